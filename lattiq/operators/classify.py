"""Classification: labels by site, co-occurrence, class patterns, features, decompositions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattiq.operators.quantiles import grouped_quantiles


def nearest_site(peaks: DataFrame, sites: list[tuple[float, float]], max_distance: float) -> DataFrame:
    """Peaks with the index of their nearest site, if nearer than max_distance; the first site wins a tie.

    The sites are a literal list (the spots of one averaged pattern).  A peak looks up
    its cell in a table of the sites near each cell, nine rows a site, and compares
    only those.
    """
    edge, cells = max_distance * (1 + 1e-9), {}
    for k, (x, y) in enumerate(sites):
        for a in (-1, 0, 1):
            for b in (-1, 0, 1):
                cells.setdefault((math.floor(x / edge) + a, math.floor(y / edge) + b), []).append((k, float(x), float(y)))
    table = peaks.sparkSession.createDataFrame([(i, j, near) for (i, j), near in cells.items()], "__i long, __j long, __near array<struct<k: long, x: double, y: double>>")
    met = peaks.join(F.broadcast(table), (F.floor(F.col("qx") / edge) == F.col("__i")) & (F.floor(F.col("qy") / edge) == F.col("__j")))
    d2 = lambda s: (F.col("qx") - s["x"]) ** 2 + (F.col("qy") - s["y"]) ** 2
    best = F.array_min(F.transform("__near", lambda s: F.struct(d2(s).alias("d2"), s["k"].alias("label"))))
    return met.withColumn("__b", best).where(F.col("__b.d2") < max_distance**2).withColumn("label", F.col("__b.label")).drop("__b", "__i", "__j", "__near")


def label_sets(labelled: DataFrame) -> DataFrame:
    return labelled.select("rx", "ry", "label").distinct()


def label_matrix(labelled: DataFrame, by_intensity: bool = False) -> DataFrame:
    """Long matrix label x position: 1, or the brightest intensity."""
    return labelled.groupBy("rx", "ry", "label").agg(F.max(F.col("intensity") if by_intensity else F.lit(1.0)).alias("x"))


def cooccurrence(labels: DataFrame, n_sites: int) -> DataFrame:
    """Number of positions at which each pair a < b of labels occurs.

    Each position's label set (at most n_sites, a literal list) makes its pairs
    inside the row, so no position's rows are joined with themselves.
    """
    sets = labels.groupBy("rx", "ry").agg(F.sort_array(F.collect_set("label")).alias("s"))
    pairs = F.flatten(F.transform("s", lambda a, i: F.transform(F.slice("s", i + 2, n_sites), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return sets.select(F.explode(pairs).alias("p")).groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("n"))


def initial_classes(labels: DataFrame, n_sites: int, threshold: float, max_classes: int = 10) -> list[set[int]]:
    """Label sets grown from the most frequent remaining pair.

    A label joins while the share of the class's positions that also have it
    exceeds the threshold.  Each step is one aggregate over positions; the driver holds sets of labels.
    """
    sets = labels.groupBy("rx", "ry").agg(F.collect_set("label").alias("s")).persist()
    pairs = [(r["n"], r["a"], r["b"]) for r in cooccurrence(labels, n_sites).collect()]
    out: list[set[int]] = []
    used: set[int] = set()
    for _, a, b in sorted(pairs, key=lambda p: (-p[0], p[1], p[2])):
        if len(out) == max_classes or a in used or b in used:
            continue
        grown = {a, b}
        while True:
            has = F.size(F.array_intersect("s", F.array(*[F.lit(x) for x in sorted(grown)]))) == len(grown)
            inside = sets.where(has)
            total = inside.count()
            rest = [x for x in range(n_sites) if x not in grown and x not in used]
            if not total or not rest:
                break
            row = inside.agg(*[F.avg(F.array_contains("s", x).cast("double")).alias(str(x)) for x in rest]).first()
            best = max(rest, key=lambda x: (row[str(x)], -x))
            if row[str(best)] <= threshold:
                break
            grown.add(best)
        out.append(grown)
        used |= grown
    sets.unpersist()
    return out


def class_pattern(p: DataFrame, weight: Column, least: float = 0.0) -> DataFrame:
    """Weighted mean pattern of positions whose weight exceeds ``least``, never under 0."""
    q = p.withColumn("__w", weight.cast("double")).where(F.col("__w") > least)
    return q.groupBy("qx", "qy").agg(F.greatest(F.sum(F.col("i") * F.col("__w")) / F.sum("__w"), F.lit(0.0)).alias("value"))


def features_in_bins(peaks: DataFrame, bins_x: int, bins_y: int, nx: int, ny: int, intensity: bool = False) -> DataFrame:
    """Count (or intensity) of peaks in a coarse grid of detector bins: rx, ry, feature, value."""
    bx = F.least(F.floor(F.col("qx") * bins_x / nx), F.lit(bins_x - 1))
    by = F.least(F.floor(F.col("qy") * bins_y / ny), F.lit(bins_y - 1))
    inside = (F.col("qx") >= 0) & (F.col("qy") >= 0) & (F.col("qx") < nx) & (F.col("qy") < ny)
    value = F.sum("intensity") if intensity else F.sum(F.lit(1.0))
    return peaks.where(inside).groupBy("rx", "ry", (bx * bins_y + by).cast("long").alias("feature")).agg(value.alias("value"))


def scale_features(f: DataFrame, how: str) -> DataFrame:
    """Min-max, robust (median and interquartile range) or shift-positive scaling of a long feature table.

    The statistics are one row for each feature.
    """
    v = F.col("value")
    if how == "minmax":
        stats = f.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
        out = F.when(F.col("hi") > F.col("lo"), (v - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    elif how == "robust":
        stats = grouped_quantiles(f, ["feature"], v, {"low": 0.25, "mid": 0.5, "high": 0.75}).select("feature", "mid", (F.col("high") - F.col("low")).alias("iqr"))
        out = (v - F.col("mid")) / F.when(F.col("iqr") != 0, F.col("iqr")).otherwise(1.0)
    elif how == "positive":
        stats = f.groupBy("feature").agg(F.min("value").alias("lo"))
        out = v - F.least(F.col("lo"), F.lit(0.0))
    else:
        raise ValueError(how)
    return f.join(stats, "feature").select("rx", "ry", "feature", out.alias("value"))


def feature_medians(f: DataFrame) -> DataFrame:
    return grouped_quantiles(f, ["feature"], F.col("value"), {"value": 0.5})


def concatenate_features(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """Two long feature tables side by side: b's features follow a's ``width``."""
    return a.select("rx", "ry", "feature", "value").unionByName(b.select("rx", "ry", (F.col("feature") + width).alias("feature"), "value"))


def delete_features(f: DataFrame, gone: list[int]) -> DataFrame:
    """Without the features named; those behind move up."""
    before = sum([F.when(F.col("feature") > k, 1).otherwise(0) for k in sorted(set(gone))], F.lit(0))
    return f.where(~F.col("feature").isin(gone) if gone else F.lit(True)).withColumn("feature", F.col("feature") - before)


# ----- candidate classes: spots(feature, class, w) and places(rx, ry, class, h), entries of 0 left out


def merge_classes(spots: DataFrame, places: DataFrame, i: int, j: int) -> tuple[DataFrame, DataFrame]:
    """Class j joins class i < j: places add up, spots are averaged by the classes' totals over the places; later classes move up."""
    total = F.sum("h").alias("__t")
    both = F.col("class").isin(i, j)
    weights = places.where(both).groupBy("class").agg(total)  # two rows
    whole = F.sum("__t").over(W.partitionBy())
    shares = weights.select("class", (F.col("__t") / whole).alias("__share"))
    to = F.when(F.col("class") == j, i).when(F.col("class") > j, F.col("class") - 1).otherwise(F.col("class")).cast("long")
    w = spots.join(F.broadcast(shares), "class", "left").select("feature", to.alias("class"), (F.col("w") * F.coalesce("__share", F.lit(1.0))).alias("w"))
    return w.groupBy("feature", "class").agg(F.sum("w").alias("w")), places.select("rx", "ry", to.alias("class"), "h").groupBy("rx", "ry", "class").agg(F.sum("h").alias("h"))


def remove_class(spots: DataFrame, places: DataFrame, i: int) -> tuple[DataFrame, DataFrame]:
    up = F.when(F.col("class") > i, F.col("class") - 1).otherwise(F.col("class")).cast("long")
    return tuple(t.where(F.col("class") != i).withColumn("class", up) for t in (spots, places))


def _correlations(table: DataFrame, keys: list[str], value: str, n: int) -> DataFrame:
    """a, b, cc: correlation over n places (or spots) of each pair of classes that meet, from moments.

    Pairs are made inside a place's row, as many as its classes allow.
    """
    moments = table.groupBy("class").agg(F.sum(value).alias("s"), F.sum(F.col(value) ** 2).alias("q"))
    sets = table.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("class", F.col(value).alias("v")))).alias("m"))
    pairs = F.flatten(F.transform("m", lambda x, k: F.transform(F.slice("m", k + 2, F.size("m")), lambda y: F.struct(x["class"].alias("a"), y["class"].alias("b"), (x["v"] * y["v"]).alias("p")))))
    met = sets.select(F.explode(pairs).alias("p")).groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.sum("p.p").alias("p"))
    a, b = (moments.select(*[F.col(c).alias(f"{c}{x}") for c in ("class", "s", "q")]) for x in "ab")
    spread = lambda x: F.sqrt(F.col(f"q{x}") - F.col(f"s{x}") ** 2 / n)
    return met.join(a, F.col("a") == F.col("classa")).join(b, F.col("b") == F.col("classb")).select("a", "b", ((F.col("p") - F.col("sa") * F.col("sb") / n) / (spread("a") * spread("b"))).alias("cc"))


def merge_candidates(spots: DataFrame, places: DataFrame, n_features: int, n_places: int, least_spots: float = 0.1, least_places: float = 0.1) -> DataFrame:
    """Pairs of classes whose spots and whose places correlate above both limits, with the product as score.

    Both limits are 0 or more, so classes that share nothing are no candidates.
    """
    w = _correlations(spots, ["feature"], "w", n_features).withColumnRenamed("cc", "cc_w")
    h = _correlations(places, ["rx", "ry"], "h", n_places).withColumnRenamed("cc", "cc_h")
    both = w.join(h, ["a", "b"]).where((F.col("cc_w") > least_spots) & (F.col("cc_h") > least_places))
    return both.withColumn("score", F.col("cc_w") * F.col("cc_h"))


def pca(vectors: DataFrame, column: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, components (k x d) and explained variances, from one aggregate of second moments.

    The sign of a component makes its largest entry positive.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import VectorUDT
    from pyspark.ml.stat import Summarizer

    v = vectors if isinstance(vectors.schema[column].dataType, VectorUDT) else vectors.withColumn(column, array_to_vector(column))
    mean = np.array(v.select(Summarizer.mean(F.col(column)).alias("m")).first()["m"])
    values, rows = np.linalg.eigh(_covariance(v, column, mean))
    order = np.argsort(values)[::-1][:k]
    rows = rows[:, order].T
    signs = np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(axis=1)])
    return mean, rows * signs[:, None], values[order]


def _covariance(v: DataFrame, column: str, mean: np.ndarray) -> np.ndarray:
    import pandas as pd

    d = len(mean)

    def run(batches):
        total, n = np.zeros((d, d)), 0
        for pdf in batches:
            x = np.array([r.toArray() if hasattr(r, "toArray") else r for r in pdf[column]]) - mean
            total += x.T @ x
            n += len(x)
        yield pd.DataFrame({"k": np.arange(d * d), "s": total.ravel(), "n": n})

    from pyspark.ml.functions import vector_to_array

    sums = v.select(vector_to_array(column).alias(column)).mapInPandas(run, "k long, s double, n long").groupBy("k").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("k").collect()
    return np.array([r["s"] for r in sums]).reshape(d, d) / max(sums[0]["n"] - 1, 1)


def gaussian_mixture(features: DataFrame, components: range, seed: int = 0):
    """The mixture with the least Bayesian information criterion; full covariances."""
    from pyspark.ml.clustering import GaussianMixture

    n = features.count()
    d = len(features.first()["features"])
    best = None
    for k in components:
        model = GaussianMixture(k=k, seed=seed, maxIter=30).fit(features)
        bic = -2 * model.summary.logLikelihood + (k - 1 + k * d + k * d * (d + 1) // 2) * np.log(n)
        if best is None or bic < best[0]:
            best = (bic, model)
    return best[1]


def nmf(vectors: DataFrame, column: str, k: int, iterations: int = 30, seed: int = 0) -> tuple[np.ndarray, list[float]]:
    """Non-negative factors H (k x d) by multiplicative updates; the error after each.

    The weights of a row depend on that row and H alone, so they are computed in
    place; an iteration is one pass that sums the k x k and k x d products.
    """
    import pandas as pd

    d = len(vectors.first()[column])
    h = np.random.default_rng(seed).random((k, d)) + 0.1
    errors: list[float] = []
    for _ in range(iterations):

        def run(batches, h=h):
            ww, wx, err = np.zeros((k, k)), np.zeros((k, d)), 0.0
            for pdf in batches:
                x = np.maximum(np.stack(pdf[column].to_numpy()).astype(float), 0)
                w = nonnegative_weights(x, h)
                ww += w.T @ w
                wx += w.T @ x
                err += float(((x - w @ h) ** 2).sum())
            yield pd.DataFrame({"k": np.arange(k * k + k * d + 1), "s": np.concatenate([ww.ravel(), wx.ravel(), [err]])})

        rows = vectors.select(column).mapInPandas(run, "k long, s double").groupBy("k").agg(F.sum("s").alias("s")).orderBy("k").collect()
        s = np.array([r["s"] for r in rows])
        ww, wx = s[: k * k].reshape(k, k), s[k * k : -1].reshape(k, d)
        errors.append(float(s[-1]))
        h = h * wx / np.maximum(ww @ h, 1e-12)
    return h, errors


def nonnegative_weights(x: np.ndarray, h: np.ndarray, steps: int = 50) -> np.ndarray:
    """Weights w >= 0 of each row of x over the rows of h, by multiplicative updates."""
    hh, xh = h @ h.T, x @ h.T
    w = np.maximum(xh / np.maximum(np.diag(hh), 1e-12), 1e-9)
    for _ in range(steps):
        w = w * xh / np.maximum(w @ hh, 1e-12)
    return w

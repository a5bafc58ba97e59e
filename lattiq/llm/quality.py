"""Quality classifier: regularised quadratic discriminant analysis.

Each whole text becomes a short vector of transformed statistics.  The class
covariances are shrunk towards their pooled covariance and a multiple of the
identity; a score is the difference of the two log densities, each from a
Mahalanobis distance through a Cholesky factor cached in the broadcast model,
put on the probability scale by a logistic curve fitted to the training rows.

The fit uses at most about ``max_train_docs`` labelled rows, chosen by a hash of
doc_id; that bound also makes the labels safe to broadcast and the vectors safe
to collect.  Scoring is one pass over all texts.

Defined results: a null text counts as empty and gets a score like any other;
several labels of a document count as the highest; labels that are null or 0/1
of one class only give the constant share of label 1 (0.5 with no labels at
all); repeated rows get equal scores.  Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_share, held_out, learnable, slices

NAMES = ("log_bytes", "upper", "digit", "space", "stops", "symbols", "bang", "pipe", "word_bytes", "distinct", "repeat", "line_words", "same_lines", "control")


def _classes() -> np.ndarray:
    """Class of each byte: 0 other letter, 1 upper case, 2 digit, 3 space, 4 stop, 5 symbol, 6 '!', 7 '|', 8 control."""
    kind = np.zeros(256, np.uint8)
    for members, k in (("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), ("0123456789", 2), (" \t\n\r\x0b\x0c", 3), (".,;:?'-\"()", 4), ("#$%&*+/<=>@[\\]^_`{}~", 5), ("!", 6), ("|", 7)):
        kind[list(members.encode())] = k
    kind[[b for b in range(32) if kind[b] == 0] + [127]] = 8
    return kind


KIND = _classes()


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a whole text, in the order of NAMES."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    count = np.bincount(KIND[np.frombuffer(raw, np.uint8)], minlength=9) if n else np.zeros(9)
    words, lines = raw.lower().split(), [x for x in raw.split(b"\n") if x]
    w = len(words)
    share = lambda k, of: float(np.log((k + 0.5) / (of - k + 0.5 + 0.01 * of)))  # noqa: E731  a smoothed log odds
    letters = int(count[0] + count[1])
    return [
        float(np.log1p(n)), share(count[1], letters), share(count[2], n), share(count[3], n), share(count[4], n), share(count[5], n), share(count[6], n), share(count[7], n),
        float(np.log1p((n - count[3]) / max(w, 1))), float(np.log((len(set(words)) + 1) / (w + 1))), share(sum(map(eq, words, words[1:])), max(w - 1, 0)),
        float(np.log1p(w / max(len(lines), 1))), share(len(lines) - len(set(lines)), len(lines)), share(count[8], n),
    ]


@dataclass
class QualityModel:
    """Per class (0, 1): mean, inverse Cholesky factor, log determinant; a constant score if ``means`` is empty."""

    constant: float = 0.5
    center: np.ndarray | None = None
    scale: np.ndarray | None = None
    means: list[np.ndarray] = field(default_factory=list)
    factors: list[np.ndarray] = field(default_factory=list)
    log_dets: list[float] = field(default_factory=list)
    slope: float = 1.0
    shift: float = 0.0

    def log_ratio(self, x: np.ndarray) -> np.ndarray:
        """log density under class 1 less that under class 0."""
        z, out = (x - self.center) / self.scale, []
        for mean, factor, log_det in zip(self.means, self.factors, self.log_dets):
            y = (z - mean) @ factor.T
            out.append(-0.5 * (np.einsum("ij,ij->i", y, y) + log_det))
        return out[1] - out[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * _squash(self.log_ratio(x)) + self.shift, -50, 50)))


def _squash(r: np.ndarray) -> np.ndarray:
    """Far tails of the density difference say little more; their order stays."""
    return np.sign(r) * np.log1p(np.abs(r))


def fit_arrays(x: np.ndarray, y: np.ndarray, shrink: float = 0.15, ridge: float = 0.05) -> QualityModel:
    x, y = np.asarray(x, float), np.asarray(y, int)
    if len(set(y.tolist())) < 2:
        return QualityModel(constant=float(y.mean()) if len(y) else 0.5)
    center, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z, d = (x - center) / scale, x.shape[1]
    model = QualityModel(float(y.mean()), center, scale)
    parts = [z[y == c] for c in (0, 1)]
    covariances = [(p - p.mean(axis=0)).T @ (p - p.mean(axis=0)) / len(p) for p in parts]
    pooled = sum(c * len(p) for c, p in zip(covariances, parts)) / len(z)
    for c, p in zip(covariances, parts):
        s = (1 - shrink) * c + shrink * pooled
        s = (1 - ridge) * s + ridge * np.trace(s) / d * np.eye(d)
        lower = np.linalg.cholesky(s)
        model.means.append(p.mean(axis=0))
        model.factors.append(np.linalg.inv(lower))
        model.log_dets.append(2 * float(np.log(np.diag(lower)).sum()))
    r = np.column_stack([_squash(model.log_ratio(x)), np.ones(len(x))])
    beta = np.array([1.0, np.log(y.mean() / (1 - y.mean()))])
    for _ in range(30):  # Newton steps of a logistic fit with a small penalty
        p = 1 / (1 + np.exp(-np.clip(r @ beta, -30, 30)))
        step = np.linalg.solve((r * (p * (1 - p))[:, None]).T @ r + 1e-3 * np.eye(2), r.T @ (y - p) - 1e-3 * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    model.slope, model.shift = max(float(beta[0]), 1e-3), float(beta[1])
    return model


def with_statistics(df: DataFrame, names: list[str]) -> DataFrame:
    """Replace the text by ``x``, its statistics."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)

    def run(batches):
        for batch in slices(batches, 2048):
            x = pa.array([statistics(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), x], names=[*names, "x"])

    return df.select(*names, "text").mapInArrow(run, f"{kinds}, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, max_train_docs: int = 20000, **options) -> QualityModel:
    known = labels.where(F.col("quality").isNotNull() & learnable()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    share = max_train_docs / max(known.count(), 1)
    sample = known.where(hash_share(F.col("doc_id"), share))  # about max_train_docs rows at most, hence the broadcast
    rows = with_statistics(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), ["quality"])
    pairs = rows.collect()
    return fit_arrays(np.array([r["x"] for r in pairs]).reshape(len(pairs), len(NAMES)), np.array([int(r["quality"] > 0) for r in pairs]), **options)


def score(df: DataFrame, model: QualityModel, names: list[str]) -> DataFrame:
    """The named columns and ``score``: the probability of label 1."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)

    def run(batches):
        for batch in slices(batches, 2048):
            x = np.array([statistics(t) for t in batch.column("text").to_pylist()]).reshape(batch.num_rows, len(NAMES))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(shared.value.score(x), pa.float64())], names=[*names, "score"])

    return df.select(*names, "text").mapInArrow(run, f"{kinds}, score double")


def quality_of_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, held_out, score, predicted."""
    model = fit(docs, labels)
    out = score(docs.select("doc_id", held_out().alias("held_out"), "text"), model, ["doc_id", "held_out"])
    return out.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))

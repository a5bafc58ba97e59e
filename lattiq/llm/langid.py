"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of a bounded, repeatable sample (``max_train_docs`` per
language, chosen by a hash of doc_id) in a distributed aggregate; the driver
receives at most languages x 2**bits cells.  Scoring broadcasts the matrix of
log probabilities and sums the rows that a document's n-grams select.

Defined results: a text that is null or has no letter gives ``und`` with score
0; with nothing to learn from, every row is ``und``.  Texts are lower-cased,
everything but letters is a word boundary, and the whole text counts; a text
longer than CHUNK is worked on in stretches that overlap by an n-gram less one,
so each n-gram counts once wherever it stands.  Ties between languages go to the first in code-point order.  Repeated rows get equal
results; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, hash_share, held_out, learnable, slices

GRAMS = (1, 2, 3)
UNDETERMINED = "und"
CHUNK = 1 << 15  # characters worked on at a time


@dataclass
class LanguageModel:
    langs: list[str]
    bits: int
    log_prior: np.ndarray  # (languages,)
    log_prob: np.ndarray  # (2**bits + 1, languages); the last row is zero, for positions that hold no n-gram


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _parts(texts: list[str | None], chars: int):
    """Lists of (index, text) of about ``chars`` characters; a text of more is alone in its list."""
    part, size = [], 0
    for i, t in enumerate(texts):
        t = t or ""
        if part and size + len(t) > chars:
            yield part
            part, size = [], 0
        part.append((i, t))
        size += len(t) + 2
    if part:
        yield part


def letters_of(texts: list[str]):
    """Lower-cased letters of the texts, end to end, with one space for each run of others and at both ends of each text.

    Also returns where each text starts and whether it has a letter.
    """
    padded = [" " + t.lower() + " " for t in texts]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(p) for p in padded])[:-1]]).astype(np.int64)
    letter = _letters()[np.minimum(codes, 0x10FFFF)]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[starts] = True
    has = np.logical_or.reduceat(letter, starts)
    sizes = np.add.reduceat(keep, starts, dtype=np.int64)
    return np.where(letter[keep], codes[keep], 32).astype(np.uint64), np.cumsum(sizes) - sizes, has


def gram_buckets(codes: np.ndarray, starts: np.ndarray, bits: int, low: int = 0, high: int | None = None):
    """Hash buckets of all n-grams that start at low to high, a row for each length n.

    Positions where no n-gram of that length fits into the text hold the bucket 2**bits.
    """
    high = len(codes) if high is None else min(high, len(codes))
    ends = np.append(starts[1:], len(codes))
    place = np.arange(low, high)
    left = ends[np.searchsorted(starts, place, side="right") - 1] - place  # characters up to the text's end
    rows, h = [], np.zeros(high - low, np.uint64)
    for n in range(1, max(GRAMS) + 1):
        nxt = np.zeros(high - low, np.uint64)
        found = codes[low + n - 1 : high + n - 1]
        nxt[: len(found)] = found
        h = h * np.uint64(0x100000001B3) + nxt + np.uint64(n)
        if n in GRAMS:
            bucket = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
            rows.append(np.where(left >= n, bucket, 1 << bits))
    return rows


def stretches(texts: list[str | None], bits: int, chars: int = 0):
    """For stretches of the texts: which texts they hold, which of those have a letter, where each starts in the stretch, and its buckets."""
    chars = chars or CHUNK
    for part in _parts(texts, chars):
        of = np.array([i for i, _ in part])
        codes, starts, has = letters_of([t for _, t in part])
        step = chars if len(part) == 1 else len(codes)
        for low in range(0, len(codes), step):
            rows = gram_buckets(codes, starts, bits, low, low + step)
            yield of, has, starts if low == 0 else np.zeros(1, np.int64), rows


def _count_cells(batches, langs: list[str], bits: int):
    index, width = {x: i for i, x in enumerate(langs)}, (1 << bits) + 1
    total = np.zeros(len(langs) * width, np.int64)
    for batch in slices(batches, 2048):
        lang = batch.column("lang").to_pylist()
        for texts, _, starts, rows in stretches(batch.column("text").to_pylist(), bits):
            of = np.repeat([index[lang[i]] for i in texts.tolist()], np.diff(np.append(starts, len(rows[0]))))
            for r in rows:
                total += np.bincount(of * width + r, minlength=len(total))
    cells = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(total[cells], pa.int64())], names=["cell", "n"])


def fit(docs: DataFrame, bits: int = 16, max_train_docs: int = 5000, smoothing: float = 0.2) -> LanguageModel:
    """Learn from ``text`` and non-null ``lang`` of rows that are not held out.

    ``max_train_docs`` bounds the expected number of documents sampled for each
    language; class frequencies are those of all learnable rows.
    """
    labelled = docs.where(learnable() & F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    width = (1 << bits) + 1
    cells = np.zeros((len(langs), width))
    if langs:
        chosen = F.lit(False)
        for x in langs:
            chosen = chosen | ((F.col("lang") == x) & hash_share(F.col("doc_id"), max_train_docs / counts[x]))
        parts = labelled.where(chosen & F.col("text").isNotNull()).select("text", "lang").mapInArrow(lambda it: _count_cells(it, langs, bits), "cell long, n long")
        for r in parts.groupBy("cell").agg(F.sum("n").alias("n")).toLocalIterator():
            cells[divmod(r["cell"], width)] = r["n"]
    cells = cells[:, :-1] + smoothing
    log_prob = np.zeros((width, len(langs)))
    if langs:
        log_prob[:-1] = np.log(cells / cells.sum(axis=1, keepdims=True)).T
    prior = np.array([counts[x] for x in langs], float)
    return LanguageModel(langs, bits, np.log(prior / max(prior.sum(), 1)), log_prob)


def score_texts(texts: list[str | None], model: LanguageModel) -> tuple[list[str], np.ndarray]:
    """Language and posterior probability of each text."""
    n, k = len(texts), len(model.langs)
    like, letters = np.zeros((n, k)) + model.log_prior, np.zeros(n, bool)
    if k:
        for of, has, starts, rows in stretches(texts, model.bits):
            letters[of] = has
            for r in rows:
                like[of] += np.add.reduceat(model.log_prob[r], starts, axis=0)
    best = like.argmax(axis=1) if k else np.zeros(n, int)
    if k:
        post = np.exp(like - like.max(axis=1, keepdims=True))
        score = np.where(letters, post.max(axis=1) / post.sum(axis=1), 0.0)
    else:
        score = np.zeros(n)
    return [model.langs[b] if ok and k else UNDETERMINED for b, ok in zip(best, letters)], score


def predict(df: DataFrame, model: LanguageModel, text: str = "text", lang_out: str = "lang_pred", score_out: str = "score", drop_text: bool = False) -> DataFrame:
    """Append the predicted language and its score to ``df``; the model is broadcast."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kept = [f for f in df.schema.fields if not (drop_text and f.name == text) and f.name not in (lang_out, score_out)]
    schema = T.StructType([*kept, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])
    names = [f.name for f in kept]

    def run(batches):
        for batch in slices(batches, 2048):
            lang, score = score_texts(batch.column(text).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*names, lang_out, score_out])

    return df.mapInArrow(run, schema)


def language_of_documents(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document, learned from the documents themselves."""
    model = fit(docs.select("doc_id", "text", "lang"), **options)
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model, drop_text=True)


def keep_identified(docs: DataFrame, min_score: float = 0.3, **options) -> DataFrame:
    """The documents, with their own columns, whose language could be told.

    Rejected: texts without a letter, and texts whose best language has a
    posterior under ``min_score``.
    """
    model = fit(docs.select("doc_id", "text", "lang"), **options)
    lang, score = fresh(docs, "lang_pred", "score")
    out = predict(docs, model, lang_out=lang, score_out=score)
    return out.where((F.col(lang) != UNDETERMINED) & (F.col(score) >= min_score)).select(*(F.col(f"`{c}`") for c in docs.columns))

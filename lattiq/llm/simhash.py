"""SimHash near-duplicates with pigeonring filtering.

A fingerprint's 64 bits form a ring of 8 segments.  If two fingerprints differ in
at most 4 bits, some start on the ring has all its chains of consecutive segments
within the proportional budget: a chain of length l differs in at most
l * 4 / 8 bits.  So the first segment agrees, at most one of the next two
differs, at most two of the next four, and so on.  Each admissible set of
agreeing segments of a chain is a join key; the chain is taken as long as the
number of distinct fingerprints asks for, which gives keys of 8, 16, 24 or 32
bits.  Pairs that meet in a key are pruned by the chain budgets from that key's
start before the full Hamming test.

A similarity asked for in terms of shingles (``keep_representatives``) lies beyond
what chain keys of a fingerprint can seek: at 0.8 about 15 of 100 bits differ, and
some hundred keys a document would be needed.  There candidates agree in a band of
BAND minima of the set of shingles under as many hash functions, which two sets do
with a probability that follows from their similarity alone, whatever the number of
rows; a pair at the similarity meets with probability 1 - MISS.  Of a set of few
shingles the smallest shingles are keys as well: of two sets at the similarity, one
of the first s - ceil(similarity * s) + 1 of each is shared, so no such pair is
missed.  Pairs that meet are pruned by SimHash fingerprints of PRUNE_WORDS words,
ring and chain budgets first, and similarity is then computed exactly, on the sets,
within the components of what is left.

Equal fingerprints are one node, named by the smallest doc_id.  A task reports a
spanning forest of the links it finds, never all pairs; keys with very many
fingerprints are dealt over cells of block pairs.

Defined results: a text that is null or has no word has fingerprint zero and
links like any other; a row with a null doc_id gets its fingerprint, no links
and a null component; rows with one doc_id count as one document, so that all
fingerprints of it are in one component; an empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, bounded, fresh, slices, split_hot
from .components import components, local_roots

SEGMENTS, WIDTH, BUDGET = 8, 8, 4
WORDS = 4
SEED = 42
CELL = 8192
#: Texts of a candidate component that are compared in one piece.
SETS_CELL = 2048
#: Minima in a band; the share of pairs at the similarity that meet in no band; shingles of a text whose pairs are all found.
BAND, MISS, FEW = 5, 1e-5, 32
#: Words of the fingerprints that prune candidates, and how many deviations beyond the mean of pairs at the similarity their budget is.
PRUNE_WORDS, SLACK = 4, 6.0


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """XXH64 of each word shingle, repeats included; a shorter text is one shingle."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII case and white space only
    if not found:
        return np.zeros(0, np.uint64)
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = [0, *ends[:-1].tolist()]
    ends = (ends - 1).tolist()
    digest, k = xxhash.xxh64_intdigest, min(words, len(found))
    return np.array([digest(line[s:e], SEED) for s, e in zip(starts, ends[k - 1 :])], np.uint64)


def fingerprint(hashes: np.ndarray, size: int = 1) -> np.ndarray:
    """``size`` words of 64 bits; a bit is set if it is set in over half the hashes, which each word mixes anew."""
    out = np.zeros(size, np.uint64)
    for k in range(size):
        counts = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 1 << 16):
            part = hashes[at : at + (1 << 16)]
            if k:
                part = (part ^ (part >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * k * 0x9E3779B9)
                part = part ^ (part >> np.uint64(32))
            counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0]
    return out


def fingerprints(df: DataFrame, keep: list[str], words: int = WORDS, size: int = 1) -> DataFrame:
    """The named columns and fp, the fingerprint as an array of signed longs."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        for batch in slices(batches, 2048):
            fp = np.array([fingerprint(shingle_hashes(t, words), size) for t in batch.column("text").to_pylist()], np.uint64).reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * size, pa.int32()), pa.array(fp.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists], names=[*keep, "fp"])

    return df.select(*keep, "text").mapInArrow(run, f"{kinds}, fp array<long>")


def band_count(similarity: float, miss: float = MISS) -> int:
    """Bands of BAND minima of which two sets of the similarity share none with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log(1 - similarity**BAND))


def candidate_keys(shingles: np.ndarray, similarity: float, factors: np.ndarray) -> np.ndarray:
    """Keys, as signed longs, of which two sets (sorted) of the similarity share one; ``factors`` are odd, a row a band."""
    s, out = len(shingles), []
    if 0 < s <= FEW / similarity:
        out.append(shingles[: s - math.ceil(similarity * s - 1e-9) + 1])
    if s > FEW:
        least = np.full(factors.size, np.iinfo(np.uint64).max)
        for at in range(0, s, 512):
            least = np.minimum(least, (shingles[at : at + 512, None] * factors.reshape(1, -1)).min(axis=0))
        data, width = least.astype("<u8").tobytes(), 8 * factors.shape[1]
        out.append(np.array([xxhash.xxh64_intdigest(data[k * width : (k + 1) * width], k + 1) for k in range(len(factors))], np.uint64))
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def agreeing_sets(depth: int) -> list[tuple[int, ...]]:
    """Minimal sets of segments, counted from a chain's start, that agree in any admissible chain of odd length ``depth``."""
    out = []
    for differ in combinations(range(1, depth), (depth - 1) // 2):
        if all(sum(s < length for s in differ) <= length * BUDGET // SEGMENTS for length in range(1, depth + 1)):
            out.append(tuple(s for s in range(depth) if s not in differ))
    return out


def chain_depth(n: int) -> int:
    """The shortest chain whose key keeps the mean number of unrelated fingerprints per key under 8."""
    return next((d for d in (1, 3, 5) if n <= 8 << (8 * ((d + 1) // 2))), 7)


def _keys(depth: int):
    """An array column of (key, start): the key numbers the start and the agreeing set and holds the segments' bits."""
    out = []
    for start in range(SEGMENTS):
        for k, agree in enumerate(agreeing_sets(depth)):
            key = F.lit(start * 16 + k).cast("long")
            for s in agree:
                segment = F.shiftrightunsigned(F.element_at("fp", 1), WIDTH * ((start + s) % SEGMENTS)).bitwiseAND(F.lit((1 << WIDTH) - 1))
                key = F.shiftleft(key, WIDTH).bitwiseOR(segment)
            out.append(F.struct(key.alias("key"), F.lit(start).alias("start")))
    return F.array(*out)


def _linked(x: np.ndarray, start: np.ndarray, budget: int) -> np.ndarray:
    """Which xors of fingerprint pairs (a row of words each) pass the full Hamming test.

    First they have to pass the chain budgets: fingerprints of one word from their
    key's start, longer ones, whose segments are their words, from some start.
    """
    if x.shape[1] == 1:
        differ = np.bitwise_count(x[:, 0].astype("<u8").view(np.uint8).reshape(-1, SEGMENTS)).astype(np.int64)
        starts = [start]
    else:
        differ = np.bitwise_count(x).astype(np.int64)
        starts = [np.full(len(x), k) for k in range(x.shape[1])]
    segments = differ.shape[1]
    some, rows = np.zeros(len(x), bool), np.arange(len(x))
    for first in starts:
        left, total = rows, np.zeros(len(rows), np.int64)
        for length in range(1, segments + 1):
            total = total + differ[left, (first[left] + length - 1) % segments]
            ok = total * segments <= length * budget
            left, total = left[ok], total[ok]
        some[left] = True  # the chain of all segments is the full test
        rows = rows[~some[rows]]
    return some


def forest(group: np.ndarray, fp: np.ndarray, node: np.ndarray, start: np.ndarray, own: np.ndarray, cross: np.ndarray, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest, as pairs of nodes, of the links between rows of equal (sorted) group.

    A start below 0 marks a row that links with all of its group.  In groups with
    ``cross`` only rows of different ``own`` are compared.  Groups that have come
    to be one component are left early.
    """
    names, index = np.unique(node, return_inverse=True)
    first, last = np.searchsorted(group, group, side="left"), np.searchsorted(group, group, side="right")
    heads = np.flatnonzero(first == np.arange(len(group)))
    root, found, size, shift = np.arange(len(names)), [], 0, 1
    rows = np.arange(len(group))
    while True:
        rows = rows[rows + shift < last[rows]]
        if not len(rows):
            break
        a = rows[(~cross[rows] | (own[rows] != own[rows + shift])) & (root[index[rows]] != root[index[rows + shift]])]
        ok = (start[a] < 0) | (start[a + shift] < 0)
        test = np.flatnonzero(~ok)
        ok[test] = _linked(fp[a[test]] ^ fp[a[test] + shift], start[a[test]], budget)
        a = a[ok]
        if len(a):
            found.append((index[a], index[a + shift]))
            size += len(a)
        if size > 1 << 18 or (found and shift % 64 == 0):
            root = local_roots(len(names), *(np.concatenate([np.arange(len(names)), *(f[i] for f in found)]) if i == 0 else np.concatenate([root, *(f[i] for f in found)]) for i in (0, 1)))
            found, size = [], 0
            own_root = root[index]
            low, high = np.minimum.reduceat(own_root, heads), np.maximum.reduceat(own_root, heads)
            done = np.repeat(low == high, np.diff(np.append(heads, len(group))))
            rows = rows[~done[rows]]
        shift += 1
    if found:
        root = local_roots(len(names), *(np.concatenate([np.arange(len(names)), *(f[i] for f in found)]) if i == 0 else np.concatenate([root, *(f[i] for f in found)]) for i in (0, 1)))
    child = np.flatnonzero(root != np.arange(len(names)))
    return names[child], names[root[child]]


def links(nodes: DataFrame, cell: int = CELL, depth: int | None = None) -> DataFrame:
    """Edges (a, b) between nodes (node long, fp array<long>) that span the components of all links."""
    keys = _keys(depth or chain_depth(nodes.count()))
    rows = nodes.select("node", "fp", F.explode(keys).alias("k"))
    return met(rows.select(F.col("k.key").alias("key"), F.col("k.start").alias("start"), "node", "fp"), BUDGET, cell)


def met(rows: DataFrame, budget: int, cell: int = CELL) -> DataFrame:
    """Edges (a, b) that span the links of rows (key long, start int, node long, fp array<long>) with one key."""
    rows = split_hot(rows, "key", "node", cell)

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush(table: pa.Table):
            col = {c: table.column(c).to_numpy() for c in table.column_names if c != "fp"}
            fp = table.column("fp").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(table.num_rows, -1)
            group = np.cumsum(np.concatenate([[0], np.any([col[c][1:] != col[c][:-1] for c in ("key", "cell_i", "cell_j")], axis=0)])) if table.num_rows else np.zeros(0, int)
            a, b = forest(group, fp, col["node"], col["start"].astype(np.int64), col["own"], col["cell_i"] != col["cell_j"], budget)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:  # sorted by key and cell; the last group of a batch may go on in the next
            table = pa.Table.from_batches([*held, batch])
            last = [table.column(c)[-1].as_py() for c in ("key", "cell_i", "cell_j")] if table.num_rows else None
            if last is None:
                continue
            same = np.all([table.column(c).to_numpy() == v for c, v in zip(("key", "cell_i", "cell_j"), last)], axis=0)
            cut = int(np.argmax(same))
            if cut:
                yield flush(table.slice(0, cut))
            held = table.slice(cut).to_batches()
        if held:
            yield flush(pa.Table.from_batches(held))

    dealt = rows.repartition("key", "cell_i", "cell_j").sortWithinPartitions("key", "cell_i", "cell_j")
    return dealt.mapInArrow(run, "a long, b long")


def group_by_fingerprint(prints: DataFrame, **how) -> DataFrame:
    """doc_id, fp, component_id for rows (doc_id, fp); ``how`` goes to ``links``."""
    space = Workspace(prints.sparkSession, "simhash")
    prints = space.write(prints, "fingerprints")
    nodes = space.write(prints.where(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").cast("long").alias("node")), "nodes")
    # one document under several fingerprints (repeated ids) joins them
    several = prints.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low != high")
    several = prints.join(several.select(F.col("doc_id").alias("id")), F.col("doc_id") == F.col("id")).select("id", F.col("fp").alias("of"))
    joins = several.join(nodes, F.col("fp") == F.col("of")).select(F.col("id").cast("long").alias("a"), F.col("node").alias("b"))
    found = components(links(nodes, **how).union(joins), space)
    named = nodes.join(found, "node", "left").select(F.col("fp").alias("of"), F.coalesce("component", "node").alias("component_id"))
    out = prints.join(named, (F.col("fp") == F.col("of")) & F.col("doc_id").isNotNull(), "left")
    return out.select("doc_id", "fp", "component_id")


def components_of_documents(docs: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, fingerprint, component_id."""
    out = group_by_fingerprint(fingerprints(docs.select("doc_id", "text"), ["doc_id"]))
    return out.select("doc_id", F.lower(F.lpad(F.hex(F.element_at("fp", 1)), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct shingles of a text, sorted."""
    return np.unique(shingle_hashes(text, words))


def signature(shingles: np.ndarray) -> list[int]:
    """128 bits of a set of shingles, as two signed longs."""
    data = shingles.astype("<u8").tobytes()
    return [int(np.uint64(xxhash.xxh64_intdigest(data, seed)).astype(np.int64)) for seed in (SEED, SEED + 1)]


def prune_budget(similarity: float) -> int:
    """Bits of PRUNE_WORDS words in which pairs of sets at the similarity differ, but for a share of well under MISS of them."""
    bits = 64 * PRUNE_WORDS
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(bits * p + SLACK * math.sqrt(bits * p * (1 - p)))


def sketches(df: DataFrame, words: int, similarity: float) -> DataFrame:
    """doc_id, sign (the signature of its set of shingles), keys (its candidate keys), fp (its fingerprint) and start (-1: a set of few) of each row."""
    factors = np.random.default_rng(SEED).integers(0, 1 << 63, (band_count(similarity), BAND), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches):
        for batch in slices(batches, 2048):
            sets = [shingle_set(t, words) for t in batch.column("text").to_pylist()]
            longs = pa.list_(pa.int64())
            cols = [pa.array([signature(x) for x in sets], longs), pa.array([candidate_keys(x, similarity, factors) for x in sets], longs), pa.array([fingerprint(x, PRUNE_WORDS).view(np.int64) for x in sets], longs), pa.array([-1 if len(x) <= FEW / similarity else 0 for x in sets], pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=["doc_id", "sign", "keys", "fp", "start"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, sign array<long>, keys array<long>, fp array<long>, start int")


def similar_forest(sets: list[np.ndarray], node: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest, as pairs of nodes, of the sets whose Jaccard similarity reaches the given one; sets of one node are linked.

    Each set is compared, over an inverted index, with all that are not yet reached.
    """
    names, index = np.unique(node, return_inverse=True)
    sizes, n = np.array([len(x) for x in sets]), len(sets)
    tokens, token = np.unique(np.concatenate(sets), return_inverse=True)
    owner, first = np.repeat(np.arange(n), sizes), np.concatenate([[0], np.cumsum(sizes)])
    order = np.argsort(token, kind="stable")
    holders, held = owner[order], np.concatenate([[0], np.cumsum(np.bincount(token, minlength=len(tokens)))])
    left, a, b = np.ones(n, bool), [], []
    for seed in range(n):
        if not left[seed]:
            continue
        left[seed], todo = False, [seed]
        while todo and left.any():
            u = todo.pop()
            mine = token[first[u] : first[u + 1]]
            start, many = held[mine], held[mine + 1] - held[mine]
            at = np.arange(many.sum()) + np.repeat(start - np.concatenate([[0], np.cumsum(many)[:-1]]), many) if len(mine) else np.zeros(0, int)
            shared = np.bincount(holders[at], minlength=n)
            near = np.flatnonzero(left & (shared > 0) & (shared / np.maximum(sizes[u] + sizes - shared, 1) >= similarity))
            left[near] = False
            a += [u] * len(near)
            b += near.tolist()
            todo += near.tolist()
    root = local_roots(len(names), index[np.array(a, int)], index[np.array(b, int)])
    child = np.flatnonzero(root != np.arange(len(names)))
    return names[child], names[root[child]]


def similar_links(docs: DataFrame, found: DataFrame, words: int, similarity: float, space: Workspace, cell: int = SETS_CELL) -> DataFrame:
    """Edges (a, b) that span the components of the exact links within each candidate component of ``found`` (node, component).

    The texts of a node are those of its doc_id.  All pairs of a candidate
    component are compared, whether they met as candidates or not.
    """

    def read(batches):
        for batch in slices(batches, 2048):
            sets = pa.array([shingle_set(t, words).view(np.int64) for t in batch.column("text").to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("component"), batch.column("node"), sets], names=["component", "node", "shingles"])

    texts = docs.select("doc_id", "text").join(bounded(found), F.col("doc_id") == F.col("node")).select("component", "node", "text")
    sets = space.write(texts.mapInArrow(read, "component long, node long, shingles array<long>"), "sets")
    by = ["component", "cell_i", "cell_j"]

    def run(batches):
        now, sets, nodes = None, [], []
        for batch in batches:  # sorted; a group may go on in the next batch
            col = [batch.column(c).to_numpy() for c in by]
            lists, node = batch.column("shingles"), batch.column("node").to_numpy()
            flat, at = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
            for k, key in enumerate(zip(*col)):
                if key != now:
                    if len(sets) > 1:
                        yield similar_forest(sets, np.array(nodes), similarity)
                    now, sets, nodes = key, [], []
                sets.append(flat[at[k] : at[k + 1]].copy())
                nodes.append(node[k])
        if len(sets) > 1:
            yield similar_forest(sets, np.array(nodes), similarity)

    def edges(batches):
        for a, b in run(batches):
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = split_hot(sets, "component", "node", cell).select(*by, "node", "shingles")
    return dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(edges, "a long, b long")


def keep_representatives(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents, with their own columns, that are the smallest doc_id of their group.

    Texts link whose sets of shingles of ``words`` words have at least the
    Jaccard similarity, which is computed exactly; no others do, however the
    rows are counted.  Texts without a word have equal, empty sets.  Of the pairs
    at the similarity itself candidates miss a share of about MISS, of those above
    it less, and none that has a text of FEW shingles or fewer.  Rows with a null
    doc_id stay; of rows with one doc_id one stays, the least by digests of its
    text and then of all its columns.
    """
    space = Workspace(docs.sparkSession, "simhash-kept")
    named = docs.where(F.col("doc_id").isNotNull())
    prints = space.write(sketches(named, words, similarity), "sketches")
    same = prints.groupBy("sign").agg(F.min("doc_id").cast("long").alias("node"), F.max("doc_id").cast("long").alias("top"), F.any_value("keys").alias("keys"), F.any_value("fp").alias("fp"), F.any_value("start").alias("start"))
    nodes = space.write(same, "nodes")
    keyed = nodes.select(F.explode("keys").alias("key"), "start", "node", "fp")
    near = space.write(components(met(keyed, prune_budget(similarity)), space, "candidate"), "candidates")
    exact = similar_links(named, near, words, similarity, space)
    repeated = space.write(prints.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("id")), "repeated")
    twice = not repeated.isEmpty()
    if twice:  # a document under several sets (repeated ids) joins them
        many = prints.join(repeated, F.col("doc_id") == F.col("id"), "left_semi").join(nodes.select(F.col("sign").alias("of"), "node"), F.col("sign") == F.col("of"))
        exact = exact.union(many.where("doc_id != node").select(F.col("doc_id").cast("long").alias("a"), F.col("node").alias("b")))
    merged = components(exact, space)
    # who goes: nodes that have a smaller one in their component, and all but the smallest of equal sets
    copies = prints.select("doc_id", "sign").join(nodes.where("node < top").select(F.col("sign").alias("of"), "node"), F.col("sign") == F.col("of"))
    out = merged.where("component < node").select(F.col("node").alias("out"))
    gone = space.write(out.union(copies.where("doc_id > node").select(F.col("doc_id").cast("long"))).distinct(), "gone")
    for name in ("sketches", "candidates", "sets"):
        space.drop(name)
    name, one = fresh(docs, "out", "one")
    left = docs.join(bounded(gone.toDF(name)), F.col("doc_id") == F.col(name), "left_anti")
    if not twice:
        return left
    again = bounded(repeated.toDF(name))
    rest = left.join(again, F.col("doc_id") == F.col(name), "left_anti")
    alike = left.join(again, F.col("doc_id") == F.col(name), "left_semi")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    order = F.struct(F.md5(F.coalesce("text", F.lit("")).cast("binary")), F.xxhash64(*columns))
    chosen = alike.groupBy("doc_id").agg(F.min_by(F.struct(*columns), order).alias(one))
    return rest.unionByName(chosen.select(*[F.col(one).getField(c).alias(c) for c in docs.columns]))

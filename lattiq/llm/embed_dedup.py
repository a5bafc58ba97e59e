"""Embedding near-duplicates: randomised-rotation binary codes with correction factors.

A unit vector o, randomly rotated, is stored as the signs of its coordinates and
the factor f = <o', o>, o' being the unit vector along the signs.  For another
vector q, <o', q> / f is an unbiased estimate of <o, q>, with an error that
exceeds sqrt((1 - f^2) / f^2 / (d - 1)) * EPSILON very rarely.  <o', q> is
computed from bit counts, q being quantised to QUERY_BITS bits.  A pair whose
estimate plus bound is under the threshold is dropped; all others are recomputed
exactly, in double precision, so no link is below the threshold.

Candidates: a vector goes to one bucket in each of several tables, keyed by its
label and ``bits`` signs of further rotations; bits and tables follow from the
number of vectors so that a pair at the threshold meets with probability
1 - MISS, and buckets stay small.  A pair counts in the first table where it meets.

Equal vectors of a label are one node with a multiplicity.  A task reports link
counts and a spanning forest, not pairs.  Buckets with very many vectors are
dealt over cells of block pairs, in which blocks are compared chunk by chunk.

Defined results: a vector that is null, empty, zero, or holds null or non-finite
components, or has a null label, links with nothing; so do rows with a null
vec_id, whose component is null and kept false; vectors of different length
never link; an empty table gives an empty result.  Rows with one vec_id count
as several vectors and share a component.  Other columns are not read.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, slices, split_hot
from .components import components, local_roots

EPSILON = 5.0
QUERY_BITS = 6
MISS = 5e-4
CELL = 4096


@lru_cache(maxsize=64)
def rotation(dim: int, k: int) -> np.ndarray:
    """The k-th random rotation of dim coordinates; the same in every process."""
    q, r = np.linalg.qr(np.random.default_rng([20240, dim, k]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def plan(n: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables) for n vectors."""
    bits = min(24, max(6, math.ceil(math.log2(max(n, 2))) - 2))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - agree))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def table_keys(u: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Sign keys of unit vectors: a column for each table."""
    dim = u.shape[1]
    signs = np.concatenate([u @ rotation(dim, 1 + k).T > 0 for k in range(-(-bits * tables // dim))], axis=1)
    weights = 1 << np.arange(bits)
    return (signs[:, : bits * tables].reshape(len(u), tables, bits) * weights).sum(axis=2).astype(np.int32)


def binary_codes(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs under rotation 0 (64-bit words) and the correction factors."""
    y = u @ rotation(u.shape[1], 0).T
    packed = np.packbits(y > 0, axis=1, bitorder="little")
    packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))
    return packed.view("<u8"), np.abs(y).sum(axis=1) / math.sqrt(u.shape[1])


def quantised(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors under rotation 0 in QUERY_BITS bits: least value, step, bit planes (vector, bit, word) and sum of levels."""
    y = q @ rotation(q.shape[1], 0).T
    low = y.min(axis=1)
    step = np.maximum((y.max(axis=1) - low) / (2**QUERY_BITS - 1), 1e-12)
    level = np.rint((y - low[:, None]) / step[:, None]).astype(np.uint8)
    planes = np.packbits((level[:, None, :] >> np.arange(QUERY_BITS, dtype=np.uint8)[:, None]) & 1, axis=2, bitorder="little")
    planes = np.ascontiguousarray(np.pad(planes, ((0, 0), (0, 0), (0, -planes.shape[2] % 8)))).view("<u8")
    return low, step, planes, level.sum(axis=1, dtype=np.int64)


def pair_estimates(quantities, codes: np.ndarray, factors: np.ndarray, dim: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of the quantised vectors a and the coded vectors b (rows, pair by pair), and their bounds."""
    low, step, planes, total = quantities
    code, dot, ones = codes[b], np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    for w in range(codes.shape[1]):
        ones += np.bitwise_count(code[:, w])
        for bit in range(QUERY_BITS):
            dot += np.bitwise_count(planes[a, bit, w] & code[:, w]).astype(np.int64) << bit
    # sum over signs of +-(low + step * level)
    signed = 2 * (low[a] * ones + step[a] * dot) - (dim * low[a] + step[a] * total[a])
    f = factors[b]
    spread = np.sqrt(np.maximum(1 - f**2, 0)) / f * EPSILON / math.sqrt(max(dim - 1, 1))
    return signed / math.sqrt(dim) / f, spread + step[a] / 2 * math.sqrt(dim) / f


def linked_pairs(x: np.ndarray, codes: np.ndarray, factors: np.ndarray, keys: np.ndarray, table: np.ndarray, group: np.ndarray, own: np.ndarray, cross: np.ndarray, threshold: float, chunk: int = 1 << 16):
    """Pairs of rows of equal (sorted) group that link and do not meet in an earlier table, in chunks.

    Rows are compared with those one place on, then two, and so on: all groups
    advance together, however many and small they are.
    """
    u, dim = unit(x), x.shape[1]
    quantities = quantised(u)
    last = np.searchsorted(group, group, side="right")
    rows, shift = np.arange(len(group)), 1
    while True:
        rows = rows[rows + shift < last[rows]]
        if not len(rows):
            return
        for low in range(0, len(rows), chunk):
            a = rows[low : low + chunk]
            b = a + shift
            keep = ~cross[a] | (own[a] != own[b])
            a, b = a[keep], b[keep]
            est, bound = pair_estimates(quantities, codes, factors, dim, a, b)
            keep = est + bound >= threshold
            a, b = a[keep], b[keep]
            keep = np.einsum("ij,ij->i", u[a], u[b]) >= threshold
            a, b = a[keep], b[keep]
            earlier = (keys[a] == keys[b]) & (np.arange(keys.shape[1]) < table[a][:, None])
            keep = ~earlier.any(axis=1)
            yield a[keep], b[keep]
        shift += 1


def link_vectors(vectors: DataFrame, threshold: float = 0.98, cell: int = CELL) -> DataFrame:
    """vec_id, n_links, component_id for rows (vec_id long, embedding array, label)."""
    spark = vectors.sparkSession
    space = Workspace(spark, "embeddings")
    dim = F.size("embedding")
    sound = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & (dim > 0)
    sound = sound & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    kind = vectors.schema["embedding"].dataType.simpleString()
    used = vectors.where(F.coalesce(sound, F.lit(False))).select("vec_id", "label", "embedding")
    nodes = space.write(used.groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")), "nodes")
    bits, tables = plan(nodes.count(), threshold)
    def code(batches):
        for batch in slices(batches, 2048):
            lists = batch.column("embedding")
            sizes = np.diff(lists.offsets.to_numpy())
            for d in np.unique(sizes):  # vectors of one length at a time
                part = batch.filter(pa.array(sizes == d))
                x = part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
                keys = table_keys(unit(x), bits, tables)
                packed, factors = binary_codes(unit(x))
                yield pa.RecordBatch.from_arrays([part.column("label").cast(pa.string()), pa.array(np.full(len(x), d), pa.int32()), part.column("node"), part.column("copies"), part.column("embedding"), pa.array([r.tobytes() for r in packed], pa.binary()), pa.array(factors), pa.array(list(keys), pa.list_(pa.int32()))], names=["label", "dim", "node", "copies", "embedding", "code", "factor", "keys"])

    coded = nodes.mapInArrow(code, f"label string, dim int, node long, copies long, embedding {kind}, code binary, factor double, keys array<int>")
    rows = coded.select("*", F.posexplode("keys").alias("table", "bits"))
    rows = rows.withColumn("bucket", F.xxhash64("label", "dim", "table", "bits"))
    rows = split_hot(rows, "bucket", "node", cell)
    group = ["bucket", "label", "dim", "table", "bits", "cell_i", "cell_j"]

    def compare(batches):
        held: list[pa.RecordBatch] = []

        def ids(t: pa.Table) -> np.ndarray:
            return np.any([t.column(c).to_numpy(zero_copy_only=False)[1:] != t.column(c).to_numpy(zero_copy_only=False)[:-1] for c in group], axis=0)

        def flush(t: pa.Table):
            t = t.combine_chunks()
            number = np.concatenate([[0], np.cumsum(ids(t))])
            sizes = np.bincount(number)
            some = np.flatnonzero(sizes[number] > 1)  # vectors alone in their bucket have no pair
            t, number = t.take(pa.array(some)), number[some]
            found: list[tuple] = []
            dims = t.column("dim").to_numpy()
            for d in np.unique(dims):  # a bucket holds vectors of one length
                at = np.flatnonzero(dims == d)
                part = t.take(pa.array(at)).combine_chunks()
                node, copies, own, place = (part.column(c).to_numpy() for c in ("node", "copies", "own", "table"))
                lists, codes, keys = (part.column(c).chunk(0) for c in ("embedding", "code", "keys"))
                x = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
                codes = np.frombuffer(b"".join(codes.to_pylist()), "<u8").reshape(len(x), -1)
                keys = keys.flatten().to_numpy().reshape(len(x), -1)
                cross = part.column("cell_i").to_numpy() != part.column("cell_j").to_numpy()
                names, index = np.unique(node, return_inverse=True)
                count, root = np.zeros(len(names), np.int64), np.arange(len(names))
                for a, b in linked_pairs(x, codes, part.column("factor").to_numpy(), keys, place, number[at], own, cross, threshold):
                    np.add.at(count, index[a], copies[b])
                    np.add.at(count, index[b], copies[a])
                    if len(a):
                        root = local_roots(len(names), np.concatenate([np.arange(len(names)), index[a]]), np.concatenate([root, index[b]]))
                hit, child = np.flatnonzero(count), np.flatnonzero(root != np.arange(len(names)))
                found += [(names[hit], np.zeros(len(hit), np.int64), count[hit]), (names[child], names[root[child]], np.zeros(len(child), np.int64))]
            a, b, n = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "n"])

        for batch in batches:  # sorted; the last group of a batch may go on in the next
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([*held, batch])
            new = np.flatnonzero(ids(t)) + 1
            cut = int(new[-1]) if len(new) else 0
            if cut:
                yield flush(t.slice(0, cut))
            held = t.slice(cut).to_batches()
        if held:
            yield flush(pa.Table.from_batches(held))

    dealt = rows.repartition(*group).sortWithinPartitions(*group)
    # rows with n > 0 are link counts of a; the others are forest edges (a, b)
    found = space.write(dealt.mapInArrow(compare, "a long, b long, n long"), "found", batch=1 << 14)
    label_of = components(found.where("n = 0").select("a", "b"), space)
    counts = found.where("n > 0").groupBy("a").agg(F.sum("n").alias("more"))
    full = nodes.join(counts, F.col("node") == F.col("a"), "left").drop("a").join(label_of.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    full = full.select(F.col("label").alias("n_label"), F.col("embedding").alias("n_embedding"), (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    linked = used.join(full, (F.col("label") == F.col("n_label")) & (F.col("embedding") == F.col("n_embedding"))).select("vec_id", "n_links", "component_id")
    alone = vectors.where(~F.coalesce(sound, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone)


def near_duplicate_vectors(vectors: DataFrame) -> DataFrame:
    """The contract's rows: vec_id, n_links, component_id, kept."""
    out = link_vectors(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


ORACLE = """
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings),
u as (
  select vec_id, label, e, sqrt(list_dot_product(e, e)) as norm from v
  where label is not null and e is not null and len(e) > 0
    and list_bool_and([x is not null and isfinite(x) for x in e]) and list_bool_or([x <> 0 for x in e])),
l as (
  select a.vec_id as a, b.vec_id as b from u a join u b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id
  where list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
r(id, reached) as (
  select vec_id, vec_id from v union select l.b, r.reached from r join l on l.a = r.id),
c as (select id, min(reached) as component_id from r group by id),
n as (select a, count(*) as n from l group by a)
select v.vec_id, coalesce(n.n, 0)::bigint as n_links, component_id, v.vec_id = component_id as kept
from v join c on c.id = v.vec_id left join n on n.a = v.vec_id
"""

"""Mixing sources to target weights along a time-varying curriculum.

DataFrame functions only.  Sources in code-point order (null last) weigh 1, 2,
3, repeating, and share the total of all sizes; a target stops at ``max_epochs``
times its source's size and the excess is shared again by weight.  The final
targets are the water level L with sum(min(cap, weight * L)) = total, found from
prefix sums over the table of sources.

A source's documents, in a fixed order by a digest of doc_id, are laid end to
end and repeated; the mix takes the first ``target`` words of that line, so each
document is taken floor(target / source size) times and one stretch once more.

The curriculum: training time t runs from 0 to 1 and source s draws words at the
rate target * (1 + slope * (2t - 1)); the slope depends on the weight, so heavy
sources come late and light ones early.  The integral of the rate is the
cumulative demand target * ((1 - slope) * t + slope * t * t).  Inverting it at
the word offset of each copy of a document gives its position in training.

Sums inside a source are prefix sums over blocks by the first digits of the
digest, so a hot source is spread over many tasks.

Defined results: a null text has size 0 and takes nothing; a source without
words has target 0; rows with equal doc_id and source are ordered by size and
text digest; an empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, Workspace, bounded

SLOPE = {1: -0.5, 2: 0.0, 3: 0.5}
BLOCK_ROWS = 20_000  # documents of a block, about, if one source had all


def block_digits(rows: int) -> int:
    """Hexadecimal digits of the digest that name a block; results do not depend on them."""
    return min(8, max(3, math.ceil(math.log(max(rows, 1) / BLOCK_ROWS, 16)) if rows else 3))


def sizes(docs: DataFrame, *more: str) -> DataFrame:
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return docs.select("doc_id", "source", words.alias("size"), order.alias("place"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(-1)).alias("mark"), *more)


def targets(sized: DataFrame, max_epochs: int = 3) -> DataFrame:
    """source, source_size, weight, target: one row for each source.

    The windows without a partition run over the sources, not the documents.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("weight", (rank - 1) % 3 + 1).withColumn("cap", F.col("source_size") * max_epochs)
    # in order of cap / weight the sources reach their caps; before: those that have
    by_cap = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    per = per.withColumn("before", F.coalesce(F.sum("cap").over(by_cap.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    per = per.withColumn("open", F.sum("weight").over(by_cap.rowsBetween(W.currentRow, W.unboundedFollowing)))
    per = per.withColumn("total", F.sum("source_size").over(W.partitionBy(F.lit(0))))
    per = per.withColumn("level", (F.col("total") - F.col("before")) / F.col("open"))
    fits = F.when(F.col("cap") >= F.col("weight") * F.col("level"), F.col("level"))
    per = per.withColumn("level", F.max(fits).over(W.partitionBy(F.lit(0))))
    return per.select("source", "source_size", "weight", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")).alias("target"))


def mix(docs: DataFrame, max_epochs: int = 3, *, more: tuple[str, ...] = ()) -> DataFrame:
    """One row for each document with what the mix takes of it, in training order.

    doc_id, source, size, source_size, target, taken, positions (of each copy,
    in [0, 1]) and position (of the first copy; null if none is taken).
    """
    space = Workspace(docs.sparkSession, "mixing")
    sized = space.write(sizes(docs), "sizes")
    block = F.substring("place", 1, block_digits(sized.count()))
    sized = sized.withColumn("block", block)
    blocks = sized.groupBy("source", "block").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    goal = targets(sized, max_epochs).withColumnRenamed("source", "of")
    blocks = blocks.withColumn("before", before).join(goal, F.col("source").eqNullSafe(F.col("of"))).drop("of", "words")
    blocks = space.write(blocks.select(F.col("source").alias("b_source"), F.col("block").alias("b_block"), "before", "source_size", "weight", "target"), "blocks")
    inside = W.partitionBy("source", "block").orderBy("place", "doc_id", "size", "mark").rowsBetween(W.unboundedPreceding, -1)
    wide = sizes(docs, *more).withColumn("block", block) if more else sized  # texts are not written, only dealt out
    lined = wide.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    # as many blocks as sources and digits allow: far fewer than documents
    joined = lined.join(bounded(blocks, 500_000), (F.col("block") == F.col("b_block")) & F.col("source").eqNullSafe(F.col("b_source")))
    offset = F.col("before") + F.col("ahead")
    goal_words = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(goal_words / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long")
    rest = goal_words - whole * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - offset))
    copies = whole + F.when(part > 0, 1).otherwise(0)
    slope = F.element_at(F.create_map(*[F.lit(x) for kv in SLOPE.items() for x in kv]), F.col("weight"))

    def position(k):
        demand = F.least(F.lit(1.0), (offset + k * F.col("source_size")) / F.col("target"))
        root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * demand)
        # t solves slope*t*t + (1-slope)*t = demand; this form also holds for slope 0
        return 2 * demand / ((1 - slope) + root)

    spots = F.when((F.col("size") > 0) & (copies > 0), F.transform(F.sequence(F.lit(0).cast("long"), copies - 1), position)).otherwise(F.array().cast("array<double>"))
    out = joined.select("doc_id", "source", "size", "source_size", "target", (whole * F.col("size") + part).cast("long").alias("taken"), spots.alias("positions"), *more)
    return out.withColumn("position", F.when(F.size("positions") > 0, F.element_at("positions", 1)))


def mixture_of_documents(docs: DataFrame) -> DataFrame:
    """The contract's rows, range-sorted by position of the first copy."""
    out = mix(docs).select("doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position"))
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def training_order(docs: DataFrame) -> DataFrame:
    """The documents as training reads them: whole copies, range-sorted by position.

    Of the stretch that is taken once more, a document counts if at least half of
    it is taken, so every source comes within a document of its target.
    """
    names = docs.columns
    row = docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"))
    mixed = mix(row, more=("__row",))
    n = F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + 0.5).cast("int")
    spread = mixed.where(F.col("size") > 0).select("__row", F.explode(F.slice("positions", F.lit(1), n)).alias("__at"))
    return spread.orderBy("__at", "__row.doc_id").select(*[F.col("__row").getField(c).alias(c) for c in names])


ORACLE = r"""
with d as (
  select doc_id, source,
         cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
         md5(coalesce(cast(doc_id as varchar), '')) as place
  from documents),
s as (
  select source, cast(sum(size) as bigint) as source_size,
         cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as bigint) as weight
  from d group by source),
c as (
  select *, source_size * 3 as cap, sum(source_size) over () as total,
         coalesce(sum(source_size * 3) over (order by (source_size * 3)::double / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as before,
         sum(weight) over (order by (source_size * 3)::double / weight, source nulls last rows between current row and unbounded following) as open
  from s),
l as (select *, (total - before)::double / open as level from c),
m as (select max(level) as level from l where cap >= weight * level),
t as (select l.source, l.source_size, l.weight, least(l.cap::double, l.weight * m.level) as target from l, m),
o as (
  select d.doc_id, d.size, t.source_size, t.target,
         coalesce(sum(d.size) over (partition by d.source order by d.place, d.doc_id rows between unbounded preceding and 1 preceding), 0) as ahead,
         case when t.source_size > 0 then round(t.target)::bigint // t.source_size else 0 end as whole,
         case t.weight when 1 then -0.5::double when 2 then 0.0::double else 0.5::double end as slope
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
       cast(whole * size + greatest(0, least(size, round(target)::bigint - whole * source_size - ahead)) as bigint) as taken,
       case when size > 0 and (whole > 0 or ahead < round(target)::bigint) then
         round(2 * least(1.0::double, ahead / target)
               / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * least(1.0::double, ahead / target))), 9)
       end as position
from o
"""

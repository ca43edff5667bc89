"""Mixing sources to target weights over training time.

Each source has a weight schedule over time 0 to 1, linear between knots. Its integral, scaled to the source's target, is the
source's cumulative token demand. A source's documents stand in a fixed pseudo-random order; the words before a document are
where it stands in that demand, and the inverse of the demand there is its training position. Ranges of positions then sort all
documents into training order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallywright.llm.common import running, settle

#: A target stops at so many times its source's size, and so no document is taken more often.
MOST_PASSES = 3

#: Weight schedules as (time, weight) knots by weight: light sources fade out, heavy ones fade in. Only the shape counts.
SCHEDULES = {1: [(0.0, 1.5), (1.0, 0.5)], 2: [(0.0, 1.0), (1.0, 1.0)], 3: [(0.0, 0.5), (0.5, 1.25), (1.0, 1.25)]}

WORD = r"[^\x20\x09-\x0D]+"


def cycled(weights: tuple[int, ...] = (1, 2, 3)) -> Column:
    """A weight for each source by its place among the sources in code point order, null last, over and over."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))


def targets(sizes: DataFrame, weight: Column, passes: int = MOST_PASSES) -> DataFrame:
    """Adds weight and target to sizes (source, source_size): shares of the whole by weight, none above passes x its size.

    In order of cap over weight the capped sources are a prefix. A source is capped if the level (what the ones before leave, by
    the weight of the ones from it on) passes its cap; the first level that isn't holds for all that follow. One row a source.
    """
    up = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    after = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * passes).withColumn("level", level)
    free = F.max(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("level"))).over(every)
    return rows.withColumn("free", free).select("source", "source_size", "weight", F.coalesce(F.least(F.col("cap").cast("double"), F.col("free") * F.col("weight")), F.col("cap").cast("double")).alias("target"))


def _segments(knots: list[tuple[float, float]]) -> list[tuple[float, float, float, float]]:
    """(demand before, time before, weight there, slope) of each piece between knots; demand scaled to 1 in all."""
    area = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False)]
    out, total, done = [], sum(area), 0.0
    for (t0, w0), (t1, w1), a in zip(knots, knots[1:], area, strict=False):
        out.append((done / total, t0, w0 / total, (w1 - w0) / (t1 - t0) / total))
        done += a
    return out


def position(weight: Column, share: Column, schedules: dict[int, list[tuple[float, float]]]) -> Column:
    """The time at which the schedule of this weight has asked for ``share`` of its demand; the inverse of a quadratic in each piece."""
    out = share
    for w, knots in schedules.items():
        at = F.lit(None).cast("double")
        for begin, t0, w0, slope in _segments(knots):
            rest = share - begin
            at = F.when(share >= begin, F.lit(t0) + 2 * rest / (F.lit(w0) + F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * rest, F.lit(0.0))))).otherwise(at)
        out = F.when(weight == w, at).otherwise(out)
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))


def plan(docs: DataFrame, weight: Column | None = None, schedules: dict[int, list[tuple[float, float]]] = SCHEDULES, passes: int = MOST_PASSES) -> DataFrame:
    """One row per document of docs (doc_id, text, source): size, source_size, weight, target, taken, copies, positions; key names the row.

    A document is taken once for each pass over its source in which the middle of its words comes before the target: whole
    documents only, so a source's words miss its target by half a document at most. positions holds the training time of each
    copy. A null text has 0 words; null sources are a source of their own; a source without words takes nothing; repeated rows
    stand next to each other and are taken like others. An empty table gives an empty plan. The order is a function of ids alone.
    """
    code = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), code.alias("_code"), F.substring(code, 1, 3).alias("_part"), F.xxhash64("text").alias("key"))
    rows = settle(rows, "mix-sizes")
    wanted = settle(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), cycled() if weight is None else weight, passes), "mix-targets")
    placed = running(rows, ["source"], "_part", [F.col("_code"), F.col("doc_id"), F.col("size"), F.col("key")], F.col("size"), "before")
    wanted = wanted.withColumnRenamed("source", "_source")
    placed = placed.join(wanted, placed.source.eqNullSafe(wanted._source))
    middle = [F.col("before") + F.col("size") / 2 + F.lit(p) * F.col("source_size") for p in range(passes)]
    share = [F.when(m < F.col("target"), position(F.col("weight"), m / F.col("target"), schedules)) for m in middle]
    placed = placed.withColumn("positions", F.array_compact(F.array(*share))).withColumn("copies", F.size("positions"))
    return placed.select("doc_id", "key", "size", "source_size", "weight", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "positions")


def in_order(df: DataFrame, at: Column, tie: str = "doc_id") -> DataFrame:
    """Sorts by ranges of training position; rows without one come first."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.withColumn("_at", at).repartitionByRange(n, "_at", tie).sortWithinPartitions("_at", tie).drop("_at")


def mixed(docs: DataFrame, **options: object) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, range-sorted by training position, with all their columns.

    A table that is written from this has the order in its files; who needs it in rows takes the positions from plan().
    """
    copies = plan(docs, **options).where("copies > 0").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "positions")
    copies = copies.groupBy("_id", "_key").agg(F.flatten(F.collect_list("positions")).alias("positions"))
    keyed = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_own"), F.xxhash64("text").alias("_hash"))
    joined = keyed.join(copies, keyed._own.eqNullSafe(copies._id) & (keyed._hash == copies._key))
    # of repeated rows the first carries the copies of all
    once = joined.dropDuplicates(["_id", "_key"])
    placed = once.select("_row", "_own", F.explode("positions").alias("_position"))
    return in_order(placed, F.col("_position"), "_own").select("_row.*")

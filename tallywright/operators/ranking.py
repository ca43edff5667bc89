"""Positions in an order, for all rows of a table or of each key, without bringing a key's rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def null_safe(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """df with the other columns of ``other``, joined on equal keys; null keys are equal."""
    named = other.withColumnsRenamed({k: f"_other_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & df[k].eqNullSafe(named[f"_other_{k}"])
    return df.join(named, same).drop(*[f"_other_{k}" for k in keys])


def positioned(df: DataFrame, keys: list[str], bucket: Column, order: list[Column | str], out: str = "position", weight: Column | None = None) -> DataFrame:
    """Adds ``out``: the row's place (from 0) among the rows of its keys, in order of (bucket, order); with a weight, the sum of the weights before it.

    Buckets are counted first; a window over the counts gives each bucket's first place, and a second one numbers the rows of a
    bucket. Buckets should be many and even, and must not part the order: a value's leading digits, a hash's prefix.
    """
    rows = df.withColumn("_bucket", bucket).withColumn("_weight", F.lit(1) if weight is None else weight)
    counts = rows.groupBy(*keys, "_bucket").agg(F.sum("_weight").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    same = rows["_bucket"].eqNullSafe(offsets["_b"])
    for i, k in enumerate(keys):
        same = same & rows[k].eqNullSafe(offsets[f"_k{i}"])
    inside = F.coalesce(F.sum("_weight").over(Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(offsets, same).withColumn(out, F.col("_offset") + inside).drop("_bucket", "_weight", "_b", "_offset", *[f"_k{i}" for i in range(len(keys))])


def with_even_bucket(df: DataFrame, keys: list[str], value: str, buckets: int = 256) -> tuple[DataFrame, Column]:
    """df with cuts of ``value`` among the rows of the same keys, and the column that numbers the parts between them.

    Cuts are approximate quantiles, so parts are even however values lie, if values are distinct: count rows of a value first.
    """
    shares = [i / buckets for i in range(1, buckets)]
    cuts = df.groupBy(*keys).agg(F.percentile_approx(F.col(value).cast("double"), shares, 4 * buckets).alias("_cuts"))
    if not keys:
        return df.join(F.broadcast(cuts)), F.size(F.filter("_cuts", lambda c: c < F.col(value).cast("double")))  # one row
    return null_safe(df, cuts, keys), F.size(F.filter("_cuts", lambda c: c < F.col(value).cast("double")))

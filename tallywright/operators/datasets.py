"""Operations on a split: filter, slice, shuffle, repeat, stratified samples, examples for prompts."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallywright.operators.ranking import positioned


def filtered(df: DataFrame, keys: DataFrame, by: list[str], require_all: bool | None = None) -> DataFrame:
    """The rows whose key is among keys (repeated keys count once).

    ``require_all`` asks for a check first: with False it is an error if nothing matches, with True if any key has no match. Without
    it nothing is run.
    """
    if require_all is not None:
        checked(df, keys, by, require_all)
    return df.join(keys.select(*by).distinct(), by, "left_semi")


def checked(df: DataFrame, keys: DataFrame, by: list[str], require_all: bool) -> None:
    """Raises if no key matches, or, if ``require_all``, if any key doesn't; counts are all that comes to the driver."""
    missing, asked = unmatched(df, keys, by).count(), keys.select(*by).distinct().count()
    if asked == missing:
        raise ValueError(f"filter: none of {asked} keys matches")
    if require_all and missing:
        raise ValueError(f"filter: {missing} of {asked} keys match nothing")


def values_digest(values: DataFrame, column: str = "value") -> str:
    """A digest of the distinct values, whatever their order: one number a partition and a sum of hashes reach the driver."""
    text = F.col(column).cast("string")
    row = values.select(text.alias("v")).distinct().agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(F.sha2("v", 256), 1, 15), 16, 10).cast("decimal(38,0)")).alias("s")).first()
    return hashlib.sha256(f"{row.n}:{row.s or 0}".encode()).hexdigest()


def retrieved(df: DataFrame, n: int, mode: str = "first", seed: int = 0, order: str | None = None, by: str | None = None) -> DataFrame:
    """n rows of a split, of each group if ``by`` is given: the first by ``order``, or a seeded draw; an error with fewer."""
    key = draw(seed, F.to_json(F.struct(*df.columns))) if mode == "random" else F.col(order)
    if by is not None:
        picked = df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(key))).where(F.col("_r") <= n).drop("_r")
        short = df.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") < n).count()
    else:
        picked = df.orderBy(key).limit(n)
        short = picked.count() < n
    if short:
        raise ValueError(f"fewer than {n} rows to take")
    return picked


def unmatched(df: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    """The keys that no row has."""
    return keys.select(*by).distinct().join(df, by, "left_anti")


def without(df: DataFrame, reserved: DataFrame, by: list[str]) -> DataFrame:
    """The rows that aren't reserved, for example as examples of prompts."""
    return df.join(reserved, by, "left_anti")


def sliced(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def draw(seed: int, *cols: Column | str) -> Column:
    """A pseudo-random code of a row, the same everywhere: the MD5 of seed:col:col."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c for c in cols]))


def shuffled(df: DataFrame, key: str, seed: int = 0, out: str = "position") -> DataFrame:
    """Adds each row's place in a seeded order."""
    code = draw(seed, key)
    return positioned(df, [], F.substring(code, 1, 3), [code, F.col(key)], out)


def repeated(df: DataFrame, times: int, out: str = "repeat_index") -> DataFrame:
    """So many copies of each row, numbered."""
    if times < 1 or out in df.columns:
        raise ValueError("repeat: at least 1 time, and only once")
    return df.withColumn(out, F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def allocation(df: DataFrame, by: str, num: int | None = None, per_group: int | None = None, fraction: float | None = None, min_per_group: int = 1) -> DataFrame:
    """(by, size, alloc): how many rows of each stratum a sample takes. Exactly one of num, per_group and fraction is given.

    num: every stratum gets its floor; then seat after seat goes to the stratum that lacks most of its share of the target. Seats
    that are certain are granted outright, so the ranking of seats depends on the number of strata only, not of rows.
    """
    if sum(x is not None for x in (num, per_group, fraction)) != 1:
        raise ValueError("exactly one of num, per_group and fraction")
    sizes = df.groupBy(by).agg(F.count("*").alias("size"))
    if per_group is not None:
        return sizes.withColumn("alloc", F.least("size", F.lit(per_group)).cast("long"))
    if fraction is not None:
        return sizes.withColumn("alloc", F.least("size", F.greatest(F.lit(min_per_group), F.ceil(F.col("size") * F.lit(fraction)))).cast("long"))
    every = Window.partitionBy(F.lit(0))
    base = sizes.withColumn("least", F.least("size", F.lit(min_per_group))).withColumn("total", F.sum("size").over(every)).withColumn("strata", F.count("*").over(every))
    base = base.withColumn("target", F.least(F.greatest(F.lit(num), F.sum("least").over(every)), "total")).withColumn("quota", F.col("size").cast("double") * F.col("target") / F.col("total"))
    base = base.withColumn("sure", F.greatest("least", F.least("size", F.floor("quota") - F.col("strata") * min_per_group - 1)).cast("long"))
    seats = base.withColumn("open", F.col("target") - F.sum("sure").over(every)).withColumn("seat", F.explode(F.sequence(F.col("sure") + 1, F.greatest(F.col("sure") + 1, F.least("size", F.ceil("quota")))))).where("seat <= size")
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.col("quota") - F.col("seat") + 1), F.col(by).cast("string")))
    more = seats.withColumn("rank", rank).where(F.col("rank") <= F.col("open")).groupBy(by).agg(F.count("*").alias("more"))
    return base.join(more.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by")), "left").select(by, "size", (F.col("sure") + F.coalesce("more", F.lit(0))).alias("alloc"))


def stratified(df: DataFrame, by: str, key: str, seed: int = 0, **budget: float) -> DataFrame:
    """A sample of each stratum by its allocation, chosen by a seeded order."""
    code = draw(seed, F.col(by).cast("string"), F.col(key).cast("string"))
    placed = positioned(df, [by], F.substring(code, 1, 3), [code, F.col(key)], "_place")
    seats = allocation(df, by, **budget).select(F.col(by).alias("_by"), "alloc")
    return placed.join(seats, F.col(by).eqNullSafe(F.col("_by"))).where("_place < alloc").drop("_place", "_by", "alloc")


def first_of_group(df: DataFrame, by: str, n: int, *order: str) -> DataFrame:
    """The first n rows of each group, numbered from 1 in ``rank``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= n)


def example_prefix(examples: DataFrame, by: str, text: Column, n: int, order: str, glue: str = "\n\n") -> DataFrame:
    """(by, prefix, n_examples): the texts of the first n examples of each group in order; groups with fewer are left out.

    Where a group with fewer must be an error, take examples by retrieved() first.
    """
    first = first_of_group(examples, by, n, order).withColumn("_text", text)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "_text"))), lambda x: x["_text"]), glue)
    return first.groupBy(by).agg(joined.alias("prefix"), F.count("*").alias("n_examples")).where(F.col("n_examples") == n)


def apply(df: DataFrame, operations: list[dict], key: str = "sample_id") -> DataFrame:
    """An ordered list of one-entry operations: {"slice": 10}, {"shuffle": 7}, {"repeat": 3}, {"stratified": {...}}, {"filter": {"by", "keys"}}."""
    for op in operations:
        if len(op) != 1:
            raise ValueError(f"an operation has one name: {op}")
        name, value = next(iter(op.items()))
        if name == "slice":
            df = sliced(df, value, key)
        elif name == "shuffle":
            df = shuffled(df, key, value)
        elif name == "repeat":
            df = repeated(df, value)
        elif name == "stratified":
            df = stratified(df, key=key, **value)
        elif name == "filter":
            df = filtered(df, value["keys"], value["by"])
        else:
            raise ValueError(f"no operation named {name}")
    return df

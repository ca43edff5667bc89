"""Tables by name, datasets with splits, and checks of the files they come from."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@dataclass(frozen=True)
class Dataset:
    """Named splits; every operation gives a new one. ``test`` is what is evaluated, ``train`` where examples come from."""

    splits: dict[str, DataFrame]

    @property
    def test(self) -> DataFrame | None:
        return self.splits.get("test")

    @property
    def train(self) -> DataFrame | None:
        return self.splits.get("train")

    def map(self, operation: Callable[[DataFrame], DataFrame], split: str = "test") -> Dataset:
        """The operation on one split; without that split nothing changes."""
        if split not in self.splits:
            return self
        return replace(self, splits=self.splits | {split: operation(self.splits[split])})

    def evaluated_on(self, split: str) -> Dataset:
        """Another split takes the place of ``test``."""
        rest = {k: v for k, v in self.splits.items() if k != split}
        return Dataset(rest | {"test": self.splits[split]})


#: Readers by format: each takes (spark, path, schema or None).
FORMATS: dict[str, Callable[..., DataFrame]] = {
    "parquet": lambda spark, path, schema=None: spark.read.parquet(path),
    "jsonl": lambda spark, path, schema=None: (spark.read.schema(schema) if schema else spark.read).json(path),
    "json": lambda spark, path, schema=None: (spark.read.schema(schema) if schema else spark.read).option("multiLine", True).json(path),
    "csv": lambda spark, path, schema=None: (spark.read.schema(schema) if schema else spark.read).option("header", True).option("multiLine", True).option("escape", '"').csv(path),
    "tsv": lambda spark, path, schema=None: (spark.read.schema(schema) if schema else spark.read).option("header", True).option("sep", "\t").csv(path),
    "text": lambda spark, path, schema=None: spark.read.text(path),
}


def load(spark: SparkSession, splits: dict[str, str | list[str]], kind: str = "parquet", schema: str | None = None) -> Dataset:
    """A dataset from paths of splits; several paths of a split are united by column name."""
    read = FORMATS[kind]
    out = {}
    for name, paths in splits.items():
        frames = [read(spark, p, schema) for p in ([paths] if isinstance(paths, str) else paths)]
        out[name] = frames[0]
        for more in frames[1:]:
            out[name] = out[name].unionByName(more, allowMissingColumns=True)
    return Dataset(out)


def accepted_values(spark: SparkSession, path: str) -> DataFrame:
    """(value) from lines of text: blank lines and those that begin with # don't count."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("value")).where((line != "") & ~line.startswith("#")).distinct()


def checksum_mismatches(spark: SparkSession, folder: str, declared: DataFrame) -> DataFrame:
    """(name, sha256, actual) of the declared (name, sha256) whose file in the folder is missing or differs."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    actual = files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("actual"))
    return declared.join(actual, "name", "left").where(~F.col("actual").eqNullSafe(F.col("sha256"))).select("name", "sha256", "actual")


def rollouts(lineitem: DataFrame) -> DataFrame:
    """The fixture of judged rollouts: one sample an order, one rollout a line, in a total order."""
    from pyspark.sql.window import Window

    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate"]
    index = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)) - 1
    extracted: Column = F.col("l_discount") > 0
    return lineitem.select(F.col("l_orderkey").alias("sample_id"), index.alias("idx"), (F.col("l_quantity") > 25).alias("correct"), F.when(extracted, F.col("l_returnflag")).alias("answer"), extracted.alias("extracted"), F.col("l_partkey").alias("part"), F.col("l_tax").alias("tax"))

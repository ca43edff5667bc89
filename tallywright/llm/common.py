"""What the operators share: tables in the cluster's shared folder, distributed running sums, connected components."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Buckets that a key's rows are dealt into before a window numbers them.
BUCKETS = 4096

_local_dir: dict[str, str] = {}


class Recent:
    """A worker's memory of computed values (str -> bytes) in bounded space: when full, what wasn't used since it last was full is forgotten.

    ``limit`` is in bytes of keys, values and what Python keeps around them; two generations of that size are held at most, beside
    what the batch at hand needs.
    """

    AROUND = 200

    def __init__(self, limit: int):
        self.limit, self.held, self.now, self.old = limit, 0, {}, {}

    def missing(self, keys: set[str]) -> list[str]:
        """Those of the keys that must be computed and learned; the others ``now`` has."""
        new = keys.difference(self.now)
        if not new:
            return []
        if self.held > self.limit:
            self.now, self.old, self.held = {}, self.now, 0
            new = keys
        out, again = [], {}
        for k in new:
            if (value := self.old.get(k)) is None:
                out.append(k)
            else:
                again[k] = value
        self.learn(again)
        return out

    def learn(self, values: dict[str, bytes]) -> None:
        self.now.update(values)
        self.held += self.AROUND * len(values) + sum(map(len, values)) + sum(map(len, values.values()))


def in_slices(texts: pa.Array, work: Callable[[list[str | None]], pa.Array], rows: int = 512) -> pa.Array:
    """``work`` of an Arrow batch, so many rows at a time, and without what the memory pool holds on to afterwards: workers stay small."""
    parts = [work(texts.slice(i, rows).to_pylist()) for i in range(0, len(texts), rows)] or [work([])]
    out = parts[0] if len(parts) == 1 else pa.concat_arrays(parts)
    del parts
    pa.default_memory_pool().release_unused()
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a temporary one, which only a local master may use."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dir:
        _local_dir[app] = "file://" + tempfile.mkdtemp(prefix="tallywright-")
    return _local_dir[app]


#: Folder, in the application's part of the shared folder, of what is settled now; scratch() sets another.
_scope: ContextVar[str] = ContextVar("scope", default="tables")


@contextmanager
def scratch() -> Iterator[str]:
    """Tables that are settled inside go to a folder of their own, whose name it gives; release() deletes it."""
    name = f"scratch-{uuid.uuid4().hex}"
    token = _scope.set(name)
    try:
        yield name
    finally:
        _scope.reset(token)


def _own_dir(spark: SparkSession, scope: str) -> str:
    return f"{shared_dir(spark)}/tallywright/{spark.sparkContext.applicationId}/{scope}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in this application's part of the shared folder that nothing has used yet."""
    return f"{_own_dir(spark, _scope.get())}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: lineage ends here, and a lost executor costs nothing above."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def reclaim(spark: SparkSession) -> None:
    """Lets Spark delete the files of shuffles that nothing refers to any more; it does so when the driver collects its garbage."""
    for _ in range(2):  # what the first pass frees may hold on to more
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def release(spark: SparkSession, scope: str) -> None:
    """Deletes the tables that were settled in a scratch folder, once what was made of them has been written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_dir(spark, scope))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bucket_of(*cols: Column | str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(buckets)).cast("int")


def running(df: DataFrame, keys: list[str], bucket: str, order: list[Column], value: Column, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same keys that stand before this one by (bucket, order).

    A window over one key's rows would bring a hot key to one task. Here each (keys, bucket) is summed first, a window over
    those sums (as many rows a key as there are buckets) gives each bucket's offset, and a second window numbers the rows inside
    a bucket only. The bucket must come first in the intended order.
    """
    keyed = df.withColumn("_value", value.cast("long"))
    sums = keyed.groupBy(*keys, bucket).agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(bucket).alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    cond = keyed[bucket] == offsets["_b"]
    for i, k in enumerate(keys):
        cond = cond & keyed[k].eqNullSafe(offsets[f"_k{i}"])
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = keyed.join(offsets, cond).drop("_b", *[f"_k{i}" for i in range(len(keys))])
    return joined.withColumn(out, F.col("_offset") + F.coalesce(F.sum("_value").over(inside), F.lit(0))).drop("_value", "_offset")


def components(links: DataFrame, name: str = "components", rounds: int = 40) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b): component is the smallest node that links lead to.

    Alternating stars: each round gives every node's larger neighbours its smallest neighbour, then its smaller ones, until the
    links no longer change. A round is two grouped minima and two joins. Minima are written before they are joined, so that a node with
    many links doesn't hold its join to one task: adaptive execution splits it, or sends the minima to all tasks if they are few.
    """
    edges = settle(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-edges")
    seen = None
    for _ in range(rounds):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = settle(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m")), f"{name}-low")
        large = both.join(low, both.a == low.k).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = settle(large, f"{name}-large")
        low = settle(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k"), f"{name}-low")
        small = large.join(low, large.a == low.k).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = settle(small, f"{name}-small")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"{name}: links still change after {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Whether a document is kept from learning: the CRC-32 of its id as text leaves no remainder by 5; so does a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))

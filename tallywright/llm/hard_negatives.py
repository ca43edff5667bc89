"""Hard-negative mining with Kronecker-packed products.

The components of several candidates are made non-negative by a bias and put side by side into separated fields of one wide integer;
one multiplication by an anchor's component then serves all of them, and the sum over components holds each candidate's product in
its field, because no field can overflow into the next. Taking the biases off gives the exact inner products.

Anchors are taken in blocks of bounded size; every block is compared with all rows in two passes: one finds each anchor's positives,
whose scores bound the scores of its negatives, which the other finds. A task keeps its best few rows an anchor (or pair) only, and
those are ranked across tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallywright.llm.common import bucket_of, fresh_path, running, settle
from tallywright.llm.vector_codes import _matrix, whole_rows

POSITIVES, NEGATIVES, SCALE = 5, 10, 256

#: A negative's score in hundredths of the positive's.
LOW, HIGH = 30, 90

#: Anchors that are sent to all tasks at a time, and columns of scores that a task makes at a time.
BLOCK, COLUMNS = 4096, 320

#: Stands for a null id inside tasks: after all others.
NO_ID = np.iinfo(np.int64).max

_LEAST = np.iinfo(np.int64).min + 1  # has an opposite


@dataclass(frozen=True)
class Packing:
    """How candidates are packed: ``bias`` is added to each component of candidates and anchors, fields have ``bits``, an integer holds ``fields``.

    Integers of up to 53 bits are multiplied as doubles, in which they and all sums are exact; wider ones as 64-bit integers.
    """

    bias: int
    bits: int
    fields: int

    @staticmethod
    def of(length: int, largest: int) -> Packing:
        """For vectors of so many components from -largest to largest."""
        bits = max(1, (length * (2 * largest) ** 2).bit_length())
        if bits > 50:  # a score and a row's place in its batch must fit into 64 bits together
            raise ValueError(f"products of {length} components of up to {largest} need {bits} bits")
        return Packing(largest, bits, 53 // bits if 53 // bits > 1 else 63 // bits)

    @property
    def kind(self) -> type:
        return np.float64 if self.bits * self.fields <= 53 else np.int64

    def pack(self, x: np.ndarray) -> np.ndarray:
        """(ceil(rows / fields), length) wide integers; row r is in field r % fields of integer r // fields."""
        biased = np.concatenate([x + self.bias, np.zeros((-len(x) % self.fields, x.shape[1]), np.int64)])
        shifts = np.arange(self.fields, dtype=np.int64) * self.bits
        return (biased.reshape(-1, self.fields, x.shape[1]) << shifts[None, :, None]).sum(1).astype(self.kind)

    def products(self, packed: np.ndarray, x: np.ndarray, anchors: np.ndarray) -> np.ndarray:
        """The inner products (rows of x, anchors), from the packed rows of x."""
        wide = (packed @ (anchors + self.bias).T.astype(self.kind)).astype(np.int64)
        shifts = np.arange(self.fields, dtype=np.int64) * self.bits
        fields = (wide[:, None, :] >> shifts[None, :, None]) & ((1 << self.bits) - 1)
        held = fields.reshape(-1, len(anchors))[: len(x)]
        # (x + b)(a + b) summed, less b(x + b) and ba summed
        return held - self.bias * (x + self.bias).sum(1)[:, None] - self.bias * anchors.sum(1)[None]


@dataclass
class Wanted:
    """Columns of scores to be ranked: each is an anchor (a row of ``vectors``); with ``low`` and ``high``, rows of other labels between them count, else other rows of its label."""

    anchor: np.ndarray
    vectors: np.ndarray
    label: np.ndarray
    own: np.ndarray
    most: int
    low: np.ndarray | None = None
    high: np.ndarray | None = None


def _merged(score: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``most`` of each column by score, larger first, then by id."""
    order = np.lexsort((ids, -score), axis=0)[:most]
    return np.take_along_axis(score, order, axis=0), np.take_along_axis(ids, order, axis=0)


def _best(packing: Packing, wanted: Wanted, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the best rows of a batch, which is sorted by id, for these columns; _LEAST where there are fewer."""
    anchors, at = np.unique(wanted.anchor[columns], return_inverse=True)
    score = packing.products(packing.pack(x), x, wanted.vectors[anchors])[:, at]
    same = labels[:, None] == wanted.label[wanted.anchor[columns]][None]
    if wanted.low is None:
        fits = same & (ids[:, None] != wanted.own[wanted.anchor[columns]][None])
    else:
        fits = ~same & (score >= wanted.low[columns][None]) & (score <= wanted.high[columns][None])
    n = len(x)
    key = np.where(fits, score * n + (n - 1 - np.arange(n))[:, None], _LEAST)
    most = min(wanted.most, n)
    top = np.argpartition(key, n - most, axis=0)[n - most :] if most < n else np.broadcast_to(np.arange(n)[:, None], key.shape)
    found = np.take_along_axis(key, top, axis=0) > _LEAST
    return np.where(found, np.take_along_axis(score, top, axis=0), _LEAST), np.where(found, ids[top], NO_ID)


def _ranked(rows: DataFrame, packing: Packing, wanted: Wanted) -> DataFrame:
    """(c, rank, score, id): the first ``most`` rows of each column c of ``wanted``, ranked from 1. An id of NO_ID is null."""
    shared = rows.sparkSession.sparkContext.broadcast(wanted)  # a block of anchors, with a few columns each: bounded

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        score = np.full((wanted.most, len(wanted.anchor)), _LEAST, np.int64)
        ids = np.full(score.shape, NO_ID, np.int64)
        for batch in batches:
            for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                own = part.column("vec_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
                order = np.argsort(own, kind="stable")
                x, labels = _matrix(part.column("v"), len(own))[order], part.column("label").to_numpy(zero_copy_only=False)[order]
                for at in range(0, score.shape[1], COLUMNS):
                    columns = np.arange(at, min(at + COLUMNS, score.shape[1]))
                    s, k = _best(packing, wanted, x, own[order], labels, columns)
                    score[:, columns], ids[:, columns] = _merged(np.concatenate([score[:, columns], s]), np.concatenate([ids[:, columns], k]), wanted.most)
        k, c = np.nonzero(score > _LEAST)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(score[k, c]), pa.array(ids[k, c])], names=["c", "score", "id"])

    found = rows.mapInArrow(search, "c long, score long, id long")
    rank = F.row_number().over(Window.partitionBy("c").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= wanted.most)


def hard_negatives(
    vectors: DataFrame, anchor: Callable[[Column], Column], id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor`` says of an id whether its row is an anchor. A score is the inner product of two vectors in whole numbers,
    floor(scale * x) of each component. An anchor's positives are the first rows of its label with another id, its negatives for a
    positive the first rows of other labels whose score is from low to high hundredths of the positive's; larger scores come first,
    then smaller ids.

    Rows take no part if their label is null, or their vector is, or a component of it is null or not finite. A null id is no
    anchor and comes after all ids (the largest 64-bit integer counts as null). Repeated rows each take part; equal anchors count
    once. Of an empty table the result is empty. Further columns are ignored, whatever their names. Vectors of different lengths, or
    with components too large for exact products, raise ValueError.
    """
    spark = vectors.sparkSession
    plain = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("embedding")).where("label is not null")
    rows, n, length, largest = whole_rows(plain, scale, (1 << 31) - 1, F.col("vec_id"), F.col("label"))
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n:
        return spark.createDataFrame([], out)
    packing = Packing.of(length, largest)
    rows = settle(rows, "negatives-rows")
    chosen = rows.where(anchor(F.col("vec_id"))).distinct().withColumn("_bucket", bucket_of("vec_id", "label", "v"))
    numbered = settle(running(chosen, [], "_bucket", [F.col("vec_id"), F.col("label"), F.col("v")], F.lit(1), "a").drop("_bucket"), "negatives-anchors")
    path, blocks = fresh_path(spark, "negatives"), -(-numbered.count() // BLOCK)
    for b in range(blocks):
        block = numbered.where(F.col("a").between(b * BLOCK, (b + 1) * BLOCK - 1)).orderBy("a").collect()
        own, label = np.array([r.vec_id for r in block], np.int64), np.array([r.label for r in block], np.int64)
        x = np.array([r.v for r in block], np.int64).reshape(len(block), length)
        pairs = sorted(_ranked(rows, packing, Wanted(np.arange(len(block)), x, label, own, positives)).collect(), key=lambda r: (r.c, r["rank"]))
        at, score = np.array([r.c for r in pairs], np.int64), np.array([r.score for r in pairs], np.int64)
        bounds = -((-low * score) // 100), high * score // 100
        found = _ranked(rows, packing, Wanted(at, x, label, own, negatives, *bounds)) if len(pairs) else spark.createDataFrame([], "c long, score long, id long, rank int")
        known = spark.createDataFrame([(c, int(own[r.c]), r.id, r.score) for c, r in enumerate(pairs)], "c long, anchor_id long, positive_id long, positive_score long")
        made = found.join(F.broadcast(known), "c")  # ``positives`` rows an anchor of the block at most
        named = made.select("anchor_id", F.nullif("positive_id", F.lit(int(NO_ID))).alias("positive_id"), F.col("rank").cast("int"), F.nullif("id", F.lit(int(NO_ID))).alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        named.write.mode("overwrite").parquet(f"{path}/block={b}")
    return spark.read.parquet(path).select(*[c.split()[0] for c in out.split(", ")]) if blocks else spark.createDataFrame([], out)

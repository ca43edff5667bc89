"""Vector code compression: product codes whose codebooks are fitted by Ball k-means, exact in whole numbers.

A vector is cut into parts; each part position has a codebook. An entry and the parts assigned to it are a ball. In rounds after the
first, an entry j can only take a part from entry i if their distance is at most twice the part's distance from i. So the radius of a
ball tells its neighbour entries; a part nearer than half the way to the closest of them is in the stable core and is compared with
nothing; the halves of the distances to the neighbours, in order, cut the ball into rings, and a part in the n-th ring is compared
with the first n neighbours only. Balls without a moved entry among themselves and their neighbours are skipped whole. Squared
distances are whole numbers and ties are compared too, so codes are those of comparing every part with every entry.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import release, scratch, settle

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024

CODED = "vec_id long, label long, v array<int>, codes array<int>"


def whole(vector: Column | str, scale: int) -> Column:
    """floor(scale * x) of each component x, as whole doubles; null if the vector, or a component, is null or not finite."""
    x = (F.col(vector) if isinstance(vector, str) else vector).cast("array<double>")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    # floor() gives longs, which huge components don't fit into; those stay doubles and whole_rows() refuses them
    return F.when(~odd, F.transform(x, lambda v: F.when(F.abs(v) * scale < 2.0**52, F.floor(v * scale).cast("double")).otherwise(v * scale)))


def whole_rows(vectors: DataFrame, scale: int, most: int, *cols: Column) -> tuple[DataFrame, int, int, int]:
    """(rows of cols and v, their number, the length of a vector, the largest size of a component) of the vectors that ``whole`` keeps.

    All vectors must have one length, and no component may be larger than ``most`` after scaling.
    """
    rows = vectors.select(*cols, whole("embedding", scale).alias("v")).where("v is not null")
    seen = rows.agg(F.count("*").alias("n"), F.min(F.size("v")).alias("shortest"), F.max(F.size("v")).alias("longest"), F.max(F.array_max(F.transform("v", F.abs))).alias("largest")).first()
    if seen.n and seen.shortest != seen.longest:
        raise ValueError(f"vectors have {seen.shortest} to {seen.longest} components; they must have as many each")
    if (seen.largest or 0) > most:
        raise ValueError(f"a component times {scale} is {seen.largest:g}; sums of products are exact up to {most}")
    return rows.withColumn("v", F.col("v").cast("array<int>")), seen.n, seen.longest or 0, int(seen.largest or 0)


@dataclass
class Codebooks:
    """The entries of every part position (parts, entries, width), and what the last round says of their balls.

    ``near[p][i]`` are the neighbour entries of entry i by squared distance, ``apart[p][i]`` those squared distances; ``still[p][i]``
    says that neither the entry nor a neighbour moved. Before the first round there are no balls, and ``near`` is None.
    """

    entries: np.ndarray
    near: list[list[np.ndarray]] | None = None
    apart: list[list[np.ndarray]] | None = None
    still: np.ndarray | None = None

    @staticmethod
    def of(entries: np.ndarray, radius: np.ndarray, moved: np.ndarray) -> Codebooks:
        """Balls around the entries; ``radius`` (parts, entries) is no less than the distance of any part in the ball, -1 for empty ones."""
        near, apart, still = [], [], np.zeros(radius.shape, bool)
        for p, book in enumerate(entries):
            squares = (book * book).sum(1)
            between = squares[:, None] - 2 * (book @ book.T) + squares[None]
            order = np.argsort(between, axis=1, kind="stable")
            near.append([])
            apart.append([])
            for i, row in enumerate(order):
                row = row[row != i]
                row = row[: np.searchsorted(between[i, row], 4 * radius[p, i] ** 2, side="right")] if radius[p, i] >= 0 else row[:0]
                near[p].append(row)
                apart[p].append(between[i, row])
                still[p, i] = not moved[p, i] and not moved[p, row].any()
        return Codebooks(entries, near, apart, still)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _keys(x: np.ndarray, entries: np.ndarray, places: np.ndarray, count: int, kind: type) -> np.ndarray:
    """Squared distance * count + place of every row of x from the entries at these places: the least key is the nearest, ties by place."""
    x, c = x.astype(kind), entries[places].astype(kind)
    squares = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None]
    return squares * count + places.astype(kind)[None]


def nearest(x: np.ndarray, books: Codebooks, p: int, now: np.ndarray | None, kind: type) -> np.ndarray:
    """The place of the nearest entry of codebook p for each row of x, by its entry in the round before (``now``)."""
    entries = books.entries[p]
    count = len(entries)
    if books.near is None or now is None:
        return _keys(x, entries, np.arange(count), count, kind).argmin(1)
    out = now.copy()
    gap = x - entries[now]
    own = (gap * gap).sum(1)
    order = np.argsort(now, kind="stable")
    starts = np.searchsorted(now[order], np.arange(count + 1))
    for i in np.flatnonzero(np.diff(starts)):
        if books.still[p, i] or not len(books.near[p][i]):
            continue
        rows = order[starts[i] : starts[i + 1]]
        ring = np.searchsorted(books.apart[p][i], 4 * own[rows], side="right")
        rows, ring = rows[ring > 0], ring[ring > 0]  # the others are in the stable core
        if not len(rows):
            continue
        places = books.near[p][i][: ring.max()]
        keys = _keys(x[rows], entries, places, count, kind)
        keys[np.arange(len(places))[None] >= ring[:, None]] = np.inf if kind is np.float64 else np.iinfo(np.int64).max
        best = keys.argmin(1)
        mine = own[rows].astype(kind) * count + i
        out[rows] = np.where(keys[np.arange(len(rows)), best] < mine, places[best], i)
    return out


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    """An Arrow column of lists of one length as a matrix of 64-bit integers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows, -1 if rows else 0)


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    rows, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(matrix.ravel(), kind))


def _assigned(table: DataFrame, books: Codebooks, kind: type) -> DataFrame:
    """The table with each part's nearest entry in ``codes``."""
    shared = table.sparkSession.sparkContext.broadcast(books)  # parts * entries entries and their neighbours: bounded

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        parts, _, width = books.entries.shape
        for batch in batches:
            n = batch.num_rows
            x = _matrix(batch.column("v"), n).reshape(n, parts, width)
            now = _matrix(batch.column("codes"), n) if n and len(batch.column("codes").flatten()) else None
            codes = np.stack([nearest(x[:, p], books, p, None if now is None else now[:, p], kind) for p in range(parts)], axis=1).reshape(n, parts)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("v"), _lists(codes, pa.int32())], names=["vec_id", "label", "v", "codes"])

    return table.mapInArrow(assign, CODED)


def _balls(table: DataFrame, books: Codebooks) -> DataFrame:
    """(p, entry, n, square, sums): parts of each ball, their largest squared distance and componentwise sums; each task adds up its own first."""
    shared = table.sparkSession.sparkContext.broadcast(books.entries)
    schema = "p int, entry int, n long, square long, sums array<long>"

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = shared.value
        parts, count, width = entries.shape
        n, square, sums = np.zeros((parts, count), np.int64), np.full((parts, count), -1, np.int64), np.zeros((parts, count, width), np.int64)
        for batch in batches:
            rows = batch.num_rows
            x, codes = _matrix(batch.column("v"), rows).reshape(rows, parts, width), _matrix(batch.column("codes"), rows).reshape(rows, parts)
            for p in range(parts):
                n[p] += np.bincount(codes[:, p], minlength=count)
                gap = x[:, p] - entries[p, codes[:, p]]
                np.maximum.at(square[p], codes[:, p], (gap * gap).sum(1))
                np.add.at(sums[p], codes[:, p], x[:, p])
        p, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[p, entry]), pa.array(square[p, entry]), _lists(sums[p, entry].reshape(len(p), width), pa.int64())], names=["p", "entry", "n", "square", "sums"])

    own = table.select("v", "codes").mapInArrow(gather, schema)
    width = books.entries.shape[2]
    added = own.groupBy("p", "entry").agg(F.sum("n").alias("n"), F.max("square").alias("square"), *[F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(width)])
    return added.select("p", "entry", "n", "square", F.array(*[f"s{k}" for k in range(width)]).cast("array<long>").alias("sums"))


def _moved(books: Codebooks, balls: DataFrame) -> Codebooks:
    """Entries replaced by floor(sum / count); unused ones stay. At most parts * entries rows come to the driver."""
    entries, radius = books.entries.copy(), np.full(books.entries.shape[:2], -1, np.int64)
    for r in balls.collect():
        entries[r.p, r.entry] = np.floor_divide(np.array(r.sums, dtype=np.int64), r.n)
        gap = entries[r.p, r.entry] - books.entries[r.p, r.entry]
        radius[r.p, r.entry] = math.isqrt(r.square) + math.isqrt(int((gap * gap).sum())) + 2  # of the old ball, and how far it moved
    return Codebooks.of(entries, radius, (entries != books.entries).any(2))


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks | None]:
    """((vec_id, label, v, codes, error), codebooks): v are the vectors in whole numbers, codes the nearest entry of each part, error the squared distances summed.

    Rows whose vector is null or holds null or non-finite components go. Each codebook starts as that part of the vectors of the
    smallest ids (repeated ids by their components, null ids last); all rows are fitted on. Repeated rows count as often as they are
    there. Of an empty table the result is empty and there are no codebooks. Further columns are ignored, whatever their names.
    Vectors of different lengths, a length that the parts don't divide, or components too large for exact sums raise ValueError.
    """
    plain = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("embedding"))
    # keys are squares * entries + place: below 2^53 they are exact as doubles, below 2^62 as integers
    rows, n, length, largest = whole_rows(plain, scale, 1 << 22, F.col("vec_id"), F.col("label"))
    if length % parts:
        raise ValueError(f"{length} components can't be cut into {parts} equal parts")
    if not n:
        return rows.select("*", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error")).where("false"), None
    width = length // parts
    top = (width + 1) * 4 * (largest + 1) ** 2 * (entries + 1)
    if top >= 1 << 62:
        raise ValueError(f"squared distances over {width} components of up to {largest} are too large")
    kind = np.float64 if top < 1 << 53 else np.int64
    seeds = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    books = Codebooks(np.array([r.v for r in seeds], dtype=np.int64).reshape(len(seeds), parts, width).transpose(1, 0, 2).copy())
    old, table = None, rows.withColumn("codes", F.array().cast("array<int>"))
    for _ in range(rounds):
        with scratch() as new:
            table = settle(_assigned(table, books, kind), "vector-codes")
        if old:
            release(vectors.sparkSession, old)
        old = new
        books = _moved(books, _balls(table, books))
    final = settle(_with_error(_assigned(table, books, kind), books), "vector-codes")
    if old:
        release(vectors.sparkSession, old)
    return final, books


def _with_error(table: DataFrame, books: Codebooks) -> DataFrame:
    shared = table.sparkSession.sparkContext.broadcast(books.entries)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = shared.value
        parts, _, width = entries.shape
        for batch in batches:
            rows = batch.num_rows
            x, codes = _matrix(batch.column("v"), rows).reshape(rows, parts, width), _matrix(batch.column("codes"), rows).reshape(rows, parts)
            gap = x - entries[np.arange(parts)[None], codes]
            yield batch.append_column("error", pa.array((gap * gap).sum((1, 2))))

    return table.mapInArrow(measure, f"{CODED}, error long")


def label_errors(coded: DataFrame) -> DataFrame:
    """Adds label_error: the error summed over rows of equal label, null labels together.

    Sums are made before the shuffle and written, so that Spark knows their size: few are sent to all tasks, many are joined, where
    adaptive execution can split a label with many rows.
    """
    sums = settle(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "vector-label-errors")
    return coded.join(sums, coded["label"].eqNullSafe(sums["_label"])).drop("_label")

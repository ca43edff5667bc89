"""Document fingerprints: bottom-k sketches of word shingles.

A sketch is the k smallest distinct hashes of a text's shingles, in order. Sketches of parts merge into that of the whole (with the
shingles across the cut), and two of them estimate the resemblance, the containment and the number of distinct shingles of their texts;
of texts with k shingles at most they hold all, and the figures are exact but for collisions of 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallywright.llm.common import in_slices

WORDS, K = 5, 128

_WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Characters that are looked at together; words that a task remembers the hashes of; documents put out together.
PIECE, REMEMBERED, AT_ONCE = 1 << 20, 1 << 18, 512

#: Bytes of text of a block of neighbours, and how many blocks there are at least and at most; keys drawn for each block's bound.
BLOCK_BYTES, LEAST_BLOCKS, MOST_BLOCKS, DRAWN = 32 << 20, 64, 1 << 16, 20

_LARGEST = 2.0**64


class Sketcher:
    """Makes sketches as unsigned 64-bit integers in ascending order; words' hashes are remembered, in bounded number."""

    def __init__(self, words: int = WORDS, k: int = K):
        self.words, self.k, self.known = words, k, {}

    def hashes(self, text: str) -> np.ndarray:
        """A hash of each word of the text."""
        known, words = self.known, _WORD.findall(text)
        new = set(words).difference(known)
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = set(words)
        known.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def shingles(self, words: np.ndarray) -> np.ndarray:
        """Hashes of the shingles of hashed words, in order; of all words together if there are too few for one."""
        n = min(self.words, len(words))
        if not n:
            return np.zeros(0, np.uint64)
        out = np.full(len(words) - n + 1, n, np.uint64)
        for i in range(n):
            out = _mixed(out ^ words[i : len(words) - n + 1 + i])
        return out

    def sketch(self, text: str) -> np.ndarray:
        """Long texts are sketched in pieces that end between words; a piece begins with the last words of the one before."""
        if len(text) <= PIECE:
            return self.smallest(self.shingles(self.hashes(text)))
        out, carried, at = np.zeros(0, np.uint64), np.zeros(0, np.uint64), 0
        while at < len(text):
            end = at + PIECE
            if end < len(text):
                gap = re.compile(r"[\x20\x09-\x0D]").search(text, end)
                end = gap.start() if gap else len(text)
            words = np.concatenate([carried, self.hashes(text[at:end])])
            if len(words) >= self.words:
                out = self.merged(out, self.smallest(self.shingles(words)))
                carried = words[len(words) - self.words + 1 :]
            else:
                carried = words
            at = end
        return out if len(out) else self.smallest(self.shingles(carried))

    def smallest(self, hashes: np.ndarray) -> np.ndarray:
        return np.unique(hashes)[: self.k]

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.smallest(np.concatenate([a, b]))

    def likeness(self, a: np.ndarray, b: np.ndarray) -> float:
        """Estimated resemblance (Jaccard similarity): the part of the smallest hashes of both that both have; 1 for two empty sketches."""
        if not len(a) or not len(b):
            return float(len(a) == len(b))
        both = np.sort(np.concatenate([a, b]))
        twice = both[1:] == both[:-1]
        first = np.concatenate([[True], ~twice])
        last = np.flatnonzero(first)[: self.k]
        return float(np.concatenate([twice, [False]])[last].sum() / len(last))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit over all 64, so that order and place of words matter."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _signed(hashes: np.ndarray) -> np.ndarray:
    """Unsigned hashes as signed integers in the same order."""
    return (hashes ^ np.uint64(1 << 63)).view(np.int64)


def sketches(docs: DataFrame, text_col: str = "text", words: int = WORDS, k: int = K, out: str = "sketch") -> DataFrame:
    """docs with the sketch of each text in ``out`` (array<long>, ascending; hashes less 2^63). A null text counts as empty; a sketch of no words is empty."""

    @F.arrow_udf("array<long>")
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sketcher = Sketcher(words, k)
        for batch in batches:
            yield in_slices(batch, lambda texts: pa.array([_signed(sketcher.sketch(t or "")) for t in texts], pa.list_(pa.int64())))

    return docs.withColumn(out, made(F.coalesce(F.col(text_col), F.lit(""))))


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both texts' shingles together."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def merge_sketches(rows: DataFrame, keys: list[str], sketch_col: str = "sketch", k: int = K) -> DataFrame:
    """(keys, sketch) of rows (keys, sketch): the merged sketch of each group; null keys are a group.

    Each of a group's k smallest hashes is among the k smallest of some part of it, so groups with many rows are ranked in parts first.
    """
    each = rows.select(*keys, F.explode_outer(sketch_col).alias("_h")).distinct()  # a row without a hash keeps the groups of empty sketches
    order = F.col("_h").asc_nulls_last()
    few = each.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, F.pmod(F.xxhash64("_h"), F.lit(64))).orderBy(order))).where(F.col("_r") <= k)
    least = few.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("_r") <= k)
    return least.groupBy(*keys).agg(F.array_sort(F.collect_list("_h")).alias(sketch_col))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of two sketches: 1 if both are empty."""
    both = merge(a, b, k)
    shared = F.size(F.array_intersect(F.array_intersect(a, b), both))
    return F.when(F.size(both) == 0, 1.0).otherwise(shared / F.size(both))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: as many as hashes while there are fewer than k, else (k - 1) over the part of all hashes up to the k-th."""
    last = F.element_at(a, k).cast("double") + 2.0**63
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * _LARGEST / (last + 1))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated part of a's distinct shingles that b has too (0 to 1): 1 if a is empty."""
    j = resemblance(a, b, k)
    both = j * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


_KEY = ("_none", "_down", "_hash")


def _keyed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with the key of their order: descending ids, null ids last, rows of one id by their texts' hashes."""
    return docs.withColumns({"_none": F.col("doc_id").isNull(), "_down": F.bitwise_not(F.coalesce("doc_id", F.lit(0))), "_hash": F.xxhash64("text")})


def _bounds(keyed: DataFrame) -> list[tuple[bool, int, int]]:
    """Sorted keys that cut the rows into blocks of about BLOCK_BYTES; they are drawn by chance, so only blocks' sizes depend on the draw."""
    seen = keyed.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = min(MOST_BLOCKS, max(LEAST_BLOCKS, -(-(seen.bytes or 0) // BLOCK_BYTES)))
    fraction = min(1.0, DRAWN * blocks / max(1, seen.n))
    drawn = sorted(tuple(r) for r in keyed.select(*_KEY).sample(fraction, seed=1).collect())  # DRAWN * MOST_BLOCKS keys or so at most
    return sorted({drawn[i * len(drawn) // blocks] for i in range(1, blocks)}) if drawn else []


def _keys(keys: list[tuple[bool, int, int] | None]) -> Column:
    """Keys as one constant array."""
    return F.from_json(F.lit(json.dumps([k and {"n": k[0], "d": k[1], "h": k[2]} for k in keys])), "array<struct<n:boolean,d:long,h:long>>")


def _block(key: Column, bounds: list[tuple[bool, int, int]]) -> Column:
    """How many bounds are at or before a row's key, by halving the bounds again and again."""
    if not bounds:
        return F.lit(0)
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(bounds)) & (F.get(_keys(bounds), at + step - 1) <= key), at + step).otherwise(at))


def with_next(docs: DataFrame, work: Callable[[list[tuple[int | None, str, str]]], pa.RecordBatch], schema: str) -> DataFrame:
    """What ``work`` makes of documents and the ones that follow them by descending id (the first follows the last).

    ``work`` gets triples (doc_id, text, next text) and gives an Arrow batch for some of them. Texts are shuffled once: rows go to
    blocks of neighbours, and a block's first document goes to the block before it too, behind its rows. Blocks are read in order,
    with one document held at a time. Blocks' bounds are fixed before, so a repeated task sees the same rows.
    """
    key = F.struct(*[F.col(c).alias(a) for c, a in zip(_KEY, "ndh", strict=True)])
    keyed = _keyed(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    bounds = _bounds(keyed)
    placed = keyed.withColumn("_block", _block(key, bounds))
    heads = [(r[0], tuple(r[1])) for r in placed.groupBy("_block").agg(F.min(key).alias("head")).orderBy("_block").collect()]  # a row a block
    first, before = [None] * (len(bounds) + 1), [0] * (len(bounds) + 1)
    for i, (block, head) in enumerate(heads):
        first[block], before[block] = head, heads[i - 1][0]
    own = F.struct(F.col("_block").alias("block"), F.lit(False).alias("behind"))
    also = F.struct(F.get(F.from_json(F.lit(json.dumps(before)), "array<int>"), F.col("_block")).alias("block"), F.lit(True).alias("behind"))
    to = F.when(key == F.get(_keys(first), F.col("_block")), F.array(own, also)).otherwise(F.array(own))
    dealt = placed.select("doc_id", "text", *_KEY, F.explode(to).alias("_to")).select("doc_id", "text", *_KEY, "_to.*")
    ordered = dealt.repartitionById(len(bounds) + 1, "block").sortWithinPartitions("block", "behind", *_KEY, "text")

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ready, chars = None, [], 0
        for batch in batches:
            ids, texts, blocks, behind = (batch.column(c) for c in ("doc_id", "text", "block", "behind"))
            for i in range(batch.num_rows):
                text, block = texts[i].as_py(), blocks[i].as_py()
                if held and held[2] == block:
                    ready.append((held[0], held[1], text))
                    chars += len(text)
                held = None if behind[i].as_py() else (ids[i].as_py(), text, block)
                if len(ready) >= AT_ONCE or chars >= PIECE:
                    yield work(ready)
                    ready, chars = [], 0
        if ready:
            yield work(ready)

    return ordered.select("doc_id", "text", "block", "behind").mapInArrow(follow, schema)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, k: int = K) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each document.

    The edited text is the text whose last floor(n_chars / 2) code points are replaced by the first as many (or all) of the next
    document by descending id. A fingerprint is the sketch's hashes as 16 hexadecimal digits each; near_edited and near_next are the
    likeness to the edited text's and to the next document's. A null text is the empty text, whose fingerprint is empty; two empty
    fingerprints are alike, an empty one and another aren't. Null ids come last; rows of one id stand in the order of their texts'
    hashes. A single document is its own next. Of an empty table the result is empty; further columns are ignored, whatever their names.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketcher, last = Sketcher(words, k), [None, None]

    def work(rows: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
        out = []
        for doc_id, text, then in rows:
            own = last[1] if last[0] == text else sketcher.sketch(text)
            half = len(text) // 2
            edited = text[: len(text) - half] + then[:half]
            changed, following = sketcher.sketch(edited), sketcher.sketch(then)
            last[:] = then, following
            out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), own.byteswap().tobytes().hex(), changed.byteswap().tobytes().hex(), sketcher.likeness(own, changed), sketcher.likeness(own, following)))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return with_next(plain, work, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

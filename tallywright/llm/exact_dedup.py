"""Exact duplicates by deterministic block naming.

Each text is cut into fixed-size blocks of bytes. The distinct blocks are dealt out by a hash and sorted; their places become the
blocks' integer names. Then adjacent pairs of names are sorted and named, level by level, until every document has one name. Two documents have the same (level, name) if and only if their texts are identical. A row is known by its id and the SHA-256
of its text, so that rows of one id with different texts stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallywright.llm.common import BUCKETS, bucket_of, reclaim, settle

BLOCK_BYTES = 4096

#: Stands for the missing second half of a pair; no block or pair has this name.
NO_HALF = -1


def _hash(col: str) -> Column:
    return F.xxhash64(col)


def _named(distinct: DataFrame, cols: list[str]) -> DataFrame:
    """Adds ``name``: the row's rank in sorted order of the columns inside a bucket of their hash, interleaved with the bucket; a function of the distinct rows alone."""
    dealt = distinct.withColumn("_bucket", bucket_of(*cols))
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(*cols)).cast("long")
    return dealt.withColumn("name", rank * BUCKETS + F.col("_bucket")).drop("_bucket")


def _blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    raw = docs.select("doc", F.col("text").cast("binary").alias("raw")).withColumn("n", F.greatest(F.lit(1), F.ceil(F.octet_length("raw") / F.lit(block_bytes))).cast("int"))
    cut = raw.select("doc", "n", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring(F.col("raw"), i * block_bytes + 1, F.lit(block_bytes)))).alias("pos", "block"))
    return cut.withColumn("h", _hash("block"))


def _block_names(blocks: DataFrame) -> DataFrame:
    """(doc, n, pos, name) of the first level: the distinct blocks are shuffled once and sorted, and their places are the names.

    A place is partition and rank in it, fixed when the names are written. Blocks find their names by a hash of their content; where
    contents share a hash they get names below NO_HALF and are found by content.
    """
    place = F.monotonically_increasing_id()
    names = settle(blocks.select("h", "block").distinct().sortWithinPartitions("block").select("h", place.alias("name")), "exact-names")
    reclaim(blocks.sparkSession)
    twins = names.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h")
    if twins.isEmpty():
        return blocks.drop("block").join(names, "h").select("doc", "n", "pos", "name")
    twins = settle(twins, "exact-twins")
    contents = settle(blocks.join(twins, "h", "left_semi").select("h", "block").distinct().sortWithinPartitions("block").select("h", "block", (NO_HALF - 1 - place).alias("name")), "exact-contents")
    alone = blocks.join(twins, "h", "left_anti").drop("block").join(names, "h").select("doc", "n", "pos", "name")
    return alone.union(blocks.join(contents, ["h", "block"]).select("doc", "n", "pos", "name"))


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc, level, name) for docs (doc, text): equal level and name mean equal text. Null texts count as empty."""
    level = settle(_block_names(_blocks(docs.withColumn("text", F.coalesce("text", F.lit(""))), block_bytes)), "exact-level")
    done, depth = level.where("n = 1").select("doc", F.lit(0).alias("level"), "name"), 0
    while not (rest := level.where("n > 1")).isEmpty():
        depth += 1
        half = F.shiftright("pos", 1)
        pairs = rest.groupBy("doc", half.alias("pos"), F.shiftright(F.col("n") + 1, 1).alias("n")).agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("l"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(NO_HALF)).alias("r"))
        pairs = settle(pairs, "exact-pairs")
        names = settle(_named(pairs.select("l", "r").distinct(), ["l", "r"]), "exact-names")
        level = settle(pairs.join(names, ["l", "r"]).select("doc", "n", "pos", "name"), "exact-level")
        done = done.union(level.where("n = 1").select("doc", F.lit(depth).alias("level"), "name"))
    return done.distinct()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays. A null text is the empty text. A null id loses against any other; if all ids
    of a group are null, keep_id is null and one such row stays. Repeated rows (same id and text) all count and one of them stays.
    An empty table gives an empty result; further columns of docs are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("text_sha256", F.sha2("text", 256))
    keyed = rows.select(F.struct("doc_id", "text_sha256").alias("doc"), "text")
    copies = rows.groupBy("doc_id", "text_sha256").agg(F.count("*").alias("copies")).select(F.struct("doc_id", "text_sha256").alias("doc"), "copies")
    named = settle(identities(keyed, block_bytes).join(copies, "doc"), "exact-named")
    # written first, so that adaptive execution can split the join where a group is large
    groups = settle(named.groupBy("level", "name").agg(F.max("doc.doc_id").alias("keep_id"), F.sum("copies").alias("group_size")), "exact-groups")
    out = named.join(groups, ["level", "name"]).select("doc.doc_id", "keep_id", "group_size", "doc.text_sha256", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return out.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    verdict = exact_dedup(docs, id_col, text_col, block_bytes).where("kept").select(F.struct(F.col("doc_id"), F.col("text_sha256")).alias("_doc"))
    keyed = docs.select(F.struct("*").alias("_row"), F.struct(F.col(id_col).alias("doc_id"), F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256).alias("text_sha256")).alias("_doc"))
    return keyed.join(verdict, "_doc", "left_semi").dropDuplicates(["_doc"]).select("_row.*")

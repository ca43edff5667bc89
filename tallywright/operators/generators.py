"""Long-context samples: needles in a haystack, chains of variables, common and frequent words. All a function of seed and id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallywright.operators.datasets import draw
from tallywright.operators.ranking import positioned


def drawn(*parts: Column | str) -> Column:
    """A number below 2^32 drawn from the parts, the same everywhere: the first digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def number_of(digits: int, *parts: Column) -> Column:
    """A number of so many digits, drawn from the parts."""
    low = 10 ** (digits - 1)
    return (drawn(*parts) % (9 * low) + low).cast("string")


def needles(spark: SparkSession, n: int, haystack: int, keys: int = 4, asked: int = 1, seed: int = 0) -> DataFrame:
    """(sample_id, input, outputs): ``keys`` needles at drawn depths among so many filler sentences; the first ``asked`` are asked for."""
    filler = F.lit("The grass is green. The sky is blue. The sun is yellow. Here we go. There and back again.")
    ids = F.sequence(F.lit(0), F.lit(keys - 1))
    rows = spark.range(n).select(F.col("id").alias("sample_id")).withColumn("needles", F.transform(ids, lambda i: F.struct((drawn(F.lit(seed), "sample_id", i) % (haystack + 1)).alias("depth"), F.concat(F.lit("key-"), number_of(5, F.lit(seed), F.col("sample_id"), i)).alias("key"), number_of(7, F.lit(seed + 1), F.col("sample_id"), i).alias("value"))))

    def said(d: Column) -> Column:
        return F.transform(F.filter("needles", lambda x: x["depth"] == d), lambda x: F.concat(F.lit("One of the special magic numbers for "), x["key"], F.lit(" is: "), x["value"], F.lit(".")))

    lines = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(haystack)), lambda d: F.when(d < haystack, F.concat(said(d), F.array(filler))).otherwise(said(d))))
    queries = F.slice("needles", 1, asked)
    return rows.select("sample_id", F.concat(F.array_join(lines, "\n"), F.lit("\nWhat are the special magic numbers for "), F.array_join(F.transform(queries, lambda x: x["key"]), ", "), F.lit(" mentioned in the provided text?")).alias("input"), F.transform(queries, lambda x: x["value"]).alias("outputs"))


def chains(spark: SparkSession, n: int, num_chains: int = 2, hops: int = 4, seed: int = 0) -> DataFrame:
    """(sample_id, input, outputs): assignments along each chain in order, chains interleaved by draw; outputs are the first chain's names."""
    each = spark.range(n).select(F.col("id").alias("sample_id"), F.explode(F.sequence(F.lit(0), F.lit(num_chains - 1))).alias("chain")).select("*", F.explode(F.sequence(F.lit(0), F.lit(hops))).alias("hop"))
    name = lambda hop: F.translate(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "sample_id", "chain", hop)), 1, 5), "0123456789abcdef", "ABCDEFGHIJKLMNOP")
    value = number_of(5, F.lit(seed), F.col("sample_id"), F.col("chain"))
    line = F.when(F.col("hop") == 0, F.concat(F.lit("VAR "), name(F.col("hop")), F.lit(" = "), value)).otherwise(F.concat(F.lit("VAR "), name(F.col("hop")), F.lit(" = VAR "), name(F.col("hop") - 1)))
    # sorted draws of a chain belong to its hops in order: each chain keeps its order among the others
    drawn = each.withColumn("line", line).withColumn("name", name(F.col("hop"))).withColumn("code", draw(seed, "sample_id", "chain", "hop"))
    slot = Window.partitionBy("sample_id", "chain").orderBy("code")
    codes = drawn.select("sample_id", "chain", (F.row_number().over(slot) - 1).alias("hop"), F.col("code").alias("at"))
    rows = drawn.join(codes, ["sample_id", "chain", "hop"]).groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("lines"), F.array_sort(F.collect_list(F.when(F.col("chain") == 0, F.struct("hop", "name")))).alias("names"))
    return rows.select("sample_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("input"), F.transform("names", lambda x: x["name"]).alias("outputs"))


def numbered(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """Adds ``position``: the rows' places, from 0, in an order drawn by the seed."""
    code = draw(seed, key)
    return positioned(rows, [], F.substring(code, 1, 3), [code, F.col(key)])


def common_words(words: DataFrame, n: int, common: int = 10, uncommon: int = 40, often: int = 30, seldom: int = 3, seed: int = 0) -> DataFrame:
    """(sample_id, input, outputs): of a vocabulary (word), so many words come often and others seldom, in drawn order, numbered."""
    rank = F.row_number().over(Window.partitionBy("sample_id").orderBy("code"))
    ids = words.sparkSession.range(n).select(F.col("id").alias("sample_id"))
    vocabulary = numbered(words.select("word").where("word is not null").distinct(), "word", seed)
    total = vocabulary.count()
    n_drawn = min(total, common + uncommon)
    # Floyd's draw without repeats: of 0..j a place by hash, or j itself if that one is taken
    last = lambda i: F.lit(total - n_drawn) + i
    place = lambda i: drawn(F.lit(seed), "sample_id", i) % (last(i) + 1)
    places = F.aggregate(F.sequence(F.lit(0), F.lit(n_drawn - 1)).cast("array<long>"), F.array().cast("array<long>"), lambda taken, i: F.array_append(taken, F.when(F.array_contains(taken, place(i)), last(i)).otherwise(place(i)))) if n_drawn else F.array().cast("array<long>")
    chosen = ids.withColumn("position", F.explode(places)).join(vocabulary, "position").withColumn("code", draw(seed, "sample_id", "word")).withColumn("rank", rank)
    copies = chosen.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("rank") <= common, F.lit(often)).otherwise(F.lit(seldom))))).withColumn("at", draw(seed, "sample_id", "word", "copy"))
    rows = copies.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("list"), F.array_sort(F.collect_set(F.when(F.col("rank") <= common, F.col("word")))).alias("outputs"))
    return rows.select("sample_id", F.array_join(F.transform("list", lambda x, i: F.concat(i + 1, F.lit(". "), x["word"])), " ").alias("input"), "outputs")


def frequent_words(spark: SparkSession, n: int, tokens: int = 600, vocabulary: int = 50, alpha: float = 2.0, seed: int = 0) -> DataFrame:
    """(sample_id, input, outputs): coded words as often as a Zipf law says; the commonest is an ellipsis, the next three are asked for."""
    ranks = F.sequence(F.lit(0), F.lit(vocabulary - 1))
    total = sum(1 / (r + 1) ** alpha for r in range(vocabulary))
    each = spark.range(n).select(F.col("id").alias("sample_id"), F.explode(ranks).alias("rank"))
    coded = F.translate(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "sample_id", "rank")), 1, 6), "0123456789abcdef", "bcdfghjklmnpqrst")
    each = each.withColumn("word", F.when(F.col("rank") == 0, "...").otherwise(coded)).withColumn("k", F.floor(F.lit(tokens / total) / F.pow(F.col("rank") + 1, F.lit(alpha))).cast("int")).where("k > 0")
    copies = each.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("k")))).withColumn("at", draw(seed, "sample_id", "rank", "copy"))
    rows = copies.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("list"), F.array_sort(F.collect_set(F.when(F.col("rank").between(1, 3), F.struct("rank", "word")))).alias("top"))
    return rows.select("sample_id", F.array_join(F.transform("list", lambda x: x["word"]), " ").alias("input"), F.transform("top", lambda x: x["word"]).alias("outputs"))


def with_distractors(questions: DataFrame, documents: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """questions (sample_id, gold) with k drawn documents (doc_id) beside the gold one, in drawn order, as ``context`` of ids.

    Documents are numbered in a drawn order; a question takes k + 1 that follow each other from a drawn place on, round the end,
    and leaves out the gold one or the last. It has fewer than k only where there are no more documents.
    """
    pool = numbered(documents.select("doc_id").where("doc_id is not null").distinct(), "doc_id", seed)
    total = pool.count()
    asked = questions.groupBy("sample_id", "gold").agg(F.count("*").alias("times")).withColumn("turns", F.sequence(F.lit(0), F.lit(min(k, total - 1))) if total else F.array().cast("array<int>"))
    start = drawn(F.lit(seed + 2), "sample_id") % max(1, total)
    turned = asked.withColumn("turn", F.explode("turns")).select("sample_id", "gold", "turn", F.pmod(start + F.col("turn"), F.lit(max(1, total))).alias("position"))
    found = turned.join(pool, "position").where(~F.col("doc_id").eqNullSafe(F.col("gold"))).groupBy("sample_id", "gold").agg(F.slice(F.array_sort(F.collect_list(F.struct("turn", "doc_id"))), 1, k).alias("some"))
    found = found.select(F.col("sample_id").alias("_id"), F.col("gold").alias("_gold"), F.transform("some", lambda x: x["doc_id"]).alias("some"))
    dealt = asked.join(found, asked.sample_id.eqNullSafe(found._id) & asked.gold.eqNullSafe(found._gold), "left").withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    others = F.coalesce("some", F.array().cast("array<long>"))
    order = F.transform(F.array_sort(F.transform(F.concat(F.array("gold"), others), lambda d: F.struct(F.md5(F.concat_ws(":", F.lit(seed), "sample_id", d)).alias("at"), d.alias("d")))), lambda x: x["d"])
    return dealt.select("sample_id", "gold", order.alias("context"))

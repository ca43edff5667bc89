"""Operations on splits, over the documents and the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.operators import datasets
from tallywright.plans.catalogue import query
from tallywright.sources.tables import table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")


@query("filter_semi", "select doc_id, lang from documents where doc_id in (select doc_id from labels where quality = 1)")
def filter_semi(spark: SparkSession, d: str) -> DataFrame:
    return datasets.filtered(_docs(spark, d), table(spark, d, "labels").where("quality = 1"), ["doc_id"]).select("doc_id", "lang")


@query("filter_composite", "select doc_id, lang, source from documents where (lang, source) in (select lang, source from documents join labels using (doc_id) where toxic = 1)")
def filter_composite(spark: SparkSession, d: str) -> DataFrame:
    keys = _docs(spark, d).join(table(spark, d, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    return datasets.filtered(_docs(spark, d), keys, ["lang", "source"]).select("doc_id", "lang", "source")


@query("filter_unmatched", "select distinct item_id as doc_id from benchmark where item_id not in (select doc_id from labels)")
def filter_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return datasets.unmatched(table(spark, d, "labels"), table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id")), ["doc_id"])


@query("slice", "select doc_id, source from documents order by doc_id limit 50")
def slice_(spark: SparkSession, d: str) -> DataFrame:
    return datasets.sliced(_docs(spark, d), 50, "doc_id").select("doc_id", "source")


@query("shuffle", "select doc_id, row_number() over (order by md5('7:' || doc_id), doc_id) - 1 as position from documents")
def shuffle(spark: SparkSession, d: str) -> DataFrame:
    return datasets.shuffled(_docs(spark, d), "doc_id", 7).select("doc_id", "position")


@query("repeat", "select item_id, repeat_index::int as repeat_index from benchmark cross join range(4) r(repeat_index)")
def repeat(spark: SparkSession, d: str) -> DataFrame:
    return datasets.repeated(table(spark, d, "benchmark").select("item_id"), 4)


PICK = "select doc_id, source from (select d.*, row_number() over (partition by d.source order by md5('7:' || coalesce(d.source, '') || ':' || doc_id), doc_id) as r from documents d) join alloc using (source) where r <= alloc"


@query("stratified_num", f"""with s as (select source, count(*) as size from documents group by 1), t as (select *, least(size, 2) as least, greatest(100, sum(least(size, 2)) over ()) as want, sum(size) over () as total from s),
  q as (select *, size::double * least(want, total) / total as quota, least(want, total) as target from t), seats as (select source, quota - seat + 1 as lack, row_number() over (order by quota - seat + 1 desc, source) as r, target - sum(least) over (partition by 0) * 0 as target from q, lateral (select unnest(range(least + 1, size + 1)) as seat)),
  open as (select source, count(*) as more from seats where r <= target - (select sum(least) from t) group by 1), alloc as (select source, least + coalesce(more, 0) as alloc from t left join open using (source)) {PICK}""")
def stratified_num(spark: SparkSession, d: str) -> DataFrame:
    return datasets.stratified(_docs(spark, d), "source", "doc_id", 7, num=100, min_per_group=2).select("doc_id", "source")


@query("stratified_per_group", f"with alloc as (select source, least(count(*), 5) as alloc from documents group by 1) {PICK}")
def stratified_per_group(spark: SparkSession, d: str) -> DataFrame:
    return datasets.stratified(_docs(spark, d), "source", "doc_id", 7, per_group=5).select("doc_id", "source")


@query("stratified_fraction", f"with alloc as (select source, least(count(*), greatest(1, ceil(count(*)::double * 0.1))) as alloc from documents group by 1) {PICK}")
def stratified_fraction(spark: SparkSession, d: str) -> DataFrame:
    return datasets.stratified(_docs(spark, d), "source", "doc_id", 7, fraction=0.1).select("doc_id", "source")


@query("fewshot_prefix", "with f as (select source, doc_id, n_chars, row_number() over (partition by source order by doc_id) as r from documents) select source, string_agg('Document ' || doc_id || ' has ' || n_chars || ' characters.', '\n\n' order by r) as prefix, count(*) as n_examples from f where r <= 3 group by 1 having count(*) = 3")
def fewshot_prefix(spark: SparkSession, d: str) -> DataFrame:
    return datasets.example_prefix(_docs(spark, d), "source", F.concat(F.lit("Document "), "doc_id", F.lit(" has "), "n_chars", F.lit(" characters.")), 3, "doc_id")


@query("fewshot_prompts", "with f as (select source, doc_id, n_chars, row_number() over (partition by source order by doc_id) as r from documents), p as (select source, string_agg(n_chars::varchar, ' ' order by r) as prefix from f where r <= 3 group by 1 having count(*) = 3) select doc_id, prefix || ' ?' as prompt from documents join p using (source)")
def fewshot_prompts(spark: SparkSession, d: str) -> DataFrame:
    prefixes = datasets.example_prefix(_docs(spark, d), "source", F.col("n_chars").cast("string"), 3, "doc_id", " ")
    return _docs(spark, d).join(prefixes, "source").select("doc_id", F.concat("prefix", F.lit(" ?")).alias("prompt"))


@query("exclude_fewshot", "with f as (select doc_id, row_number() over (partition by source order by doc_id) as r from documents) select doc_id from documents where doc_id not in (select doc_id from f where r <= 3)")
def exclude_fewshot(spark: SparkSession, d: str) -> DataFrame:
    return datasets.without(_docs(spark, d), datasets.first_of_group(_docs(spark, d), "source", 3, "doc_id").select("doc_id"), ["doc_id"]).select("doc_id")


@query("union_subsets", "select doc_id as id, text, 'documents' as subset from documents union all select item_id, text, 'benchmark' from benchmark")
def union_subsets(spark: SparkSession, d: str) -> DataFrame:
    docs, items = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    return docs.withColumn("subset", F.lit("documents")).unionByName(items.withColumn("subset", F.lit("benchmark")))


@query("catalogue_filter", "select source, count(*) as n, min(n_chars) as least, max(n_chars) as most from documents where lang in ('en', 'fr') and n_chars > 100 group by 1")
def catalogue_filter(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where(F.col("lang").isin("en", "fr") & (F.col("n_chars") > 100)).groupBy("source").agg(F.count("*").alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))

"""Languages and sentence ends, learned from all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.functions.languages import LONGEST, MOST, Detector, profiles
from tallywright.functions.sentences import stop_scores
from tallywright.plans.catalogue import query
from tallywright.sources.tables import table

GRAMS = rf"""
    words as materialized (select doc_id, lang, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) as w from documents where text is not null),
    counted as (select doc_id, lang, '_' || w || '_' as w, count(*) as k from words group by all),
    grams as materialized (
      select doc_id, lang, substr(w, i, n) as gram, sum(k) as k from (select *, unnest(range(1, {LONGEST + 1})) as n from counted), lateral (select unnest(range(1, length(w) - n + 2)) as i)
      group by doc_id, lang, gram),
    profiles as materialized (
      select lang, gram, row_number() over (partition by lang order by sum(k) desc, gram) as place from grams where lang is not null and doc_id % 5 <> 0 group by lang, gram
      qualify place <= {MOST}),
    own as materialized (select doc_id, gram, row_number() over (partition by doc_id order by k desc, gram) as place from grams qualify place <= {MOST}),
    far as (
      select o.doc_id, l.lang, sum(coalesce(abs(o.place - p.place), {MOST})) as distance
      from own o cross join (select distinct lang from profiles) l left join profiles p on p.lang = l.lang and p.gram = o.gram group by o.doc_id, l.lang)"""


@query("language_distance", f"""
    with {GRAMS}
    select d.doc_id, arg_min(f.lang, (f.distance, f.lang)) as guess, cast(min(f.distance) as bigint) as distance from documents d left join far f using (doc_id) group by d.doc_id""")  # fmt: skip
def language_distance(spark: SparkSession, d: str) -> DataFrame:
    """The language of every document by profiles of those whose id isn't divisible by five."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    detector = Detector(profiles(docs.where("doc_id % 5 <> 0")))
    return docs.select("doc_id", detector.nearest(F.col("text")).alias("near")).select("doc_id", F.col("near.lang").alias("guess"), F.col("near.distance").alias("distance"))


@query("stop_scores", r"""
    with t as (select unnest(regexp_extract_all(lower(text), '\p{L}+(?:\.\p{L}+)*\.?')) as w from documents where text is not null),
    c as (select rtrim(w, '.') as word, count(*) filter (w like '%.') as with_stop, count(*) filter (w not like '%.') as without from t group by 1),
    p as (select sum(with_stop) / sum(with_stop + without) as p from c),
    l as (select *, length(replace(word, '.', '')) as letters from c, p where with_stop > 0)
    select word, with_stop, without, round(2 * (with_stop * (ln(0.99) - ln(p)) + without * (ln(1 - 0.99) - ln(1 - p))) * exp(-letters) * (length(word) - letters + 1) * pow(letters, -without), 6) + 0.0 as score from l""")  # fmt: skip
def stops(spark: SparkSession, d: str) -> DataFrame:
    """How likely each word is an abbreviation, by all documents."""
    return stop_scores(table(spark, d, "documents")).withColumn("score", F.round("score", 6) + F.lit(0.0))

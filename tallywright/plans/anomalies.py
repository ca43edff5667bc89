"""Anomalies of every document read as a sample: its lines are rollouts, its words candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.operators import anomalies
from tallywright.plans.catalogue import query
from tallywright.sources.tables import table

#: The fixture in SQL: lines of a text are rollouts; long ones were cut, those without a digit gave no answer.
OUTCOMES = """lines as (select doc_id, lang, source, text, case when text is null or text = '' then [] else string_split(text, chr(10)) end as x from documents),
  outcomes as (select doc_id, case when lang is null then 'failed' when doc_id % 9 = 0 then 'inferred' else 'final' end as stage, doc_id % 3 as iteration, len(x) = 0 as empty, doc_id % 5 = 0 as lost,
    list_filter(range(len(x)), lambda i: length(x[i + 1]) > 60) as cut, case when doc_id % 4 = 1 then null else list_filter(range(len(x)), lambda i: not regexp_matches(x[i + 1], '[0-9]')) end as missed, doc_id % 4 <> 1 as record, len(x) as n, source from lines)"""
FOUND = OUTCOMES + """, found as (
    select doc_id, iteration, 'empty_infer_gen' as rule, [0] as indices from outcomes where stage = 'final' and empty
    union all select doc_id, iteration, 'truncated_output', cut from outcomes where stage = 'final' and len(cut) > 0
    union all select doc_id, iteration, 'empty_postprocess', [0] from outcomes where stage = 'final' and not record and source is null
    union all select doc_id, iteration, 'extraction_failure', case when n = 0 then [0] else missed end from outcomes where stage = 'final' and record and (n = 0 or len(missed) > 0))"""


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    lines = F.when(F.col("text").isNull() | (F.col("text") == ""), F.array().cast("array<string>")).otherwise(F.split("text", "\n", -1))
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", lines.alias("x"))
    reasons = F.transform("x", lambda t: F.when(F.char_length(t) > 60, "length").otherwise("stop"))
    ranks = F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<double>")).otherwise(F.transform("x", lambda t: -F.char_length(t).cast("double")))
    call = F.struct(F.col("x").alias("texts"), reasons.alias("finish_reasons"), ranks.alias("logprobs"), F.lit(None).cast("array<string>").alias("logprob_tokens"))
    record = F.transform("x", lambda t, i: F.struct(i.alias("index"), t.rlike("[0-9]").alias("extracted")))
    stage = F.when(F.col("lang").isNull(), "failed").when(F.col("doc_id") % 9 == 0, "inferred").otherwise("final")
    return docs.select(
        F.col("doc_id").alias("sample_id"), (F.col("doc_id") % 3).alias("iteration"), stage.alias("stage"), F.array(call).alias("calls"),
        F.col("source").alias("result"), F.when(F.col("doc_id") % 4 != 1, record).alias("rollouts"),
    )


@query("anomaly_details", f"with {FOUND} select doc_id as sample_id, iteration, rule, array_to_string(indices, ',') as indices from found")
def anomaly_details(spark: SparkSession, d: str) -> DataFrame:
    """Every odd sample of a generation task with the rollouts that each rule found."""
    found = anomalies.detected(_outcomes(spark, d), {"gen"})
    return found.withColumn("indices", F.concat_ws(",", F.col("indices").cast("array<string>")))


@query("anomaly_summary", f"""with {FOUND} select 'total_samples' as metric, count(*) as value from outcomes union all select 'final_samples', count(*) from outcomes where stage = 'final' union all select 'failed_samples', count(*) from outcomes where stage = 'failed'
  union all select 'anomaly_samples', count(distinct doc_id) from found union all select 'samples:' || rule, count(distinct doc_id) from found group by rule union all select 'rollouts:' || rule, sum(len(indices))::bigint from found group by rule""")
def anomaly_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the report of a generation task."""
    outcomes = _outcomes(spark, d)
    return anomalies.summary(outcomes, anomalies.detected(outcomes, {"gen"}))


@query("anomaly_candidates", f"""with {OUTCOMES} select doc_id as sample_id, 'empty_infer_ppl' as rule from outcomes where stage = 'final' and (lost or empty) union all select doc_id, 'empty_postprocess' from outcomes where stage = 'final' and not record and source is null
  union all select doc_id, 'extraction_failure' from outcomes where stage = 'final' and record and (n = 0 or len(missed) > 0)""")
def anomaly_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The same outcomes as those of a perplexity task: other rules apply."""
    return anomalies.detected(_outcomes(spark, d), {"ppl"}).select("sample_id", "rule")

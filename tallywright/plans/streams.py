"""Samples as streams: records come in several loads, and the stream is stopped and started again after each."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.plans import sampling  # noqa: F401  whose report this one must equal
from tallywright.plans.catalogue import ORACLE, query
from tallywright.session import shared_folder
from tallywright.sources.tables import rollouts, table
from tallywright.streaming import samples

#: Outcomes of actions, as the fixture reads events: errors fail, every seventh for good; purchases finalise.
OUTCOMES = """w as (select user_id as sample_id, event_id as seq, coalesce(event_type <> 'error', false) as ok, coalesce(event_type = 'purchase', false) as fin, coalesce(event_type = 'error' and json_extract_string(props, '$.k')::int % 7 = 0, false) as never from events where user_id is not null and event_id is not null),
  o as (select *, row_number() over (partition by sample_id order by seq) as i from w)"""


def _in_loads(rows: DataFrame, load: Column, loads: int, schema: str, stream: Callable[[DataFrame], DataFrame], each: Callable[[DataFrame], DataFrame], out: str) -> DataFrame:
    """Writes the rows load by load; after each, a stream that goes on from the last checkpoint takes in what is new."""
    spark, base = rows.sparkSession, f"{shared_folder(rows.sparkSession)}/stream-{uuid.uuid4().hex}"
    columns = [part.split() for part in schema.split(", ")]
    rows.select(*[F.col(name).cast(kind) for name, kind in columns], load.cast("int").alias("load")).write.partitionBy("load").parquet(f"{base}/all")  # made once
    made = spark.read.schema(f"{schema}, load int").parquet(f"{base}/all")
    for k in range(loads):
        made.where(F.col("load") == k).drop("load").write.mode("append").parquet(f"{base}/in")
        fresh = spark.readStream.schema(schema).parquet(f"{base}/in")
        samples.kept(stream(fresh), f"{base}/out", f"{base}/state", each).awaitTermination()
    return samples.parts_of(spark, f"{base}/out", out)


@query("stream_progress", f"""with recursive {OUTCOMES}, s as (
    select distinct sample_id, 0::bigint as i, null::bigint as seq, 0 as iteration, 'initial' as stage, 0 as retry_count, null::varchar as error_action, null::varchar as error_reason from o
    union all
    select s.sample_id, o.i, o.seq, case when ok and stage = 'feedback' and not fin and iteration + 1 < 2 then iteration + 1 else iteration end,
           case when not ok then case when never or retry_count + 1 > 2 then 'failed' else stage end
                when stage = 'initial' then 'preprocessed' when stage = 'preprocessed' then 'inferred' when stage = 'inferred' then 'postprocessed' when stage = 'postprocessed' then 'feedback'
                when fin then 'final' when iteration + 1 >= 2 then 'failed' else 'initial' end,
           case when not ok and not never then retry_count + 1 else retry_count end,
           case when not ok or (stage = 'feedback' and not fin and iteration + 1 >= 2) then case stage when 'initial' then 'preprocess' when 'preprocessed' then 'infer' when 'inferred' then 'postprocess' when 'postprocessed' then 'feedback' else 'finalize' end end,
           case when not ok and never then 'non_retriable' when not ok and retry_count + 1 > 2 then 'retry_limit' when ok and stage = 'feedback' and not fin and iteration + 1 >= 2 then 'iteration_limit' end
    from s join o on o.sample_id = s.sample_id and o.i = s.i + 1 where s.stage not in ('final', 'failed'))
  select sample_id, seq, iteration, stage, retry_count, error_action, error_reason from s where i > 0""")
def stream_progress(spark: SparkSession, d: str) -> DataFrame:
    """The log of all samples from their events' outcomes, which come in four loads by event_id."""
    failed = F.col("event_type") == "error"
    never = F.get_json_object("props", "$.k").cast("int") % 7 == 0
    said = table(spark, d, "events").select(
        F.col("user_id").alias("sample_id"), F.col("event_id").alias("seq"), F.lit(None).cast("string").alias("action"), (~failed).alias("ok"), (F.col("event_type") == "purchase").alias("finalize"), F.when(failed & never, "non_retriable").when(failed, "exception::E").alias("reason"),
    )
    last = said.agg(F.max("seq")).first()[0] or 0  # loads follow each other in seq, as outcomes of a sample do
    load = F.floor(F.col("seq") * 4 / (last + 1))
    return _in_loads(said, load, 4, samples.OUTCOME, lambda s: samples.progressed(s, 2, 2), lambda b: b, samples.RECORD).drop("batch")


@query("stream_report", ORACLE["sampling_report"])
def stream_report(spark: SparkSession, d: str) -> DataFrame:
    """The sampling report of all orders from four loads of verdicts: every second rollout is first judged wrongly, and set right in a later load."""
    once = rollouts(table(spark, d, "lineitem")).select("sample_id", "idx", "correct", F.col("answer").alias("vote"), "extracted")
    late = F.col("idx") % 2 == 1
    twice = once.select("*", F.explode(F.when(late, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))).alias("seq"))
    records = twice.select("sample_id", "idx", F.col("seq").cast("long").alias("seq"), (F.col("correct") != (F.col("seq") == 0)).alias("correct"), F.when(F.col("seq") == 0, "?").otherwise(F.col("vote")).alias("vote"), "extracted")
    load = F.when(F.col("seq") == 0, F.col("idx") % 2).otherwise(1 + F.pmod("idx", F.lit(3)))
    requested = table(spark, d, "orders").count()
    return samples.report_of(_in_loads(records, load, 4, samples.JUDGED, samples.changes, samples.summed, samples.CHANGE), F.lit(requested), 4, 4)

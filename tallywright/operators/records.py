"""What a run leaves behind: records of stages, the stage log, a manifest, the report and the run's identity; and reading them again."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stages after which nothing is to be done.
TERMINAL = ("final", "failed")


def prompt_record(prompt: Column, reference: Column, extra: Column | None = None) -> Column:
    """struct of prompt, reference and extra (map<string,string>), as one stage leaves it for the next."""
    return F.struct(prompt.alias("prompt"), reference.cast("string").alias("reference"), (F.create_map().cast("map<string,string>") if extra is None else extra).alias("extra"))


def prediction_record(predictions: Column) -> Column:
    """array<struct<index, prediction, extracted>> of an array of predictions; null ones weren't extracted."""
    return F.transform(predictions, lambda p, i: F.struct(i.alias("index"), p.cast("string").alias("prediction"), p.isNotNull().alias("extracted")))


def judgement_record(reference: Column, correct: Column, scores: Column | None = None) -> Column:
    """struct of reference and rollouts (index, correct, score) of an array of verdicts and, if given, one of scores of the same length."""
    score = (lambda i: F.get(scores, i).cast("double")) if scores is not None else (lambda i: F.lit(None).cast("double"))
    rollouts = F.transform(correct, lambda c, i: F.struct(i.alias("index"), F.coalesce(c, F.lit(False)).alias("correct"), score(i).alias("score")))
    return F.struct(reference.cast("string").alias("reference"), rollouts.alias("rollouts"))


def call_record(model: Column, finish_reason: Column, input_tokens: Column, output_tokens: Column) -> Column:
    """struct of what a model call says about itself."""
    return F.struct(model.alias("model"), finish_reason.alias("finish_reason"), input_tokens.cast("long").alias("input_tokens"), output_tokens.cast("long").alias("output_tokens"))


def as_json(record: Column) -> Column:
    return F.to_json(record)


def from_record(text: Column, schema: str) -> Column:
    """The record again; null for what can't be read."""
    return F.from_json(text, schema)


def is_terminal(stage: Column) -> Column:
    return stage.isin(*TERMINAL)


def shard_of(sample_id: Column, shards: int) -> Column:
    """The shard that a sample's records belong to, whatever kind of id it has."""
    return F.pmod(F.xxhash64(sample_id.cast("string")), F.lit(shards)).cast("int")


def append_log(log: DataFrame, folder: str, shards: int = 64) -> None:
    """Appends records (sample_id, iteration, stage, ...) as JSON lines, in folders of iteration and stage; a shard's records stand together."""
    log.repartition(shards, shard_of(F.col("sample_id"), shards)).write.mode("append").partitionBy("iteration", "stage").json(folder)


def read_log(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The records of all appends; schema says all columns, iteration and stage included. Lines that can't be read are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(folder)


def manifest(log: DataFrame) -> DataFrame:
    """(iteration, stage, records, samples) of a log: what is there, to be compared with what should be."""
    return log.groupBy("iteration", "stage").agg(F.count("*").alias("records"), F.count_distinct("sample_id").alias("samples"))


def final_and_failed(state: DataFrame) -> DataFrame:
    """One row (finals, fails, open) over the latest state of samples."""
    return state.agg(F.count_if(F.col("stage") == "final").alias("finals"), F.count_if(F.col("stage") == "failed").alias("fails"), F.count_if(~is_terminal(F.col("stage"))).alias("open"))


def hydrated(samples: DataFrame, log: DataFrame, stage: str, record: str) -> DataFrame:
    """Samples with the latest record that a stage left of each, null without any: how a resumed run goes on."""
    last = log.where(F.col("stage") == stage).groupBy("sample_id").agg(F.max_by(record, F.struct("iteration", "seq")).alias(record))
    return samples.join(last, "sample_id", "left")


def write_report(report: DataFrame, path: str, **more: str) -> None:
    """A report (metric, value), a few dozen rows, as one JSON object in a text file, with what else is given."""
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value"))))
    extra = F.create_map(*[F.lit(x) for p in more.items() for x in p]) if more else F.create_map().cast("map<string,string>")
    report.agg(F.to_json(F.struct(pairs.alias("metrics"), extra.alias("about"))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str) -> dict[str, float]:
    """The metrics of a report; none if there is none."""
    found = spark.read.text(path).first()
    return json.loads(found.value)["metrics"] if found else {}


def write_meta(spark: SparkSession, folder: str, **meta: object) -> bool:
    """Writes a run's identity where there is none yet, and says whether it did: a resumed run keeps its first one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/meta")
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return False
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.text(f"{folder}/meta")
    return True


def usage_shares(calls: DataFrame, *by: str) -> DataFrame:
    """Tokens of calls (input_tokens, output_tokens) of each group, and their share of all in percent."""
    groups = calls.groupBy(*by).agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    whole = groups.agg(F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("whole"))  # one row
    return groups.crossJoin(F.broadcast(whole)).withColumn("share", F.coalesce((F.col("input_tokens") + F.col("output_tokens")) * 100 / F.nullif("whole", F.lit(0)), F.lit(0.0))).drop("whole")


def runs_of(spark: SparkSession, folder: str) -> DataFrame:
    """(path, model, run_id, metrics) of all reports in folders <model>/<run id>/report."""
    found = spark.read.text(f"{folder}/*/*/report").select("value", F.col("_metadata.file_path").alias("path"))
    part = F.split("path", "/")
    return found.select("path", F.element_at(part, -4).alias("model"), F.element_at(part, -3).alias("run_id"), F.from_json(F.get_json_object("value", "$.metrics"), "map<string,double>").alias("metrics"))

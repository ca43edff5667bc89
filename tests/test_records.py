"""What a run writes, and what is read of it again."""

from pyspark.sql import functions as F

from tallywright.operators import datasets, metrics, records

LOG = "sample_id long, seq long, answer string, iteration int, stage string"


def test_log_report_and_meta(spark, tmp_path):
    log = spark.createDataFrame([(1, 1, "a", 0, "postprocessed"), (1, 2, "b", 1, "postprocessed"), (2, 3, None, 0, "failed")], LOG)
    for part in (log.where("seq < 3"), log.where("seq = 3")):
        records.append_log(part, f"{tmp_path}/log", 4)
    again = records.read_log(spark, f"{tmp_path}/log", LOG)
    assert sorted(map(tuple, again.select("sample_id", "seq", "answer", "iteration", "stage").collect()), key=str) == sorted(map(tuple, log.collect()), key=str)
    assert {(r.iteration, r.stage, r.records, r.samples) for r in records.manifest(again).collect()} == {(0, "postprocessed", 1, 1), (1, "postprocessed", 1, 1), (0, "failed", 1, 1)}
    got = records.hydrated(spark.range(1, 4).withColumnRenamed("id", "sample_id"), again, "postprocessed", "answer")
    assert {(r.sample_id, r.answer) for r in got.collect()} == {(1, "b"), (2, None), (3, None)}
    report = spark.createDataFrame([("score", 50.0), ("fails", 1.0)], "metric string, value double")
    records.write_report(report, f"{tmp_path}/runs/m/r1/report", score_key="score")
    assert records.read_report(spark, f"{tmp_path}/runs/m/r1/report") == {"score": 50.0, "fails": 1.0}
    assert [(r.model, r.run_id, r.metrics["score"]) for r in records.runs_of(spark, f"{tmp_path}/runs").collect()] == [("m", "r1", 50.0)]
    assert records.write_meta(spark, f"{tmp_path}/run", version="1") and not records.write_meta(spark, f"{tmp_path}/run", version="2")
    assert spark.read.text(f"{tmp_path}/run/meta").first().value == '{"version": "1"}'


def test_records(spark):
    row = spark.createDataFrame([(["a", None], [True, None], [0.5, 1.0])], "p array<string>, c array<boolean>, s array<double>")
    out = row.select(records.prediction_record(F.col("p")).alias("p"), records.judgement_record(F.lit("a"), F.col("c"), F.col("s")).alias("j"), records.prompt_record(F.lit("q"), F.lit(1)).alias("q")).first()
    assert [(x["index"], x.prediction, x.extracted) for x in out.p] == [(0, "a", True), (1, None, False)]
    assert [(x.correct, x.score) for x in out.j.rollouts] == [(True, 0.5), (False, 1.0)] and out.q.reference == "1"
    text = row.select(records.from_record(records.as_json(records.judgement_record(F.lit("a"), F.col("c"))), "struct<reference:string>").alias("r")).first().r
    assert text.reference == "a"
    state = spark.createDataFrame([("final",), ("failed",), ("initial",)], "stage string")
    assert records.final_and_failed(state).first()[:] == (1, 1, 1)
    calls = spark.createDataFrame([("a", 1, 2), ("a", 3, 0), ("b", 0, 2)], "stage string, input_tokens long, output_tokens long")
    assert {r.stage: round(r.share, 1) for r in records.usage_shares(calls, "stage").collect()} == {"a": 75.0, "b": 25.0}


def test_views_and_filters(spark):
    import pytest

    verdicts = spark.createDataFrame([(1, 0, True), (1, 1, False), (2, 0, True)], "sample_id long, idx int, correct boolean")
    answers = spark.createDataFrame([(1, 0, "a"), (1, 1, None), (2, 0, "b"), (2, 1, "c")], "sample_id long, idx int, answer string")
    assert {r.sample_id: (r.correct, r.answers) for r in metrics.rollout_view(verdicts, answers).collect()} == {1: ([True, False], ["a", None]), 2: ([True], None)}
    assert metrics.unscored_rollouts(verdicts).first().unscored == 1
    rows, keys = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1,), (9,)], "k int")
    assert datasets.filtered(rows, keys, ["k"], require_all=False).count() == 1
    for bad, strict in ((keys, True), (keys.where("k = 9"), False)):
        with pytest.raises(ValueError):
            datasets.filtered(rows, bad, ["k"], require_all=strict)
    values = spark.createDataFrame([("a",), ("b",), ("a",)], "value string")
    assert datasets.values_digest(values) == datasets.values_digest(values.distinct().orderBy(F.desc("value"))) != datasets.values_digest(values.where("value = 'a'"))
    assert datasets.retrieved(rows, 1, "random", 3).count() == 1
    with pytest.raises(ValueError):
        datasets.retrieved(rows, 3, "random")

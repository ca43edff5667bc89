"""Samples as streams: the state machine by hand, and reports after increments, restarts and corrections."""

import random

import pytest
from pyspark.sql import functions as F

from tallywright.operators import metrics
from tallywright.streaming import samples
from tallywright.streaming.samples import Progress, advanced


def walk(*said, retries=1, iterations=2):
    at, log = Progress(), []
    for seq, (action, ok, finalize, reason) in enumerate(said):
        step = advanced(at, seq, action, ok, finalize, reason, retries, iterations)
        log.append(step and (step[0].stage, step[0].iteration, step[0].retry_count, *step[1:]))
        at = step[0] if step else at
    return log


OK, END, BAD = (None, True, False, None), (None, True, True, None), (None, False, False, "exception::E")


def test_a_sample_goes_through_all_stages():
    assert [s[0] for s in walk(OK, OK, OK, OK, END)] == ["preprocessed", "inferred", "postprocessed", "feedback", "final"]
    assert walk(OK, OK, OK, OK, END, OK)[-1] is None  # it has ended


def test_feedback_begins_again_until_the_limit():
    assert walk(OK, OK, OK, OK, OK)[-1] == ("initial", 1, 0, None, None)
    assert walk(*[OK] * 10)[-1] == ("failed", 1, 0, "finalize", "iteration_limit")


def test_failures_are_tried_again_but_not_for_ever():
    assert walk(OK, BAD, OK)[1:] == [("preprocessed", 0, 1, "infer", None), ("inferred", 0, 1, None, None)]
    assert walk(OK, BAD, BAD)[-1] == ("failed", 0, 2, "infer", "retry_limit")
    assert walk(OK, (None, False, False, "non_retriable"))[-1] == ("failed", 0, 0, "infer", "non_retriable")


def test_old_and_foreign_outcomes_say_nothing():
    assert walk(("infer", True, False, None))[0] is None and walk(("preprocess", True, False, None))[0][0] == "preprocessed"
    assert advanced(Progress(seq=5), 5, None, True, False, None, 1, 1) is None


def drained(spark, base, schema, stream, each=lambda b: b):
    samples.kept(stream(spark.readStream.schema(schema).parquet(f"{base}/in")), f"{base}/out", f"{base}/state", each).awaitTermination()


def put(spark, base, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")


def test_outcomes_that_come_twice_and_null_ids_change_nothing(spark, tmp_path):
    base = f"file://{tmp_path}"
    rows = [(1, s, None, True, s == 4, None) for s in range(5)] + [(2, 0, "preprocess", None, None, None), (None, 0, None, True, False, None)]
    for part in (rows[:3], rows[:3], rows[3:], []):
        put(spark, base, part, samples.OUTCOME)
        drained(spark, base, samples.OUTCOME, lambda s: samples.progressed(s, 3, 1))
    log = samples.parts_of(spark, f"{base}/out", samples.RECORD)
    assert sorted((r.sample_id, r.seq, r.stage) for r in log.collect()) == [(1, 0, "preprocessed"), (1, 1, "inferred"), (1, 2, "postprocessed"), (1, 3, "feedback"), (1, 4, "final"), (2, 0, "initial")]
    assert [tuple(r) for r in samples.due(log).collect()] == [(2, 0, "preprocess")]
    assert {r.sample_id: r.stage for r in samples.latest(log).collect()} == {1: "final", 2: "initial"}


def test_a_batch_that_is_run_again_replaces_its_part(spark, tmp_path):
    """Killed after it wrote its part but before it said so: the commit of the last batch is missing."""
    base = f"file://{tmp_path}"
    for part in ([(1, 0, None, True, False, None)], [(1, 1, None, True, False, None), (2, 0, None, True, False, None)]):
        put(spark, base, part, samples.OUTCOME)
        drained(spark, base, samples.OUTCOME, samples.progressed)
    commits = sorted(p for p in (tmp_path / "state" / "commits").iterdir() if p.name.isdigit())
    before = sorted(map(tuple, samples.parts_of(spark, f"{base}/out", samples.RECORD).drop("batch").collect()), key=str)
    commits[-1].unlink()
    (tmp_path / "state" / "commits" / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    drained(spark, base, samples.OUTCOME, samples.progressed)
    assert len(before) == 3 and sorted(map(tuple, samples.parts_of(spark, f"{base}/out", samples.RECORD).drop("batch").collect()), key=str) == before


@pytest.mark.parametrize("seed", [1, 2])
def test_report_after_ten_increments_is_the_report_from_scratch(spark, tmp_path, seed):
    draw, base = random.Random(seed), f"file://{tmp_path}"
    rows = [(draw.randrange(12), draw.randrange(4), seq, draw.choice([True, False, None]), draw.choice(["a", "b", " a ", "", None]), draw.choice([True, False])) for seq in range(150)]
    draw.shuffle(rows)  # late records, too
    for k in range(10):
        put(spark, base, rows[15 * k : 15 * k + 15] + rows[:2], samples.JUDGED)
        drained(spark, base, samples.JUDGED, samples.changes, samples.summed)
    last = {}
    for r in sorted(rows, key=lambda r: r[2]):
        last[r[:2]] = r
    scratch = spark.createDataFrame([(r[0], r[1], bool(r[3]), r[4], r[5]) for r in last.values()], "sample_id long, idx long, correct boolean, answer string, extracted boolean")
    want = metrics.sampling_report(spark.range(15).select(F.col("id").alias("sample_id")), scratch, 4, 4).first().asDict()
    changed = samples.parts_of(spark, f"{base}/out", samples.CHANGE)
    assert samples.report_of(changed, F.lit(15), 4, 4).first().asDict() == want
    assert samples.report_of(samples.summed(changed), F.lit(15), 4, 4).first().asDict() == want  # sums of sums
    assert changed.count() < 10 * 2 * 17  # no part is larger than twice the records it came from


def test_report_of_nothing(spark):
    got = samples.report_of(spark.createDataFrame([], samples.CHANGE), F.lit(0), 1, 1).first()
    assert got.pass_at_1 == 0 and got.judged == got.fails == 0


def test_neighbours_share_a_state_and_a_call_of_python(spark, tmp_path):
    """One state a sample took over 240 s for 150,000 orders; what is put out shows how samples are taken together."""
    base, n = f"file://{tmp_path}", 5000
    for seq in (0, 1, 1):  # the last load comes again
        put(spark, base, [(s - 2500, 0, seq, seq == 1 and s % 2 == 0, "a", True) for s in range(n)], samples.JUDGED)
        drained(spark, base, samples.JUDGED, samples.changes)
    changed = samples.parts_of(spark, f"{base}/out", samples.CHANGE)
    assert changed.count() < 30
    got = {r.c: r.weight for r in samples.summed(changed.drop("batch")).collect()}
    assert got == {0: n // 2, 1: n // 2}

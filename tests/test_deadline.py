"""Graders with a deadline: a pair that takes too long costs one child."""

import time

import pytest
from pyspark.sql import functions as F

from tallywright.functions import deadline, mathematics
from tallywright.tasks import TASKS, evaluate


def _slow():
    """The grader, as a function that is sent by value."""

    def test(prediction, truth):
        if prediction == "forever":
            while True:
                pass
        if prediction == "crash":
            import os

            os._exit(9)
        if prediction == "error":
            raise RuntimeError("no")
        return prediction.lower() == truth

    return test


def test_child_is_killed_and_replaced():
    child = deadline.Child(_slow(), 1.0)
    try:
        assert child.ask("A", "a") == (True, "done") and child.ask("b", "a") == (False, "done") and child.starts == 1
        began = time.time()
        assert child.ask("forever", "a") == (None, "timed_out") and time.time() - began < 4
        assert child.ask("A", "a") == (True, "done") and child.starts == 2
        assert child.ask("error", "a") == (None, "failed") and child.ask("A", "a")[0] and child.starts == 2
        assert child.ask("crash", "a") == (None, "failed") and child.ask("A", "a")[0] and child.starts == 3
    finally:
        child.end()
    with pytest.raises(ValueError):
        with deadline.deadline(0):
            pass


def test_one_bad_pair_among_ten_thousand(spark):
    rows = spark.range(10_000, numPartitions=2).select("id", F.when(F.col("id") == 4321, "forever").when(F.col("id") == 7, F.lit(None)).when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "A").otherwise("b").alias("p"))
    grade = deadline.graded(_slow(), 2.0)
    got = rows.select("id", "p", grade(F.col("p"), F.lit("a")).alias("g")).groupBy("p", "g.value", "g.verdict").count().collect()
    assert {(r.p, r.value, r.verdict): r["count"] for r in got} == {("forever", None, "timed_out"): 1, (None, False, "done"): 1, ("a", True, "done"): 3334, ("A", True, "done"): 3331, ("b", False, "done"): 3333}


def test_tasks_count_what_was_not_decided(spark, monkeypatch):
    samples = spark.createDataFrame([(i, "1/2") for i in range(4)], "sample_id long, reference string")
    said = {0: r"\boxed{\frac{1}{2}}", 1: r"\boxed{0.5}", 2: r"\boxed{7}"}
    responses = spark.createDataFrame([(i, 0, t) for i, t in said.items()], "sample_id long, idx int, text string")
    task = TASKS["hmmt_feb_2026_0shot_gen"]
    plain = {r.metric: r.value for r in evaluate(task, samples, responses).collect()}
    with deadline.deadline(20):
        timed = {r.metric: r.value for r in evaluate(task, samples, responses).collect()}
    assert timed == plain | {"n_timed_out": 0.0} and plain["score"] == 50.0

    def never(*_):
        while True:
            pass

    with deadline.deadline(1):
        column = mathematics._tested(never)(F.lit("x"), F.col("reference"))
    assert samples.limit(1).select(column.alias("v")).first().v is None

"""Rules about odd samples, their scopes and their reports."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tallywright.operators import anomalies

OUTCOMES = (
    "sample_id long, iteration int, stage string, calls array<struct<texts:array<string>,finish_reasons:array<string>,logprobs:array<double>,logprob_tokens:array<string>>>, "
    "result string, rollouts array<struct<index:int,extracted:boolean>>"
)
ROWS = [
    (1, 0, "final", [(["a", "b"], ["stop", "length"], None, None), (["c", "d"], ["content_filter", None], None, None)], "x", None),
    (2, 0, "final", [([], None, None, None)], None, [(5, False), (None, None), (7, True)]),
    (3, 1, "final", [(["a"], None, [], None), (["b"], None, [-1.0], ["b"])], " ", None),
    (4, 0, "final", None, None, []),
    (5, 0, "failed", None, None, None),
    (6, 0, "final", [], "fine", None),
    (7, 0, "final", [(None, None, None, [])], "fine", None),
]


@pytest.fixture(scope="module")
def outcomes(spark):
    return spark.createDataFrame(ROWS, OUTCOMES)


def found(outcomes, tags):
    return {(r.sample_id, r.rule): list(r.indices) for r in anomalies.detected(outcomes, tags).collect()}


def test_rules_by_scope(outcomes):
    every = {(2, "extraction_failure"): [1, 5], (3, "empty_postprocess"): [0], (4, "extraction_failure"): [0]}
    assert found(outcomes, {"gen"}) == every | {(1, "truncated_output"): [0, 1], (2, "empty_infer_gen"): [0], (7, "empty_infer_gen"): [0]}
    assert found(outcomes, {"ppl"}) == every | {(3, "empty_infer_ppl"): [0], (7, "empty_infer_ppl"): [0]}
    assert found(outcomes, {"clp"}) == every and found(outcomes, set()) == {}
    assert found(outcomes.limit(0), {"gen"}) == {}


def test_catalogue():
    assert anomalies.by_category() == {"output_quality": ["empty_infer_gen", "empty_infer_ppl", "truncated_output"], "correctness": ["empty_postprocess", "extraction_failure"]}
    code = anomalies.rules_hash()
    assert len(code) == 16 and code == anomalies.rules_hash() and [r["name"] for r in anomalies.schema()["rules"]][0] == "empty_infer_gen"
    other = (*anomalies.RULES[:-1], replace(anomalies.RULES[-1], threshold=2))
    assert anomalies.rules_hash(other) != code and anomalies.schema(other)["rules"][-1]["threshold"] == 2
    assert replace(anomalies.RULES[0], tags=()).definition()["tags"] == ["empty infer gen"]
    with pytest.raises(ValueError):
        replace(anomalies.RULES[0], severity="loud")


def test_reports_by_version_of_rules(spark, outcomes, tmp_path):
    details = anomalies.detected(outcomes, {"gen"})
    counts = anomalies.summary(outcomes, details)
    assert anomalies.loaded(spark, str(tmp_path)) is None
    code = anomalies.save(details, counts, str(tmp_path), "t", "2024-01-01T00:00:00")
    got, about, numbers = anomalies.loaded(spark, str(tmp_path))
    assert got.count() == details.count() and about["rules_hash"] == code and about["task_name"] == "t"
    assert numbers == {
        "total_samples": 7, "final_samples": 6, "failed_samples": 1, "anomaly_samples": 5, "samples:truncated_output": 1, "rollouts:truncated_output": 2, "samples:empty_infer_gen": 2, "rollouts:empty_infer_gen": 2,
        "samples:extraction_failure": 2, "rollouts:extraction_failure": 3, "samples:empty_postprocess": 1, "rollouts:empty_postprocess": 1,
    }
    mine = (*anomalies.RULES, anomalies.Rule("long_text", "a text is long", "performance", "it takes long", lambda: F.when(F.size("calls") > 1, F.array(F.lit(0)))))
    assert anomalies.loaded(spark, str(tmp_path), mine) is None
    more = anomalies.detected(outcomes, {"gen"}, mine)
    anomalies.save(more, anomalies.summary(outcomes, more), str(tmp_path), "t", "2024-01-02T00:00:00", mine)
    assert anomalies.loaded(spark, str(tmp_path), mine)[2]["samples:long_text"] == 2 and anomalies.loaded(spark, str(tmp_path))[0].count() == details.count()

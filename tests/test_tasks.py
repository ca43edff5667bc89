"""Every named task over a few samples of all columns that tasks know: verdicts and a report come, and failures are counted."""

import pytest
from pyspark.sql import functions as F

from tallywright.sources.benchmarks import LOADERS
from tallywright.tasks import TASKS, evaluate
from tallywright.tasks.core import drawn_examples, examples_by, filled, identified

#: Tasks whose rules the queries run over the tables, or other tasks here share.
COVERED = {
    "gsm8k_kshot_base_gen", "mmlu_pro_0shot_gen", "mmmlu_kshot_clp", "simpleqa_verified_0shot_gen", "ruler_0shot_gen", "drop_kshot_gen", "gsm_plus_0shot_gen", "ugmathbench_0shot_gen_fixed", "sysbench_0shot_gen", "human_eval_0shot_gen", "complex_constraints_0shot_gen",
    "apex_2025_0shot_gen", "apex_shortlist_2025_0shot_gen", "brumo_2025_0shot_gen", "hmmt_feb_2025_0shot_gen", "hmmt_feb_2026_0shot_gen", "hmmt_nov_2025_0shot_gen", "smt_2025_0shot_gen", "cmimc_2025_0shot_gen", "imo_answer_bench_0shot_gen", "aime_2024_0shot_gen", "aime_2025_0shot_gen",
    "platinum_multiarith_0shot_gen", "platinum_singleop_0shot_gen", "platinum_singleq_0shot_gen", "platinum_svamp_0shot_gen", "arc_easy_kshot_clp", "arc_easy_kshot_ppl", "human_eval_0shot_base_gen", "livecodebench_code_generation_kshot_base_gen", "mbpp_kshot_base_gen", "c_eval_kshot_clp",
}


def samples(spark):
    base = spark.range(3).withColumnRenamed("id", "sample_id")
    text = {c: F.lit(v) for c, v in {
        "prompt": "p", "reference": "A", "category": "stem", "subset": "sat-en", "subject": "law", "locale": "de_de", "problem": "q", "perturbation_type": "x", "benchmark_name": "b", "language": "english", "instruction_types": "Code without Comments", "uid": "u", "subtask": "slack-user", "setting": "conflict",
        "variant": "v", "system": "", "own_id": "1", "alignment": "aligned", "test": "t", "entry_point": "f",
    }.items()}
    numbers = {c: F.lit(v) for c, v in {"version": 1, "context_length": 4096, "n_criteria": 2, "turn": 1, "session": 1, "n_turns": 2, "n_choices": 4, "step": 0}.items()}
    arrays = {"golds": ["1"], "kinds": ["NV"], "outputs": ["A"], "criteria_texts": ["c", "d"], "rubrics": ["r"], "instruction_id_list": ["punctuation:no_comma"], "kwargs": ["{}"], "ids": ["1"], "targets": ["1"], "choices": ["a", "b"]}
    return base.withColumns(text | numbers | {c: F.array(*map(F.lit, v)) for c, v in arrays.items()} | {"options": F.array(F.array().cast("array<string>"))})


def responses(spark):
    said = "Answer: A\nANSWER: A \\boxed{A}"
    reply = 'CORRECT correct: yes confidence: 90 1: PASS 评判结果: {"1": "是"} "answer_score": 1 {"score": 1, "rubrics_check": {"q_1": "yes"}, "SATISFIED_ALL_REQUIREMENTS": "YES"}'
    likely = F.array(*[F.struct(F.array(F.lit(-9.0), F.lit(-1.0 - i)).alias("logprobs"), F.lit(2).alias("input_tokens")) for i in range(2)])
    flat = F.array(*[F.struct(F.array(F.lit(-9.0), F.lit(-1.0)).alias("logprobs"), F.lit(2).alias("input_tokens")) for _ in range(2)])
    parts = F.array(*[F.struct(F.array(F.lit("p"), F.lit(" x")).alias("tokens"), F.array(F.lit(-1.0), F.lit(-1.0 - i)).alias("logprobs")) for i in range(2)])
    top = F.create_map(*[x for i, c in enumerate("ABCDE") for x in (F.lit(f" {c}"), F.lit(-1.0 - i))])
    base = spark.range(2).select(F.col("id").alias("sample_id"), F.lit(0).alias("idx"))
    return base.withColumns({"text": F.lit(said), "reply": F.lit(reply), "top": top, "conditional": likely, "unconditional": flat, "continuations": parts, "outcome": F.lit("passed")})


def test_all_tasks_have_loaders():
    assert len(TASKS) == 65 and {t.dataset for t in TASKS.values()} <= set(LOADERS)


@pytest.mark.parametrize("name", sorted(set(TASKS) - COVERED))
def test_task(spark, name):
    got = {r.metric: r.value for r in evaluate(TASKS[name], samples(spark), responses(spark)).collect()}
    headline = TASKS[name].headline
    assert got and all(v is not None for v in got.values())
    assert headline is None or got["score"] == got.get(headline, got["score"])
    assert got.get("fails", 1) == 1


def test_prompts(spark):
    pool = spark.createDataFrame([(i, f"s{i % 2}", f"q{i}") for i in range(10)], "i int, subject string, q string")
    assert filled("{a} and {b} {c}", a=F.lit("x"), b=F.lit(1)) is not None
    assert spark.range(1).select(filled("{a}, {c}: {a}", a=F.lit("x"))).first()[0] == "x, {c}: x"
    one = drawn_examples(pool, 3, F.col("q"), 7, "|").first().prefix
    assert len(one.split("|")) == 3 and one == drawn_examples(pool.repartition(3), 3, F.col("q"), 7, "|").first().prefix
    by = {r.subject: r.prefix for r in examples_by(pool, ["subject"], 2, F.concat("q", F.lit(" ")), F.col("i")).collect()}
    assert by == {"s0": "q0 q2 ", "s1": "q1 q3 "}
    with pytest.raises(Exception, match="not"):
        examples_by(pool, ["subject"], 6, F.col("q"), F.col("i")).collect()
    ids = identified(spark.createDataFrame([(1,), (1,), (2,)], "a int")).select("sample_id").distinct().count()
    assert ids == 3

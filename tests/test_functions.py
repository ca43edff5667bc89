"""Rules that the tables don't show: guards, ties, forms, odd budgets, failures of a provider, generated samples."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tallywright.functions import constraints, sampling, text
from tallywright.operators import datasets, evaluation, generators, grading, metrics, ranking, runlog
from tallywright.sources import tables


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "text string").select(column(F.col("text")).alias("x")).first().x


def test_estimators_are_the_mean_over_draws(spark):
    cases = [(n, c, k) for n in range(6) for c in range(n + 1) for k in (1, 2, 3)]
    for k in (1, 2, 3):
        frame = spark.createDataFrame([(n, c) for n, c, q in cases if q == k], "n long, c long")
        for r in frame.select("n", "c", sampling.pass_at_k(F.col("n"), F.col("c"), k).alias("one"), sampling.pass_pow_k(F.col("n"), F.col("c"), k).alias("all")).collect():
            draws = list(combinations([i < r.c for i in range(r.n)], k))
            assert abs(r.one - (sum(map(any, draws)) / len(draws) if draws else 0)) < 1e-9
            assert abs(r.all - (sum(map(all, draws)) / len(draws) if draws else 0)) < 1e-9


def test_votes(spark):
    rows = [(1, 0, True, "a"), (1, 1, True, " a"), (1, 2, False, "b"), (2, 0, True, "a"), (2, 1, False, "b"), (3, 0, False, ""), (3, 1, False, None), (4, 0, False, "x")]
    got = {r.sample_id: (r.n, r.majority, r.consistency) for r in metrics.votes(spark.createDataFrame(rows, "sample_id long, idx int, correct boolean, answer string")).collect()}
    assert got == {1: (3, 1, 2 / 3), 2: (2, 0, 0.5), 3: (2, 0, 0.0), 4: (1, 0, 1.0)}


def test_report_of_nothing(spark):
    empty = spark.createDataFrame([], "sample_id long, idx int, correct boolean, answer string, extracted boolean")
    r = metrics.sampling_report(empty, empty, 4, 2).first()
    assert (r.requested, r.judged, r.pass_at_1, r.majority_at_k) == (0, 0, 0.0, None)


@pytest.mark.parametrize("seed", range(6))
def test_allocation_is_the_greedy_one(spark, seed):
    r = random.Random(seed)
    sizes = {f"g{i}": r.randint(1, 60) for i in range(r.randint(1, 9))}
    num, floor = r.randint(1, sum(sizes.values()) + 5), r.randint(0, 4)
    total = sum(sizes.values())
    alloc = {k: min(floor, n) for k, n in sizes.items()}
    target = min(max(num, sum(alloc.values())), total)
    while sum(alloc.values()) < target:
        best = max((k for k in sorted(sizes) if alloc[k] < sizes[k]), key=lambda k: sizes[k] * target / total - alloc[k])
        alloc[best] += 1
    frame = spark.createDataFrame([(k,) for k, n in sizes.items() for _ in range(n)], "g string")
    assert {x.g: x.alloc for x in datasets.allocation(frame, "g", num=num, min_per_group=floor).collect()} == alloc


def test_operations(spark):
    frame = spark.createDataFrame([(i, f"s{i % 3}") for i in range(30)], "sample_id long, g string")
    out = datasets.apply(frame, [{"stratified": {"by": "g", "per_group": 4}}, {"slice": 10}, {"repeat": 2}])
    assert out.count() == 20 and sorted({r.repeat_index for r in out.collect()}) == [0, 1]
    with pytest.raises(ValueError):
        datasets.repeated(out, 2)
    with pytest.raises(ValueError):
        datasets.allocation(frame, "g", num=3, fraction=0.5)
    assert [r.position for r in datasets.shuffled(frame, "sample_id", 3).orderBy("position").collect()] == list(range(30))


def test_positions_with_hot_and_null_keys(spark):
    rows = [(None if i % 5 == 0 else "hot", float(i % 7)) for i in range(200)]
    frame, bucket = ranking.with_even_bucket(spark.createDataFrame(rows, "k string, v double").where("k is not null"), ["k"], "v")
    got = ranking.positioned(frame, ["k"], bucket, ["v"]).orderBy("position").collect()
    assert [r.position for r in got] == list(range(160)) and [r.v for r in got] == sorted(r.v for r in got)


def test_text(spark):
    assert one(spark, text.normalize_text, "The  Quick, (brown) fox: a\tdog's") == "quick brown fox dogs"
    assert one(spark, text.strict_number, "so #### -1,234.5 then #### 9") == "-1,234.5"
    assert one(spark, text.flexible_number, "12 then $1,000. end") == "$1,000."
    assert one(spark, lambda t: text.exact_match_form(text.flexible_number(t)), "12 then $1,000. end") == "1000"
    assert one(spark, text.fenced_code, "a\n```py\nx = 1\n```\nb") == "x = 1" and one(spark, text.fenced_code, "```") == ""
    assert one(spark, text.judge_grade, "grade: B") == "B" and one(spark, text.judge_grade, "none") == "C"
    assert one(spark, text.judge_confidence, "Confidence: 85%") == 85 and one(spark, text.judge_confidence, "") == 100
    assert one(spark, text.judge_yes, "Correct: YES") is True
    assert one(spark, text.strip_latex, r"\dfrac12") == r"\frac{1}{2}" and one(spark, text.strip_latex, "3/4") == r"\frac{3}{4}" and one(spark, text.strip_latex, r"x = .5\%") == "0.5"
    assert one(spark, text.loose_forms, "*a*\nb\n*c*") == ["*a*\nb\n*c*", "b\n*c*", "*a*\nb", "b", "a\nb\nc", "b\nc", "a\nb", "b"]


CASES = [
    ("length_constraints:number_paragraphs", {"num_paragraphs": 2}, "one\n***\ntwo", "one\n***\n\n***\ntwo"), ("combination:two_responses", {}, "a ****** b", "a ****** a"), ("detectable_format:json_format", {}, '```json\n{"a": 1}\n```', "{a"),
    ("combination:repeat_prompt", {"prompt": "Say hi"}, "say HI there", "hi"), ("nth_paragraph:first_word", {"num_paragraphs": 2, "nth_paragraph": 2, "first_word": "Then"}, "One.\n\n'Then, two.", "One.\n\nTwo."),
    ("detectable_format:constrained_response", {}, "My answer is yes. Indeed", "yes"), ("detectable_format:number_highlighted_sections", {"num_highlights": 2}, "*a* and *b c*", "*a* and * *"), ("change_case:uppercase", {}, "ALL CAPS 1", "Not"),
    ("change_case:capital_word_frequency", {"relation": "at least", "frequency": 2}, "YES AND no", "YES and no"), ("startend:end_checker", {"phrase": "The end"}, 'so it is the END"', "the end of it"), ("detectable_content:postscript", {"marker": "P.P.S"}, "x\nP. P. S", "P.S. x"),
]


@pytest.mark.parametrize("name,kwargs,yes,no", CASES, ids=[c[0] for c in CASES])
def test_constraints(spark, name, kwargs, yes, no):
    frame = spark.createDataFrame([(yes,), (no,), ("  ",), (None,)], "text string")
    assert [r.x for r in frame.select(constraints.strict(name, F.col("text"), **kwargs).alias("x")).collect()] == [True, False, False, False]
    assert frame.select(constraints.loose(name, F.col("text"), **kwargs).alias("x")).first().x is True


def test_relations(spark):
    with pytest.raises(ValueError):
        constraints.related(F.lit(1), "around", 3)
    assert len(constraints.CHECKS) >= 26


def test_grading(spark):
    frame = spark.createDataFrame([([0.0, 2.0, 2.0], [1.0, None, 3.0], "A big dog", "big dog")], "s array<double>, l array<double>, a string, b string")
    r = frame.select(grading.first_best(F.col("s")).alias("best"), grading.total_logprob(F.col("l")).alias("total"), grading.total_logprob(F.col("l"), True).alias("rest"), grading.fuzzy(F.col("a"), F.col("b")).alias("fuzzy"), grading.exact_words(F.col("a"), F.col("b")).alias("same"),
                     grading.shared_words(F.split(F.lit("a a b"), " "), F.split(F.lit("a a a c"), " ")).alias("shared")).first()
    assert (r.best, r.total, r.rest, r.fuzzy, r.same, r.shared) == (1, 4.0, 3.0, True, 1, 2)


def test_task_with_a_provider_that_fails(spark):
    def provider(prompts):
        if any("3" in p for p in prompts):
            raise RuntimeError
        return [["answer 1", "answer 2"] for _ in prompts]

    samples = spark.createDataFrame([(i, "1") for i in range(6)], "sample_id long, reference string")
    task = evaluation.Task(prompt=F.concat(F.lit("question "), F.col("sample_id").cast("string")), extract=lambda t: F.regexp_extract(t, "answer ([0-9])", 1), grade=lambda a, r: a == r, n=2, k=2)
    answers = evaluation.inferred(task.prompts(samples), provider)
    assert [(r.sample_id, r.error) for r in answers.where("error is not null").collect()] == [(3, "exception::RuntimeError")]
    r = task.report(samples, answers).first()
    assert (r.requested, r.judged, r.fails, r.n_short) == (6, 5, 1, 0) and abs(r.pass_at_1 - 500 / 12) < 1e-6


def test_truncation_needs_every_reason(spark):
    rows = [(1, 0, "stop"), (1, 1, "length"), (2, 0, None)]
    frame = spark.createDataFrame(rows, "sample_id long, idx int, finish_reason string")
    assert tuple(runlog.truncation(frame).first()) == (None, None) and tuple(runlog.truncation(frame.where("sample_id = 1")).first()) == (1, 2)


def test_generators(spark):
    for r in generators.needles(spark, 5, 40, keys=3, asked=2).collect():
        assert len(r.outputs) == 2 and all(f"is: {v}." in r.input for v in r.outputs) and r.input.count("special magic numbers for") == 4 and r.input.count("The grass") == 40
    for r in generators.chains(spark, 5, 3, 4).collect():
        at = [r.input.index(f"VAR {n} = ") for n in r.outputs]
        assert len(at) == 5 and at == sorted(at) and r.input.count("\n") == 14
    words = spark.createDataFrame([(f"w{i}",) for i in range(100)], "word string")
    for r in generators.common_words(words, 3, common=4, uncommon=10, often=5, seldom=2).collect():
        said = [w for w in r.input.split() if not w.endswith(".")]
        assert len(r.outputs) == 4 and all(said.count(w) == 5 for w in r.outputs) and len(said) == 40
    for r in generators.frequent_words(spark, 3).collect():
        said = r.input.split()
        counts = sorted(((said.count(w), w) for w in set(said)), reverse=True)
        assert counts[0][1] == "..." and [w for _, w in counts[1:4]] == r.outputs
    questions, docs = spark.range(4).select(F.col("id").alias("sample_id"), F.col("id").alias("gold")), spark.range(200).select(F.col("id").alias("doc_id"))
    for r in generators.with_distractors(questions, docs, 5).collect():
        assert r.gold in r.context and len(r.context) == len(set(r.context)) == 6


def test_common_words_come_from_the_whole_vocabulary(spark):
    words = spark.range(25_000).select(F.format_string("w%05d", "id").alias("word"))
    said = [{w for w in r.input.split() if not w.endswith(".")} for r in generators.common_words(words, 8).collect()]
    assert len(said) == 8 and all(len(s) == 50 for s in said) and 150 < sum(w >= "w10000" for s in said for w in s) < 330


def test_every_question_has_its_distractors(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"))
    for n in (1, 150):
        got = generators.with_distractors(spark.range(n).select(F.col("id").alias("sample_id"), F.col("id").alias("gold")), docs, 4).collect()
        assert len(got) == n and all(r.gold in r.context and len(r.context) == len(set(r.context)) == 5 for r in got)
    assert n == 150 and len({d for r in got for d in r.context}) > 250
    few = generators.with_distractors(spark.range(3).select(F.col("id").alias("sample_id"), F.col("id").alias("gold")), docs.limit(3), 4).collect()
    assert all(sorted(r.context) == [0, 1, 2] for r in few)


def test_sources(spark, tmp_path):
    for name, n in (("a", 3), ("b", 2)):
        (tmp_path / f"{name}.jsonl").write_text("".join(f'{{"q": "{name}{i}"}}\n' for i in range(n)))
    data = tables.load(spark, {"dev": [str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")]}, "jsonl").evaluated_on("dev")
    assert data.test.count() == 5 and data.train is None and data.map(lambda f: f.limit(2)).test.count() == 2 and data.map(lambda f: f.limit(2), "none") is data
    (tmp_path / "values.txt").write_text("# accepted\nx\n\n y \nx\n")
    assert sorted(r.value for r in tables.accepted_values(spark, str(tmp_path / "values.txt")).collect()) == ["x", "y"]
    (tmp_path / "files").mkdir()
    (tmp_path / "files/one").write_text("1")
    declared = spark.createDataFrame([("one", "6b86b273ff34fce19d6b804eff5a3f5747ada4eaa22f1d49c01e52ddb7875b4b"), ("two", "00")], "name string, sha256 string")
    assert [r.name for r in tables.checksum_mismatches(spark, str(tmp_path / "files"), declared).collect()] == ["two"]


def test_profiles_keep_the_group_of_null_keys(spark):
    from tallywright.operators.runlog import nearest_rank

    rows = [(k, float(v)) for k in ("a", None) for v in range(100)] + [("b", None)]
    got = {r.k: (r.n, r.p50, r.p99) for r in nearest_rank(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()}
    assert got == {"a": (100, 50.0, 99.0), None: (100, 50.0, 99.0)}

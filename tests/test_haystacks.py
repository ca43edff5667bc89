"""Samples that fill a budget: none is over it, one more item would be; answers are where they should be."""

import re

import pytest
from pyspark.sql import functions as F

from tallywright.operators import generators, haystacks
from tallywright.operators.haystacks import SUBTASKS

WORDS = "Once upon a time there was a mill. It stood by a river (a slow one)! Who knew? Nobody, they said.".split()


def count(text):
    return len(re.findall(r"[^\W\d_]+|\d|[^\w\s]|_", text))


@pytest.mark.parametrize("name", SUBTASKS)
@pytest.mark.parametrize("length", [420, 777])
def test_needles_fill_the_budget(spark, name, length):
    spec = SUBTASKS[name]
    samples = spark.range(6).select(F.col("id").alias("sample_id"), F.array(*map(F.lit, WORDS)).alias("haystack"))
    for r in haystacks.needle_samples(samples, spec, length, 64, 9, seed=3).collect():
        assert r.length == count(r.input + r.answer_prefix) + 64 + 9 <= length
        if spec.haystack == "essay":
            following = count(WORDS[r.n_items % len(WORDS)])
        else:
            following = count(haystacks.NOISE) if spec.haystack == "noise" else 110
        assert r.length + following > length and r.n_items > 0
        assert len(r.outputs) == spec.asked * spec.values and all(r.input.count(o) == 1 for o in r.outputs)
        assert len(re.findall("One of the special magic", r.input)) == spec.keys * spec.values + (r.n_items if spec.haystack == "needle" else 0)
        assert r.token_position_answer == count(r.input[: r.input.index(r.outputs[0])])
        if spec.haystack == "essay":
            for before in re.findall(r"(\S+) One of the special magic", r.input):
                assert before[-1] in ".!?)" or before == "afterwards."


def test_haystacks_of_nothing_and_budgets_too_small(spark):
    samples = spark.createDataFrame([(1, None), (2, []), (3, [None, "", "word"])], "sample_id long, haystack array<string>")
    got = {r.sample_id: r for r in haystacks.needle_samples(samples, SUBTASKS["niah_single_2"], 200, 20).collect()}
    assert got[1].n_items == got[2].n_items == 0 and got[1].length <= 200 and got[3].length == 200  # words of one token fill all
    small = haystacks.needle_samples(samples, SUBTASKS["niah_multiquery"], 30, 20).collect()
    assert all(r.n_items == 0 and r.length > 30 for r in small)


def test_fit_is_that_of_trying_all(spark):
    rows = [([3, 1, 2], left) for left in range(-1, 20)] + [([], 5), ([7], 6)]
    got = spark.createDataFrame(rows, "counts array<int>, left int").select("counts", "left", haystacks.fitted(F.col("counts"), F.col("left")).alias("n")).collect()
    for r in got:
        n, used = 0, 0
        while r.counts and used + r.counts[n % len(r.counts)] <= r.left:
            used += r.counts[n % len(r.counts)]
            n += 1
        assert r.n == n


def test_chains_keep_their_order_in_the_noise(spark):
    made = generators.chains(spark, 4, 2, 3, 5).withColumn("value", generators.number_of(5, F.lit(5), F.col("sample_id"), F.lit(0)))
    for r in haystacks.chain_samples(made, 8, 600, seed=1).collect():
        assert r.length == count(r.input + r.answer_prefix) + 30 <= 600 < r.length + count(haystacks.NOISE)
        at = [r.input.index(f"VAR {name} =") for name in r.outputs]
        assert at == sorted(at) and len(at) == 4 and re.search(rf"VAR {r.outputs[0]} = (\d+)", r.input)[1] in r.answer_prefix


def test_words_behind_the_budget_are_not_counted(spark):
    from pyspark.sql import functions as F

    from tallywright.operators import haystacks

    def count(t):  # raises on words far behind the budget; single signs have no token
        return F.when(t.contains("behind"), F.raise_error(F.lit("counted")).cast("int")).otherwise(F.size(F.filter(F.split(t, r"\s+"), lambda w: F.length(w) > 1)))

    whole = [(1, ["ab"] * 900 + ["behind"]), (2, ["."] * 700 + ["ab"]), (3, None)]
    got = {r.sample_id: r for r in haystacks.needle_samples(spark.createDataFrame(whole, "sample_id long, haystack array<string>"), haystacks.SUBTASKS["niah_single_2"], 300, 0, count=count).collect()}
    assert got[1].length == got[2].length == 300 and got[1].n_items == got[2].n_items and got[3].n_items == 0

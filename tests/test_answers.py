"""Answers out of responses, verdicts out of judges' replies, and mathematical equality, case by case."""

import pytest
from pyspark.sql import functions as F

from tallywright.functions import answers as a
from tallywright.functions import mathematics as m
from tallywright.operators import grading as g


def values(spark, cases):
    """The values of column builders over one text each, in one row."""
    frame = spark.createDataFrame([tuple(t for _, t, _ in cases)], ", ".join(f"c{i} string" for i in range(len(cases))))
    return list(frame.select(*[f(F.col(f"c{i}")).alias(f"v{i}") for i, (f, _, _) in enumerate(cases)]).first())


EXTRACTION = [
    (a.last_box, r"so \boxed{\frac{1}{2}} and \boxed{3}", "3"), (a.last_box, "none", None), (a.last_box, r"\boxed{\frac{1}{2}} \boxed{0.5}", r"\frac{1}{2}"), (a.last_box, r"\boxed{3} then \boxed{\approx 3.1}", "3"),
    (a.last_box, r"\fbox{a\boxed{b}c}", "abc"), (a.competition_answer, "it is 12 or 34.", "34"), (lambda t: a.competition_answer(t, strict=True), "12", None), (lambda t: a.last_box(t, True), "\\boxed{9}\n\\boxed{2}, \\boxed{3}", "2,3"),
    (lambda t: a.last_box(t, True), "\\boxed{1}\n\\boxed{2,3} \\boxed{2,3}", "2,3"), (a.announced_option, "Réponse : **B**", "B"), (a.announced_option, "الإجابة: ب", "B"), (a.announced_option, "nothing", ""), (a.announced_option, r"Answer: $\boxed{C}$", "C"),
    (lambda t: a.first_option(t, "ABCD"), "The answer is (C).", "C"), (lambda t: a.first_option(t, "ABCD"), "答案是：B", "B"), (lambda t: a.first_option(t, "ABCD"), "x", ""), (lambda t: a.lettered(t, "A-P"), "ANSWER: k", "k"),
    (a.cloze_answer, r"The answer is \boxed{x = 5}", "5"), (a.cloze_answer, "so $y = 7$ it is", "7"), (a.cloze_answer, "x = 12.", "12"), (a.cloze_answer, "about 3 or 4.5", "4.5"), (a.cloze_answer, "no", None),
    (a.last_box, r"so \boxed{" + "{" * 9 + "x" + "}" * 9 + "}", "{" * 9 + "x" + "}" * 9), (a.last_box, r"\boxed{1} \boxed{ {" + "{" * 12 + r"\boxed{y}" + "}" * 12, "y"), (a.last_box, "{" * 9 + r"\boxed{a{b}\fbox{c}}" + "}" * 20 + r" \boxed{2", "a{b}c"),
    (a.first_capital, "maybe c or D", "D"), (a.all_letters, "A, (C)", ["A", "C"]), (a.strict_form, "#### $1,234.", ""), (a.strict_form, "so #### 1,234.", "1234"), (a.marked_number, "a 5\n#### 3.50", "3.5"), (a.marked_number, "7 apples, 8", "8"),
    (a.marked_number, "#### 4 Question 9", "4"), (a.unanswerable, "It does not specify. #### 3", "None"), (a.unanswerable, "#### 3", ""), (a.unanswerable, "it is 3", "None"), (a.stated_answer, "The final answer is $x+1$. I hope it is correct.", "x+1"),
    (a.stated_answer, r"\boxed{4}%", "4}"), (a.stated_answer, "the answer is 12.", "12"), (a.stated_answer, "```output\n42\n```", "42"), (a.stated_answer, "1,000 then", "1000"), (a.slot_answer, r"so \boxed{1, (2,3)}", "1, (2,3)"),
    (a.slot_answer, "The final answer is 7.", "7"), (a.slot_answer, "nothing", None), (a.slots, "1, (2,3), $x$", ["1", "(2,3)", "x"]), (a.slots, r"\{1,2\}, 3", ["(1,2)", "3"]), (a.theorem_answer, "The answer is True.", "True"),
    (a.theorem_answer, "hence The answer is x = 2\\pi", "2*3.14"), (a.theorem_answer, "it is 5 or 6", "6"), (a.theorem_answer, "The answer is (b)", "(b)"), (a.judge_correct, "It is correct. VERDICT: not correct", False), (a.judge_correct, "INCORRECT... no, CORRECT", True),
    (a.judge_correct, "partially correct", False), (a.judge_correct, "correctness", False), (lambda t: a.judge_last(t)["confidence"], '"correct": "yes", **confidence**: 80%', 80), (lambda t: a.judge_last(t)["correct"], "correct: no then correct: yes", True),
    (lambda t: a.judge_last(t)["parsed"], "incorrect: maybe", False), (lambda t: a.judge_criteria(t, F.lit(3)), "1: PASS\n- 2. FAIL\n1: fail\n3: PASS/FAIL", [False, False, None]),
    (lambda t: a.judge_block(t, F.array(F.lit("1"), F.lit("2"))), '评判结果: {1: "是", "2": "否"} ... 评判结果: {1: "……"}', [True, False]), (lambda t: a.judge_score(t)["score"], '【JSON】```json\n{"answer_score": 1.0}\n```', 1),
    (lambda t: a.judge_score(t)["score"], '"answer_score": 1 【JSON】 {"answer_score": 0}', 0), (lambda t: a.judge_score(t)["raw"], "【评分】：100分", "100"), (lambda t: a.judge_score(t)["score"], "【评分】：100分", None),
    (lambda t: a.judge_object(t)["satisfied"], 'I see {x}. {"rubrics_check": {"q_1": "yes"}, "SATISFIED_ALL_REQUIREMENTS": "YES"}', True), (lambda t: a.judge_object(t)["checks"], '{"rubrics_check": {"q_1": "yes", "q_2": "no"}}', {"q_1": "yes", "q_2": "no"}),
    (a.judge_object, "no object", None), (lambda t: a.judge_partial(t)["score"], '[Evaluation Start] {"score": 0.5, "x": 1} [Evaluation End] score: 1', 0.5), (lambda t: a.judge_partial(t)["parsed"], "nothing", False),
    (lambda t: a.judge_partial(t)["score"], "**Final Score**: 1", 1.0), (a.answer_line, "I think\nFinal answer: 12\nmore", "12\nmore"), (a.answer_line, " plain ", "plain"), (lambda t: a.turns(t)[0]["role"], '[{"role": "user", "content": "x"}]', "user"),
    (a.object_slice, "text {'a': 1} end", '{"a": 1}'), (a.object_slice, "```json\n{\"a\": 2}\n```", '{"a": 2}'), (a.object_slice, "none", None), (a.bare_word, " 'User'.\n", "user"), (a.numbers_only, "50% of $3π", "50/100 of 3*3.14"),
    (a.program_output, "```output\n1\n``` and ```output\n2\n```", "2"), (a.prefixed_form, "x #### 1,200.", "1200"),
]


def test_extraction(spark):
    got = values(spark, EXTRACTION)
    wrong = [(t, v, want) for (_, t, want), v in zip(EXTRACTION, got, strict=True) if v != want]
    assert not wrong, wrong


CANONICAL = [
    (m.canonical, r"\dfrac12", r"\frac{1}{2}"), (m.canonical, r"\left(.5\right)", r"(.5)"), (m.canonical, "3/4", r"\frac{3}{4}"), (m.canonical, r"\sqrt3", r"\sqrt{3}"), (m.canonical_value, r"x = 0.5", r"\frac{1}{2}"),
    (m.canonical_value, r"90^\circ", "90"), (m.canonical_value, r"5\text{ cm}", "5"), (m.canonical_value, r"50\%", "50"), (m.canonical_long, r"\text{Yes}", "Yes"), (m.canonical_long, r"12.00", "12"), (m.canonical_long, r"$\frac13$.", r"\frac{1}{3}"),
    (m.canonical_long, "3j+1", "3i+1"), (m.squashed, r" A \$ b", "ab"),
]


def test_canonical_forms(spark):
    got = values(spark, CANONICAL)
    assert not [(t, v, want) for (_, t, want), v in zip(CANONICAL, got, strict=True) if v != want]


@pytest.mark.parametrize(("one", "other", "same"), [
    (r"\frac{1}{2}", "0.5", True), ("x^2+2x+1", "(x+1)^2", True), (r"2\sqrt{3}", r"\sqrt{12}", True), ("50%", "0.5", True), ("(1,2)", "(1, 2)", True), ("(1,2)", "(2,1)", False), ("x=3", "3", True), ("y=2x", "y-2x=0", True),
    (r"\begin{pmatrix}1&2\\3&4\end{pmatrix}", r"\begin{bmatrix}1&2\\3&4\end{bmatrix}", True), ("3", "4", False), ("", "1", False), ("__import__('os')", "1", False), ("9**9**9", "1", False), ("1,000", "1000", True), ("sin(x)", "cos(x)", False),
    (r"7\sin(\frac{\pi}{5}x)+1", "7*sin(pi*x/5)+1", True), ("2^{10}", "1024", True), ("x/0", "1", False),
])
def test_equal(one, other, same):
    assert m.equal(one, other) is same


EQUIVALENT = [
    ["x+1", "1+x", r"\frac{x^2-1}{x-1}", "(2x+2)/2", "x - (-1)"], ["x-1", "-1+x"], ["(a+b)^3", "a^3+3a^2b+3ab^2+b^3", "(b+a)(a+b)^2"], ["1/2", r"\frac{1}{2}", "0.5", r"\dfrac24", "2^{-1}", ".50"], [r"\sqrt{12}", r"2\sqrt3", "12^{1/2}", r"\frac{6}{\sqrt{3}}"],
    [r"1+\sqrt2", r"\frac{1}{\sqrt2-1}", r"\frac{2+\sqrt8}{2}"], [r"\sqrt{6}", r"\sqrt2\sqrt3", r"\frac{\sqrt{24}}{2}"], [r"\sqrt{10403}", r"\sqrt{101}\sqrt{103}"], [r"\sqrt[3]{-8}", "-2", "-4/2"], ["2i", r"\sqrt{-4}", r"\frac{-2}{i}"], ["-1", "i^2", "i^{10}"],
    [r"2\pi", r"\pi+\pi", r"\frac{4\pi^2}{2\pi}"], [r"\frac{a}{b}+\frac{c}{d}", r"\frac{ad+bc}{bd}"], ["1024", "2^{10}", "4^5"], [r"\sqrt[4]{4}", r"\sqrt{2}", "2^{0.5}"], ["x^{100}-y^{100}", "(x^{50}-y^{50})(x^{50}+y^{50})"], [r"\sin(2x)", r"\sin(x+x)"], ["(1,x+1)", "(1, 1+x)"], ["(x+1,1)"],
    ["1,000", "1000", "10^3"], [r"\sqrt[3]{16}", r"2\sqrt[3]{2}"], [r"\frac{1}{1+\frac{1}{x}}", r"\frac{x}{x+1}"], ["0", "x-x", r"\sqrt2-\sqrt2"], ["401", "+".join(["1"] * 401), "(" * 500 + "401" + ")" * 500], ["x", "(" * 400 + "x" + ")" * 400, "x" + "+0" * 3000], [r"\sqrt{5}-\sqrt{7}", r"-\frac{2}{\sqrt5+\sqrt7}"], [r"\sqrt{7}-\sqrt{5}"],
]


def test_equal_is_exact_and_keys_agree():
    """All pairs of forms: equal if and only if they are of one class, and so are their keys."""
    forms = [(k, f) for k, forms in enumerate(EQUIVALENT) for f in forms]
    wrong = [(f, g) for k, f in forms for n, g in forms if m.equal(f, g, percent=False) != (k == n)]
    keys = {f: m.key(f) for _, f in forms}
    wrong += [(f, g) for k, f in forms for n, g in forms if (keys[f] == keys[g]) != (k == n)]
    assert not wrong, wrong


@pytest.mark.parametrize(("one", "other", "same"), [
    ("10^{30}+1", "10^{30}", False), ("x^{1000000}", "x^{999999}x", True), ("9**9**9", "9**9**8", False), (r"\sin^2", "1", False), (r"\sin(x)\sin(x)+\cos(x)\cos(x)", "1", True), ("3.14159265", r"\pi", True), ("x+y=3", "3-y=x", True), ("x+y=3", "2x+2y=6", True),
    ("x+y=3", "2x+2y=3", False), (r"\sqrt{x^2}", "x", False), ("(x", "x", False), ("x)", "x", False), ("[1,2)", "(1,2)", True), ("x/0", "x/0+1", False), (r"\infty", r"\infty", True), (r"-\infty", r"\infty", False), (r"\sqrt{3+2\sqrt2}", r"1+\sqrt2", True),
])
def test_equal_without_bounds(one, other, same):
    assert m.equal(one, other, percent=False) is same


def test_the_field_is_what_it_should_be():
    from tallywright.functions.algebra import HALF, P

    def prime(n):  # Miller-Rabin
        d, k = n - 1, 0
        while d % 2 == 0:
            d, k = d // 2, k + 1
        powers = [[pow(b, d << i, n) for i in range(k)] for b in range(2, 60)]
        return all(x[0] == 1 or n - 1 in x for x in powers)

    assert prime(P) and prime(HALF) and P % 8 == 7 and all(pow(q, HALF, P) == 1 for q in range(2, 100))


def test_nothing_but_arithmetic_is_evaluated():
    for text in ("open('x')", "().__class__", "[1][0]", "lambda: 1", "1 if 1 else 2", "'a'", "True", "2**5000"):
        with pytest.raises((ValueError, SyntaxError)):
            m.evaluated(text)
    assert m.evaluated("(1, -2.5)") == (1, -2.5) and m.number("1e3") == 1000 and m.number("abc(") is None


@pytest.mark.parametrize(("p", "t", "kind", "options", "same"), [
    ("T", "True", "TF", [], True), ("t", "True", "TF", [], False), ("B: 1/2", "B", "MCS", ["A", "B"], True), ("(b)", "B", "MCS", ["A", "B"], True), ("A, C", "CA", "MCM", [], True), ("Paris", "paris", "OE", [], True), ("(1, 2)", "(1,2)", "OL", [], True),
    ("(2, 1)", "(1,2)", "OL", [], False), ("(2, 1)", "(1,2)", "UOL", [], True), ("(2, 2)", "(1,2)", "UOL", [], False), ("1.0005", "1", "NV", [], True), ("1.002", "1", "NV", [], False), ("x, t", "x, y", "OL", [], False),
])
def test_slots_by_type(p, t, kind, options, same):
    assert m.slot_equal(p, t, kind, options) is same


def test_equality_as_columns(spark):
    rows = [("1/2", "0.5", "(b)", "(B)"), ("x", None, "3.9", "4"), ("2", "3", "4.1", "4.0"), ("a", "A", "(3, 1)", "[1, 3]"), (None, "1", "yes", "False")]
    frame = spark.createDataFrame(rows, "p string, t string, q string, u string")
    got = frame.select(m.math_equal(F.col("p"), F.col("t")).alias("e"), m.verified(F.col("t"), F.col("p")).alias("v"), m.theorem_equal(F.col("q"), F.col("u")).alias("h"), m.numeric(F.col("p")).alias("n"), m.vote_key(F.col("p")).alias("k")).collect()
    assert [r.e for r in got] == [True, False, False, False, False] and [r.v for r in got] == [True, False, False, True, False]
    assert [r.h for r in got] == [True, True, True, True, False] and [r.n for r in got] == [0.5, None, 2.0, None, None] and got[0].k == "1/2" and [r.k for r in got][2:] == ["2", got[3].k, None]
    slots = spark.createDataFrame([(["1", "T"], ["1.0", "True"], ["NV", "TF"], [[], []]), (["1"], ["1", "2"], [], []), (None, ["1"], ["NV"], [[]])], "p array<string>, t array<string>, k array<string>, o array<array<string>>")
    assert [r[0] for r in slots.select(m.slots_equal(F.col("p"), F.col("t"), F.col("k"), F.col("o"))).collect()] == [[True, True], [False, False], [False]]


# grading of spans, choices, calls


def brute_assignment(scores):
    from itertools import permutations

    n, k = len(scores), len(scores[0])
    if n <= k:
        return max(sum(scores[i][p[i]] for i in range(n)) for p in permutations(range(k), n))
    return max(sum(scores[p[j]][j] for j in range(k)) for p in permutations(range(n), k))


def test_assignment_is_the_best():
    import random

    r = random.Random(4)
    for _ in range(60):
        scores = [[r.choice([0, 0, r.random() * 100]) for _ in range(c)] for c in [r.randint(1, 5)] for _ in range(r.randint(1, 5))]
        pairs = g.assignment(scores)
        assert len(pairs) == min(len(scores), len(scores[0])) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
        assert abs(sum(scores[i][j] for i, j in pairs) - brute_assignment(scores)) < 1e-9


def test_spans(spark):
    rows = [("the Red Fox", "red fox|dog"), ("3 yards", "3.0 yards"), ("4 yards", "3 yards"), ("", " | "), ("x", ""), ("two words", "words")]
    got = spark.createDataFrame(rows, "p string, r string").select(g.drop_scores(F.col("p"), F.split("r", r"\|")).alias("s")).collect()
    assert [(r.s.em, r.s.f1) for r in got] == [(1.0, 100.0), (1.0, 100.0), (0.0, 0.0), (1.0, 100.0), (0.0, 0.0), (0.0, 66.67)]
    bags = spark.createDataFrame([([["a"], ["b", "c"]], [["b", "c"], ["a"], ["d"]]), ([], [["a"]])], "p array<array<string>>, g array<array<string>>")
    assert [r[0] for r in bags.select(g.aligned_f1(F.col("p"), F.col("g"))).collect()] == [66.67, 0.0]


def test_choices_and_likelihoods(spark):
    frame = spark.createDataFrame([({" A": -1.0, "A": -2.0, "B ": -0.5}, ["x ", "A", " B"], [-1.0, -2.0, None], 2)], "top map<string,double>, tokens array<string>, p array<double>, n int")
    row = frame.select(
        g.choice_scores(F.col("top"), ["A", "B"]).alias("ab"), g.choice_scores(F.col("top"), ["A", "C"]).alias("ac"), g.option_logprob(F.col("tokens"), F.col("p"), "A").alias("o"), g.continuation_logprob(F.col("tokens"), F.col("p"), F.lit(2)).alias("c"),
        g.echoed_logprob(F.col("p"), F.col("n")).alias("e"), g.official_scores(F.array(F.lit(0.0), F.lit(0.0))).alias("s"),
    ).first()
    assert (row.ab, row.ac, row.o, row.c, row.e, row.s) == ([-1.0, -0.5], None, -2.0, -2.0, -2.0, [0.5, 0.5])


def test_hierarchy_graders(spark):
    cases = [
        (lambda t: g.language_named(F.array(F.lit("English")), t), 'so {"language": "english"', True), (lambda t: g.language_named(F.array(F.lit("English")), t), '{"language": "English"} {"language": "x"}', False), (lambda t: g.verbs_score(F.lit("run, jump"), t), "run, fly", 0.5),
        (lambda t: g.verbs_score(F.lit("run, jump"), t, True), "Verbs: run, jump", 1.0), (lambda t: g.translation_score(F.lit("el gato negro"), t), "el gato", 0.8), (lambda t: g.translation_score(F.lit("el gato"), t, True), "Here:\nel gato", 1.0), (lambda t: g.same_word(F.lit("bob"), t), " Bob. ", True),
        (lambda t: g.gatekept(F.lit(1), F.lit("k"), F.lit("p"), t), "Access Granted", True), (lambda t: g.gatekept(F.lit(0), F.lit("secret"), F.lit(None).cast("string"), t), "the SECRET", False), (lambda t: g.gatekept(F.lit(0), F.lit("zz"), F.lit("one two three four"), t), "one two x", False),
        (lambda t: g.mixed_score(F.lit("lang_detect"), F.lit("French"), t), '{"language": "French"}', 1.0), (lambda t: g.call_scores(t, F.lit('{"name": "f", "args": {"a": 1, "b": "x"}}'))["args_f1"], '{"name": "f", "args": {"a": 1, "b": "y"}}', 0.5),
        (lambda t: g.call_scores(t, F.lit('{"name": "f", "args": {}}'))["name"], "no json", 0.0), (lambda t: g.call_scores(t, F.lit('{"name": "f", "args": {}}'))["args_recall"], "{'name': 'f', 'args': {}}", 1.0), (lambda t: F.round(g.unigram_recall(F.lit("a b c d"), t), 2), "a b", 0.5),
    ]
    got = values(spark, cases)
    assert not [(t, v, want) for (_, t, want), v in zip(cases, got, strict=True) if v != want and not (isinstance(v, float) and abs(v - want) < 1e-9)]

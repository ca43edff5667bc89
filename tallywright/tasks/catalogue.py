"""All named tasks. Instructions and templates of prompts are fixed values of the benchmarks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions import answers, constraints, ifbench, multi_if
from tallywright.functions.deadline import limit
from tallywright.functions.mathematics import canonical, canonical_value, math_equal, slots_equal, theorem_equal, verified, vote_key
from tallywright.functions.text import exact_match_form, fenced_code, flexible_number, judge_confidence, judge_grade, judge_yes
from tallywright.functions.words import stripped
from tallywright.operators import grading
from tallywright.sources.benchmarks import CHINESE_CLOZE, CHINESE_QA, ENGLISH_CLOZE, ENGLISH_QA, MANY_LETTERS, OTHERWISE, category
from tallywright.sources.tables import Dataset
from tallywright.tasks import reports
from tallywright.tasks.core import JUDGED, REQUESTED, Task, drawn_examples, examples_by, filled, identified

TASKS: dict[str, Task] = {}


def add(name: str, dataset: str, samples: Callable, judge: Callable, report: Callable, headline: str | None, denominator: str = REQUESTED, mode: str = "gen", shots: int = 0, **options: object) -> None:
    TASKS[name] = Task(name, dataset, mode, headline, denominator, samples, judge, report, shots, options)


def prompted(data: Dataset, prompt: Column, reference: Column, **more: Column) -> DataFrame:
    """Samples of the test split."""
    return identified(data.test).select("sample_id", prompt.alias("prompt"), reference.alias("reference"), *[v.alias(k) for k, v in more.items()])


def judged(rows: DataFrame, answer: Column, correct: Callable[[Column], Column], **more: Column) -> DataFrame:
    """Verdicts of rollouts (text); what isn't extracted is wrong. Under a deadline, what wasn't decided in time is wrong and ``timed_out``."""
    found = rows.withColumn("answer", F.nullif(answer.cast("string"), F.lit("")))
    if limit() is not None:
        found = found.withColumn("correct", correct(F.col("answer"))).withColumn("extracted", F.col("answer").isNotNull())
        found = found.withColumn("timed_out", F.col("extracted") & F.col("reference").isNotNull() & F.col("correct").isNull()).withColumn("correct", F.coalesce("correct", F.lit(False)))
        return found.withColumns(more) if more else found
    out = found.withColumn("extracted", F.col("answer").isNotNull()).withColumn("correct", F.coalesce(correct(F.col("answer")), F.lit(False)))
    return out.withColumns(more) if more else out


def text() -> Column:
    return F.col("text")


def reference() -> Column:
    return F.col("reference")


# competitions

BOXED = "Put your final answer within \\boxed{}."
TO_999 = BOXED + "\nThe answer is an integer between 0 and 999 inclusive."
SECTION = BOXED + " Thus, format your final answer as follows:\n\n### Final answer\n\nThe final answer is \\boxed{your final answer}."
REASON = "Please reason step by step. Put your final answer within \\boxed{}."
STEPS = 'Solve the following math problem step by step. The last line of your response should be of the form Answer: $ANSWER (without quotes) where $ANSWER is the answer to the problem.\n\n{problem}\n\nRemember to put your answer on its own line after "Answer:", and you do not need to use a \\boxed command.'
LINE = r"(?i)Answer\s*:\s*([^\n]+)"


def _competition(instruction: str) -> Callable[[Dataset], DataFrame]:
    return lambda data: prompted(data, F.concat(F.lit(instruction + "\n\n"), F.col("problem")), F.col("answer"))


def _boxed_verdicts(rows: DataFrame) -> DataFrame:
    """The boxed answer, all boxes of the last line if the gold is a list; without any, the last whole number."""
    return judged(rows, answers.competition_answer(text(), reference().contains(",")), lambda a: verified(reference(), a), vote=vote_key(F.col("answer")))


def _sampled(samples: DataFrame, verdicts: DataFrame, n: int, k: int, votes: bool = True) -> DataFrame:
    return reports.sampled(samples, verdicts, n, k, votes)


for _name, _instruction in {"aime_2026": TO_999, "apex_2025": BOXED, "apex_shortlist_2025": BOXED, "brumo_2025": BOXED, "cmimc_2025": SECTION, "hmmt_feb_2025": BOXED, "hmmt_feb_2026": BOXED, "hmmt_nov_2025": BOXED, "smt_2025": BOXED, "imo_answer_bench": REASON}.items():
    add(f"{_name}_0shot_gen", _name, _competition(_instruction), _boxed_verdicts, _sampled, "pass@1")


def _lined(column: str) -> Callable[[Dataset], DataFrame]:
    return lambda data: prompted(data, filled(STEPS, problem=F.col(column)), F.col("answer"))


def _line_verdicts(rows: DataFrame) -> DataFrame:
    return judged(rows, stripped(F.regexp_extract(text(), LINE, 1)), lambda a: verified(reference(), a), vote=vote_key(F.col("answer")))


for _name, _column in {"aime_2024": "problem", "aime_2025": "question", "math_500": "problem"}.items():
    add(f"{_name}_0shot_gen", _name, _lined(_column), _line_verdicts, _sampled, "pass@1")


def _shots(data: Dataset, split: str, n: int, shot: Column, seed: int, glue: str = "") -> DataFrame:
    return drawn_examples(data.splits[split], n, shot, seed, glue)


def _with_prefix(data: Dataset, prefix: DataFrame, prompt: Callable[[Column], Column], reference: Column, **more: Column) -> DataFrame:
    rows = identified(data.test).crossJoin(F.broadcast(prefix))  # one row
    return rows.select("sample_id", prompt(F.col("prefix")).alias("prompt"), reference.alias("reference"), *[v.alias(k) for k, v in more.items()])


def _hendrycks(data: Dataset) -> DataFrame:
    shot = F.concat(F.lit("Problem: "), F.col("problem"), F.lit("\nSolution: "), F.col("solution"), F.lit("\n\n"))
    return _with_prefix(data, _shots(data, "train", 4, shot, 1234), lambda p: F.concat(p, F.lit("Problem: "), F.col("problem"), F.lit("\nSolution: ")), answers.last_box(F.col("solution")))


add(
    "hendrycks_math_kshot_base_gen", "hendrycks_math", _hendrycks,
    lambda rows: judged(rows, F.coalesce(answers.last_box(text(), False), answers.stated_answer(text())), lambda a: (canonical(a) == canonical(reference())) | math_equal(a, reference()), vote=vote_key(F.col("answer"))),
    _sampled, "accuracy", shots=4,
)

# school mathematics

COT = "\nPlease reason step by step, and put your final answer within \\boxed{}."


def _school(data: Dataset) -> DataFrame:
    return prompted(data, F.concat(F.col("question"), F.lit(COT)), answers.after_last(F.col("answer"), "#### "))


def _school_verdicts(rows: DataFrame) -> DataFrame:
    return judged(rows, F.coalesce(answers.last_box(text()), answers.last_of(text(), f"({answers.NUMBER})")), lambda a: verified(F.replace(reference(), F.lit(","), F.lit("")), F.replace(a, F.lit(","), F.lit(""))))


add("gsm8k_0shot_gen", "gsm8k", _school, _school_verdicts, lambda s, v, n, k: reports.together(reports.accuracy(s, v, True), reports.sampled(s, v, n, k).where("metric not in ('score', 'fails', 'n_unextracted')")), "accuracy")
add("gsm1k_0shot_gen", "gsm1k", _school, _school_verdicts, lambda s, v, n, k: reports.accuracy(s, v, True), "accuracy")


def _exact_forms(rows: DataFrame) -> DataFrame:
    """Strict: the number behind ####. Flexible: the last thing like a number. Both as forms that are compared as texts."""
    strict, loose = answers.strict_form(text()), exact_match_form(flexible_number(text()))
    gold = answers.prefixed_form(reference())
    out = judged(rows, strict, lambda a: a == gold)
    return out.withColumn("flexible", F.coalesce((loose != "") & (loose == gold), F.lit(False)))


def _two_rates(samples: DataFrame, verdicts: DataFrame, requested: bool, headline: str) -> DataFrame:
    both = [reports.accuracy(samples, verdicts, requested, name, column) for name, column in (("exact_match", "correct"), ("flexible_exact_match", "flexible"))]
    score = next(b for b, name in zip(both, ("exact_match", "flexible_exact_match"), strict=True) if name == headline)
    return reports.together(score, *[b.where(F.col("metric").endswith("exact_match")) for b in both if b is not score])


def _school_shots(n: int) -> Callable[[Dataset], DataFrame]:
    def samples(data: Dataset) -> DataFrame:
        asked = F.concat(F.lit("Question: "), F.col("question"), F.lit("\nAnswer:"))
        prefix = _shots(data, "train", n, F.concat(asked, F.lit(" "), F.col("answer"), F.lit("\n\n")), 1234)
        return _with_prefix(data, prefix, lambda p: F.concat(p, asked), answers.after_last(F.col("answer"), "#### "))

    return samples


add("gsm8k_kshot_base_gen", "gsm8k", _school_shots(8), _exact_forms, lambda s, v, n, k: _two_rates(s, v, False, "exact_match"), "exact_match", JUDGED, shots=8)
add("gsm1k_kshot_base_gen", "gsm1k", _school_shots(5), _exact_forms, lambda s, v, n, k: _two_rates(s, v, True, "flexible_exact_match"), "flexible_exact_match", shots=5)

VALUE = "Your task is to solve a series of math word problems by providing the final answer. Use the format #### [value] to highlight your answer. For example, if the answer is 560, you should write #### 560. Make sure to carefully read and understand each problem before providing your answer."


def _perturbed(data: Dataset) -> DataFrame:
    gold = answers.no_extra_zeros(F.replace(F.trim(answers.last_of(F.regexp_replace(F.col("solution"), r"\.\s*\z", ""), r"(?d)####(.*)")), F.lit(","), F.lit("")))
    return prompted(data, F.concat(F.lit(VALUE + "\n\n"), F.col("question")), gold, perturbation_type=F.col("perturbation_type"))


def _perturbed_verdicts(rows: DataFrame) -> DataFrame:
    found = answers.perturbed_answer(text(), F.col("perturbation_type"))
    return judged(rows, found, lambda a: F.when((reference() == "None") | (a == "None"), a == reference()).otherwise((a == reference()) | math_equal(a, reference(), False)))


def _perturbed_report(samples: DataFrame, verdicts: DataFrame, n: int, k: int) -> DataFrame:
    rest = samples.where("perturbation_type is null or perturbation_type <> 'critical thinking'")
    without = reports.accuracy(rest, verdicts.join(rest.select("sample_id"), "sample_id", "left_semi"), True, "score_wo_critical_thinking").where("metric = 'score_wo_critical_thinking'")
    return reports.together(reports.accuracy(samples, verdicts, True), without, reports.accuracies(samples, verdicts, "perturbation_type", True))


add("gsm_plus_0shot_gen", "gsm_plus", _perturbed, _perturbed_verdicts, _perturbed_report, "accuracy")


def _platinum(subset: str) -> Callable[[Dataset], DataFrame]:
    def samples(data: Dataset) -> DataFrame:
        rows = Dataset({"test": data.test.where(F.col("subset") == subset)})
        return prompted(rows, F.col("platinum_prompt"), F.get("platinum_target", F.lit(0)), targets=F.col("platinum_target"))

    return samples


def _platinum_verdicts(rows: DataFrame) -> DataFrame:
    """The last number on the answer's line, without currency and commas; equal to the first target as a number."""
    line = F.coalesce(answers.last_of(text(), r"(?i)answer\s*:\s*([^\n]*)"), answers.last_of(stripped(text()), r"([^\n]+)"))
    number = answers.last_of(F.regexp_replace(line, "[$,]", ""), f"({answers.NUMBER})")
    return judged(rows, number, lambda a: a.try_cast("double") == reference().try_cast("double"))


def _with_errors(samples: DataFrame, verdicts: DataFrame, n: int, k: int) -> DataFrame:
    wrong = reports.first_only(verdicts).agg(F.count_if(~F.col("correct")).alias("v"))
    return reports.together(reports.accuracy(samples, verdicts, True), reports.metrics(wrong, n_errors=F.col("v")), reports.sampled(samples, verdicts, n, k).where("metric not in ('score', 'fails', 'n_unextracted')"))


for _subset in ("gsm8k", "multiarith", "singleop", "singleq", "svamp"):
    add(f"platinum_{_subset}_0shot_gen", "platinum_bench", _platinum(_subset), _platinum_verdicts, _with_errors, "accuracy")

# choices in words

MULTIPLE = "Answer the following multiple choice question. The last line of your response should be of the following format: 'Answer: $LETTER' (without quotes) where LETTER is one of ABCD. Think step by step before answering.\n\n{Question}\n\nA) {A}\nB) {B}\nC) {C}\nD) {D}"


def _letter(place: Column) -> Column:
    return F.substring(F.lit("ABCDEFGHIJKLMNOP"), place.cast("int") + 1, F.lit(1))


def _mmlu_words(data: Dataset) -> DataFrame:
    options = {letter: F.get("choices", F.lit(i)) for i, letter in enumerate("ABCD")}
    return prompted(data, filled(MULTIPLE, Question=F.col("question"), **options), _letter(F.col("answer")), category=category(F.col("subject"), OTHERWISE))


def _by_category(samples: DataFrame, verdicts: DataFrame, n: int, k: int) -> DataFrame:
    return reports.together(reports.accuracy(samples, verdicts, False), reports.accuracies(samples, verdicts, "category", False))


add("mmlu_0shot_gen", "mmlu", _mmlu_words, lambda rows: judged(rows, answers.announced_option(text()), lambda a: a == reference()), _by_category, "score", JUDGED)


def _mmlu_pro(data: Dataset) -> DataFrame:
    named = F.transform("options", lambda o, i: F.when(o != "N/A", F.concat(_letter(i), F.lit(". "), o)))
    listed = F.array_join(F.filter(named, lambda x: x.isNotNull()), "\n")
    head = "Answer the following multiple choice question. The last line of your response should be of the following format: 'ANSWER: $LETTER' (without quotes) where LETTER is one of Options(e.g. one of ABCDEFGHIJKLMNOP). Think step by step before answering.\n\nQuestion:\n\n{question}\n\nOptions:\n\n{options}"
    return prompted(data, filled(head, question=F.col("question"), options=listed), F.col("answer"), category=F.col("category"))


add("mmlu_pro_0shot_gen", "mmlu_pro", _mmlu_pro, lambda rows: judged(rows, answers.lettered(text(), "A-P"), lambda a: a == reference()), _by_category, "score", JUDGED)


def _gpqa(data: Dataset, repeats: int = 4, seed: int = 0) -> DataFrame:
    """Each question so many times, each time with its options in another drawn order."""
    rows = identified(data.test).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    choices = F.array(*[F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), "sample_id", "repeat", F.lit(str(i)))).alias("at"), F.col(c).alias("choice"), F.lit(i == 0).alias("right")) for i, c in enumerate(("Correct Answer", "Incorrect Answer 1", "Incorrect Answer 2", "Incorrect Answer 3"))])
    rows = rows.withColumn("order", F.array_sort(choices)).withColumn("sample_id", F.xxhash64("sample_id", "repeat"))
    options = {letter: F.get("order", F.lit(i))["choice"] for i, letter in enumerate("ABCD")}
    gold = _letter(F.array_position(F.transform("order", lambda x: x["right"]), True) - 1)
    return rows.select("sample_id", filled(MULTIPLE, Question=F.col("Question"), **options).alias("prompt"), gold.alias("reference"), "repeat")


add("gpqa_diamond_0shot_gen", "gpqa_diamond", _gpqa, lambda rows: judged(rows, F.regexp_extract(text(), r"(?i)Answer[ \t]*:[ \t]*\$?([A-D])\$?", 1), lambda a: a == reference()), lambda s, v, n, k: reports.accuracy(s, v, False), "score", JUDGED)


def _openbook(data: Dataset) -> DataFrame:
    named = F.zip_with(F.col("choices.label"), F.col("choices.text"), lambda a, b: F.concat(a, F.lit(". "), b))
    return prompted(data, F.concat(F.col("question_stem"), F.lit("\n"), F.array_join(named, "\n"), F.lit("\nAnswer:")), F.col("answerKey"))


add("openbookqa_kshot_gen", "openbookqa", _openbook, lambda rows: judged(rows, answers.first_option(text(), "ABCD"), lambda a: a == reference()), lambda s, v, n, k: reports.accuracy(s, v, False), "accuracy", JUDGED)

EXAM_GROUPS = {"macro_en_mcq": [s for s in ENGLISH_QA if s != "gaokao-english"], "macro_zh_mcq": [*CHINESE_QA, "gaokao-english"], "macro_math": ["sat-math", "aqua-rat", "gaokao-mathqa", "gaokao-mathcloze", "math"]}


def _exams(data: Dataset) -> DataFrame:
    question = F.concat(F.coalesce(F.concat(F.col("passage"), F.lit("\n")), F.lit("")), F.col("question"), F.lit("\n"), F.array_join("options", "\n"))
    return prompted(data, question, F.coalesce("label", "answer"), subset=F.col("subset"))


def _exam_verdicts(rows: DataFrame) -> DataFrame:
    """By what a subset wants: a value, a set of letters, or the first letter."""
    cloze, many = F.col("subset").isin(*ENGLISH_CLOZE, *CHINESE_CLOZE), F.col("subset").isin(*MANY_LETTERS)
    letters = F.array_join(F.array_sort(F.array_distinct(answers.all_letters(text()))), "")
    found = F.when(cloze, answers.cloze_answer(text())).when(many, letters).otherwise(answers.first_capital(text()))
    gold = F.array_join(F.array_sort(F.array_distinct(answers.all_letters(reference()))), "")
    return judged(rows, found, lambda a: F.when(cloze, canonical_value(a) == canonical_value(reference())).when(many, a == gold).otherwise(a == reference()))


add("agieval_0shot_gen", "agieval", _exams, _exam_verdicts, lambda s, v, n, k: reports.together(reports.macro(s, v, "subset", EXAM_GROUPS, whole=True), reports.accuracies(s, v, "subset", False), reports.health(s, v)), "score", JUDGED)

# choices by log probability


def _clp_verdicts(labels: str) -> Callable[[DataFrame], DataFrame]:
    """The label of the largest score among the first token's; samples that lack a label's score fail, and so have no verdict."""

    def judge(rows: DataFrame) -> DataFrame:
        scored = rows.withColumn("scores", grading.choice_scores(F.col("top"), list(labels))).where("scores is not null")
        place = grading.first_best(F.col("scores"))
        return scored.withColumn("answer", F.substring(F.lit(labels), place.cast("int") + 1, F.lit(1))).withColumns({"extracted": F.lit(True), "correct": F.col("answer") == reference()})

    return judge


def _options(row: dict[str, Column]) -> Column:
    return F.concat(*[x for letter, c in row.items() for x in (F.lit(f"\n{letter}. "), c)])


def _exam_shots(data: Dataset, split: str, by: list[str], n: int, question: Column, answer: Column, cue: str, head: Callable[[Column], Column], gold: Column, **more: Column) -> DataFrame:
    """Few-shot prompts of multiple choice: a group's head, n answered examples of the same group, the open question."""
    rows = identified(data.test)
    shots = examples_by(data.splits[split], by, n, F.concat(question, F.lit(cue), answer, F.lit("\n\n")), F.xxhash64(F.to_json(F.struct(*data.splits[split].columns)))) if n else rows.select(*by).distinct().withColumn("prefix", F.lit(""))
    joined = rows.join(shots, by)
    return joined.select("sample_id", F.concat(head(F.col(by[-1])), F.col("prefix"), question, F.lit(cue)).alias("prompt"), gold.alias("reference"), *[v.alias(k) for k, v in more.items()])


def _spoken(subject: Column) -> Column:
    return F.concat(F.lit(" "), F.replace(subject, F.lit("_"), F.lit(" ")))


def _mmlu_clp(data: Dataset, shots: int = 5, split: str = "dev") -> DataFrame:
    question = F.concat(F.col("question"), _options({letter: F.get("choices", F.lit(i)) for i, letter in enumerate("ABCD")}))
    head = lambda s: F.concat(F.lit("The following are multiple choice questions (with answers) about"), _spoken(s), F.lit(".\n\n"))
    return _exam_shots(data, split, ["subject"], shots, question, F.concat(F.lit(" "), _letter(F.col("answer"))), "\nAnswer:", head, _letter(F.col("answer")), category=category(F.col("subject"), OTHERWISE))


add("mmlu_kshot_clp", "mmlu", _mmlu_clp, _clp_verdicts("ABCD"), _by_category, "score", JUDGED, "clp", 5)


def _columns(*names: str) -> dict[str, Column]:
    return {n: F.col(n) for n in names}


def _chinese_exam(head: str) -> Callable[..., DataFrame]:
    def samples(data: Dataset, shots: int = 5, split: str = "dev") -> DataFrame:
        question = F.concat(F.col("question"), _options(_columns(*"ABCD")))
        return _exam_shots(data, split, ["subject"], shots, question, F.col("answer"), "\n答案：", lambda s: filled(head, subject=s), F.col("answer"), subject=F.col("subject"))

    return samples


# Subjects of the Chinese exams by category.
C_EVAL = {
    "stem": "advanced_mathematics college_chemistry college_physics college_programming computer_architecture computer_network discrete_mathematics electrical_engineer high_school_biology high_school_chemistry high_school_mathematics high_school_physics metrology_engineer middle_school_biology middle_school_chemistry middle_school_mathematics middle_school_physics operating_system probability_and_statistics veterinary_medicine",
    "social_science": "business_administration college_economics education_science high_school_geography high_school_politics mao_zedong_thought marxism middle_school_geography middle_school_politics teacher_qualification",
    "humanities": "art_studies chinese_language_and_literature high_school_chinese high_school_history ideological_and_moral_cultivation law legal_professional logic middle_school_history modern_chinese_history professional_tour_guide",
    "other": "accountant basic_medicine civil_servant clinical_medicine environmental_impact_assessment_engineer fire_engineer physician plant_protection sports_science tax_accountant urban_and_rural_planner",
}


def _subject_macro(groups: dict[str, list[str]] | None) -> Callable[..., DataFrame]:
    def report(samples: DataFrame, verdicts: DataFrame, n: int, k: int, groups: dict[str, list[str]] | None = groups) -> DataFrame:
        named = samples.withColumn("subject", F.coalesce(F.nullif("subject", F.lit("")), F.lit("miscellaneous")))
        return reports.together(reports.macro(named, verdicts, "subject", groups), reports.metrics(reports.counts(samples, verdicts), fails=F.col("fails")))

    return report


add("c_eval_kshot_clp", "c_eval", _chinese_exam("以下是中国关于{subject}考试的单项选择题，请选出其中的正确答案。\n\n"), _clp_verdicts("ABCD"), _subject_macro({k: v.split() for k, v in C_EVAL.items()}), "overall", JUDGED, "clp", 5)
#: Categories of this exam overlap; a table of them is given to the report as ``groups``.
add("cmmlu_kshot_clp", "cmmlu", _chinese_exam("以下是关于{subject}的单项选择题，请直接给出正确答案的选项。\n\n"), _clp_verdicts("ABCD"), _subject_macro(None), "overall", JUDGED, "clp", 5)


def _locales(data: Dataset, shots: int = 5) -> DataFrame:
    """The first examples of each locale and subject are shown, and not asked."""
    question = F.concat(F.col("Question"), _options(_columns(*"ABCD")))
    order = F.xxhash64(F.to_json(F.struct(*data.test.columns)))
    ranked = data.test.withColumn("_place", F.row_number().over(_window(["Locale", "Subject"], order)))
    shown, asked = ranked.where(F.col("_place") <= shots).drop("_place"), ranked.where(F.col("_place") > shots).drop("_place")
    head = lambda s: F.concat(F.lit("The following are multiple choice questions (with answers) about"), _spoken(s), F.lit(".\n\n"))
    return _exam_shots(Dataset({"test": asked, "dev": shown}), "dev", ["Locale", "Subject"], shots, question, F.concat(F.lit(" "), F.col("Answer")), "\nAnswer:", head, F.col("Answer"), locale=F.col("Locale"), category=F.col("Category"), subject=F.col("Subject"))


def _window(by: list[str], order: Column):  # noqa: ANN202
    from pyspark.sql.window import Window

    return Window.partitionBy(*by).orderBy(order)


def _locale_report(samples: DataFrame, verdicts: DataFrame, n: int, k: int) -> DataFrame:
    """Accuracy over all, of each locale, and of each category and subject in it: grouping sets over one pass."""
    hits = reports.first_only(verdicts).select("sample_id", F.col("correct").alias("hit"))
    rows = samples.join(hits, "sample_id")
    cells = rows.groupingSets([[], ["locale"], ["locale", "category"], ["locale", "subject"]], "locale", "category", "subject").agg(F.grouping_id().alias("g"), F.count_if("hit").alias("k"), F.count("*").alias("n"))
    name = F.when(F.col("g") == 7, "score_mmmlu").otherwise(F.concat_ws("_", F.lit("score"), "locale", "category", "subject"))
    report = cells.where("n > 0").select(name.alias("metric"), reports.rate(F.col("k"), F.col("n")).alias("value"))
    return reports.together(report, report.where("metric = 'score_mmmlu'").select(F.lit("score").alias("metric"), "value"), reports.metrics(reports.counts(samples, verdicts), fails=F.col("fails")))


add("mmmlu_kshot_clp", "mmmlu", _locales, _clp_verdicts("ABCD"), _locale_report, "score_mmmlu", JUDGED, "clp", 5)


def _arc_clp(data: Dataset, shots: int = 25, split: str = "train") -> DataFrame:
    listed = F.array_join(F.transform("choices", lambda c, i: F.concat(F.lit("\n"), _letter(i), F.lit(". "), c)), "")
    question = F.concat(F.lit("Question: "), F.col("question"), listed, F.lit("\nAnswer:"))
    prefix = _shots(data, split, shots, F.concat(question, F.lit(" "), _letter(F.col("answer")), F.lit("\n\n")), 1234)
    return _with_prefix(data, prefix, lambda p: F.concat(p, question), _letter(F.col("answer")), n_choices=F.size("choices"))


def _arc_verdicts(rows: DataFrame) -> DataFrame:
    """Among as many labels as the question has choices, all of which need a score."""
    scores = F.coalesce(*[F.when(F.col("n_choices") == n, grading.choice_scores(F.col("top"), list("ABCDE"[:n]))) for n in (3, 4, 5)])
    scored = rows.withColumn("scores", scores).where("scores is not null")
    return scored.withColumn("answer", _letter(grading.first_best(F.col("scores")))).withColumns({"extracted": F.lit(True), "correct": F.col("answer") == reference()})


def _arc_ppl(data: Dataset, shots: int = 25, split: str = "train") -> DataFrame:
    context = F.concat(F.lit("Question: "), F.col("question"), F.lit("\nAnswer:"))
    prefix = _shots(data, split, shots, F.concat(context, F.lit(" "), F.get("choices", F.col("answer")), F.lit("\n\n")), 1234)
    return _with_prefix(data, prefix, lambda p: F.concat(p, context), F.col("answer").cast("string"), choices=F.col("choices"))


def _arc_ppl_verdicts(rows: DataFrame) -> DataFrame:
    """Of each choice (rows: conditional and unconditional, arrays by choice of logprobs and input_tokens) the gain of its likelihood; the first largest."""
    gain = F.zip_with("conditional", "unconditional", lambda a, b: grading.echoed_logprob(a["logprobs"], a["input_tokens"]) - grading.echoed_logprob(b["logprobs"], b["input_tokens"]))
    return rows.withColumn("scores", gain).withColumn("answer", grading.first_best(F.col("scores")).cast("string")).withColumns({"extracted": F.lit(True), "correct": F.col("answer") == reference()})


def _acc(samples: DataFrame, verdicts: DataFrame, n: int, k: int) -> DataFrame:
    return reports.accuracy(samples, verdicts, False, "acc")


for _name in ("arc_challenge", "arc_easy"):
    add(f"{_name}_kshot_clp", _name, _arc_clp, _arc_verdicts, _acc, "acc", JUDGED, "clp", 25)
    add(f"{_name}_kshot_ppl", _name, _arc_ppl, _arc_ppl_verdicts, _acc, "acc", JUDGED, "ppl", 25)


def _ending(t: Column) -> Column:
    """Without bracketed notes and doubled spaces, titles as sentences."""
    return F.replace(F.regexp_replace(F.replace(stripped(t), F.lit(" [title]"), F.lit(". ")), r"\[.*?\]", ""), F.lit("  "), F.lit(" "))


def _hellaswag(data: Dataset, shots: int = 10, split: str = "train") -> DataFrame:
    query = _ending(F.concat(F.col("activity_label"), F.lit(": "), F.col("ctx_a"), F.lit(" "), F.concat(F.upper(F.substring("ctx_b", 1, 1)), F.substring(F.col("ctx_b"), F.lit(2), F.length("ctx_b")))))
    choices = F.transform("endings", _ending)
    gold = F.get(choices, F.col("label").cast("int"))
    prefix = _shots(data, split, shots, F.concat(query, F.lit(" "), gold), 1234, "\n\n")
    return _with_prefix(data, prefix, lambda p: F.concat(p, F.lit("\n\n"), query), F.col("label").cast("string"), choices=choices)


def _hellaswag_verdicts(rows: DataFrame) -> DataFrame:
    """Of each choice (rows: continuations, an array by choice of tokens and logprobs) the likelihood behind the prompt, and that by its characters."""
    totals = F.transform("continuations", lambda c: grading.continuation_logprob(c["tokens"], c["logprobs"], F.length("prompt")))
    normal = F.zip_with(totals, "choices", lambda t, c: F.when(F.length(c) > 0, t / F.length(c)).otherwise(t))
    out = rows.withColumn("answer", grading.first_best(normal).cast("string")).withColumn("plain", grading.first_best(totals).cast("string"))
    return out.withColumns({"extracted": F.lit(True), "correct": F.col("answer") == reference(), "acc": F.col("plain") == reference()})


add("hellaswag_kshot_ppl", "hellaswag", _hellaswag, _hellaswag_verdicts, lambda s, v, n, k: reports.together(reports.accuracy(s, v, True, "acc_norm"), reports.accuracy(s, v, True, "acc", "acc").where("metric = 'acc'")), "acc_norm", REQUESTED, "ppl", 10)

# reading


def _drop(data: Dataset, shots: int = 3) -> DataFrame:
    prefix = _shots(data, "train", shots, F.concat(F.lit("---\n"), F.col("context"), F.lit(" "), F.col("completion")), 42, "\n\n")
    head = 'You will be asked to read a passage and answer a question. Some examples of passages and Q&A are provided below.\n\n# Examples\n{few_shot_str}\n\n# Your Task\n\n---\n{context} \n\nThink step by step, then write a line of the form "Answer: $ANSWER" at the end of your response.\n'
    return _with_prefix(data, prefix, lambda p: filled(head, few_shot_str=p, context=F.col("context")), F.col("ref_text"))


def _drop_verdicts(rows: DataFrame) -> DataFrame:
    """The answer's line, or the whole response; the best over the references between bars."""
    said = F.coalesce(answers.first_of(text(), LINE), text())
    scores = grading.drop_scores(F.coalesce(F.col("answer"), F.lit("")), F.split(reference(), r"\|"))
    return judged(rows, said, lambda a: F.lit(False)).withColumn("s", scores).withColumns({"em": F.col("s.em"), "f1": F.col("s.f1") / 100, "correct": F.col("s.em") == 1})


add("drop_kshot_gen", "drop", _drop, _drop_verdicts, lambda s, v, n, k: reports.means(s, v, ["em", "f1"], "f1"), "f1", JUDGED, shots=3)


def _long_documents(data: Dataset) -> DataFrame:
    documents = F.array_join(F.transform("documents", lambda d, i: F.concat(F.lit("BEGIN DOCUMENT "), i + 1, F.lit(":\n"), d, F.lit("\nEND DOCUMENT "), i + 1)), "\n\n")
    head = "BEGIN INPUT DOCUMENTS\n\n{documents}\n\nEND INPUT DOCUMENTS\n\nAnswer the following question using the input documents provided above.\n\nSTART QUESTION\n\n{question}\n\nEND QUESTION\n"
    return prompted(data, filled(head, documents=documents, question=F.col("question")), F.col("answer"))


def _reply_verdicts(verdict: Callable[[Column], Column], answer: Callable[[Column], Column] = lambda t: t) -> Callable[[DataFrame], DataFrame]:
    """Rollouts with a judge's reply each."""
    return lambda rows: judged(rows, answer(text()), lambda a: verdict(F.coalesce("reply", F.lit(""))))


add("aa_lcr_0shot_gen", "aa_lcr", _long_documents, _reply_verdicts(answers.judge_correct), lambda s, v, n, k: reports.graded(s, v, n), "accuracy")
add("browsecomp_0shot_gen", "browsecomp", lambda data: prompted(data, F.concat(F.col("problem"), F.lit("\n\nYour response should be in the following format:\nExplanation: {your explanation for your final answer}\nExact Answer: {your succinct, final answer}\nConfidence: {your confidence score between 0% and 100% for your answer}")), F.col("answer")), lambda rows: judged(rows, text(), lambda a: judge_yes(F.coalesce("reply", F.lit(""))), confidence=judge_confidence(F.coalesce("reply", F.lit("")))), lambda s, v, n, k: reports.graded(s, v, n), "accuracy")


def _facts_verdicts(rows: DataFrame) -> DataFrame:
    out = judged(rows, text(), lambda a: judge_grade(F.coalesce("reply", F.lit(""))) == "A")
    return out.withColumn("grade", judge_grade(F.coalesce("reply", F.lit(""))))


add("simpleqa_verified_0shot_gen", "simpleqa_verified", lambda data: prompted(data, F.col("problem"), F.col("answer")), _facts_verdicts, lambda s, v, n, k: reports.three_grades(s, v, n), "f1")


def _last_exam_verdicts(rows: DataFrame) -> DataFrame:
    out = judged(rows, text(), lambda a: F.lit(False)).withColumn("j", answers.judge_last(F.coalesce("reply", F.lit(""))))
    return out.withColumns({"correct": F.col("j.correct"), "confidence": F.col("j.confidence"), "parsed": F.col("j.parsed")})


add("hle_0shot_gen", "hle", lambda data: prompted(data, F.concat(F.lit("Your response should be in the following format:\nExplanation: {your explanation for your answer choice}\nAnswer: {your chosen answer}\nConfidence: {your confidence score between 0% and 100% for your answer}\n\n"), F.col("question")), F.col("answer")), _last_exam_verdicts, lambda s, v, n, k: reports.confident(s, v, n), "accuracy")


def _tables(data: Dataset) -> DataFrame:
    tables = F.array_join(F.transform("relevant_tables", lambda t: F.array_join(t, "")), "\n\n")
    head = 'You are a helpful science assistant who answers questions about information in tables.\n\nHere is the relevant tabular data:\n\n{tables}\n\nYou may think through the question step by step. Your final response should be "Answer:" followed by the answer.\n\nQuestion: {question}\n'
    return prompted(data, filled(head, tables=tables, question=F.col("question")), F.col("answer"))


def _table_verdicts(rows: DataFrame) -> DataFrame:
    out = judged(rows, answers.answer_line(text()), lambda a: F.lit(False)).withColumn("j", answers.judge_partial(F.coalesce("reply", F.lit(""))))
    return out.withColumns({"correct": F.col("j.score") == 1, "partial": F.col("j.score") == 0.5, "parsed": F.col("j.parsed"), "exact": answers.same_answer(F.col("answer"), reference())})


def _table_report(samples: DataFrame, verdicts: DataFrame, n: int, k: int) -> DataFrame:
    row = reports.units(samples, verdicts, n).agg(F.count("*").alias("n"), *[F.count_if(c).alias(c) for c in ("correct", "partial", "exact")], F.count_if(~F.col("parsed")).alias("unread"))
    values = {c: F.round(reports.rate(F.col(c), F.col("n")), 2) for c in ("correct", "partial", "exact")}
    return reports.together(reports.metrics(row, score=values["correct"], accuracy=values["correct"], partial=values["partial"], exact_match=values["exact"], n=F.col("n"), n_grader_unparsed=F.col("unread")), reports.health(samples, verdicts))


add("scitarc_0shot_gen", "scitarc", _tables, _table_verdicts, _table_report, "accuracy")

# instructions


def _instructed(data: Dataset) -> DataFrame:
    """kwargs are kept as JSON without nulls, so that equal ones are equal texts."""
    rows = identified(data.test)
    kinds = dict(rows.dtypes)["kwargs"]
    as_json = F.col("kwargs") if kinds == "array<string>" else F.transform("kwargs", lambda k: F.to_json(k))
    return rows.select("sample_id", "prompt", F.lit(None).cast("string").alias("reference"), "instruction_id_list", as_json.alias("kwargs"))


#: Parameters whose names differ from the checks' own.
RENAMED = {"keywords": "words", "forbidden_words": "words", "end_phrase": "phrase", "prompt_to_repeat": "prompt", "let_frequency": "frequency", "let_relation": "relation", "capital_frequency": "frequency", "capital_relation": "relation", "postscript_marker": "marker"}


def _following(registry: dict, renamed: dict[str, str]) -> Callable[[DataFrame], DataFrame]:
    def judge(rows: DataFrame) -> DataFrame:
        out = constraints.followed(judged(rows, text(), lambda a: F.lit(False)), registry, renamed)
        return out.withColumn("correct", F.forall("strict", lambda x: x))

    return judge


for _name, _dataset, _registry, _renamed, _headline in (
    ("ifeval_0shot_gen", "ifeval", constraints.CHECKS, RENAMED, "strict_prompt_level_accuracy"), ("ifeval_0shot_gen_fixed", "ifeval", constraints.REPAIRED, RENAMED, "strict_prompt_level_accuracy"),
    ("ifbench_0shot_gen", "ifbench", ifbench.IFBENCH, {}, "loose_prompt_level_accuracy"), ("ifbench_0shot_gen_fixed", "ifbench", ifbench.IFBENCH_REPAIRED, {}, "loose_prompt_level_accuracy"),
):
    add(_name, _dataset, _instructed, _following(_registry, _renamed), lambda s, v, n, k, h=_headline: reports.followed(s, v, h), _headline, JUDGED)


def _turns(data: Dataset) -> DataFrame:
    """A sample a turn: what is asked at that turn, behind the turns before it."""
    rows = identified(data.test).select(F.col("sample_id").alias("conversation"), "key", "language", F.posexplode("turns").alias("at", "of"))
    return rows.select(F.xxhash64("conversation", "at").alias("sample_id"), F.col("of.prompt").alias("prompt"), F.lit(None).cast("string").alias("reference"), "language", (F.col("at") + 1).alias("turn"), "of.instruction_id_list", "of.kwargs")


for _name, _registry in (("multi_if_0shot_gen", multi_if.MULTI_IF), ("multi_if_0shot_gen_fixed", multi_if.MULTI_IF_REPAIRED)):
    add(_name, "multi_if", _turns, _following(_registry, RENAMED), lambda s, v, n, k: reports.turns_followed(s, v), "all_turns_all_languages_overall", JUDGED)


def _inverse(data: Dataset) -> DataFrame:
    return prompted(data, F.col("prompt"), F.col("response_reference"), language=F.col("language"), instruction_types=F.col("instruction_types"))


def _inverse_verdicts(rows: DataFrame) -> DataFrame:
    out = judged(rows, text(), lambda a: F.lit(False)).withColumn("j", answers.judge_score(F.coalesce("reply", F.lit(""))))
    return out.withColumns({"correct": F.coalesce(F.col("j.score") == 1, F.lit(False)), "parsed": F.col("j.score").isNotNull()})


def _inverse_report(samples: DataFrame, verdicts: DataFrame, n: int, k: int) -> DataFrame:
    """pass@1 and, over all graded rollouts, pass rates of each language and of each type: grouping sets."""
    cells = verdicts.groupingSets([["language"], ["instruction_types"]], "language", "instruction_types").agg(F.count_if("correct").alias("k"), F.count("*").alias("n"))
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("language", "instruction_types")), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    breakdown = cells.select(F.concat(F.when(F.col("language").isNotNull(), "language_").otherwise("type_"), slug, F.lit("_pass_rate")).alias("metric"), reports.rate(F.col("k"), F.col("n")).alias("value"))
    unread = verdicts.agg(F.count_if(~F.col("parsed")).alias("v"))
    return reports.together(reports.sampled(samples, verdicts, n, k, votes=False), breakdown, reports.metrics(unread, n_grader_unparsed=F.col("v")))


add("inverse_ifeval_0shot_gen", "inverse_ifeval", _inverse, _inverse_verdicts, _inverse_report, "pass@1")


def _criteria(data: Dataset) -> DataFrame:
    return prompted(data, F.col("prompt"), F.lit(None).cast("string"), n_criteria=F.size("criteria"), criteria_texts=F.col("criteria"))


def _criteria_verdicts(rows: DataFrame) -> DataFrame:
    verdicts = answers.judge_criteria(F.coalesce("reply", F.lit("")), F.col("n_criteria"))
    out = judged(rows, text(), lambda a: F.lit(False)).withColumn("v", verdicts)
    out = out.withColumns({"satisfied": F.size(F.filter("v", lambda x: F.coalesce(x, F.lit(False)))), "criteria": F.col("n_criteria"), "unread": F.size(F.filter("v", lambda x: x.isNull()))})
    return out.withColumn("correct", (F.col("criteria") > 0) & (F.col("satisfied") == F.col("criteria")))


add("complex_constraints_0shot_gen", "complex_constraints", _criteria, _criteria_verdicts, lambda s, v, n, k: reports.rubric(s, v, n), "task_pass_rate")


def _rubrics(data: Dataset) -> DataFrame:
    said = F.transform(answers.turns(F.col("conversation_history")), lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    rubrics = F.from_json(F.coalesce(F.get_json_object("prompt_metadata", "$.rubrics"), F.lit("[]")), "array<string>")
    return prompted(data, F.array_join(said, "\n"), F.lit(None).cast("string"), benchmark_name=F.col("benchmark_name"), rubrics=rubrics)


def _rubric_verdicts(rows: DataFrame) -> DataFrame:
    out = judged(rows, text(), lambda a: F.lit(False)).withColumn("j", answers.judge_object(F.coalesce("reply", F.lit(""))))
    checks = F.col("j.checks")
    out = out.withColumns({"parsed": F.col("j").isNotNull(), "correct": F.coalesce(F.col("j.satisfied"), F.lit(False)), "criteria": F.coalesce(F.size(F.map_keys(checks)), F.lit(0))})
    return out.withColumns({"satisfied": F.coalesce(answers.all_passes(checks), F.lit(0)), "in_range": F.coalesce(answers.passes_in_range(checks, F.col("rubrics")), F.lit(0)), "n_rubrics": F.greatest(F.size("rubrics"), F.lit(1))})


add("advanced_if_0shot_gen", "advanced_if", _rubrics, _rubric_verdicts, lambda s, v, n, k: reports.declared(s, v, n), "overall_pass_rate")

#: The lenient and the strict reading of a cell of the hierarchy are both scored; their mean is the sample's score.


def _hierarchy_samples(data: Dataset) -> DataFrame:
    rows = data.test.withColumnRenamed("sample_id", "own_id")
    history = F.array_join(F.concat("conversation_history", F.array("instruction")), "\n")
    return prompted(Dataset({"test": rows}), history, F.col("answer_json"), **{c: F.col(c) for c in ("uid", "category", "subtask", "setting", "variant", "system", "own_id")})


def _hierarchy_verdicts(rows: DataFrame) -> DataFrame:
    """By subtask: access, language, translation, verbs, one word, or a mixture of them; rules are scored as instructions elsewhere."""
    gold, said = reference(), F.coalesce(text(), F.lit(""))
    field = lambda k: F.get_json_object(gold, f"$.{k}")
    plain = F.coalesce(F.from_json(F.concat(F.lit("["), gold, F.lit("]")), "array<string>")[0], gold)
    names = F.when(gold.startswith("["), F.from_json(gold, "array<string>")).otherwise(F.array(plain))
    both = lambda f, truth: (F.round(f(truth, said, False), 2) + F.round(f(truth, said, True), 2)) / 2
    subtask = F.col("subtask")
    safe = grading.gatekept(field("label").cast("int"), F.coalesce(field("access_code"), F.lit("\u0000")), field("system_prompt"), said).cast("double")
    score = (
        F.when(subtask.isin("tensortrust", "user-prompt-hijack", "user-prompt-extract", "hijack", "extraction"), safe).when(subtask == "lang-detect", grading.language_named(names, said).cast("double"))
        .when(subtask == "translation", both(grading.translation_score, plain)).when(subtask == "verb-extract", both(grading.verbs_score, plain)).when(subtask == "slack-user", grading.same_word(plain, said).cast("double"))
        .when(subtask == "get-webpage", (grading.mixed_score(field("task"), field("content"), said) + grading.mixed_score(field("task"), field("content"), said, True)) / 2)
    )
    out = judged(rows, text(), lambda a: F.lit(False)).withColumn("score", F.coalesce(score, F.lit(0.0)))
    return out.withColumn("correct", F.col("score") == 1)


add("iheval_0shot_gen", "iheval", _hierarchy_samples, _hierarchy_verdicts, lambda s, v, n, k: reports.hierarchy(s, v), "score_conflict", JUDGED)


def _sessions(data: Dataset) -> DataFrame:
    """A sample a turn of a session; criteria as their numbers."""
    turn = "array<struct<user:string,assistant:string,alignment:string,criteria:map<string,string>>>"
    rows = data.test.select("session_id", "system_prompt", "n_turns", F.posexplode(F.from_json("turns_json", turn)).alias("at", "of"))
    return rows.select(F.xxhash64("session_id", "at").alias("sample_id"), F.concat("system_prompt", F.lit("\n\n"), F.col("of.user")).alias("prompt"), F.lit(None).cast("string").alias("reference"), F.col("session_id").alias("session"), (F.col("at") + 1).alias("turn"), "n_turns", F.col("of.alignment").alias("alignment"), F.array_sort(F.map_keys("of.criteria")).alias("ids"))


def _session_verdicts(rows: DataFrame) -> DataFrame:
    out = judged(rows, text(), lambda a: F.lit(False)).withColumn("v", answers.judge_block(F.coalesce("reply", F.lit("")), F.col("ids")))
    out = out.withColumns({"satisfied": F.size(F.filter("v", lambda x: F.coalesce(x, F.lit(False)))), "criteria": F.size("ids"), "unread": F.size(F.filter("v", lambda x: x.isNull()))})
    return out.withColumn("correct", (F.col("criteria") > 0) & (F.col("satisfied") == F.col("criteria")))


add("sysbench_0shot_gen", "sysbench", _sessions, _session_verdicts, lambda s, v, n, k: reports.sessions(s, v), "csr", JUDGED)


def _calls(data: Dataset) -> DataFrame:
    return prompted(data, F.array_join(F.transform("origin_prompt", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n"), F.col("ground_truth"))


def _call_verdicts(rows: DataFrame) -> DataFrame:
    out = judged(rows, stripped(text()), lambda a: F.lit(False)).withColumn("s", grading.call_scores(F.coalesce(text(), F.lit("")), reference())).select("*", "s.*")
    axes = ("name", "args_precision", "args_recall", "args_f1", "parse_rate")
    correct = F.lit(True)
    for a in axes:
        correct = correct & (F.col(a) == 1)
    return out.withColumn("correct", correct)


add("t_eval_before_calling_0shot_gen", "t_eval_before_calling", _calls, _call_verdicts, lambda s, v, n, k: reports.means(s, v, ["name", "args_precision", "args_recall", "args_f1", "parse_rate"]), None, JUDGED)

# long contexts

ANY_SUBTASKS = ("qa_squad", "qa_hotpotqa")


def _long(data: Dataset) -> DataFrame:
    return prompted(data, F.col("input"), F.array_join("outputs", "|"), outputs=F.col("outputs"), subtask=F.col("subtask"), context_length=F.col("context_length"))


def _long_verdicts(rows: DataFrame) -> DataFrame:
    """In percent: whether any reference is there for questions, else the share of those that are."""
    said = F.coalesce(text(), F.lit(""))
    score = F.when(F.col("subtask").isin(*ANY_SUBTASKS), grading.any_reference(said, F.col("outputs"))).otherwise(grading.found_references(said, F.col("outputs"))) * 100
    out = judged(rows, stripped(text()), lambda a: F.lit(False)).withColumn("score", score)
    return out.withColumn("correct", F.col("score") == 100)


add("ruler_0shot_gen", "ruler", _long, _long_verdicts, lambda s, v, n, k: reports.by_length(s, v), "score", JUDGED)

# code: programs are assembled here and run elsewhere; rows carry the outcome (passed, failed, timeout, ...) of each


def program(task: str) -> Callable[[DataFrame], DataFrame]:
    """Adds ``program``, the source to be run for a rollout, to samples joined to responses."""
    code = F.when(fenced_code(text()) != "", fenced_code(text())).otherwise(text())

    def build(rows: DataFrame) -> DataFrame:
        body = {
            "human_eval": F.concat(F.when(code.contains("def "), F.lit("")).otherwise(F.col("prompt")), code, F.lit("\n"), F.col("test"), F.lit("\ncheck("), F.col("entry_point"), F.lit(")\n")) if task == "human_eval" else None,
            "mbpp": F.concat(F.coalesce("test_setup_code", F.lit("")), F.lit("\n"), code, F.lit("\n"), F.array_join("test_list", "\n"), F.lit("\n")) if task == "mbpp" else None,
            "scicode": F.concat(F.coalesce("required_dependencies", F.lit("")), F.lit("\n"), code, F.lit("\n"), F.array_join("test_cases", "\n"), F.lit("\n")) if task == "scicode" else None,
            "livecodebench": code,
        }[task]
        return rows.withColumn("program", body)

    return build


def _outcomes(rows: DataFrame) -> DataFrame:
    out = judged(rows, stripped(text()), lambda a: F.lit(False))
    return out.withColumn("correct", F.coalesce(F.col("outcome") == "passed", F.lit(False)))


def _code_report(samples: DataFrame, verdicts: DataFrame, n: int, k: int) -> DataFrame:
    late = verdicts.agg(F.count_if(F.col("outcome") == "timeout").alias("v"))
    return reports.together(reports.sampled(samples, verdicts, n, k, votes=False), reports.metrics(late, n_timeouts=F.col("v")))


def _functions(instruction: str) -> Callable[[Dataset], DataFrame]:
    return lambda data: prompted(data, F.concat(F.lit(instruction), F.col("prompt")), F.lit(None).cast("string"), test=F.col("test"), entry_point=F.col("entry_point"))


add("human_eval_0shot_base_gen", "human_eval", _functions(""), _outcomes, _code_report, "pass@1")
add("human_eval_0shot_gen", "human_eval", _functions("Read the following function signature and docstring, and fully implement the function described. Your response should only contain the code for this function.\n"), _outcomes, _code_report, "pass@1")


def _small_programs(data: Dataset, shots: int = 3) -> DataFrame:
    shown = F.concat(F.lit("You are an expert Python programmer, and here is your task: "), F.col("text"), F.lit(" Your code should pass these tests:\n\n"), F.array_join("test_list", "\n"), F.lit("\n[BEGIN]\n"))
    prefix = _shots(data, "prompt", shots, F.concat(shown, F.col("code"), F.lit("\n[DONE]\n")), 1234)
    return _with_prefix(data, prefix, lambda p: F.concat(p, shown), F.lit(None).cast("string"), test_list=F.col("test_list"), test_setup_code=F.col("test_setup_code"))


add("mbpp_kshot_base_gen", "mbpp", _small_programs, _outcomes, _code_report, "pass@1", shots=3)


def _contest(data: Dataset) -> DataFrame:
    starter = F.when(F.length(F.coalesce("starter_code", F.lit(""))) > 0, F.concat(F.lit("\n\n```python\n"), F.col("starter_code"), F.lit("\n```"))).otherwise("")
    return prompted(data, F.concat(F.lit("### Question:\n"), F.col("question_content"), starter, F.lit("\n\n### Answer: (use the provided format with backticks)\n\n")), F.lit(None).cast("string"))


for _name, _n in (("livecodebench_code_generation_0shot_gen", 0), ("livecodebench_code_generation_kshot_base_gen", 3)):
    add(_name, "livecodebench_code_generation", _contest, _outcomes, _code_report, "pass@1", shots=_n)


def _science(data: Dataset) -> DataFrame:
    """A sample a step of a problem."""
    rows = data.test.select("problem_id", "required_dependencies", F.posexplode("sub_steps").alias("at", "of"))
    return rows.select(F.xxhash64("problem_id", "at").alias("sample_id"), F.col("of.step_description_prompt").alias("prompt"), F.lit(None).cast("string").alias("reference"), F.col("problem_id").alias("problem"), F.col("at").alias("step"), "required_dependencies", F.col("of.test_cases").alias("test_cases"))


add("scicode_0shot_gen", "scicode", _science, _outcomes, lambda s, v, n, k: reports.steps(s, v), "main_problem_accuracy")

# theorems and versions


def _theorems(data: Dataset) -> DataFrame:
    head = "You are supposed to provide a solution to a given problem.\n\n"
    return prompted(data, F.concat(F.lit(head + "Problem:\n"), F.col("Question"), F.lit("\nSolution:")), F.col("Answer"))


def _theorem_verdicts(rows: DataFrame) -> DataFrame:
    return judged(rows, answers.theorem_answer(text()), lambda a: theorem_equal(a, reference()))


def _theorem_report(samples: DataFrame, verdicts: DataFrame, n: int, k: int) -> DataFrame:
    return reports.together(reports.accuracy(samples, verdicts, False), reports.sampled(samples, verdicts, n, k).where("metric not in ('score', 'fails', 'n_unextracted')"))


add("theoremqa_kshot_base_gen", "theoremqa", _theorems, _theorem_verdicts, _theorem_report, "accuracy", JUDGED)


def _versions(data: Dataset) -> DataFrame:
    head = F.concat(F.lit("The following is a "), F.regexp_replace("subject", "_", " "), F.lit(" problem. Put the answer of each slot, in order and separated by commas, within one \\boxed{}.\n\n"))
    return prompted(data, F.concat(head, F.col("problem")), F.array_join("answer", ","), problem=F.col("id"), version=F.col("version"), subject=F.col("subject"), golds=F.transform("answer", answers.plain_answer), kinds=F.col("answer_type"), options=F.col("options"))


def _version_verdicts(rows: DataFrame) -> DataFrame:
    said = answers.slot_answer(text())
    out = judged(rows, said, lambda a: F.lit(False)).withColumn("slots", F.when(F.col("answer").isNotNull(), answers.slots(F.col("answer"))))
    out = out.withColumn("v", slots_equal(F.col("slots"), F.col("golds"), F.col("kinds"), F.col("options")))
    return out.withColumn("correct", (F.size("v") > 0) & F.forall("v", lambda x: x))


add("ugmathbench_0shot_gen_fixed", "ugmathbench", _versions, _version_verdicts, lambda s, v, n, k: reports.versions(s, v), "eacc")

del _name, _instruction, _column, _subset, _dataset, _registry, _renamed, _headline, _n

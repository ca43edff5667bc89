"""From judged rollouts to problems, and from problems to reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallywright.functions.sampling import complete_sum, f1, pass_at_k, pass_pow_k, share
from tallywright.operators.ranking import positioned


def problems(rollouts: DataFrame) -> DataFrame:
    """(sample_id, n, c, n_unextracted, first_correct) of rollouts (sample_id, idx, correct, extracted)."""
    return rollouts.groupBy("sample_id").agg(
        F.count("*").alias("n"), F.count_if("correct").alias("c"), F.count_if(~F.col("extracted")).alias("n_unextracted"), F.min_by("correct", "idx").alias("first_correct"),
    )


def votes(rollouts: DataFrame, key: Column | None = None) -> DataFrame:
    """(sample_id, n, majority, consistency): whether the one commonest answer is correct, and its share of all rollouts.

    The vote is by ``key``, by the column ``vote`` if there is one, or by the trimmed answer; blank answers don't vote but count as rollouts. A tie is no majority.
    """
    if key is None:
        key = F.col("vote" if "vote" in rollouts.columns else "answer")
    vote = F.trim(key)
    answers = rollouts.withColumn("_vote", F.when(vote != "", vote)).groupBy("sample_id", "_vote").agg(F.count("*").alias("k"), F.bool_or("correct").alias("right"))
    counted = F.when(F.col("_vote").isNotNull(), F.struct("k", "right"))
    ranked = answers.groupBy("sample_id").agg(F.sum("k").alias("n"), F.sort_array(F.collect_list(counted), asc=False).alias("top"))  # distinct answers of one problem
    first, second = F.get("top", F.lit(0)), F.get("top", F.lit(1))
    won = F.coalesce(first["right"] & (second["k"].isNull() | (second["k"] < first["k"])), F.lit(False))
    return ranked.select("sample_id", "n", won.cast("int").alias("majority"), (F.coalesce(first["k"], F.lit(0)) / F.col("n")).alias("consistency"))


def sampling_report(requested: DataFrame, rollouts: DataFrame, n: int, k: int) -> DataFrame:
    """One row: the estimators over all requested (sample_id), those without rollouts counting as failed; denominators are stated.

    The k-estimators appear for k > 1, the majority only if k is the requested n; a metric that doesn't apply is null. With nothing
    requested or nothing judged, those that apply are zero, so a run that failed as a whole has the same columns as any other.
    """
    both = problems(rollouts).join(votes(rollouts).select("sample_id", "majority", "consistency"), "sample_id")
    rows = requested.select("sample_id").join(both, "sample_id", "left")
    num, c = F.col("n"), F.col("c")
    asked, judged = F.count(F.lit(1)), F.count("n")

    def mean(value: Column) -> Column:
        return F.coalesce(F.round(F.sum(value) * 100 / F.nullif(asked, F.lit(0)), 6), F.lit(0.0))  # zero where nothing was asked or judged

    nothing = F.lit(None).cast("double")
    return rows.agg(
        mean(pass_at_k(num, c, 1)).alias("pass_at_1"), (mean(pass_at_k(num, c, k)) if k > 1 else nothing).alias("pass_at_k"), (mean(pass_pow_k(num, c, k)) if k > 1 else nothing).alias("pass_pow_k"),
        (mean(F.col("majority")) if k == n else nothing).alias("majority_at_k"), mean(F.col("consistency")).alias("self_consistency"), mean(c / num).alias("avg_at_n"),
        F.lit(n).alias("n"), F.lit(k).alias("k"), F.count_if(num < n).alias("n_short"), F.coalesce(F.sum("n_unextracted"), F.lit(0)).alias("n_unextracted"),
        asked.alias("requested"), judged.alias("judged"), (asked - judged).alias("fails"), F.lit("requested").alias("denominator_policy"),
    )


def accuracy_by(rows: DataFrame, *by: str) -> DataFrame:
    """Micro accuracy of each group, in percent."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(share(F.col("correct")) * 100, 6).alias("accuracy"))


def macro(rows: DataFrame, inner: str, outer: str) -> DataFrame:
    """The mean over inner groups of their accuracies, for each outer group."""
    cells = rows.groupBy(outer, inner).agg(share(F.col("correct")).alias("a"))
    return cells.groupBy(outer).agg(F.count("*").alias("cells"), F.round(F.avg("a") * 100, 6).alias("macro"))


def all_of_group(rows: DataFrame, group: str, needed: int) -> DataFrame:
    """One row: the share of groups that are correct in all of ``needed`` versions, and in any version."""
    each = rows.groupBy(group).agg((F.bool_and("correct") & (F.count("*") == needed)).alias("every"), F.bool_or("correct").alias("any"))
    return each.agg(F.count("*").alias("groups"), F.round(share(F.col("every")) * 100, 6).alias("effective"), F.round(share(F.col("any")) * 100, 6).alias("covered"))


def grade_rates(grades: DataFrame, grade: Column, right: str = "A", wrong: str = "N", skipped: str = "R") -> DataFrame:
    """One row: rates of three grades, accuracy of what was attempted, and the harmonic mean of it and the overall rate."""
    rates = grades.select(grade.alias("g")).agg(*[share(F.col("g") == v).alias(k) for k, v in (("correct", right), ("incorrect", wrong), ("not_attempted", skipped))])
    given = F.when(F.col("correct") + F.col("incorrect") > 0, F.col("correct") / (F.col("correct") + F.col("incorrect"))).otherwise(0.0)
    out = rates.withColumn("given", given).withColumn("f1", f1(F.col("given"), F.col("correct")))
    return out.select(*[F.round(c, 6).alias(c) for c in ("correct", "incorrect", "not_attempted", "given", "f1")])


def calibration_error(rows: DataFrame, confidence: str, key: str, bin_size: int = 100) -> DataFrame:
    """One row (n, calibration_error): root mean squared gap of confidence (percent) and correctness over bins of equal size.

    Rows stand in order of confidence, then key; the last bin, which takes what is left, doesn't count. Null with less than a bin.
    """
    code = F.md5(F.col(key).cast("string"))
    bucket = F.struct(F.col(confidence).alias("c"), F.substring(code, 1, 2).alias("h"))
    placed = positioned(rows.select(confidence, key, "correct"), [], bucket, [code, F.col(key)])
    bins = placed.groupBy(F.floor(F.col("position") / bin_size).alias("bin")).agg(F.count("*").alias("k"), F.sum(confidence).alias("conf"), F.count_if("correct").alias("hit"))
    gap = F.col("conf") / 100 / F.col("k") - F.col("hit") / F.col("k")
    total = rows.agg(F.count("*").alias("n"))  # one row
    used = bins.crossJoin(F.broadcast(total)).where(F.col("bin") < F.floor(F.col("n") / bin_size) - 1)
    error = used.agg(F.sqrt(F.coalesce(F.sum(F.col("k") / F.col("n") * gap * gap), F.lit(0.0))).alias("e"))
    return total.crossJoin(F.broadcast(error)).select("n", F.when(F.col("n") >= bin_size, 100 * F.round("e", 2)).alias("calibration_error"))


def wald(correct: Column, n: Column) -> tuple[Column, Column]:
    """Accuracy in percent to two digits, and the half-width of its 95% interval."""
    accuracy = F.round(correct * 100 / n, 2)
    return accuracy, F.round(1.96 * F.sqrt(accuracy * (100 - accuracy) / n), 2)


def rubric_rates(units: DataFrame) -> DataFrame:
    """One row over units (satisfied, criteria): all satisfied, the mean of shares, the share of all criteria."""
    return units.agg(
        F.count("*").alias("units"), F.round(share(F.col("satisfied") == F.col("criteria")) * 100, 6).alias("all_pass"),
        F.round(F.avg(F.col("satisfied") / F.col("criteria")) * 100, 6).alias("macro"), F.round(F.sum("satisfied") / F.sum("criteria") * 100, 6).alias("micro"),
    )


def session_prefixes(turns: DataFrame) -> DataFrame:
    """(session, n_turns, prefix): how many turns from the first on are satisfied without a gap, of turns (session, turn, ok)."""
    place = F.row_number().over(Window.partitionBy("session").orderBy("turn")) - 1  # a session's own turns
    seen = turns.withColumn("bad", F.when(~F.col("ok") | (F.col("turn") != place), place))
    return seen.groupBy("session").agg(F.count("*").alias("n_turns"), F.coalesce(F.min("bad"), F.count("*")).alias("prefix"))


def session_rates(turns: DataFrame) -> DataFrame:
    """One row: the share of satisfied criteria (over all, and on average of turns), of fully satisfied turns, and the mean share of a session's prefix."""
    each = F.when(F.col("criteria") > 0, F.col("satisfied") / F.col("criteria")).otherwise(0.0)
    whole = turns.agg(F.round(F.sum("satisfied") / F.sum("criteria"), 6).alias("csr"), F.round(F.avg(each), 6).alias("csr_macro"), F.round(share(F.col("ok")), 6).alias("isr"))
    return whole.crossJoin(F.broadcast(session_prefixes(turns).agg(F.round(F.avg(F.col("prefix") / F.col("n_turns")), 6).alias("ssr"))))


def partial_key_report(rows: DataFrame, keys: list[str], denominator: Column) -> DataFrame:
    """One row: each key's sum by the denominator, in percent; a key that only some problems have is null."""
    return rows.agg(*[F.round(complete_sum(F.col(k), denominator), 6).alias(k) for k in keys])


def rollout_view(verdicts: DataFrame, predictions: DataFrame) -> DataFrame:
    """(sample_id, correct, answers) of verdicts (sample_id, idx, correct) and predictions (sample_id, idx, answer), arrays in order of idx.

    Answers are null where the two stages don't agree on how many rollouts there are: a vote needs all of them.
    """

    def packed(rows: DataFrame, column: str, out: str) -> DataFrame:
        return rows.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", column))), lambda x: x[column]).alias(out))  # a sample's rollouts

    both = packed(verdicts, "correct", "correct").join(packed(predictions, "answer", "answers"), "sample_id", "left")
    return both.select("sample_id", "correct", F.when(F.size("answers") == F.size("correct"), F.col("answers")).alias("answers"))


def unscored_rollouts(verdicts: DataFrame) -> DataFrame:
    """One row (unscored): rollouts beyond each sample's first, which a headline of single draws doesn't score."""
    return verdicts.agg((F.count("*") - F.count_distinct("sample_id")).alias("unscored"))


def problem_metrics(rollouts: DataFrame, k: int) -> DataFrame:
    """Each problem's estimators: sample_id, n, c, pass_at_1, pass_at_k, pass_pow_k, avg_at_n, majority, consistency."""
    both = problems(rollouts).join(votes(rollouts).select("sample_id", "majority", "consistency"), "sample_id")
    n, c = F.col("n"), F.col("c")
    return both.select("sample_id", "n", "c", pass_at_k(n, c, 1).alias("pass_at_1"), pass_at_k(n, c, k).alias("pass_at_k"), pass_pow_k(n, c, k).alias("pass_pow_k"), (c / n).alias("avg_at_n"), "majority", "consistency")

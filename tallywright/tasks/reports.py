"""Reports as rows (metric, value), from samples and verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.operators.metrics import calibration_error, sampling_report, session_prefixes


def metrics(row: DataFrame, **values: Column) -> DataFrame:
    """(metric, value) of one row's values; nulls are left out."""
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in values.items()])
    return row.select(F.explode(pairs).alias("m")).select("m.*").where("value is not null")


def together(*reports: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, reports)


def rate(hits: Column, of: Column) -> Column:
    """In percent; 0 of nothing."""
    return F.coalesce(hits * 100 / F.nullif(of, F.lit(0)), F.lit(0.0))


def timeouts(verdicts: DataFrame) -> DataFrame:
    """n_timed_out of verdicts made under a deadline; no row without one."""
    return metrics(verdicts.agg(F.count_if("timed_out").alias("v")), n_timed_out=F.col("v"))


def first_only(verdicts: DataFrame) -> DataFrame:
    return verdicts.where("idx = 0")


def counts(samples: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row: requested, judged, fails and what couldn't be extracted."""
    ids = verdicts.groupBy("sample_id").agg(F.count_if(~F.col("extracted")).alias("missed"))
    return samples.select("sample_id").join(ids, "sample_id", "left").agg(F.count("*").alias("requested"), F.count("missed").alias("judged"), F.coalesce(F.sum("missed"), F.lit(0)).alias("n_unextracted")).withColumn("fails", F.col("requested") - F.col("judged"))


def health(samples: DataFrame, verdicts: DataFrame) -> DataFrame:
    return metrics(counts(samples, verdicts), fails=F.col("fails"), n_unextracted=F.col("n_unextracted"))


def sampled(samples: DataFrame, verdicts: DataFrame, n: int, k: int, votes: bool = True) -> DataFrame:
    """pass@1 over all requested; with n > 1 the whole block of estimators."""
    row = sampling_report(samples, verdicts, n, k)
    names = {"pass@1": "pass_at_1", "score": "pass_at_1", "fails": "fails", "n_unextracted": "n_unextracted"}
    if n > 1:
        names |= {f"pass@{k}": "pass_at_k", f"pass^{k}": "pass_pow_k", "avg@n": "avg_at_n", "n_short": "n_short"} if k > 1 else {"avg@n": "avg_at_n", "n_short": "n_short"}
        names |= {f"maj@{k}": "majority_at_k", "self_consistency": "self_consistency"} if votes else {}
    return metrics(row, **{name: F.col(column) for name, column in names.items()})


def accuracy(samples: DataFrame, verdicts: DataFrame, requested: bool, name: str = "accuracy", correct: str = "correct") -> DataFrame:
    """Of the first rollouts, over all requested or over the judged samples."""
    hits = first_only(verdicts).agg(F.count_if(correct).alias("hits"))
    row = counts(samples, verdicts).crossJoin(F.broadcast(hits))  # one row each
    value = rate(F.col("hits"), F.col("requested" if requested else "judged"))
    return metrics(row, **{"score": value, name: value, "fails": F.col("fails"), "n_unextracted": F.col("n_unextracted")})


def accuracies(samples: DataFrame, verdicts: DataFrame, by: str, requested: bool, prefix: str = "score_") -> DataFrame:
    """One metric a group: accuracy of first rollouts."""
    hits = first_only(verdicts).select("sample_id", F.col("correct").alias("hit"))
    rows = samples.select("sample_id", by).join(hits, "sample_id", "left")
    cells = rows.groupBy(by).agg(F.count_if("hit").alias("hits"), F.count("*").alias("all"), F.count("hit").alias("judged")).where("all > 0" if requested else "judged > 0")
    key = F.regexp_replace(F.lower(F.coalesce(F.col(by).cast("string"), F.lit("unknown"))), "[^a-z0-9]+", "_")
    return cells.select(F.concat(F.lit(prefix), key).alias("metric"), rate(F.col("hits"), F.col("all" if requested else "judged")).alias("value"))


def macro(samples: DataFrame, verdicts: DataFrame, by: str, groups: dict[str, list[str]] | None = None, whole: bool = False, name: str = "overall") -> DataFrame:
    """The mean of accuracies of subsets, over all and over each group's subsets; of a group only if all its subsets are there, if ``whole``."""
    hits = first_only(verdicts).select("sample_id", F.col("correct").alias("hit"))
    cells = samples.select("sample_id", F.col(by).alias("cell")).join(hits, "sample_id").groupBy("cell").agg(F.avg(F.col("hit").cast("int")).alias("a"))
    out = [metrics(cells.agg(F.coalesce(F.avg("a") * 100, F.lit(0.0)).alias("a")), **{"score": F.col("a"), name: F.col("a")})]
    if groups:
        pairs = [(g, m, len(members)) for g, members in groups.items() for m in members]
        table = samples.sparkSession.createDataFrame(pairs, "metric string, cell string, needed int")
        found = cells.join(F.broadcast(table), "cell").groupBy("metric", "needed").agg(F.avg("a").alias("a"), F.count("*").alias("n"))  # as many rows as subsets
        out.append(found.where("n = needed" if whole else "n > 0").select("metric", (F.col("a") * 100).alias("value")))
    return together(*out)


def units(samples: DataFrame, verdicts: DataFrame, n: int) -> DataFrame:
    """Verdicts, and for each failed sample n stand-ins that are wrong."""
    failed = samples.join(verdicts.select("sample_id").distinct(), "sample_id", "left_anti").withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return verdicts.unionByName(failed.withColumns({"correct": F.lit(False), "extracted": F.lit(True)}), allowMissingColumns=True)


def graded(samples: DataFrame, verdicts: DataFrame, n: int, name: str = "accuracy") -> DataFrame:
    """The share of correct rollouts of n a requested sample."""
    row = units(samples, verdicts, n).agg(F.count_if("correct").alias("hits"), F.count("*").alias("all"))
    value = rate(F.col("hits"), F.col("all"))
    return together(metrics(row, **{"score": value, name: value}), health(samples, verdicts))


def three_grades(samples: DataFrame, verdicts: DataFrame, n: int) -> DataFrame:
    """Rates of A (correct), B (incorrect) and C (not attempted, failed samples included), accuracy of what was attempted, their F1."""
    row = units(samples, verdicts, n).agg(F.count_if(F.col("grade") == "A").alias("a"), F.count_if(F.col("grade") == "B").alias("b"), F.count("*").alias("all"))
    given, right = rate(F.col("a"), F.col("a") + F.col("b")), rate(F.col("a"), F.col("all"))
    f1 = F.when(given + right > 0, 2 * given * right / (given + right)).otherwise(0.0)
    rest = rate(F.col("all") - F.col("a") - F.col("b"), F.col("all"))
    return together(metrics(row, score=f1, f1=f1, accuracy_given_attempted=given, correct=right, incorrect=rate(F.col("b"), F.col("all")), not_attempted=rest), health(samples, verdicts))


def confident(samples: DataFrame, verdicts: DataFrame, n: int) -> DataFrame:
    """Accuracy over n a requested sample to two digits, its interval, and the calibration error of judged rollouts."""
    read = verdicts.where("parsed").withColumn("key", F.concat_ws(":", "sample_id", "idx"))
    error = calibration_error(read, "confidence", "key").select("calibration_error")
    row = read.agg(F.count_if("correct").alias("hits"), F.count("*").alias("graded")).crossJoin(F.broadcast(counts(samples, verdicts))).crossJoin(F.broadcast(error))  # one row each
    value = F.round(rate(F.col("hits"), F.col("requested") * n), 2)
    half = F.round(1.96 * F.sqrt(value * (100 - value) / F.nullif(F.col("requested") * n, F.lit(0))), 2)
    unread = verdicts.where("not parsed").agg(F.count("*").alias("unread"))
    report = metrics(row, score=value, accuracy=value, confidence_interval=half, calibration_error=F.col("calibration_error"), n=F.col("requested") * n, n_graded=F.col("graded"), fails=F.col("fails"))
    return together(report, metrics(unread, n_grader_unparsed=F.col("unread")))


def rubric(samples: DataFrame, verdicts: DataFrame, n: int, size: str | None = "n_criteria") -> DataFrame:
    """Verdicts (satisfied, criteria): all satisfied, the mean share, the share of all criteria. Failed samples satisfy none of theirs."""
    rows = units(samples, verdicts, n).withColumns({"satisfied": F.coalesce("satisfied", F.lit(0)), "criteria": F.coalesce("criteria", F.col(size) if size else F.lit(0), F.lit(0))})
    whole = (F.col("criteria") > 0) & (F.col("satisfied") == F.col("criteria"))
    share = F.when(F.col("criteria") > 0, F.col("satisfied") / F.col("criteria")).otherwise(0.0)
    row = rows.agg(F.count_if(whole).alias("hits"), F.count("*").alias("all"), F.avg(share).alias("mean"), F.sum("satisfied").alias("s"), F.sum("criteria").alias("c"), F.coalesce(F.sum("unread"), F.lit(0)).alias("unread"))
    value = rate(F.col("hits"), F.col("all"))
    return together(metrics(row, score=value, task_pass_rate=value, criterion_pass_rate_macro=F.coalesce(F.col("mean") * 100, F.lit(0.0)), criterion_pass_rate_micro=rate(F.col("s"), F.col("c")), n_grader_unparsed=F.col("unread")), health(samples, verdicts))


def declared(samples: DataFrame, verdicts: DataFrame, n: int, by: str = "benchmark_name") -> DataFrame:
    """Verdicts (satisfied, criteria, correct): pass rates, overall and of each aspect; failed samples count overall only."""

    def row(rows: DataFrame, prefix: Column) -> DataFrame:
        share = F.when(F.coalesce("criteria", F.lit(0)) > 0, F.col("in_range") / F.col("n_rubrics")).otherwise(0.0)
        cells = rows.withColumn("prefix", prefix).groupBy("prefix").agg(F.count_if("correct").alias("hits"), F.count("*").alias("all"), F.sum("satisfied").alias("s"), F.sum("criteria").alias("c"), F.avg(share).alias("m"), F.count_if(~F.col("parsed")).alias("unread"))
        values = {"pass_rate": rate(F.col("hits"), F.col("all")), "micro_pass_rate": rate(F.col("s"), F.col("c")), "macro_pass_rate": F.coalesce(F.col("m") * 100, F.lit(0.0)), "n_grader_unparsed": F.col("unread")}
        pairs = F.array(*[F.struct(F.concat("prefix", F.lit(k)).alias("metric"), v.cast("double").alias("value")) for k, v in values.items()])
        return cells.select(F.explode(pairs).alias("m")).select("m.*")

    overall = row(units(samples, verdicts, n), F.lit("overall_"))
    score = overall.where("metric = 'overall_pass_rate'").select(F.lit("score").alias("metric"), "value")
    return together(score, overall, row(verdicts, F.concat(F.coalesce(F.col(by), F.lit("unknown")), F.lit("_"))), health(samples, verdicts))


def followed(samples: DataFrame, verdicts: DataFrame, headline: str) -> DataFrame:
    """Verdicts (strict, loose: array<boolean>): prompts all of whose instructions are followed, and instructions over all prompts."""
    row, values = verdicts, {}
    aggs = {}
    for way in ("strict", "loose"):
        kept = F.size(F.filter(F.col(way), lambda x: x))
        aggs |= {f"{way}_all": F.count_if(kept == F.size(way)), f"{way}_kept": F.sum(kept), f"{way}_of": F.sum(F.size(way))}
    row = first_only(verdicts).agg(F.count("*").alias("n"), *[v.alias(k) for k, v in aggs.items()])
    for way in ("strict", "loose"):
        values |= {f"{way}_prompt_level_accuracy": rate(F.col(f"{way}_all"), F.col("n")), f"{way}_instruction_level_accuracy": rate(F.coalesce(f"{way}_kept", F.lit(0)), F.col(f"{way}_of"))}
    return together(metrics(row, score=values[headline], **values), metrics(counts(samples, verdicts), fails=F.col("fails")))


def turns_followed(samples: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verdicts (language, turn, strict, loose): for each turn, over all languages and in each, the mean of four rates; the mean of turns."""
    every = verdicts.select("turn", F.explode(F.array(F.lit("all_languages"), "language")).alias("language"), "strict", "loose")
    rates = []
    for way in ("strict", "loose"):
        kept = F.size(F.filter(F.col(way), lambda x: x))
        rates += [F.avg((kept == F.size(way)).cast("int")).alias(f"{way}_prompt_level_accuracy"), F.coalesce(F.sum(kept) / F.nullif(F.sum(F.size(way)), F.lit(0)), F.lit(0.0)).alias(f"{way}_instruction_level_accuracy")]
    names = [f"{w}_{x}_level_accuracy" for w in ("strict", "loose") for x in ("prompt", "instruction")]
    cells = every.groupBy("turn", "language").agg(F.count("*").alias("n"), *rates)
    overall = reduce(lambda a, b: a + b, [F.col(c) for c in names]) / 4 * 100
    whole = cells.where("language = 'all_languages'")
    each = cells.select(F.concat(F.lit("turn_"), "turn", F.lit("_"), "language", F.lit("_overall")).alias("metric"), overall.alias("value"))
    parts = whole.select(F.explode(F.array(*[F.struct(F.concat(F.lit("turn_"), "turn", F.lit(f"_{c}")).alias("metric"), (F.col(c) * 100).alias("value")) for c in names], F.struct(F.concat(F.lit("turn_"), "turn", F.lit("_prompts_number")).alias("metric"), F.col("n").cast("double").alias("value")))).alias("m")).select("m.*")
    mean = whole.agg(F.coalesce(F.avg(overall), F.lit(0.0)).alias("v"))
    fails = samples.join(verdicts.select("sample_id").distinct(), "sample_id", "left_anti").agg(F.count("*").alias("v"))
    return together(metrics(mean, score=F.col("v"), all_turns_all_languages_overall=F.col("v")), each, parts, metrics(fails, fails=F.col("v")))


def by_length(samples: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verdicts (context_length, subtask, score in percent): cells to two digits, their mean for a length, the mean of lengths."""
    cells = first_only(verdicts).groupBy("context_length", "subtask").agg(F.round(F.avg("score"), 2).alias("cell"))
    lengths = cells.groupBy("context_length").agg(F.avg("cell").alias("a"))
    tag = length_tag(F.col("context_length"))
    return together(
        metrics(lengths.agg(F.coalesce(F.avg("a"), F.lit(0.0)).alias("v")), score=F.col("v")), lengths.select(F.concat(F.lit("score_"), tag).alias("metric"), F.col("a").alias("value")),
        cells.select(F.concat(F.lit("score_"), "subtask", F.lit("_"), tag).alias("metric"), F.col("cell").alias("value")), metrics(counts(samples, verdicts), fails=F.col("fails")),
    )


def length_tag(length: Column) -> Column:
    """4096 is 4k; what is no multiple of 1024 stays a number."""
    return F.when((length >= 1024) & (length % 1024 == 0), F.concat((length / 1024).cast("int").cast("string"), F.lit("k"))).otherwise(length.cast("string"))


def hierarchy(samples: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verdicts (subtask, setting, variant, score 0 to 1): cells to four digits, subtasks as means of their cells, settings as means of subtasks.

    Differences of aligned and conflict to reference come signed and absolute.
    """
    cells = verdicts.groupBy("subtask", "setting", "variant").agg(F.round(F.avg("score"), 4).alias("cell"))
    tasks = cells.groupBy("subtask", "setting").agg(F.avg("cell").alias("a"))
    settings = tasks.groupBy("setting").agg(F.avg("a").alias("a"))
    pivot = settings.groupBy().pivot("setting", ["reference", "aligned", "conflict"]).agg(F.first("a"))
    away = {f"{how}_{s}": (F.abs(F.col(s) - F.col("reference")) if how == "absolute_diff" else F.col(s) - F.col("reference")) * 100 for s in ("aligned", "conflict") for how in ("diff", "absolute_diff")}
    return together(
        metrics(pivot, score=F.col("conflict") * 100, **{f"score_{s}": F.col(s) * 100 for s in ("reference", "aligned", "conflict")}, **away),
        tasks.select(F.concat_ws("_", F.lit("score"), "subtask", "setting").alias("metric"), (F.col("a") * 100).alias("value")),
        cells.select(F.concat_ws("_", F.lit("cell"), "subtask", "setting", "variant").alias("metric"), (F.col("cell") * 100).alias("value")),
        metrics(counts(samples, verdicts), fails=F.col("fails")),
    )


def sessions(samples: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verdicts (session, turn from 1, satisfied, criteria, alignment): pooled criteria, their mean by turn, whole turns, prefixes of whole turns over declared ones.

    Also whole turns by alignment, and the share of sessions that hold to each place.
    """
    rows = verdicts.withColumn("ok", (F.col("criteria") > 0) & (F.col("satisfied") == F.col("criteria")))
    share = F.when(F.col("criteria") > 0, F.col("satisfied") / F.col("criteria")).otherwise(0.0)
    row = rows.agg(F.sum("satisfied").alias("s"), F.sum("criteria").alias("c"), F.avg(share).alias("m"), F.avg(F.col("ok").cast("int")).alias("isr"), F.coalesce(F.sum("unread"), F.lit(0)).alias("unread"))
    declared_turns = samples.groupBy("session").agg(F.max("n_turns").alias("declared"))
    kept = session_prefixes(rows.select("session", (F.col("turn") - 1).alias("turn"), "ok")).join(declared_turns, "session").withColumn("of", F.greatest("declared", F.lit(1)))
    ssr = kept.agg(F.coalesce(F.avg(F.col("prefix") / F.col("of")) * 100, F.lit(0.0)).alias("v"))
    places = kept.agg(F.count("*").alias("n")).crossJoin(F.broadcast(kept.agg(F.max("of").alias("most"))))  # one row
    reach = kept.crossJoin(F.broadcast(places)).select("prefix", "n", F.explode(F.sequence(F.lit(1), F.col("most"))).alias("t")).groupBy("t", "n").agg(F.count_if(F.col("prefix") >= F.col("t")).alias("k"))
    csr = rate(F.col("s"), F.col("c"))
    return together(
        metrics(row, score=csr, csr=csr, csr_macro=F.coalesce(F.col("m") * 100, F.lit(0.0)), isr=F.coalesce(F.col("isr") * 100, F.lit(0.0)), n_grader_unparsed=F.col("unread")), metrics(ssr, ssr=F.col("v")),
        rows.groupBy("alignment").agg((F.avg(F.col("ok").cast("int")) * 100).alias("value")).select(F.concat(F.lit("isr_"), F.coalesce(F.nullif("alignment", F.lit("")), F.lit("unknown"))).alias("metric"), "value"),
        reach.select(F.concat(F.lit("r_"), "t").alias("metric"), rate(F.col("k"), F.col("n")).alias("value")),
    )


def versions(samples: DataFrame, verdicts: DataFrame, needed: int = 3) -> DataFrame:
    """Verdicts of samples (problem, version, subject): correct in all versions (of all problems, also of each subject), on average, in any version."""
    hits = first_only(verdicts).select("sample_id", F.col("correct").alias("hit"))
    rows = samples.select("sample_id", "problem", "subject").join(hits, "sample_id", "left")
    each = rows.groupBy("problem", "subject").agg(F.count("hit").alias("n"), F.count_if("hit").alias("k"), F.count("*").alias("asked"))
    row = each.agg(F.count_if((F.col("k") == needed) & (F.col("n") == needed)).alias("all"), F.count_if(F.col("k") > 0).alias("any"), F.count("*").alias("problems"), F.sum("k").alias("k"), F.sum("asked").alias("asked"), F.count_if(F.col("n") != needed).alias("short"), F.sum("n").alias("judged"))
    eacc, aacc = rate(F.col("all"), F.col("problems")), rate(F.col("k"), F.col("asked"))
    subjects = each.groupBy("subject").agg(rate(F.count_if((F.col("k") == needed) & (F.col("n") == needed)), F.count("*")).alias("value")).select(F.concat(F.lit("eacc_"), F.regexp_replace(F.lower("subject"), "[^a-z0-9]+", "_")).alias("metric"), "value")
    return together(metrics(row, score=eacc, eacc=eacc, aacc=aacc, cacc=rate(F.col("any"), F.col("problems")), delta=aacc - eacc, relative_delta=F.coalesce((aacc - eacc) * 100 / F.nullif(eacc, F.lit(0.0)), F.lit(0.0)), n_problems=F.col("problems"), n_versions_judged=F.col("judged"), incomplete_problems=F.col("short")), subjects, health(samples, verdicts))


def steps(samples: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verdicts of samples (problem, step): problems all of whose steps pass, steps over all, and how many ended in each kind of error."""
    hits = first_only(verdicts).select("sample_id", F.col("correct").alias("hit"), F.col("outcome"))
    rows = samples.select("sample_id", "problem").join(hits, "sample_id", "left")
    row = rows.groupBy("problem").agg(F.bool_and(F.coalesce("hit", F.lit(False))).alias("all"), F.count_if("hit").alias("k"), F.count("*").alias("n")).agg(F.count_if("all").alias("p"), F.count("*").alias("problems"), F.sum("k").alias("k"), F.sum("n").alias("n"))
    main = rate(F.col("p"), F.col("problems"))
    kinds = rows.where("outcome is not null").groupBy("outcome").agg(F.count("*").cast("double").alias("value")).select(F.concat(F.lit("n_"), "outcome").alias("metric"), "value")
    return together(metrics(row, score=main, main_problem_accuracy=main, subproblem_accuracy=rate(F.col("k"), F.col("n"))), kinds, health(samples, verdicts))


def means(samples: DataFrame, verdicts: DataFrame, names: list[str], headline: str | None = None, scale: float = 100.0) -> DataFrame:
    """The mean of each measure over judged samples."""
    row = first_only(verdicts).agg(*[F.coalesce(F.avg(c) * scale, F.lit(0.0)).alias(c) for c in names])
    return together(metrics(row, **({"score": F.col(headline)} if headline else {}), **{c: F.col(c) for c in names}), metrics(counts(samples, verdicts), fails=F.col("fails")))

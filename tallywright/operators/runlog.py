"""The append-only log of stages: the latest state, what is left to do, retries, anomalies, profiles, leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallywright.operators.ranking import null_safe, positioned, with_even_bucket

# The stages in order of rank.
STAGES = ["initial", "preprocessed", "inferred", "postprocessed", "feedback", "failed", "final"]

# The action that leads out of each stage, the failures that are never tried again, finish reasons that cut an output.
ACTIONS = {"initial": "preprocess", "preprocessed": "infer", "inferred": "postprocess", "postprocessed": "feedback", "feedback": "finalize"}
NEVER_AGAIN = ["iteration_limit", "retry_limit", "non_retriable"]
CUT_SHORT = ["length", "max_tokens", "content_filter"]


def stage_rank(stage: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, STAGES)), stage) - 1


def compacted(log: DataFrame, key: str = "sample_id", tie: str = "seq") -> DataFrame:
    """The latest record of each sample: by iteration, then stage, then place in the log."""
    order = F.struct("iteration", stage_rank(F.col("stage")).alias("rank"), tie)
    return log.groupBy(key).agg(F.max_by(F.struct(*[c for c in log.columns if c != key]), order).alias("_last")).select(key, "_last.*")


def pending(universe: DataFrame, log: DataFrame, key: str = "sample_id") -> DataFrame:
    """The samples that the log doesn't know."""
    return universe.join(log.select(key), key, "left_anti")


def rolled_back(state: DataFrame, max_retries: int) -> DataFrame:
    """Failed samples that may be tried again go back to before the action that failed; retry_count grows by one.

    With it above max_retries a sample stays failed, for the reason retry_limit. Failures without an action stay, too.
    """
    again = (F.col("stage") == "failed") & F.col("error_action").isNotNull() & ~F.coalesce(F.col("error_reason").isin(NEVER_AGAIN), F.lit(False))
    over = F.col("retry_count") + 1 > max_retries
    before = F.lit("initial")
    for stage, action in ACTIONS.items():
        before = F.when(F.col("error_action") == action, stage).otherwise(before)
    return state.select(
        *[c for c in state.columns if c not in ("stage", "retry_count", "error_reason")],
        F.when(again & ~over, before).otherwise(F.col("stage")).alias("stage"), (F.col("retry_count") + again.cast("int")).alias("retry_count"),
        F.when(again & over, "retry_limit").when(again, F.lit(None)).otherwise(F.col("error_reason")).alias("error_reason"),
    )


def iterated(state: DataFrame, max_iterations: int) -> DataFrame:
    """Samples whose feedback didn't finalise them begin again, or fail for the reason iteration_limit."""
    todo = (F.col("stage") == "feedback") & ~F.col("finalize")
    over = F.col("iteration") + 1 >= max_iterations
    return state.select(
        *[c for c in state.columns if c not in ("stage", "iteration", "error_reason")],
        F.when(todo & over, "failed").when(todo, "initial").when(F.col("stage") == "feedback", "final").otherwise(F.col("stage")).alias("stage"),
        (F.col("iteration") + (todo & ~over).cast("int")).alias("iteration"), F.when(todo & over, "iteration_limit").otherwise(F.col("error_reason")).alias("error_reason"),
    )


def rules() -> dict[str, Column]:
    """Rules by name: over rollouts of final samples, each says whether a rollout is odd."""
    return {
        "empty_infer": F.col("text").isNull() | (F.col("text") == ""), "truncated_output": F.col("finish_reason").isin(CUT_SHORT),
        "empty_postprocess": F.trim(F.coalesce("prediction", F.lit(""))) == "", "extraction_failure": ~F.col("extracted"),
    }


def anomalies(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(rule, n_samples, n_rollouts) of rows (sample_id, idx): one pass, every rule has a row."""
    hits = F.filter(F.array(*[F.struct(F.lit(k).alias("rule"), F.coalesce(c, F.lit(False)).alias("hit")) for k, c in checks.items()]), lambda h: h["hit"])
    long = rows.select("sample_id", F.explode(hits).alias("h")).select("sample_id", "h.rule")
    found = long.groupBy("rule", "sample_id").agg(F.count("*").alias("k")).groupBy("rule").agg(F.count("*").alias("n_samples"), F.sum("k").alias("n_rollouts"))
    names = rows.sparkSession.createDataFrame([(k,) for k in checks], "rule string")
    return names.join(found, "rule", "left").select("rule", F.coalesce("n_samples", F.lit(0)).alias("n_samples"), F.coalesce("n_rollouts", F.lit(0)).alias("n_rollouts"))


def nearest_rank(rows: DataFrame, by: str, value: str, shares: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """Count, total, mean, extremes and nearest-rank percentiles of each group: the value at place int(p n) of the sorted ones. Null values don't count; null keys are a group."""
    rows = rows.where(F.col(value).isNotNull())
    stats = rows.groupBy(by).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"), F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
    counts = rows.groupBy(by, value).agg(F.count("*").alias("_k"))
    ranged, bucket = with_even_bucket(counts, [by], value)
    placed = positioned(ranged, [by], bucket, [F.col(value)], weight=F.col("_k"))
    placed = placed.join(stats.select(F.col(by).alias("_by"), "n"), F.col(by).eqNullSafe(F.col("_by")))
    at = {p: F.least(F.floor(F.lit(p) * F.col("n")), F.col("n") - 1) for p in shares}
    points = placed.groupBy(by).agg(*[F.max(F.when((F.col("position") <= place) & (place < F.col("position") + F.col("_k")), F.col(value))).alias(f"p{round(100 * p)}") for p, place in at.items()])
    return null_safe(stats, points, [by])


def token_buckets(count: Column, edges: tuple[int, ...] = (256, 1024, 4096, 16384)) -> Column:
    """The number of the bucket: how many edges the count reaches."""
    return sum([(count >= e).cast("int") for e in edges[1:]], (count >= edges[0]).cast("int"))


def truncation(calls: DataFrame) -> DataFrame:
    """One row (truncated, scored) over calls (sample_id, idx, finish_reason): distinct rollouts; both null if any has no reason."""
    each = calls.groupBy("sample_id", "idx").agg(F.bool_or(F.col("finish_reason").isin(CUT_SHORT)).alias("cut"), F.bool_or(F.col("finish_reason").isNull()).alias("unknown"))
    whole = each.agg(F.count_if("cut").alias("cut"), F.count("*").alias("all"), F.coalesce(F.bool_or("unknown"), F.lit(False)).alias("unknown"))
    return whole.select(F.when(~F.col("unknown"), F.col("cut")).alias("truncated"), F.when(~F.col("unknown"), F.col("all")).alias("scored"))


def latest_runs(runs: DataFrame, *by: str, run: str = "run_id") -> DataFrame:
    """The run with the greatest id, as a string, of each cell."""
    rest = [c for c in runs.columns if c not in by]
    return runs.groupBy(*by).agg(F.max_by(F.struct(*rest), F.col(run).cast("string")).alias("_r")).select(*by, "_r.*")


def leaderboard(runs: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    return latest_runs(runs, row, column).groupBy(row).pivot(column, columns).agg(F.first(value))


def annotated(cells: DataFrame, references: DataFrame, on: list[str], tolerance: float) -> DataFrame:
    """Cells (observed) with their difference from the reference, if there is one, and whether it is within the tolerance."""
    joined = cells.join(references, on, "left").withColumn("diff", F.round(F.col("observed") - F.col("reference"), 6))
    return joined.withColumn("within", F.abs("diff") <= F.lit(tolerance + max(1e-9, 1e-9 * tolerance)))


def last_first(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).where(F.col("_r") <= n).drop("_r")

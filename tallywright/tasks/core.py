"""What a task is, and how it runs over recorded or generated responses.

Samples are rows (sample_id, prompt, reference and what the report groups by). Responses are rows (sample_id, idx and text, or what
a task's mode wants: logprobs, replies of a judge). Verdicts are rows (sample_id, idx, answer, extracted, correct and more). A report
is rows (metric, value), the values of rates in percent. Each step is a plan of columns; nothing is collected but a report.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallywright.sources.tables import Dataset
from tallywright.tasks.reports import timeouts

REQUESTED, JUDGED = "requested", "judged"


@dataclass(frozen=True)
class Task:
    """samples: of a dataset. judge: of samples joined to responses. report: of (samples, verdicts, n, k)."""

    name: str
    dataset: str
    mode: str
    headline: str | None
    denominator: str
    samples: Callable[[Dataset], DataFrame]
    judge: Callable[[DataFrame], DataFrame]
    report: Callable[[DataFrame, DataFrame, int, int], DataFrame]
    shots: int = 0
    options: dict = field(default_factory=dict)


def evaluate(task: Task, data: Dataset | DataFrame, responses: DataFrame, n: int = 1, k: int = 1) -> DataFrame:
    """The report (metric, value) of a task over a dataset, or over its samples, and responses; samples without any count as failed."""
    samples = task.samples(data) if isinstance(data, Dataset) else data
    verdicts = task.judge(samples.join(responses, "sample_id"))
    report = task.report(samples, verdicts, n, k)
    return report.unionByName(timeouts(verdicts)) if "timed_out" in verdicts.columns else report


def identified(df: DataFrame) -> DataFrame:
    """Adds ``sample_id``, a hash of the whole row; rows that repeat are numbered and so told apart. Nothing depends on their order."""
    code = F.xxhash64(F.to_json(F.struct(*df.columns)))
    again = F.row_number().over(Window.partitionBy("_code").orderBy(F.lit(0)))
    return df.withColumn("_code", code).withColumn("_again", again).withColumn("sample_id", F.when(F.col("_again") == 1, F.col("_code")).otherwise(F.xxhash64("_code", "_again"))).drop("_code", "_again")


def filled(template: str, **values: Column) -> Column:
    """A template with {name} fields as a column; fields that aren't given stay as they are."""
    out, rest = [], template
    while rest:
        at = min((rest.find("{" + k + "}") for k in values if "{" + k + "}" in rest), default=-1)
        if at < 0:
            out.append(F.lit(rest))
            break
        name = rest[at + 1 : rest.index("}", at)]
        out += [F.lit(rest[:at]), F.coalesce(values[name].cast("string"), F.lit(""))]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*out) if out else F.lit("")


def drawn_examples(pool: DataFrame, n: int, text: Column, seed: int, glue: str = "") -> DataFrame:
    """(prefix): one row with n examples' texts in an order drawn by the seed; an error with fewer than n."""
    first = pool.select(F.xxhash64(F.lit(seed), F.to_json(F.struct(*pool.columns))).alias("at"), text.alias("text")).orderBy("at", "text").limit(n)
    packed = first.agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("all"))  # n rows
    enough = F.when(F.size("all") == n, F.array_join(F.transform("all", lambda x: x["text"]), glue)).otherwise(F.raise_error(F.lit("not enough examples")))
    return packed.select(enough.alias("prefix"))


def examples_by(pool: DataFrame, by: list[str], n: int, text: Column, order: Column) -> DataFrame:
    """(by, prefix): the texts of each group's first n examples, joined; an error for a group with fewer."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    first = pool.withColumn("_text", text).withColumn("_rank", rank).where(F.col("_rank") <= n)
    packed = first.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_rank", "_text"))).alias("_all"))
    enough = F.when(F.size("_all") == n, F.array_join(F.transform("_all", lambda x: x["_text"]), "")).otherwise(F.raise_error(F.lit("a group has not enough examples")))
    return packed.select(*by, enough.alias("prefix"))

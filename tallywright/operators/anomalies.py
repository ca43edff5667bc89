"""Rules about odd samples: what each says, which tasks it is for, what it finds in every rollout, and reports that are kept by version of the rules.

Outcomes are rows (sample_id, iteration, stage, calls, result, rollouts), one a sample:

    calls     array<struct<texts array<string>, finish_reasons array<string>, logprobs array<double>, logprob_tokens array<string>>>, null before inference
    result    string, what postprocessing gave where that is no record
    rollouts  array<struct<index int, extracted boolean>>, the record of predictions, null where there is none
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.operators.runlog import CUT_SHORT

EVERY = "all_tasks"
CATEGORIES, SEVERITIES = ("output_quality", "performance", "correctness"), ("info", "warning", "error")
SCHEMA_VERSION = "1.0"


@dataclass(frozen=True)
class Rule:
    """``finds`` gives, over outcomes, the indices of odd rollouts (array<int>); index 0 stands for a whole sample."""

    name: str
    description: str
    category: str
    rationale: str
    finds: Callable[[], Column]
    applies_to: tuple[str, ...] = (EVERY,)
    severity: str = "warning"
    tags: tuple[str, ...] = ()
    threshold: float | None = None

    def __post_init__(self) -> None:
        if self.category not in CATEGORIES or self.severity not in SEVERITIES:
            raise ValueError(f"{self.name}: categories are {CATEGORIES}, severities {SEVERITIES}")

    def applies(self, task_tags: set[str]) -> bool:
        return EVERY in self.applies_to or bool(task_tags & set(self.applies_to))

    def definition(self) -> dict:
        out = {"name": self.name, "description": self.description, "category": self.category, "applies_to": list(self.applies_to), "severity": self.severity, "rationale": self.rationale}
        return out | {"tags": list(self.tags) or [self.name.replace("_", " ")]} | ({} if self.threshold is None else {"threshold": self.threshold})


def _none() -> Column:
    return F.array().cast("array<int>")


def _whole(odd: Column) -> Column:
    return F.when(odd, F.array(F.lit(0))).otherwise(_none())


def _places(items: Column, odd: Callable[[Column], Column]) -> Column:
    """The places from 0 of the items that are odd."""
    return F.filter(F.transform(items, lambda x, i: F.when(odd(x), i)), lambda i: i.isNotNull())


def _some_call(odd: Callable[[Column], Column]) -> Column:
    return F.coalesce(F.exists("calls", odd), F.lit(False))


def _no_logprobs(call: Column) -> Column:
    return F.coalesce(F.size(call["logprobs"]) == 0, F.lit(False)) | F.coalesce(F.size(call["logprob_tokens"]) == 0, F.lit(False))


def _cut() -> Column:
    reasons = F.transform("calls", lambda c: _places(F.coalesce(c["finish_reasons"], F.array().cast("array<string>")), lambda r: F.coalesce(r.isin(CUT_SHORT), F.lit(False))))
    return F.array_sort(F.array_distinct(F.flatten(reasons)))


def _nothing_extracted() -> Column:
    missed = F.filter(F.transform("rollouts", lambda r, i: F.when(~F.coalesce(r["extracted"], F.lit(False)), F.coalesce(r["index"], i))), lambda i: i.isNotNull())
    return F.when(F.col("rollouts").isNull(), _none()).when(F.size("rollouts") == 0, F.array(F.lit(0))).otherwise(F.array_sort(F.array_distinct(missed)))


#: The rules, in order. Names, scopes, categories and severities are fixed values.
RULES: tuple[Rule, ...] = (
    Rule("empty_infer_gen", "A call of a generation task gave no texts", "output_quality", "No text at all points at the service, its limits or the settings.", lambda: _whole(_some_call(lambda c: F.coalesce(F.size(c["texts"]) == 0, F.lit(True)))), ("gen",), tags=("generation", "api_failure", "empty_output")),
    Rule("empty_infer_ppl", "A candidate of a perplexity task came without log probabilities", "output_quality", "A sum over nothing is 0, above all real candidates, so that the empty one wins.", lambda: _whole(_some_call(_no_logprobs)), ("ppl",), tags=("perplexity", "api_failure", "empty_output")),
    Rule("truncated_output", "A text was cut at the limit of its length", "output_quality", "The limit may be too low. Tasks that read one token always end there, so only generation counts.", _cut, ("gen",), "info", ("truncation", "length_limit", "incomplete_output")),
    Rule("empty_postprocess", "Postprocessing gave nothing", "correctness", "No answer could be read from the output.", lambda: _whole(F.col("rollouts").isNull() & (F.trim(F.coalesce("result", F.lit(""))) == "")), tags=("parsing", "extraction", "correctness")),
    Rule("extraction_failure", "A rollout has no usable answer", "correctness", "It counts as wrong though the model need not be: look at the prompt, the extraction, or an empty text.", _nothing_extracted, tags=("parsing", "extraction", "empty_output", "correctness")),
)


def schema(rules: tuple[Rule, ...] = RULES) -> dict:
    return {"version": SCHEMA_VERSION, "rules": [r.definition() for r in rules]}


def rules_hash(rules: tuple[Rule, ...] = RULES) -> str:
    """Sixteen hexadecimal digits that change with any definition."""
    return xxhash.xxh3_64(json.dumps(schema(rules), sort_keys=True).encode()).hexdigest()


def by_category(rules: tuple[Rule, ...] = RULES) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for r in rules:
        out.setdefault(r.category, []).append(r.name)
    return out


def detected(outcomes: DataFrame, task_tags: set[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(sample_id, iteration, rule, indices) of final samples: the rules that apply to a task with these tags and found something.

    One pass without a shuffle. A task without tags is not looked at. Null indices of a rule count as nothing found.
    """
    chosen = [r for r in rules if r.applies(task_tags)] if task_tags else []
    if not chosen:
        return outcomes.select("sample_id", "iteration", F.lit("").alias("rule"), _none().alias("indices")).where(F.lit(False))
    each = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.coalesce(r.finds(), _none()).alias("indices")) for r in chosen])
    found = F.filter(each, lambda x: F.size(x["indices"]) > 0)
    return outcomes.where(F.col("stage") == "final").select("sample_id", "iteration", F.explode(found).alias("f")).select("sample_id", "iteration", "f.rule", "f.indices")


def summary(outcomes: DataFrame, found: DataFrame) -> DataFrame:
    """(metric, value): samples in all, final, failed and odd; for each rule the odd samples and rollouts."""
    kinds = outcomes.agg(F.count("*").alias("total_samples"), F.count_if(F.col("stage") == "final").alias("final_samples"), F.count_if(F.col("stage") == "failed").alias("failed_samples"))
    odd = found.select("sample_id").distinct().agg(F.count("*").alias("anomaly_samples"))
    rows = [t.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in t.columns])).alias("m")).select("m.*") for t in (kinds, odd)]
    rules = found.groupBy("rule").agg(F.count_distinct("sample_id").alias("samples"), F.sum(F.size("indices")).cast("long").alias("rollouts"))
    rows += [rules.select(F.concat(F.lit(f"{kind}:"), "rule").alias("metric"), F.col(kind).alias("value")) for kind in ("samples", "rollouts")]
    return reduce(DataFrame.unionByName, rows)


def save(found: DataFrame, counts: DataFrame, folder: str, task: str, generated_at: str, rules: tuple[Rule, ...] = RULES) -> str:
    """Writes details, counts and what the rules say below ``folder/rules=<hash>`` and gives that hash.

    A report of the same rules is replaced, one of others stays beside it. What the rules say is written last: without it a report is not there.
    """
    spark, code = found.sparkSession, rules_hash(rules)
    place = f"{folder}/rules={code}"
    found.write.mode("overwrite").parquet(f"{place}/samples")
    counts.coalesce(1).write.mode("overwrite").json(f"{place}/summary")
    about = json.dumps({"generated_at": generated_at, "task_name": task, "rules_hash": code, "rules_schema": schema(rules)}, sort_keys=True)
    spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{place}/meta")
    return code


def loaded(spark: SparkSession, folder: str, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, dict, dict[str, int]] | None:
    """(details, what the rules say, counts) of the report by these rules; None if it has to be made."""
    place = f"{folder}/rules={rules_hash(rules)}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{place}/meta/_SUCCESS")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    counts = spark.read.schema("metric string, value long").json(f"{place}/summary").collect()  # a row a rule and kind
    return spark.read.parquet(f"{place}/samples"), json.loads(spark.read.text(f"{place}/meta").first().value), {r.metric: r.value for r in counts}

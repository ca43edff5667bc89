"""A whole evaluation: prompts, a provider's answers, predictions, verdicts and a report, each stage a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.operators.metrics import sampling_report

#: A provider takes a batch of prompts and gives each a list of answers; what it raises becomes the rows' error.
Provider = Callable[[list[str]], list[list[str]]]


def replayed(prompts: DataFrame, responses: DataFrame) -> DataFrame:
    """The recorded answers (sample_id, texts) of prompts; without a record there is an error and no answer."""
    joined = prompts.join(responses.select("sample_id", "texts"), "sample_id", "left")
    return joined.withColumn("error", F.when(F.col("texts").isNull(), "exception::KeyError"))


def inferred(prompts: DataFrame, provider: Provider, batch: int = 64) -> DataFrame:
    """The provider's answers; a batch that raises is asked again row by row, so that one row fails alone."""

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            texts, errors = [], []
            for i in range(0, len(rows), batch):
                some = rows.prompt.iloc[i : i + batch].tolist()
                try:
                    got = [(t, None) for t in provider(some)]
                except Exception:
                    got = [_alone(provider, p) for p in some]
                texts += [t for t, _ in got]
                errors += [e for _, e in got]
            yield pd.DataFrame({"sample_id": rows.sample_id, "texts": texts, "error": errors})

    return prompts.select("sample_id", "prompt").mapInPandas(ask, "sample_id long, texts array<string>, error string")


def _alone(provider: Provider, prompt: str) -> tuple[list[str] | None, str | None]:
    try:
        return provider([prompt])[0], None
    except Exception as e:
        return None, f"exception::{type(e).__name__}"


@dataclass(frozen=True)
class Task:
    """How a sample becomes a prompt, a text a prediction, and a prediction a verdict; columns, so that Spark plans all of it."""

    prompt: Column
    extract: Callable[[Column], Column]
    grade: Callable[[Column, Column], Column]
    n: int = 1
    k: int = 1

    def prompts(self, samples: DataFrame) -> DataFrame:
        return samples.select("sample_id", self.prompt.alias("prompt"), "reference")

    def judged(self, samples: DataFrame, answers: DataFrame) -> DataFrame:
        """(sample_id, idx, answer, extracted, correct) of all rollouts that came."""
        texts = samples.select("sample_id", "reference").join(answers.where("error is null").select("sample_id", "texts"), "sample_id").select("sample_id", "reference", F.posexplode("texts").alias("idx", "text"))
        found = texts.withColumn("answer", F.nullif(self.extract(F.col("text")), F.lit("")))
        return found.select("sample_id", "idx", "answer", F.col("answer").isNotNull().alias("extracted"), F.coalesce(self.grade(F.col("answer"), F.col("reference")), F.lit(False)).alias("correct"))

    def report(self, samples: DataFrame, answers: DataFrame) -> DataFrame:
        return sampling_report(samples, self.judged(samples, answers), self.n, self.k)

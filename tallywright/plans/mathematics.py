"""Equality of expressions and votes by it, over answers whose forms and values every document decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.functions.mathematics import math_equal, vote_key
from tallywright.operators import metrics
from tallywright.plans.catalogue import query
from tallywright.sources.tables import table

#: Ways to write the square of x + n, with N for n, M for 2n and Q for n squared.
FORMS = [
    "(x+N)^2", "x^2+Mx+Q", r"\frac{(x+N)^3}{x+N}", "(N+x)(x+N)", r"\left(x+\sqrt{Q}\right)^2", r"\frac{x}{\frac{1}{x+M}}+Q", r"(x+N+\sqrt2)(x+N-\sqrt{2})+2", r"x^2+\dfrac{4\cdot Nx}{2}+N^{2}",
]


def _written(form: Column, n: Column) -> Column:
    picked = F.element_at(F.array(*map(F.lit, FORMS)), (form + 1).cast("int"))
    for letter, value in (("N", n), ("M", 2 * n), ("Q", n * n)):
        picked = F.replace(picked, F.lit(letter), value.cast("string"))
    return picked


def _chars() -> Column:
    return F.length(F.coalesce("text", F.lit("")))


@query("equal_expressions", f"""
    select doc_id, n % 90 + 2 = (case when doc_id % 3 = 0 then n % 90 + 3 when doc_id % 7 = 0 then -(n % 90 + 2) else n % 90 + 2 end) as same
    from (select doc_id, length(coalesce(text, '')) as n from documents)""")  # fmt: skip
def equal_expressions(spark: SparkSession, d: str) -> DataFrame:
    """Whether two expressions are equal, both written in a form that the document decides; some of them differ."""
    n, i = _chars() % 90 + 2, F.col("doc_id")
    other = F.when(i % 3 == 0, n + 1).when(i % 7 == 0, -n).otherwise(n)
    one = _written(i % len(FORMS), n)
    return table(spark, d, "documents").select("doc_id", math_equal(one, F.when(other < 0, F.concat(F.lit("(x-"), n.cast("string"), F.lit(")^2"))).otherwise(_written((i + _chars()) % len(FORMS), other))).alias("same"))


@query("votes_by_value", """
    with a as (select doc_id // 16 as sample_id, doc_id, length(coalesce(text, '')) % 4 + 2 as n from documents),
    v as (select sample_id, n, count(*) as k from a group by all),
    t as (select sample_id, cast(sum(k) as bigint) as n, max(k) as top from v group by 1)
    select sample_id, t.n, cast(coalesce(max(case when v.n = 3 and k = top and (select count(*) from v w where w.sample_id = t.sample_id and w.k = top) = 1 then 1 end), 0) as int) as majority,
           round(top / t.n, 9) as consistency
    from t join v using (sample_id) group by sample_id, t.n, top""")  # fmt: skip
def votes_by_value(spark: SparkSession, d: str) -> DataFrame:
    """Majority votes of groups of sixteen documents, each answering with the square of x + n in a form of its own; (x + 3)^2 is correct."""
    n = _chars() % 4 + 2
    answer = _written(F.col("doc_id") % len(FORMS), n)
    rollouts = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 16).alias("sample_id"), answer.alias("answer"), (n == 3).alias("correct"), vote_key(answer).alias("vote"))
    return metrics.votes(rollouts).select("sample_id", "n", "majority", F.round("consistency", 9).alias("consistency"))

"""Queries by name, each with its SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: The rollouts fixture in SQL.
ROLLOUTS = """rollouts as (
  select l_orderkey as sample_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_returnflag, l_shipdate) - 1 as idx,
         l_quantity > 25 as correct, case when l_discount > 0 then l_returnflag end as answer, l_discount > 0 as extracted, l_partkey as part, l_tax as tax from lineitem)"""
PROBLEMS = ROLLOUTS + """, problems as (
  select sample_id, count(*) as n, count(*) filter (correct) as c, count(*) filter (not extracted) as n_unextracted, arg_min(correct, idx) as first_correct from rollouts group by sample_id)"""
VOTES = PROBLEMS + """, answers as (select sample_id, nullif(trim(answer), '') as vote, count(*) as k, bool_or(correct) as ok from rollouts group by 1, 2),
  tops as (select sample_id, max(k) as top from answers where vote is not null group by 1),
  votes as (select p.sample_id, any_value(p.n) as n, coalesce(case when count(*) filter (a.k = t.top) = 1 then max(case when a.k = t.top and a.ok then 1 else 0 end) end, 0)::int as majority,
            coalesce(any_value(t.top), 0) / any_value(p.n) as consistency
            from problems p left join tops t using (sample_id) left join answers a on a.sample_id = p.sample_id and a.vote is not null group by p.sample_id)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under a name; the SQL, if given, must give the same rows."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add

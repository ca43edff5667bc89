"""Sampling metrics and reports over the rollouts of orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.functions.sampling import pass_at_k, pass_pow_k
from tallywright.operators import metrics
from tallywright.plans.catalogue import PROBLEMS, ROLLOUTS, VOTES, query
from tallywright.sources.tables import rollouts, table


def _rollouts(spark: SparkSession, d: str) -> DataFrame:
    return rollouts(table(spark, d, "lineitem"))


def _problems(spark: SparkSession, d: str) -> DataFrame:
    return metrics.problems(_rollouts(spark, d))


@query("pass_at_k", f"with {PROBLEMS} select sample_id, c / n as p1, case when n < 2 or c = 0 then 0.0 when c >= n then 1.0 else 1 - (n - c) * (n - c - 1) / (n * (n - 1)) end as p2 from problems")
def pass_at(spark: SparkSession, d: str) -> DataFrame:
    return _problems(spark, d).select("sample_id", F.round(pass_at_k(F.col("n"), F.col("c"), 1), 9).alias("p1"), F.round(pass_at_k(F.col("n"), F.col("c"), 2), 9).alias("p2"))


@query("pass_pow_k", f"with {PROBLEMS} select sample_id, round(case when n < 2 or c < 2 then 0.0 else c * (c - 1) / (n * (n - 1)) end, 9) as p2, round(case when n < 3 or c < 3 then 0.0 else c * (c - 1) * (c - 2) / (n * (n - 1) * (n - 2)) end, 9) as p3 from problems")
def pass_pow(spark: SparkSession, d: str) -> DataFrame:
    return _problems(spark, d).select("sample_id", *[F.round(pass_pow_k(F.col("n"), F.col("c"), k), 9).alias(f"p{k}") for k in (2, 3)])


@query("avg_at_n", f"with {ROLLOUTS} select sample_id, round(avg(correct::int), 9) as avg_at_n from rollouts group by 1")
def avg_at_n(spark: SparkSession, d: str) -> DataFrame:
    return _problems(spark, d).select("sample_id", F.round(F.col("c") / F.col("n"), 9).alias("avg_at_n"))


@query("majority_at_k", f"with {VOTES} select sample_id, n, majority from votes")
def majority(spark: SparkSession, d: str) -> DataFrame:
    return metrics.votes(_rollouts(spark, d)).select("sample_id", "n", "majority")


@query("self_consistency", f"with {VOTES} select sample_id, round(consistency, 9) as consistency from votes")
def consistency(spark: SparkSession, d: str) -> DataFrame:
    return metrics.votes(_rollouts(spark, d)).select("sample_id", F.round("consistency", 9).alias("consistency"))


@query("sampling_report", f"""with {VOTES}, r as (select o_orderkey, p.*, v.majority, v.consistency from orders o left join problems p on p.sample_id = o_orderkey left join votes v on v.sample_id = o_orderkey)
  select round(sum(c / n) * 100 / count(*), 6) as pass_at_1,
         round(sum(case when n < 4 or c = 0 then 0.0 when c >= n then 1.0 else 1 - (n-c)*(n-c-1)*(n-c-2)*(n-c-3) / (n*(n-1)*(n-2)*(n-3)) end) filter (n is not null) * 100 / count(*), 6) as pass_at_k,
         round(sum(case when n < 4 or c < 4 then 0.0 else c*(c-1)*(c-2)*(c-3) / (n*(n-1)*(n-2)*(n-3)) end) filter (n is not null) * 100 / count(*), 6) as pass_pow_k,
         round(sum(majority) * 100 / count(*), 6) as majority_at_k, round(sum(consistency) * 100 / count(*), 6) as self_consistency, round(sum(c / n) * 100 / count(*), 6) as avg_at_n,
         4 as n, 4 as k, count(*) filter (n < 4) as n_short, coalesce(sum(n_unextracted), 0)::bigint as n_unextracted, count(*) as requested, count(n) as judged, count(*) - count(n) as fails, 'requested' as denominator_policy from r""".replace(" n < 4)", " r.n < 4)"))
def sampling_report(spark: SparkSession, d: str) -> DataFrame:
    return metrics.sampling_report(table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id")), _rollouts(spark, d), 4, 4)


@query("denominator_policies", f"with {PROBLEMS} select count(*) as requested, count(n) as judged, count(*) - count(n) as fails, round(sum(first_correct::int) * 100 / count(*), 6) as over_requested, round(sum(first_correct::int) * 100 / count(n), 6) as over_judged from orders left join problems on sample_id = o_orderkey")
def denominators(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id")).join(_problems(spark, d), "sample_id", "left")
    hits = F.sum(F.col("first_correct").cast("int")) * 100
    return rows.agg(F.count("*").alias("requested"), F.count("n").alias("judged"), (F.count("*") - F.count("n")).alias("fails"), F.round(hits / F.count("*"), 6).alias("over_requested"), F.round(hits / F.count("n"), 6).alias("over_judged"))


@query("first_rollout_accuracy", f"with {PROBLEMS} select count(*) as n, count(*) filter (first_correct) as n_correct, round(avg(first_correct::int) * 100, 6) as accuracy from problems")
def first_rollout(spark: SparkSession, d: str) -> DataFrame:
    return _problems(spark, d).agg(F.count("*").alias("n"), F.count_if("first_correct").alias("n_correct"), F.round(F.avg(F.col("first_correct").cast("int")) * 100, 6).alias("accuracy"))


@query("unextracted_health", f"with {PROBLEMS} select sum(n_unextracted)::bigint as n_unextracted, count(*) filter (n < 4) as n_short, sum(n - 1)::bigint as unscored from problems")
def health(spark: SparkSession, d: str) -> DataFrame:
    return _problems(spark, d).agg(F.sum("n_unextracted").alias("n_unextracted"), F.count_if(F.col("n") < 4).alias("n_short"), F.sum(F.col("n") - 1).alias("unscored"))


@query("aggregate_partial_keys", f"with {PROBLEMS} select round(sum(c / n) * 100 / count(*), 6) as always, case when count(case when n >= 2 then c end) = count(*) then round(sum(case when n >= 2 then c end) * 100 / count(*), 6) end as sometimes from problems")
def partial_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = _problems(spark, d).select((F.col("c") / F.col("n")).alias("always"), F.when(F.col("n") >= 2, F.col("c").cast("double")).alias("sometimes"))
    return metrics.partial_key_report(rows, ["always", "sometimes"], F.count(F.lit(1)))


@query("mcq_micro_category", f"with {ROLLOUTS} select o_orderpriority as category, count(*) as n, round(avg(correct::int) * 100, 6) as accuracy from rollouts join orders on sample_id = o_orderkey group by 1")
def micro_category(spark: SparkSession, d: str) -> DataFrame:
    rows = _rollouts(spark, d).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"), F.col("o_orderpriority").alias("category")), "sample_id")
    return metrics.accuracy_by(rows, "category")


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return _rollouts(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("category"), F.col("p_type").alias("subject")), "part")


@query("macro_subject_category", f"with {ROLLOUTS}, c as (select p_brand as category, p_type, avg(correct::int) as a from rollouts join part on part = p_partkey group by 1, 2) select category, count(*) as cells, round(avg(a) * 100, 6) as macro from c group by 1")
def macro_subject(spark: SparkSession, d: str) -> DataFrame:
    return metrics.macro(_parts(spark, d), "subject", "category")


@query("macro_complete_group", f"with {ROLLOUTS}, c as (select p_brand as category, p_type, avg(correct::int) as a from rollouts join part on part = p_partkey group by 1, 2), g as (select category, count(*) as cells, round(avg(a) * 100, 6) as macro from c group by 1) select * from g where cells = (select count(distinct p_type) from part)")
def macro_complete(spark: SparkSession, d: str) -> DataFrame:
    kinds = table(spark, d, "part").agg(F.countDistinct("p_type").alias("kinds"))  # one row
    return metrics.macro(_parts(spark, d), "subject", "category").crossJoin(F.broadcast(kinds)).where("cells = kinds").drop("kinds")


@query("grouping_sets", "select lang, source, grouping_id(lang, source)::bigint as gid, count(*) as n, round(avg(quality) * 100, 6) as accuracy from documents join labels using (doc_id) where quality is not null group by grouping sets ((lang), (lang, source))")
def grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels"), "doc_id").where("quality is not null")
    return rows.groupingSets([["lang"], ["lang", "source"]], "lang", "source").agg(F.grouping_id().alias("gid"), F.count("*").alias("n"), F.round(F.avg("quality") * 100, 6).alias("accuracy"))


@query("effective_accuracy", f"with {ROLLOUTS}, g as (select sample_id, count(*) = 3 and bool_and(correct) as e, bool_or(correct) as a from rollouts group by 1) select count(*) as groups, round(avg(e::int) * 100, 6) as effective, round(avg(a::int) * 100, 6) as covered from g")
def effective(spark: SparkSession, d: str) -> DataFrame:
    return metrics.all_of_group(_rollouts(spark, d), "sample_id", 3)


@query("fails_keep_type", f"with {PROBLEMS} select o_orderpriority as type, count(*) as requested, count(n) as judged, round(coalesce(sum(first_correct::int), 0) * 100 / count(*), 6) as accuracy from orders left join problems on sample_id = o_orderkey group by 1")
def fails_keep_type(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"), F.col("o_orderpriority").alias("type")).join(_problems(spark, d), "sample_id", "left")
    return rows.groupBy("type").agg(F.count("*").alias("requested"), F.count("n").alias("judged"), F.round(F.coalesce(F.sum(F.col("first_correct").cast("int")), F.lit(0)) * 100 / F.count("*"), 6).alias("accuracy"))


@query("grade_f1", """with r as (select avg((l_returnflag = 'A')::int) as c, avg((l_returnflag = 'N')::int) as i, avg((l_returnflag = 'R')::int) as s from lineitem), g as (select *, case when c + i > 0 then c / (c + i) else 0.0 end as given from r)
  select round(c, 6) as correct, round(i, 6) as incorrect, round(s, 6) as not_attempted, round(given, 6) as given, round(case when given + c > 0 then 2 * given * c / (given + c) else 0.0 end, 6) as f1 from g""")
def grade_f1(spark: SparkSession, d: str) -> DataFrame:
    return metrics.grade_rates(table(spark, d, "lineitem"), F.col("l_returnflag"))


@query("calibration", """with r as (select cast(l_quantity as bigint) as conf, l_discount > 0.05 as correct, l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey as key from lineitem),
  p as (select *, row_number() over (order by conf, substr(md5(key::varchar), 1, 2), md5(key::varchar), key) - 1 as place from r), b as (select floor(place / 100) as bin, count(*) as k, sum(conf) as conf, count(*) filter (correct) as hit from p group by 1)
  select (select count(*) from r) as n, 100 * round(sqrt(sum(k / (select count(*) from r) * (conf / 100 / k - hit / k) * (conf / 100 / k - hit / k))), 2) as calibration_error from b where bin < (select floor(count(*) / 100) from r) - 1""")
def calibration(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("l_orderkey") * 100000000 + F.col("l_linenumber") * 10000000 + F.col("l_partkey")
    rows = table(spark, d, "lineitem").select(F.col("l_quantity").cast("long").alias("conf"), (F.col("l_discount") > 0.05).alias("correct"), key.alias("key"))
    return metrics.calibration_error(rows, "conf", "key")


@query("wald_interval", "with r as (select o_orderpriority as type, count(*) as n, round(count(*) filter (o_totalprice > 150000) * 100 / count(*), 2) as accuracy from orders group by 1) select type, n, accuracy, round(1.96 * sqrt(accuracy * (100 - accuracy) / n), 2) as half_width from r")
def wald(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("type")).agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 150000).alias("c"))
    accuracy, half = metrics.wald(F.col("c"), F.col("n"))
    return rows.select("type", "n", accuracy.alias("accuracy"), half.alias("half_width"))


@query("rubric_rates", f"with {PROBLEMS} select count(*) as units, round(avg((c = n)::int) * 100, 6) as all_pass, round(avg(c / n) * 100, 6) as macro, round(sum(c) / sum(n) * 100, 6) as micro from problems")
def rubric(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rubric_rates(_problems(spark, d).select(F.col("c").alias("satisfied"), F.col("n").alias("criteria")))


TURNS = """turns as (select conv_id as session, turn, (text is not null and text not like '%,%') as ok, (text is not null and text not like '%,%')::int + (coalesce(length(text), 0) < 200)::int as satisfied, 2 as criteria from conversations),
  bad as (select *, row_number() over (partition by session order by turn) - 1 as place from turns)"""


def _turns(spark: SparkSession, d: str) -> DataFrame:
    ok = F.col("text").isNotNull() & ~F.coalesce(F.col("text").contains(","), F.lit(False))
    return table(spark, d, "conversations").select(F.col("conv_id").alias("session"), "turn", ok.alias("ok"), (ok.cast("int") + (F.coalesce(F.length("text"), F.lit(0)) < 200).cast("int")).alias("satisfied"), F.lit(2).alias("criteria"))


@query("session_prefix", f"with {TURNS} select session, count(*) as n_turns, coalesce(min(place) filter (not ok or turn <> place), count(*)) as prefix from bad group by 1")
def session_prefix(spark: SparkSession, d: str) -> DataFrame:
    return metrics.session_prefixes(_turns(spark, d))


@query("session_rates", f"with {TURNS}, s as (select session, count(*) as n, coalesce(min(place) filter (not ok or turn <> place), count(*)) as p from bad group by 1) select round(sum(satisfied) / sum(criteria), 6) as csr, round(avg(case when criteria > 0 then satisfied / criteria else 0 end), 6) as csr_macro, round(avg(ok::int), 6) as isr, (select round(avg(p / n), 6) from s) as ssr from turns")
def session_rates(spark: SparkSession, d: str) -> DataFrame:
    return metrics.session_rates(_turns(spark, d))


@query("multi_turn_pooled", f"with {TURNS} select turn, count(*) as n, round(avg(ok::int), 6) as prompt_rate, round(sum(satisfied) / sum(criteria), 6) as instruction_rate from turns group by 1")
def multi_turn(spark: SparkSession, d: str) -> DataFrame:
    rows = _turns(spark, d).groupBy("turn").agg(F.count("*").alias("n"), F.round(F.avg(F.col("ok").cast("int")), 6).alias("prompt_rate"), F.round(F.sum("satisfied") / F.sum("criteria"), 6).alias("instruction_rate"))
    return rows

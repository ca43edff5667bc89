"""Named tasks end to end, over samples and responses made from the tables; and loaders, over files made from them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.plans.catalogue import query
from tallywright.session import shared_folder
from tallywright.sources import benchmarks
from tallywright.sources.tables import table


def _run(task: str, samples: DataFrame, responses: DataFrame, n: int = 1, k: int = 1) -> DataFrame:
    from tallywright.tasks import TASKS, evaluate

    return evaluate(TASKS[task], samples, responses, n, k).select("metric", F.round("value", 6).alias("value"))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").withColumn("sample_id", F.col("doc_id"))


def _once(df: DataFrame, text: Column, **more: Column) -> DataFrame:
    """One rollout of each row."""
    return df.select("sample_id", F.lit(0).alias("idx"), text.alias("text"), *[v.alias(k) for k, v in more.items()])


def _letter(c: Column) -> Column:
    return F.substring(F.lit("ABCD"), (c % 4 + 1).cast("int"), F.lit(1))


@query("task_gsm8k_kshot_base", """with s as (select doc_id, (n_chars % 20)::varchar as gold, text is not null as there, case when doc_id % 3 = 0 then null else (doc_id % 20)::varchar end as strict, (doc_id % 20)::varchar as loose from documents),
  j as (select *, coalesce(strict = gold, false) as a, loose = gold as b from s where there)
  select unnest(['score', 'exact_match', 'flexible_exact_match', 'fails', 'n_unextracted']) as metric, unnest([round(100.0 * sum(a::int) / count(*), 6), round(100.0 * sum(a::int) / count(*), 6), round(100.0 * sum(b::int) / count(*), 6), (select count(*) from s where not there)::double, sum((strict is null)::int)::double]) as value from j""")
def task_gsm8k(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    number = (F.col("doc_id") % 20).cast("string")
    said = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("I think "), number)).otherwise(F.concat(F.lit("so\n#### "), number))
    return _run("gsm8k_kshot_base_gen", docs.select("sample_id", (F.col("n_chars") % 20).cast("string").alias("reference")), _once(docs.where("text is not null"), said))


@query("task_mmlu_pro", """with s as (select doc_id, source, substr('ABCD', (n_chars % 4 + 1)::int, 1) as gold, substr('ABCD', (doc_id % 4 + 1)::int, 1) as answer, text is not null as there from documents), j as (select *, gold = answer as ok from s where there),
  c as (select 'score_' || regexp_replace(lower(coalesce(source, 'unknown')), '[^a-z0-9]+', '_', 'g') as metric, round(100.0 * sum(ok::int) / count(*), 6) as value from j group by source)
  select metric, value from c union all select unnest(['score', 'accuracy', 'fails', 'n_unextracted']), unnest([round(100.0 * sum(ok::int) / count(*), 6), round(100.0 * sum(ok::int) / count(*), 6), (select count(*) from s where not there)::double, 0.0]) from j""")
def task_mmlu_pro(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    samples = docs.select("sample_id", _letter(F.col("n_chars")).alias("reference"), F.col("source").alias("category"))
    return _run("mmlu_pro_0shot_gen", samples, _once(docs.where("text is not null"), F.concat(F.lit("Thus\nANSWER: "), _letter(F.col("doc_id")))))


@query("task_mmmlu_clp", """with e as (select vec_id, label, list_transform(embedding[1:4], lambda v: v::double) as p, substr('ABCD', (vec_id % 4 + 1)::int, 1) as gold from embeddings), j as (select *, substr('ABCD', list_position(p, list_max(p))::int, 1) = gold as ok from e where p is not null and len(p) = 4),
  g as (select grouping(label) as g, label, sum(ok::int) as k, count(*) as n from j group by grouping sets ((), (label)))
  select case when g = 1 then 'score_mmmlu' else 'score_' || label end as metric, round(100.0 * k / n, 6) as value from g
  union all select 'score_' || label || '_x', round(100.0 * sum(ok::int) / count(*), 6) from j group by label union all select 'score_' || label || '_y', round(100.0 * sum(ok::int) / count(*), 6) from j group by label
  union all select 'score', round(100.0 * k / n, 6) from g where g = 1 union all select 'fails', ((select count(*) from e) - (select count(*) from j))::double""")
def task_mmmlu(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").withColumn("sample_id", F.col("vec_id"))
    samples = vectors.select("sample_id", _letter(F.col("vec_id")).alias("reference"), F.col("label").cast("string").alias("locale"), F.lit("x").alias("category"), F.lit("y").alias("subject"))
    names = F.array(*[F.lit(f" {x}") for x in "ABCD"])
    top = F.map_from_arrays(names, F.slice(F.col("embedding").cast("array<double>"), 1, 4))
    return _run("mmmlu_kshot_clp", samples, vectors.where("embedding is not null and size(embedding) >= 4").select("sample_id", F.lit(0).alias("idx"), top.alias("top")))


@query("task_simpleqa_verified", """with s as (select doc_id, case when text is null then 'C' else substr('ABC', (doc_id % 3 + 1)::int, 1) end as grade from documents), c as (select count(*) as n, sum((grade = 'A')::int) as a, sum((grade = 'B')::int) as b from s), r as (select 100.0 * a / n as right_, 100.0 * a / (a + b) as given, 100.0 * b / n as wrong, n, a, b from c)
  select unnest(['score', 'f1', 'accuracy_given_attempted', 'correct', 'incorrect', 'not_attempted', 'fails', 'n_unextracted']) as metric, unnest([round(2 * given * right_ / (given + right_), 6), round(2 * given * right_ / (given + right_), 6), round(given, 6), round(right_, 6), round(wrong, 6), round(100.0 * (n - a - b) / n, 6), (select count(*) from documents where text is null)::double, 0.0]) as value from r""")
def task_simpleqa(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    reply = F.concat(F.lit("Grade: "), F.substring(F.lit("ABC"), (F.col("doc_id") % 3 + 1).cast("int"), F.lit(1)))
    return _run("simpleqa_verified_0shot_gen", docs.select("sample_id", F.lit("x").alias("reference")), _once(docs.where("text is not null"), F.lit("an answer"), reply=reply))


@query("task_ruler", """with s as (select doc_id, 4096 * (1 + doc_id % 2) as length, case when doc_id % 3 = 0 then 'qa_squad' else 'vt' end as subtask, list_filter(['the', 'un', 'der'], lambda r: contains(lower(text), r)) as hit from documents where text is not null), c as (select length, subtask, round(avg(case when subtask = 'qa_squad' then (len(hit) > 0)::int * 100.0 else len(hit) / 3 * 100 end), 2) as cell from s group by 1, 2), l as (select length, avg(cell) as a from c group by 1)
  select 'score' as metric, round(avg(a), 6) as value from l union all select 'score_' || (length // 1024) || 'k', round(a, 6) from l union all select 'score_' || subtask || '_' || (length // 1024) || 'k', cell from c union all select 'fails', count(*) from documents where text is null""")
def task_ruler(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    outputs = F.array(*map(F.lit, ("the", "un", "der")))
    samples = docs.select("sample_id", F.lit("").alias("reference"), outputs.alias("outputs"), F.when(F.col("doc_id") % 3 == 0, "qa_squad").otherwise("vt").alias("subtask"), (4096 * (1 + F.col("doc_id") % 2)).alias("context_length"))
    return _run("ruler_0shot_gen", samples, _once(docs.where("text is not null"), F.col("text")))


@query("task_drop", """with s as (select doc_id, (n_chars % 5)::varchar || ' yards' as gold, (doc_id % 5)::varchar || ' yards' as said, text is not null as there from documents), j as (select *, said = gold as ok from s where there)
  select unnest(['score', 'em', 'f1', 'fails']) as metric, unnest([round(100.0 * sum(ok::int) / count(*), 6), round(100.0 * sum(ok::int) / count(*), 6), round(100.0 * sum(ok::int) / count(*), 6), (select count(*) from s where not there)::double]) as value from j""")
def task_drop(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    gold = F.concat((F.col("n_chars") % 5).cast("string"), F.lit(" yards|the "), (F.col("n_chars") % 5).cast("string"), F.lit(".0 Yards"))
    return _run("drop_kshot_gen", docs.select("sample_id", gold.alias("reference")), _once(docs.where("text is not null"), F.concat(F.lit("Well.\nAnswer: "), (F.col("doc_id") % 5).cast("string"), F.lit(" yards"))))


@query("task_gsm_plus", """with s as (select doc_id, source, case when source is null or source <> 'web' then false else true end as web, (n_chars % 7)::varchar as gold, (doc_id % 7)::varchar as said, text is not null as there from documents), j as (select *, coalesce(there and said = gold, false) as ok from s),
  c as (select 'score_' || regexp_replace(lower(coalesce(source, 'unknown')), '[^a-z0-9]+', '_', 'g') as metric, round(100.0 * sum(ok::int) / count(*), 6) as value from j group by source)
  select metric, value from c union all select unnest(['score', 'accuracy', 'score_wo_critical_thinking', 'fails', 'n_unextracted']), unnest([round(100.0 * sum(ok::int) / count(*), 6), round(100.0 * sum(ok::int) / count(*), 6), round(100.0 * sum(ok::int) / count(*), 6), sum((not there)::int)::double, 0.0]) from j""")
def task_gsm_plus(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    samples = docs.select("sample_id", (F.col("n_chars") % 7).cast("string").alias("reference"), F.col("source").alias("perturbation_type"))
    return _run("gsm_plus_0shot_gen", samples, _once(docs.where("text is not null"), F.concat(F.lit("so\n#### "), (F.col("doc_id") % 7).cast("string"), F.lit(".0"))))


@query("task_ugmathbench", """with v as (select doc_id, 1 + doc_id % 3 as version, doc_id // 3 as problem, (n_chars % 2)::varchar as gold, (doc_id % 2)::varchar as said, text is not null as there from documents), j as (select *, coalesce(there and said = gold, false) as ok from v),
  p as (select problem, count(*) as asked, sum(there::int) as n, sum(ok::int) as k from j group by 1), r as (select 100.0 * sum((k = 3 and n = 3)::int) / count(*) as eacc, 100.0 * sum(k) / sum(asked) as aacc, 100.0 * sum((k > 0)::int) / count(*) as cacc, count(*) as problems, sum(n) as judged, sum((n <> 3)::int) as short from p)
  select unnest(['score', 'eacc', 'aacc', 'cacc', 'delta', 'relative_delta', 'n_problems', 'n_versions_judged', 'incomplete_problems', 'eacc_all', 'fails', 'n_unextracted']) as metric,
         unnest([round(eacc, 6), round(eacc, 6), round(aacc, 6), round(cacc, 6), round(aacc - eacc, 6), round(coalesce((aacc - eacc) * 100 / nullif(eacc, 0), 0), 6), problems::double, judged::double, short::double, round(eacc, 6), (select count(*) from v where not there)::double, 0.0]) as value from r""")
def task_ugmathbench(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    gold = F.array((F.col("n_chars") % 2).cast("string"))
    samples = docs.select("sample_id", gold[0].alias("reference"), F.floor(F.col("doc_id") / 3).cast("string").alias("problem"), (1 + F.col("doc_id") % 3).alias("version"), F.lit("all").alias("subject"), gold.alias("golds"), F.array(F.lit("NV")).alias("kinds"), F.array(F.array().cast("array<string>")).alias("options"))
    return _run("ugmathbench_0shot_gen_fixed", samples, _once(docs.where("text is not null"), F.concat(F.lit("so \\boxed{"), (F.col("doc_id") % 2).cast("string"), F.lit(".0}"))))


@query("task_sysbench", """with t as (select conv_id as session, turn, 1 + (turn + conv_id) % 2 as satisfied, 2 as criteria from conversations where text is not null), o as (select session, turn, satisfied, criteria, satisfied = criteria as ok, row_number() over (partition by session order by turn) - 1 as place from t),
  k as (select session, min(case when not ok or turn <> place then place end) as bad, count(*) as n from o group by 1), c as (select conv_id as session, count(*) as declared from conversations group by 1), p as (select coalesce(bad, n) as prefix, greatest(declared, 1) as of_ from k join c using (session))
  select unnest(['score', 'csr', 'csr_macro', 'isr', 'n_grader_unparsed', 'ssr', 'isr_unknown']) as metric, unnest([round(100.0 * sum(satisfied) / sum(criteria), 6), round(100.0 * sum(satisfied) / sum(criteria), 6), round(100 * avg(satisfied / criteria), 6), round(100 * avg(ok::int), 6), 0.0, (select round(100 * avg(prefix / of_), 6) from p), round(100 * avg(ok::int), 6)]) as value from o
  union all select 'r_' || t, round(100.0 * sum((prefix >= t)::int) / count(*), 6) from p, range(1, (select max(of_) + 1 from p)) r(t) group by t""")
def task_sysbench(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").withColumn("sample_id", F.xxhash64("conv_id", "turn"))
    declared = turns.groupBy("conv_id").agg(F.count("*").cast("int").alias("n_turns"))
    samples = turns.join(declared, "conv_id").select("sample_id", F.lit("").alias("reference"), F.col("conv_id").alias("session"), (F.col("turn") + 1).alias("turn"), "n_turns", F.lit("").alias("alignment"), F.array(F.lit("1"), F.lit("2")).alias("ids"))
    reply = F.concat(F.lit('评判结果: {"1": "是", "2": "'), F.when((F.col("turn") + F.col("conv_id")) % 2 == 1, "是").otherwise("否"), F.lit('"}'))
    return _run("sysbench_0shot_gen", samples, _once(turns.where("text is not null"), F.col("text"), reply=reply))


@query("task_human_eval", """with r as (select l_orderkey as id, count(*) as n, sum((l_quantity > 25)::int) as c, sum((l_quantity > 48)::int) as late from lineitem group by 1), p as (select *, case when n < 2 or c <= 0 then 0.0 when c >= n then 1.0 else 1 - ((n - c) * (n - c - 1)) / (n * (n - 1)) end as any2, case when n < 2 or c < 2 then 0.0 else (c * (c - 1)) / (n * (n - 1)) end as all2 from r)
  select unnest(['pass@1', 'score', 'fails', 'n_unextracted', 'pass@2', 'pass^2', 'avg@n', 'n_short', 'n_timeouts']) as metric, unnest([round(100 * avg(c / n), 6), round(100 * avg(c / n), 6), 0.0, 0.0, round(100 * avg(any2), 6), round(100 * avg(all2), 6), round(100 * avg(c / n), 6), sum((n < 4)::int)::double, (select count(*) from lineitem where l_quantity <= 25 and l_quantity < 2)::double]) as value from p""")
def task_human_eval(spark: SparkSession, d: str) -> DataFrame:
    from tallywright.sources.tables import rollouts

    lines = table(spark, d, "lineitem")
    rows = rollouts(lines.withColumn("l_tax", F.col("l_quantity")))
    outcome = F.when(F.col("correct"), "passed").when(F.col("tax") < 2, "timeout").otherwise("failed")
    return _run("human_eval_0shot_gen", rows.select("sample_id").distinct().withColumn("reference", F.lit("")), rows.select("sample_id", "idx", F.lit("def f(): pass").alias("text"), outcome.alias("outcome")), 4, 2)


@query("task_complex_constraints", """with s as (select doc_id, 1 + doc_id % 4 as criteria, text is not null as there from documents), u as (select *, case when there then least(1 + n, criteria) else 0 end as satisfied from (select s.*, (doc_id % 3) as n from s))
  select unnest(['score', 'task_pass_rate', 'criterion_pass_rate_macro', 'criterion_pass_rate_micro', 'n_grader_unparsed', 'fails', 'n_unextracted']) as metric, unnest([round(100.0 * sum((satisfied = criteria)::int) / count(*), 6), round(100.0 * sum((satisfied = criteria)::int) / count(*), 6), round(100 * avg(satisfied / criteria), 6), round(100.0 * sum(satisfied) / sum(criteria), 6), sum(case when there then criteria - satisfied else 0 end)::double, sum((not there)::int)::double, 0.0]) as value from u""")
def task_complex_constraints(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    samples = docs.select("sample_id", F.lit("").alias("reference"), (1 + F.col("doc_id") % 4).cast("int").alias("n_criteria"))
    passed = F.transform(F.sequence(F.lit(1), (1 + F.col("doc_id") % 3).cast("int")), lambda i: F.concat(i.cast("string"), F.lit(": PASS")))
    return _run("complex_constraints_0shot_gen", samples, _once(docs.where("text is not null"), F.lit("x"), reply=F.array_join(passed, "\n")))


# loaders


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").where("text is not null")


def _csv(df: DataFrame, path: str) -> None:
    df.write.options(header=True, escape='"', quoteAll=True, emptyValue="").csv(path)


def _loads(key: str, sql: str, write: Callable[[DataFrame, str], None], show: Callable[[DataFrame], DataFrame], name: str) -> None:
    @query(key, sql)
    def loaded(spark: SparkSession, d: str) -> DataFrame:
        folder = _folder(spark)
        write(_items(spark, d), folder)
        return show(benchmarks.LOADERS[name](spark, folder).test)


_loads("load_competition", r"select regexp_replace(text, '^\s+|\s+$', '', 'g') as problem, item_id::varchar as answer from benchmark where text is not null", lambda df, f: df.select(F.concat(F.lit(" "), "text", F.lit("\n")).alias("problem"), F.col("item_id").alias("answer")).write.parquet(f"{f}/train.parquet"), lambda t: t.select("problem", "answer"), "smt_2025")
_loads(
    "load_arc", "select text as question, (item_id % 3)::int as answer, len(text) as size from benchmark where text is not null",
    lambda df, f: df.select(F.col("text").alias("question"), F.struct(F.array("text", F.lit("b"), F.lit("c")).alias("text"), F.array(*map(F.lit, "123")).alias("label")).alias("choices"), (F.col("item_id") % 3 + 1).cast("string").alias("answerKey")).write.parquet(f"{f}/ARC-Easy/test.parquet"),
    lambda t: t.select("question", "answer", F.length(F.get("choices", F.lit(0))).cast("long").alias("size")), "arc_easy",
)
_loads(
    "load_ugmathbench", "select item_id::varchar as id, v::int as version, text || v as problem, v::varchar as answer from benchmark cross join range(1, 4) r(v) where text is not null",
    lambda df, f: df.select(F.col("item_id").cast("string").alias("id"), *[F.lit("s").alias(c) for c in ("subject", "topic", "subtopic", "level")], F.array(F.lit("k")).alias("keywords"), *[x for v in (1, 2, 3) for x in (F.concat("text", F.lit(str(v))).alias(f"problem_v{v}"), F.array(F.lit(str(v))).alias(f"answer_v{v}"), F.array(F.lit("NV")).alias(f"answer_type_v{v}"), F.array(F.array(F.lit("a"))).alias(f"options_v{v}"))]).write.parquet(f"{f}/algebra/test.parquet"),
    lambda t: t.select("id", "version", "problem", F.array_join("answer", ",").alias("answer")), "ugmathbench",
)
_loads(
    "load_complex_constraints", "select text as prompt, item_id % 3 as n from benchmark where text is not null",
    lambda df, f: _csv(df.select(F.col("text").alias("prompt"), *[F.when(F.col("item_id") % 3 >= i, F.lit(f" c{i} ")).otherwise(F.lit(" ")).alias(f"criterion_{i}") for i in range(1, 41)]), f"{f}/ComplexConstraints_benchmark_set.csv"),
    lambda t: t.select("prompt", F.size("criteria").cast("long").alias("n")), "complex_constraints",
)
_loads(
    "load_multi_if", "select item_id::varchar as key, text as first, 1 + item_id % 3 as turns from benchmark where text is not null",
    lambda df, f: _csv(df.select(F.col("item_id").alias("key"), F.lit("English").alias("language"), *[x for i in (1, 2, 3) for x in (F.when(F.col("item_id") % 3 >= i - 1, F.to_json(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))).otherwise("None").alias(f"turn_{i}_prompt"), F.lit('["punctuation:no_comma"]').alias(f"turn_{i}_instruction_id_list"), F.lit('["{}"]').alias(f"turn_{i}_kwargs"))]), f"{f}/multiIF_20241018.csv"),
    lambda t: t.select("key", F.get("turns", F.lit(0))["prompt"].alias("first"), F.size("turns").cast("long").alias("turns")), "multi_if",
)
_loads(
    "load_platinum", "select text as prompt, 'gsm8k' as subset from benchmark where text is not null and item_id % 4 <> 0",
    lambda df, f: df.select(F.when(F.col("item_id") % 4 == 0, "rejected").otherwise("verified").alias("cleaning_status"), F.col("text").alias("platinum_prompt"), *[F.array(F.lit("1")).alias(c) for c in ("original_target", "platinum_target")], *[F.lit("x").alias(c) for c in ("platinum_parsing_strategy", "platinum_prompt_no_cot")]).write.parquet(f"{f}/gsm8k/test.parquet"),
    lambda t: t.select(F.col("platinum_prompt").alias("prompt"), "subset"), "platinum_bench",
)


def _write_drop(df: DataFrame, folder: str) -> None:
    for split in ("train", "dev"):
        df.select(F.col("text").alias("context"), F.col("item_id").alias("completion")).write.option("compression", "gzip").json(f"{folder}/drop_v0_{split}.jsonl.gz")


_loads("load_drop", "select text as context, item_id::varchar as completion, '' as ref_text from benchmark where text is not null", _write_drop, lambda t: t.select("context", "completion", "ref_text"), "drop")
_loads(
    "load_mmmlu", "select text as question, substr('ABCD', (item_id % 4 + 1)::int, 1) as answer, case when item_id % 2 = 0 then 'stem' else 'other' end as category, 'de_de' as locale from benchmark where text is not null",
    lambda df, f: _csv(df.select(F.col("text").alias("Question"), *[F.lit(x).alias(x) for x in "ABCD"], (F.col("item_id") % 4).alias("Answer"), F.when(F.col("item_id") % 2 == 0, "anatomy_test.csv").otherwise("marketing_test-x").alias("Subject")), f"{f}/test/mmlu_DE-DE.csv"),
    lambda t: t.select(F.col("Question").alias("question"), F.col("Answer").alias("answer"), F.col("Category").alias("category"), F.col("Locale").alias("locale")), "mmmlu",
)

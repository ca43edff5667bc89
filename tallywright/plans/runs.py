"""Stage logs, anomalies, profiles, leaderboards and streams, over events, orders and rollouts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.operators import generators, haystacks, runlog
from tallywright.operators.evaluation import Task, replayed
from tallywright.plans.catalogue import ROLLOUTS, query
from tallywright.session import shared_folder
from tallywright.sources.tables import rollouts, table
from tallywright.streaming import stages

# How the fixture reads kinds of events as stages.
AS_STAGE = {"view": "initial", "click": "preprocessed", "signup": "inferred", "error": "failed", "purchase": "final"}
LOG = """log as (select user_id as sample_id, (json_extract_string(props, '$.k')::int % 3) as iteration, event_id as seq, case event_type when 'view' then 'initial' when 'click' then 'preprocessed' when 'signup' then 'inferred' when 'error' then 'failed' else 'final' end as stage,
  case event_type when 'view' then 0 when 'click' then 1 when 'signup' then 2 when 'error' then 5 else 6 end as rank, json_extract_string(props, '$.k')::int as k from events)"""


def _log(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    stage = F.create_map(*[F.lit(x) for p in AS_STAGE.items() for x in p])[F.col("event_type")]
    return table(spark, d, "events").select(F.col("user_id").alias("sample_id"), (k % 3).alias("iteration"), F.col("event_id").alias("seq"), stage.alias("stage"), k.alias("k"))


@query("stage_log_latest", f"with {LOG}, r as (select *, row_number() over (partition by sample_id order by iteration desc, rank desc, seq desc) as r from log) select sample_id, iteration, seq, stage from r where r = 1")
def stage_log_latest(spark: SparkSession, d: str) -> DataFrame:
    return runlog.compacted(_log(spark, d)).select("sample_id", "iteration", "seq", "stage")


@query("pending_ids", "select o_orderkey as sample_id from orders where o_orderkey not in (select user_id from events)")
def pending_ids(spark: SparkSession, d: str) -> DataFrame:
    return runlog.pending(table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id")), _log(spark, d))


@query("retry_rollback", f"""with {LOG}, s as (select seq, k % 4 as tries, case when stage = 'failed' then ['preprocess', 'infer', 'postprocess', null, 'finalize'][k % 5 + 1] end as act, case when stage = 'failed' and k % 7 = 0 then 'iteration_limit' when stage = 'failed' then 'exception::E' end as why, stage from log),
  a as (select *, stage = 'failed' and act is not null and why <> 'iteration_limit' as again from s)
  select seq, case when again and tries + 1 <= 3 then case act when 'preprocess' then 'initial' when 'infer' then 'preprocessed' when 'postprocess' then 'inferred' else 'feedback' end else stage end as stage,
         tries + coalesce(again, false)::int as retry_count, case when again and tries + 1 > 3 then 'retry_limit' when again then null else why end as error_reason from a""")
def retry_rollback(spark: SparkSession, d: str) -> DataFrame:
    log, failed = _log(spark, d), F.col("stage") == "failed"
    actions = F.array(*map(F.lit, ("preprocess", "infer", "postprocess", None, "finalize")))
    state = log.select("seq", "stage", (F.col("k") % 4).alias("retry_count"), F.when(failed, F.get(actions, F.col("k") % 5)).alias("error_action"), F.when(failed & (F.col("k") % 7 == 0), "iteration_limit").when(failed, "exception::E").alias("error_reason"))
    return runlog.rolled_back(state, 3).select("seq", "stage", "retry_count", "error_reason")


@query("iteration_bound", f"""with {LOG}, s as (select seq, iteration, case when k % 2 = 0 then 'feedback' else stage end as stage, k % 4 = 0 as fin from log), a as (select *, stage = 'feedback' and not fin as todo, iteration + 1 >= 3 as over from s)
  select seq, case when todo and over then 'failed' when todo then 'initial' when stage = 'feedback' then 'final' else stage end as stage, iteration + (todo and not over)::int as iteration, case when todo and over then 'iteration_limit' end as error_reason from a""")
def iteration_bound(spark: SparkSession, d: str) -> DataFrame:
    state = _log(spark, d).select("seq", "iteration", F.when(F.col("k") % 2 == 0, "feedback").otherwise(F.col("stage")).alias("stage"), (F.col("k") % 4 == 0).alias("finalize"), F.lit(None).cast("string").alias("error_reason"))
    return runlog.iterated(state, 3).select("seq", "stage", "iteration", "error_reason")


@query("anomaly_counts", f"""with {ROLLOUTS}, h as (select sample_id, 'extraction_failure' as rule from rollouts where not extracted union all select sample_id, 'truncated_output' from rollouts where tax > 0.07 union all select sample_id, 'empty_infer' from rollouts where idx > 6 union all select sample_id, 'empty_postprocess' from rollouts where answer is null or trim(answer) = '')
  select r.rule, count(distinct sample_id) as n_samples, count(sample_id) as n_rollouts from (values ('extraction_failure'), ('truncated_output'), ('empty_infer'), ('empty_postprocess')) r(rule) left join h using (rule) group by 1""")
def anomaly_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = rollouts(table(spark, d, "lineitem")).select("sample_id", "idx", "extracted", F.when(F.col("tax") > 0.07, "length").otherwise("stop").alias("finish_reason"), F.when(F.col("idx") <= 6, "some text").alias("text"), F.col("answer").alias("prediction"))
    return runlog.anomalies(rows, runlog.rules())


@query("truncation_pair", f"with {LOG}, e as (select sample_id, k, bool_or(stage = 'failed') as cut from log group by 1, 2) select count(*) filter (cut) as truncated, count(*) as scored from e")
def truncation_pair(spark: SparkSession, d: str) -> DataFrame:
    return runlog.truncation(_log(spark, d).select("sample_id", F.col("k").alias("idx"), F.when(F.col("stage") == "failed", "length").otherwise("stop").alias("finish_reason")))


@query("profile_percentiles", """with s as (select event_type as stage, list_sort(list(value)) as x, count(*) as n, round(sum(value), 4) as total, round(avg(value), 6) as mean, min(value) as least, max(value) as most from events group by 1)
  select stage, n, total, mean, least, most, x[least(floor(0.5 * n), n - 1)::int + 1] as p50, x[least(floor(0.9 * n), n - 1)::int + 1] as p90, x[least(floor(0.95 * n), n - 1)::int + 1] as p95, x[least(floor(0.99 * n), n - 1)::int + 1] as p99 from (select s.stage, s.x, s.n, s.total, s.mean, s.least as least_, s.most, s.least from s)""".replace("least, most, x[least(", "least, most, x[least(").replace(", s.least as least_", ""))
def profile_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return runlog.nearest_rank(table(spark, d, "events").select(F.col("event_type").alias("stage"), "value"), "stage", "value")


@query("token_buckets", "select (n_chars >= 256)::int + (n_chars >= 1024)::int + (n_chars >= 4096)::int + (n_chars >= 16384)::int as bucket, count(*) as n, min(n_chars) as least, max(n_chars) as most from documents group by 1")
def token_buckets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(runlog.token_buckets(F.col("n_chars")).alias("bucket")).agg(F.count("*").alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


RUNS = "runs as (select o_custkey as model, o_orderpriority as task, strftime(o_orderdate, '%Y%m%d') || '-' || lpad(o_orderkey::varchar, 12, '0') as run_id, o_totalprice as score from orders)"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    run = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("-"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
    return table(spark, d, "orders").select(F.col("o_custkey").alias("model"), F.col("o_orderpriority").alias("task"), run.alias("run_id"), F.col("o_totalprice").alias("score"))


@query("leaderboard_latest", f"with {RUNS} select model, task, max(run_id) as run_id, arg_max(score, run_id) as score from runs group by 1, 2")
def leaderboard_latest(spark: SparkSession, d: str) -> DataFrame:
    return runlog.latest_runs(_runs(spark, d), "model", "task").select("model", "task", "run_id", "score")


TASKS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("leaderboard_pivot", f"with {RUNS}, l as (select model, task, arg_max(score, run_id) as score from runs group by 1, 2) select model, " + ", ".join(f"max(score) filter (task = '{x}') as \"{x}\"" for x in TASKS) + " from l group by 1")
def leaderboard_pivot(spark: SparkSession, d: str) -> DataFrame:
    return runlog.leaderboard(_runs(spark, d), "model", "task", "score", TASKS)


@query("annotation", f"with {RUNS}, l as (select model, arg_max(score, run_id) as observed from runs where task = '1-URGENT' group by 1) select model, observed, c_acctbal as reference, round(observed - c_acctbal, 6) as diff, abs(round(observed - c_acctbal, 6)) <= 100000 + 1e-9 * 100000 as within from l left join customer on c_custkey = model")
def annotation(spark: SparkSession, d: str) -> DataFrame:
    cells = runlog.latest_runs(_runs(spark, d).where(F.col("task") == "1-URGENT"), "model").select("model", F.col("score").alias("observed"))
    references = table(spark, d, "customer").select(F.col("c_custkey").alias("model"), F.col("c_acctbal").alias("reference"))
    return runlog.annotated(cells, references, ["model"], 100000.0)


@query("args_f1", """with a as (select event_id, json_extract_string(props, '$.k')::int % 4 + 1 as p, json_extract_string(props, '$.k')::int % 3 + 1 as g from events), c as (select event_id, least(p, g) as k, p, g from a) select event_id, round(2 * (k / p) * (k / g) / (k / p + k / g), 6) as f1 from c""")
def args_f1(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, d, "events").select("event_id", F.sequence(F.lit(1), k % 4 + 1).alias("p"), F.sequence(F.lit(1), k % 3 + 1).alias("g"))
    common = F.size(F.array_intersect("p", "g"))
    precision, recall = common / F.size("p"), common / F.size("g")
    return rows.select("event_id", F.round(2 * precision * recall / (precision + recall), 6).alias("f1"))


@query("replay_evaluation", """with s as (select doc_id as sample_id, 'Answer: ' || chr(65 + (doc_id % 4)::int) as reply, chr(65 + (n_chars % 4)::int) as reference, text is not null and trim(text) <> '' as there from documents), j as (select sample_id, regexp_extract(reply, 'Answer: ([A-D])', 1) = reference as correct from s where there)
  select round(sum(correct::int) * 100 / (select count(*) from s), 6) as accuracy, (select count(*) from s) as requested, count(*) as judged from j""")
def replay_evaluation(spark: SparkSession, d: str) -> DataFrame:
    letter = lambda c: F.chr(F.lit(65) + c % 4)
    docs = table(spark, d, "documents")
    samples = docs.select(F.col("doc_id").alias("sample_id"), letter(F.col("n_chars")).alias("reference"))
    recorded = docs.where("text is not null and trim(text) <> ''").select(F.col("doc_id").alias("sample_id"), F.array(F.concat(F.lit("Answer: "), letter(F.col("doc_id")))).alias("texts"))  # documents without a text have no record
    task = Task(prompt=F.concat(F.lit("Question "), F.col("sample_id").cast("string")), extract=lambda t: F.regexp_extract(t, "Answer: ([A-D])", 1), grade=lambda a, r: a == r)
    answers = replayed(task.prompts(samples), recorded)
    return task.report(samples, answers).select(F.col("pass_at_1").alias("accuracy"), "requested", "judged")


@query("event_windows", "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return stages.tumbling(table(spark, d, "events"))


@query("event_sessions", """with e as (select user_id, ts, ts - lag(ts) over (partition by user_id order by ts) >= interval '30 minutes' as gap from events), g as (select user_id, ts, sum(coalesce(gap, false)::int) over (partition by user_id order by ts rows unbounded preceding) as g from e)
  select user_id, min(ts) as start, max(ts) + interval '30 minutes' as "end", count(*) as n from g group by user_id, g""")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return stages.sessions(table(spark, d, "events"))


@query("stream_windows", "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """The windows again, by Structured Streaming; state and results are in the cluster's shared folder."""
    events = table(spark, d, "events")
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema)
    return stages.ended(spark, f"{d}/events.parquet*", schema, stages.tumbling, f"{base}/out", f"{base}/state")


#: A draw and a name in SQL.
DRAWN = "('0x' || substr(md5({x}), 1, 8))::ubigint"
NAME = "translate(substr(md5('0:' || id || ':' || chain || ':' || {hop}), 1, 5), '0123456789abcdef', 'ABCDEFGHIJKLMNOP')"


def _flat(df: DataFrame, column: str) -> DataFrame:
    """The array as one text, so that every reader of results takes it for the same."""
    return df.withColumn(column, F.array_join(F.col(column).cast("array<string>"), ","))


@query("needle_samples", f"""with s as (select id, range(0, 4) as ks from range(100) r(id)), n as (select id, list_transform(ks, lambda i: {{'depth': {DRAWN.format(x="'0:' || id || ':' || i")} % 201, 'key': 'key-' || ({DRAWN.format(x="'0:' || id || ':' || i")} % 90000 + 10000), 'value': ({DRAWN.format(x="'1:' || id || ':' || i")} % 9000000 + 1000000)::varchar}}) as needles from s)
  select id as sample_id, array_to_string(flatten(list_transform(range(0, 201), lambda d: list_transform(list_filter(needles, lambda x: x.depth = d), lambda x: 'One of the special magic numbers for ' || x.key || ' is: ' || x.value || '.') || case when d < 200 then ['The grass is green. The sky is blue. The sun is yellow. Here we go. There and back again.'] else [] end)), chr(10))
    || chr(10) || 'What are the special magic numbers for ' || needles[1].key || ' mentioned in the provided text?' as input, needles[1].value as outputs from n""")
def needle_samples(spark: SparkSession, d: str) -> DataFrame:
    return _flat(generators.needles(spark, 100, 200), "outputs")


@query("chain_samples", f"""with e as (select id, chain, hop from range(100) r(id), range(2) c(chain), range(5) h(hop)), d as (select *, {NAME.format(hop='hop')} as name, {NAME.format(hop='(hop - 1)')} as was, ({DRAWN.format(x="'0:' || id || ':' || chain")} % 90000 + 10000)::varchar as value, md5('0:' || id || ':' || chain || ':' || hop) as code from e),
  l as (select *, case when hop = 0 then 'VAR ' || name || ' = ' || value else 'VAR ' || name || ' = VAR ' || was end as line, list_sort(list(code) over (partition by id, chain))[hop + 1] as spot from d)
  select id as sample_id, string_agg(line, chr(10) order by spot, line) as input, string_agg(name, ',' order by hop) filter (chain = 0) as outputs from l group by id""")
def chain_samples(spark: SparkSession, d: str) -> DataFrame:
    return _flat(generators.chains(spark, 100), "outputs")


@query("common_word_samples", f"""with v as (select word, row_number() over (order by md5('0:' || word), word) - 1 as position from (select distinct unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from benchmark)), t as (select count(*) as total, least(count(*), 50) as n from v),
  f as (select id, list_reduce([[]::bigint[]] || list_transform(range(0, n), lambda i: [i]::bigint[]), lambda taken, x: list_append(taken, case when list_contains(taken, ({DRAWN.format(x="'0:' || id || ':' || x[1]")} % (total - n + x[1] + 1))::bigint) then total - n + x[1] else ({DRAWN.format(x="'0:' || id || ':' || x[1]")} % (total - n + x[1] + 1))::bigint end)) as places from range(20) r(id), t),
  c as (select id, word, row_number() over (partition by id order by md5('0:' || id || ':' || word), word) as rank from (select id, unnest(places) as position from f) join v using (position)),
  k as (select id, word, rank, copy, md5('0:' || id || ':' || word || ':' || copy) as spot from c, range(1, 31) s(copy) where copy <= case when rank <= 10 then 30 else 3 end), p as (select *, row_number() over (partition by id order by spot, word) as place from k)
  select id as sample_id, string_agg(place || '. ' || word, ' ' order by place) as input, array_to_string(list_sort(list(distinct word) filter (rank <= 10)), ',') as outputs from p group by id""")
def common_word_samples(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"))).alias("word"))
    return _flat(generators.common_words(words, 20), "outputs")


@query("frequent_word_samples", """with e as (select id, r, case when r = 0 then '...' else translate(substr(md5('0:' || id || ':' || r), 1, 6), '0123456789abcdef', 'bcdfghjklmnpqrst') end as word, floor((600 / (select sum(1 / power(x + 1, 2.0)) from range(50) t(x))) / power(r + 1, 2.0))::int as k from range(50) s(id), range(50) v(r)),
  c as (select id, r, word, copy, md5('0:' || id || ':' || r || ':' || copy) as spot from e, range(1, 1000) t(copy) where k > 0 and copy <= k) select id as sample_id, string_agg(word, ' ' order by spot, word) as input, (select string_agg(x.word, ',' order by x.r) from e x where x.id = c.id and x.r between 1 and 3 and x.k > 0) as outputs from c group by id""")
def frequent_word_samples(spark: SparkSession, d: str) -> DataFrame:
    return _flat(generators.frequent_words(spark, 50), "outputs")


@query("qa_samples", f"""with pool as (select doc_id, row_number() over (order by md5('0:' || doc_id), doc_id) - 1 as position from (select distinct doc_id from documents)), t as (select count(*) as total from pool), q as (select doc_id as id from labels where quality = 1),
  f as (select q.id, turn, pool.doc_id from q, t, range(5) r(turn), pool where pool.position = ({DRAWN.format(x="'2:' || q.id")} % total + turn) % total), o as (select id, list(doc_id order by turn) filter (doc_id <> id) as others from f group by id)
  select id as sample_id, id as gold, array_to_string(list_transform(list_sort(list_transform([id] || others[1:4], lambda d: {{'code': md5('0:' || id || ':' || d), 'd': d}})), lambda x: x.d), ',') as context from o""")
def qa_samples(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id")
    questions = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("sample_id"), F.col("doc_id").alias("gold"))
    return _flat(generators.with_distractors(questions, docs, 4), "context")


#: Tokens of a text in SQL; what a needle's sample says around its haystack, by key and value.
TOKENS = r"len(regexp_extract_all({x}, '[\p{{L}}\p{{M}}]+|\p{{N}}|[^\s\p{{L}}\p{{M}}\p{{N}}]'))"
AROUND = """('A special magic number is hidden within the following text. Make sure to memorize it. I will quiz you about the number afterwards. One of the special magic numbers for ' || key || ' is: ' || value
    || '. What is the special magic number for ' || key || ' mentioned in the provided text? The special magic number for ' || key || ' mentioned in the provided text is')"""


@query("haystack_budgets", rf"""with k as (select doc_id, text, translate(md5('0:' || doc_id || ':key:0'), '0123456789abcdef', 'bcdfghjklmnpqrst') as code, ({DRAWN.format(x="'0:' || doc_id || ':value:0:0'")} % 9000000 + 1000000)::varchar as value from documents),
  b as (select doc_id, value, coalesce(text, '') as text, substr(code, 1, 6) || '-' || substr(code, 7, 6) as key from k),
  f as (select doc_id, value, text, {TOKENS.format(x=AROUND)} as fixed from b),
  w as (select doc_id, i, {TOKENS.format(x='word')} as c from (select doc_id, unnest(s) as word, generate_subscripts(s, 1) as i from (select doc_id, regexp_extract_all(text, '\S+') as s from f))),
  p as (select doc_id, sum(c) over (partition by doc_id order by i) as upto, sum(c) over (partition by doc_id) as total, count(*) over (partition by doc_id) as n from w where c > 0),
  t as (select f.doc_id, any_value(value) as value, any_value(fixed) as fixed, greatest(512 - 128 - any_value(fixed), 0) as room, any_value(total)::bigint as total, any_value(n) as n, list(upto::bigint order by upto) as steps from f left join p using (doc_id) group by 1),
  r as (select *, len(list_filter(steps, lambda x: x <= room % total)) as more from t)
  select doc_id as sample_id, (case when total is null then 0 else (room // total) * n + more end)::int as n_items, (128 + fixed + case when total is null then 0 else (room // total) * total + coalesce(steps[more], 0) end)::int as length, value as outputs from r""")
def haystack_budgets(spark: SparkSession, d: str) -> DataFrame:
    """A needle in every document: its words, repeated if need be, fill 512 tokens."""
    samples = table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), F.regexp_extract_all("text", F.lit(r"(\S+)")).alias("haystack"))
    return _flat(haystacks.needle_samples(samples, haystacks.SUBTASKS["niah_single_2"], 512), "outputs").select("sample_id", "n_items", "length", "outputs")

"""The numbered queries and the pipeline over the driver's tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from tallywright.llm import attention_quality, bpe, curriculum, exact_dedup, fingerprints, hard_negatives, langid, licenses, sharding, simhash, token_files, vector_codes, vector_graph
from tallywright.llm.common import documents, fresh_path, held_out


def op1_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_tokens(documents(spark, sf_dir), fresh_path(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_tokens(spark, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_label_propagation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.balanced_shards(documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.round_trip(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "bpe.*")
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = attention_quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = attention_quality.scored(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_block_naming_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op6_simhash_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op7_word_backoff_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.identify(docs.select("doc_id", "text"), langid.learn(docs)).select("doc_id", held_out().alias("held_out"), "langid.*")


def op8_pruned_graph_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_graph.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = curriculum.plan(documents(spark, sf_dir))
    first = F.get("positions", F.lit(0))
    return curriculum.in_order(plan, first).select("doc_id", "size", "source_size", "target", "taken", F.round(first, 6).alias("position"))


def op10_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents(spark, sf_dir).select("doc_id", licenses.scan(F.col("text")).alias("found")).select("doc_id", "found.*")
    base = F.filter("detections", lambda d: d["base"])

    def labels(of: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda d: d["label"]))), ",")

    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(F.transform(base, lambda d: d["first"])).alias("first_word"), F.array_max(F.transform(base, lambda d: d["first"])).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("detections")).alias("labels"), F.coalesce(F.array_max(F.transform("detections", lambda d: d["priority"] / 100)), F.lit(0.0)).alias("score"),
    )


def op11_ball_kmeans_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    code = F.lower(F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    return vector_codes.label_errors(coded).select("vec_id", code.alias("code"), "error", "label_error", F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"))


def op12_bottom_k_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(documents(spark, sf_dir))


def op13_kronecker_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives.hard_negatives(vectors, lambda vec_id: vec_id % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_frames": op1_token_frames,
    "op2_label_propagation_shards": op2_label_propagation_shards,
    "op3_segment_tree_bpe": op3_segment_tree_bpe,
    "op4_attention_quality": op4_attention_quality,
    "op5_block_naming_dedup": op5_block_naming_dedup,
    "op6_simhash_pigeonhole": op6_simhash_pigeonhole,
    "op7_word_backoff_langid": op7_word_backoff_langid,
    "op8_pruned_graph_vectors": op8_pruned_graph_vectors,
    "op9_curriculum_mix": op9_curriculum_mix,
    "op10_license_rules": op10_license_rules,
    "op11_ball_kmeans_codes": op11_ball_kmeans_codes,
    "op12_bottom_k_fingerprints": op12_bottom_k_fingerprints,
    "op13_kronecker_negatives": op13_kronecker_negatives,
    "pipeline": corpus_pipeline.run,
}


def _codes_sql() -> str:
    """The rounds of op11 one below the other, each comparing every part with every entry."""
    assign = """
        a{r} as materialized (
          select vec_id, part, min(struct_pack(d := list_sum(list_transform(list_zip(x, y), lambda t: (t[1] - t[2]) * (t[1] - t[2]))), e := entry)) as best
          from p join c{r} using (part) group by vec_id, part)"""
    move = """,
        m{r} as (
          select part, entry, list(cast(floor(s / n) as bigint) order by k) as z from (
            select part, a.best.e as entry, k, cast(sum(x[k]) as double) as s, count(*) as n
            from a{r} a join p using (vec_id, part), range(1, 17) as ks(k) group by all) group by part, entry),
        c{n} as materialized (select part, entry, coalesce(z, y) as y from c{r} left join m{r} using (part, entry)),"""
    rounds = "".join(assign.format(r=r) + move.format(r=r, n=r + 1) for r in range(4)) + assign.format(r=4)
    return f"""
        with k as materialized (
          select vec_id, label, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings
          where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        p as materialized (select vec_id, part, list_slice(v, part * 16 + 1, part * 16 + 16) as x from k, range(4) as ps(part)),
        seeds as (select vec_id, row_number() over (order by vec_id) - 1 as entry from k),
        c0 as materialized (select part, entry, x as y from p join seeds using (vec_id) where entry < 256),{rounds},
        e as (select vec_id, string_agg(lower(printf('%02x', best.e)), '' order by part) as code, cast(sum(best.d) as bigint) as error from a4 group by vec_id),
        h as (select sha256(string_agg(array_to_string(y, ','), ',' order by part, entry)) as codebooks_sha256 from c4)
        select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from e join k using (vec_id), h"""

ORACLE: dict[str, str] = {
    "op5_block_naming_dedup": """
        with d as (select doc_id, coalesce(text, '') as t from documents)
        select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
               doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256 from d""",
    "op9_curriculum_mix": r"""
        with recursive d as (
          select doc_id, source, md5(cast(doc_id as varchar)) as code,
                 coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size from documents),
        s as (select source, cast(sum(size) as bigint) as source_size,
                     1 + (row_number() over (order by source nulls last) - 1) % 3 as weight from d group by source),
        t as (select *, 3 * source_size as cap, sum(source_size) over () as total from s),
        l as (select *, (total - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
                        / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level from t),
        f as (select *, max(case when cap >= level * weight then level end) over () as free from l),
        g as (select source, source_size, weight, coalesce(least(cast(cap as double), free * weight), cap) as target from f),
        p as (select d.doc_id, d.size, g.source_size, g.weight, g.target,
                     coalesce(sum(d.size) over (partition by d.source order by code, d.doc_id rows between unbounded preceding and 1 preceding), 0) as before
              from d join g on d.source is not distinct from g.source)
        select doc_id, size, source_size, target,
               cast(size * ((before + size / 2 < target)::int + (before + size / 2 + source_size < target)::int
                            + (before + size / 2 + 2 * source_size < target)::int) as bigint) as taken,
               case when before + size / 2 < target then round(case weight
                 when 1 then 2 * ((before + size / 2) / target) / (1.5 + sqrt(2.25 - 2 * ((before + size / 2) / target)))
                 when 2 then (before + size / 2) / target
                 else case when (before + size / 2) / target < 0.4375 / 1.0625
                   then 2 * 1.0625 * ((before + size / 2) / target) / (0.5 + sqrt(0.25 + 3 * 1.0625 * ((before + size / 2) / target)))
                   else 0.5 + (((before + size / 2) / target) * 1.0625 - 0.4375) / 1.25 end end, 6) end as position from p""",
    "op11_ball_kmeans_codes": _codes_sql(),
    "op13_kronecker_negatives": """
        with v as materialized (
          select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                 list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
          where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as materialized (
          select a.vec_id as anchor_id, a.label as anchor_label, o.vec_id, o.label, cast(list_inner_product(a.v, o.v) as bigint) as score
          from v a, v o where a.vec_id % 100 = 0 and a.vec_id <> o.vec_id),
        p as (
          select anchor_id, vec_id as positive_id, score as positive_score from s where label = anchor_label
          qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
        select anchor_id, positive_id, cast(row_number() over w as integer) as rank, vec_id as negative_id, positive_score, score as negative_score
        from p join s using (anchor_id) where label <> anchor_label and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
        window w as (partition by anchor_id, positive_id order by score desc, vec_id) qualify row_number() over w <= 10""",
}

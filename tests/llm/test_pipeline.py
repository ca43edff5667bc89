"""The pipeline against a plain version of what its stages decide, and on tables of odd rows and of none."""

from collections import Counter

import corpus_pipeline
from tests.llm.test_operators import DOCS, odd_rows, smallest


def shingles(text):
    tokens = (text or "").encode().lower().split()
    return {b" ".join(tokens[i : i + 5]) for i in range(max(1, len(tokens) - 4))} if tokens else set()


def test_each_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language_id"](spark, docs, sf_dir)
    assert kept.columns == docs.columns
    kept = {r.doc_id: r.text for r in kept.collect()}
    assert set(kept) <= set(rows) and len(kept) > 0.9 * sum(any(c.isalpha() for c in r.text or "") for r in rows.values())

    exact = {r.doc_id: r.text for r in stages["exact_dedup"](spark, docs, sf_dir).collect()}
    last = {r.text or "": d for d, r in sorted(rows.items())}
    assert set(exact) == set(last.values())

    mixed = stages["mixing"](spark, docs, sf_dir)
    assert mixed.columns == docs.columns and max(Counter(r.doc_id for r in mixed.collect()).values()) <= 3


def test_near_dedup_is_jaccard_alone(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    linked = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert {r.doc_id for r in corpus_pipeline.near(spark, docs, sf_dir).collect()} == set(smallest(sorted(sets), linked).values())


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert out and all(r.exact and r.n_tokens == len(r.ids) for r in out)


def test_odd_rows_and_none(spark, tmp_path):
    for rows in (odd_rows(), []):
        docs = spark.createDataFrame(rows, DOCS)
        for name, stage in corpus_pipeline.STAGES:
            before = docs
            stage(spark, docs, "").write.parquet(path := f"{tmp_path}/{len(rows)}-{name}")
            docs = spark.read.parquet(path)
            assert name == "bpe" or docs.columns == before.columns
            if name != "mixing":
                assert docs.count() <= before.count()
        assert docs.where("not exact").count() == 0 and (docs.count() > 0) == bool(rows)


def test_edited_copies_of_a_text(spark):
    """Most are similar to the one with the fewest edits, many to no other; sketches never say that similar sets are apart."""
    import random

    import numpy as np

    from tallywright.llm import simhash

    draw = random.Random(3)
    base = [f"word{i}" for i in range(150)]
    texts = []
    for k in range(150):
        words = list(base)
        for j in range(k % 5):
            words[draw.randrange(150)] = f"own{k}x{j}"
        texts.append(" ".join(words))
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    linked = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in simhash.drop_near_copies(docs).collect()} == set(smallest(sorted(sets), linked).values())
    bits = [simhash.sketch(simhash.shingles(t, 5)) for t in texts[:40]]
    for a in range(40):
        for b in range(a):
            assert int(np.bitwise_count(bits[a] ^ bits[b]).sum()) <= len(sets[a] ^ sets[b])


def test_copies_edited_too_much_meet_few_others(spark):
    """Copies that are similar to none leave crowded shingles before pairs are made; no similar pair of different classes goes with them."""
    import random

    from pyspark.sql import functions as F

    from tallywright.llm import simhash

    draw = random.Random(5)
    base = [f"word{i}" for i in range(150)]
    texts = []
    for k in range(240):
        words = list(base)
        for j in range(k % 8):
            words[draw.randrange(150)] = f"own{k}x{j}"
        texts.append(" ".join(words))
    sets = [{int(x) for x in simhash.shingles(t, 5)} for t in texts]
    alike = {(a, b) for a in range(240) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    placed = spark.createDataFrame([(1, i, i % 8, len(x), i) for i, x in enumerate(sets)], "token long, node long, at int, n int, class long").withColumn("crowded", F.lit(True))
    frame = spark.createDataFrame([(i, sorted(x)) for i, x in enumerate(sets)], "node long, s array<long>")
    own, hubs = simhash.own_shingles(placed, frame)
    live = {r.node: r.common for r in simhash._matched(placed, own, hubs, 0.8, 2).collect()}
    assert {i for pair in alike for i in pair} <= set(live) and len(live) < 200
    assert all(live[a] >= len(sets[a] & sets[b]) and live[b] >= len(sets[a] & sets[b]) for a, b in alike)


def test_strangers_of_a_crowded_shingle_go_by_their_prefixes(spark, monkeypatch):
    """Texts that only have a line in common leave its shingles before texts are read again; near copies that have it, too, stay and are found."""
    import random

    from tallywright.llm import simhash

    monkeypatch.setattr(simhash, "MANY", 8)
    monkeypatch.setattr(simhash, "common_shingles", lambda docs, words: ([], []))  # as in a sample that is too small for a line's shingles
    read, of = [], simhash.sets_of
    monkeypatch.setattr(simhash, "sets_of", lambda wanted, *rest: read.append(wanted.count()) or of(wanted, *rest))
    draw = random.Random(7)
    line = [f"line{i}" for i in range(12)]
    base = [f"base{i}" for i in range(90)]
    texts = [" ".join(line + [f"own{k}x{i}" for i in range(80)]) for k in range(200)]
    for k in range(40):
        words = line + base
        for j in range(k % 5):
            words[draw.randrange(12, 102)] = f"new{k}x{j}"
        texts.append(" ".join(words))
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    linked = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in simhash.drop_near_copies(docs).collect()} == set(smallest(sorted(sets), linked).values())
    assert len(read) > 1 and max(read[1:]) < 120

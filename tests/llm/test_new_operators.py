"""Vector codes, fingerprints and hard negatives against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywright.llm import fingerprints, hard_negatives, queries, simhash, vector_codes
from tallywright.llm.fingerprints import Sketcher

VECTORS = "vec_id long, embedding array<double>, label int, v string, codes string, error string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "clash", "clash", "clash") for i, v, label in rows], VECTORS)


def odd_vectors(n=700, width=8, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, width))
    rows = [(i, (centres[i % 9] * (i % 3) + rng.normal(size=width) * 0.2).tolist(), [0, 1, 2, 1, 1, None][i % 6]) for i in range(n)]
    rows += [(n + 1, None, 1), (n + 2, [0.0] * (width - 1) + [None], 1), (n + 3, [float("nan")] * width, 2), (n + 4, [float("-inf")] * width, 2), (None, [0.5] * width, None), (n + 5, [0.0] * width, 0)]
    rows += [rows[5], rows[5], rows[6], (7, [0.25] * width, 1), (100, [0.3] * width, 1)]
    return rows


# 11: vector codes

def plain_codes(rows, parts, entries, rounds, scale):
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    x = np.floor(np.array([v for _, v, _ in kept]) * scale).astype(np.int64).reshape(len(kept), parts, -1)
    first = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, x[r].ravel().tolist()))[:entries]
    books = x[first].transpose(1, 0, 2).copy()
    for turn in range(rounds + 1):
        d = ((x.transpose(1, 0, 2)[:, :, None] - books[:, None]) ** 2).sum(3)
        codes, error = d.argmin(2), d.min(2).sum(0)
        if turn < rounds:
            for p in range(parts):
                for e in set(codes[p].tolist()):
                    books[p, e] = x[codes[p] == e, p].sum(0) // (codes[p] == e).sum()
    by = {}
    for (_, _, label), e in zip(kept, error.tolist(), strict=True):
        by[label] = by.get(label, 0) + e
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return sorted(((i, codes[:, r].tolist(), int(error[r]), by[label]) for r, (i, _, label) in enumerate(kept)), key=str), digest


@pytest.mark.parametrize("entries,scale", [(16, 1024), (256, 3), (1000, 1), (32, 1 << 18)])
def test_codes(spark, entries, scale):
    """Few entries, many ties, more entries than vectors, components that are too large for exact doubles."""
    rows = odd_vectors()
    coded, books = vector_codes.vector_codes(vectors(spark, rows).repartition(5), parts=4, entries=entries, rounds=4, scale=scale)
    got = sorted(((r.vec_id, r.codes, r.error, r.label_error) for r in vector_codes.label_errors(coded).collect()), key=str)
    assert (got, books.digest()) == plain_codes(rows, 4, entries, 4, scale)


def test_rings_and_stable_cores_skip_work():
    """Every part finds its nearest entry, and with clusters far apart most parts are compared with nothing or with few entries."""
    rng = np.random.default_rng(1)
    entries = rng.integers(-400, 400, size=(64, 4))
    x = entries[rng.integers(64, size=3000)] + rng.integers(-60, 60, size=(3000, 4))
    books = vector_codes.Codebooks(entries[None])
    now = vector_codes.nearest(x, books, 0, None, np.float64)
    moved = np.array([x[now == i].sum(0) // (now == i).sum() if (now == i).any() else entries[i] for i in range(64)])
    gap = np.sqrt(((x - moved[now]) ** 2).sum(1))
    radius = np.array([int(np.ceil(gap[now == i].max())) if (now == i).any() else -1 for i in range(64)])
    books = vector_codes.Codebooks.of(moved[None], radius[None], (moved != entries).any(1)[None])
    own = ((x - moved[now]) ** 2).sum(1)
    rings = np.array([np.searchsorted(books.apart[0][i], 4 * d, side="right") for i, d in zip(now, own, strict=True)])
    assert (rings == 0).mean() > 0.3 and rings.mean() < 10
    assert (vector_codes.nearest(x, books, 0, now, np.float64) == ((x[:, None] - moved[None]) ** 2).sum(2).argmin(1)).all()
    books.still[:] = True
    assert (vector_codes.nearest(x, books, 0, now, np.int64) == now).all()


def test_codes_of_nothing(spark):
    coded, books = vector_codes.vector_codes(vectors(spark, []))
    assert vector_codes.label_errors(coded).count() == 0 and books is None
    assert vector_codes.vector_codes(vectors(spark, [(1, None, 1)]))[0].count() == 0


def test_codes_refuse_what_has_no_exact_result(spark):
    for rows in ([(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)], [(1, [1.0] * 6, 1)], [(1, [1e300] * 4, 1)]):
        with pytest.raises(ValueError):
            vector_codes.vector_codes(vectors(spark, rows))


# 12: fingerprints

def plain_shingles(text, n=5):
    sketcher = Sketcher(n)
    found = sketcher.hashes(text)
    return set(sketcher.shingles(found).tolist())


def odd_texts():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(1, 6)))
    long = " ".join(word() for _ in range(5000))
    texts = [None, "", " \n\t", "one", "two words", "a b c d", "a b c d e", "a b c d f", long, long, long + " tail", "ä ö ü ß é", "日本語のテキスト", "👩‍👩‍👧 x", "x" * 3000, " ".join([word()] * 400)]
    rows = [(i * 3 - 5, t) for i, t in enumerate(texts)] + [(4, "same id"), (4, "same id"), (4, "another text of this id"), (None, "no id"), (None, None), (None, "no id, and more")]
    return rows + [(1000 + i, " ".join(word() for _ in range(r.randint(0, 300)))) for i in range(150)]


def plain_fingerprints(spark, rows):
    """The rows in order, each with the text that follows it."""
    hashed = {r.t: r.h for r in spark.createDataFrame([(t or "",) for _, t in rows], "t string").distinct().select("t", F.xxhash64("t").alias("h")).collect()}
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), hashed[r[1]], r[1]))
    sketcher = Sketcher()
    out = []
    for k, (i, text) in enumerate(order):
        then = order[(k + 1) % len(order)][1]
        edited = text[: len(text) - len(text) // 2] + then[: len(text) // 2]
        a, b, c = (sketcher.sketch(t) for t in (text, edited, then))
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), "".join(f"{h:016x}" for h in a.tolist()), "".join(f"{h:016x}" for h in b.tolist()), sketcher.likeness(a, b), sketcher.likeness(a, c)))
    return sorted(out, key=str)


def test_fingerprints(spark, monkeypatch):
    rows = odd_texts()
    frame = spark.createDataFrame([(i, t, "clash", 1, True) for i, t in rows], "doc_id long, text string, block string, _hash int, behind boolean").repartition(7)
    want = plain_fingerprints(spark, rows)
    assert sorted(map(tuple, fingerprints.fingerprints(frame).collect()), key=str) == want
    monkeypatch.setattr(fingerprints, "LEAST_BLOCKS", 1)  # one block follows itself
    assert sorted(map(tuple, fingerprints.fingerprints(frame).collect()), key=str) == want


def test_fingerprints_of_the_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.QUERIES["op12_bottom_k_fingerprints"](spark, sf_dir).collect()), key=str) == plain_fingerprints(spark, rows)


def test_fingerprints_of_few_rows(spark):
    kind = "doc_id long, text string"
    assert fingerprints.fingerprints(spark.createDataFrame([], kind)).count() == 0
    (one,) = fingerprints.fingerprints(spark.createDataFrame([(1, "ab cd")], kind)).collect()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"ab ab").hexdigest()
    assert fingerprints.fingerprints(spark.createDataFrame([(1, None)], kind)).first().near_edited == 1.0


def test_long_texts_are_sketched_in_pieces(monkeypatch):
    r = random.Random(5)
    texts = [" ".join(str(r.randint(0, 99)) for _ in range(n)) for n in (3, 4, 5, 50, 2000)] + ["x" * 500, "a " * 300, "  "]
    whole = [Sketcher().sketch(t) for t in texts]
    monkeypatch.setattr(fingerprints, "PIECE", 37)
    monkeypatch.setattr(fingerprints, "REMEMBERED", 10)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(whole, (Sketcher().sketch(t) for t in texts), strict=True))


def test_sketches_merge_and_estimate(spark):
    """Estimates by columns against the shingles themselves; sketches of parts merge into those of all."""
    r = random.Random(6)
    words = [str(r.randint(0, 10**6)) for _ in range(6000)]
    texts = {"a": " ".join(words[:4000]), "b": " ".join(words[2000:]), "c": " ".join(words[:500]), "d": "", "e": "few words are here once again"}
    made = fingerprints.sketches(spark.createDataFrame(list(texts.items()), "name string, text string"))
    both = made.select(F.col("name").alias("x"), F.col("sketch").alias("s")).join(made.select(F.col("name").alias("y"), F.col("sketch").alias("t")), F.lit(True))
    s, t = F.col("s"), F.col("t")
    for row in both.select("x", "y", fingerprints.resemblance(s, t).alias("r"), fingerprints.containment(s, t).alias("c"), fingerprints.distinct_shingles(s).alias("n")).collect():
        a, b = plain_shingles(texts[row.x]), plain_shingles(texts[row.y])
        assert abs(row.r - (len(a & b) / len(a | b) if a | b else 1.0)) < 0.15
        assert abs(row.c - (len(a & b) / len(a) if a else 1.0)) < 0.35
        assert abs(row.n - len(a)) <= 0.3 * len(a) and (len(a) >= fingerprints.K or row.n == len(a))
    merged = fingerprints.merge_sketches(made.withColumn("part", F.when(F.col("name") < "d", F.lit("p"))), ["part"]).collect()
    sketcher = Sketcher()
    want = {"p": set().union(*(plain_shingles(texts[x]) for x in "abc")), None: plain_shingles(texts["d"]) | plain_shingles(texts["e"])}
    for row in merged:
        assert row.sketch == fingerprints._signed(sketcher.smallest(np.array(sorted(want.pop(row.part)), np.uint64))).tolist()
    assert not want


# 13: hard negatives

def plain_negatives(rows, every, positives, negatives, low, high, scale):
    kept = [(i, np.floor(np.array(v) * scale).astype(np.int64), label) for i, v, label in rows if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out, seen = [], set()
    for i, v, label in kept:
        if i is None or i % every or (i, tuple(v), label) in seen:
            continue
        seen.add((i, tuple(v), label))
        scored = sorted(((int(v @ w), o, other) for o, w, other in kept), key=lambda r: (-r[0], r[1] is None, r[1] or 0))
        for score, o, _ in [r for r in scored if r[2] == label and r[1] != i][:positives]:
            fit = [r for r in scored if r[2] != label and low * score <= 100 * r[0] <= high * score][:negatives]
            out += [(i, o, k + 1, r[1], score, r[0]) for k, r in enumerate(fit)]
    return sorted(out, key=str)


@pytest.mark.parametrize("scale,block,columns", [(256, 4096, 320), (2, 7, 5), (1 << 14, 4096, 320)])
def test_negatives(spark, monkeypatch, scale, block, columns):
    """Whole numbers with few and many ties, blocks of few anchors, fields too wide to share an integer."""
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "COLUMNS", columns)
    rows = odd_vectors() + [(None, [0.5] * 8, 1), (None, [0.1] * 8, 0)]
    got = hard_negatives.hard_negatives(vectors(spark, rows).repartition(3), lambda i: i % 20 == 0, scale=scale)
    got = sorted(map(tuple, got.collect()), key=str)
    assert len(got) > 100 and got == plain_negatives(rows, 20, 5, 10, 30, 90, scale)


def test_packed_products():
    rng = np.random.default_rng(2)
    for length, largest in ((64, 200), (8, 3), (8, 1 << 20), (3, 1), (1, 0), (256, 60000)):
        packing = hard_negatives.Packing.of(length, largest)
        x, a = rng.integers(-largest, largest + 1, size=(37, length)), rng.integers(-largest, largest + 1, size=(11, length))
        x[0], a[0] = largest, largest
        x[1], a[1] = -largest, -largest
        assert (packing.products(packing.pack(x), x, a) == x @ a.T).all()
    assert hard_negatives.Packing.of(64, 200).fields == 2 and hard_negatives.Packing.of(8, 3).fields > 4


def test_negatives_of_nothing(spark):
    assert hard_negatives.hard_negatives(vectors(spark, []), lambda i: i % 1 == 0).count() == 0
    alone = vectors(spark, [(0, [1.0, 1.0], 1), (1, [1.0, 1.0], None)])
    assert hard_negatives.hard_negatives(alone, lambda i: i % 1 == 0).count() == 0
    assert hard_negatives.hard_negatives(alone, lambda i: i > 5).count() == 0


# classes that meet

def test_a_dense_group_and_strangers_make_few_rows(spark):
    """Classes meet before members: a class of 3,000 in one bucket with ten strangers makes rows in proportion to it; sparse buckets are joined at once."""
    rows = [(1, 5, i, 0, True) for i in range(3000)] + [(1, 5, 10_000 + k, 1 + k, True) for k in range(10)] + [(2, 5, 20_000 + k, 100 + k % 50, k % 2 == 0) for k in range(0, 100, 2)] + [(3, 5, k, k, False) for k in range(5)]
    a = spark.createDataFrame(rows, "part int, value long, a long, ca long, crowded boolean")
    b = a.withColumnsRenamed({"a": "b", "ca": "cb"})
    got = sorted((r.part, r.a, r.b) for r in simhash.across(a, b, ["part", "value"]).collect())
    assert got == sorted((r[0], r[2], q[2]) for r in rows for q in rows if r[0] == q[0] and r[3] != q[3])

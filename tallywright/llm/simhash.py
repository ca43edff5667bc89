"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint's 64 bits are grouped so that correlated bits stand together. With thresholds t_i whose sum is t - m + 1 over m
groups, two fingerprints within t bits are within t_i bits in some group i (-1: a group is never probed). Dynamic programming
picks the thresholds of least estimated cost; each fingerprint probes all values within t_i bits of its own in group i, and the
join that finds them verifies all 64 bits.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, comb, log

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import components, reclaim, release, scratch, settle

BITS, WORDS, LINK_BITS, SEED = 64, 4, 4, 42

#: What drop_near_copies() takes for near: a Jaccard similarity of the sets of five-word shingles. Pairs of fingerprints within so
#: many bits are looked at first; shared rare shingles find the others.
NEAR_WORDS, NEAR_BITS, NEAR_JACCARD = 5, 4, 0.8

#: Fingerprints that the grouping of bits and the cost estimates are fitted on; results don't depend on them.
SAMPLE = 2048

#: Rows of one key from which its classes are counted before its members are joined.
CROWDED = 64

#: Nodes of one shingle that are compared with each other as they are; where there are more, those that can match no other class go first.
#: Results don't depend on it.
MANY = 256

#: Documents in which common shingles are counted, and how many of those are told to all workers; results don't depend on them.
SAMPLE_DOCS, SAMPLE_COMMON = 4096, 1 << 16

#: How often nodes of crowded shingles that can be similar to none of another class are left out before pairs are made; results don't depend on it.
ROUNDS = 2

#: Ratio of the sizes of sets that count as one size when partners of a node are looked for; results don't depend on it.
SIZE_STEP = 1.02

#: Words of 64 bits in a sketch of a set of shingles: which of so many classes of hashes hold an odd number of them.
SKETCH = [f"p{i}" for i in range(8)]

#: Costs in units of a probe's row: comparing a candidate.
CANDIDATE_COST = 0.05


def _hashes(text: str | None, words: int) -> np.ndarray:
    """The hashes of a text's word shingles in order; a text of fewer words is one shingle, a text without words has none."""
    tokens = (text or "").encode().lower().split()
    shingles = map(b" ".join, zip(*[tokens[i:] for i in range(words)], strict=False)) if len(tokens) > words else [b" ".join(tokens)] if tokens else []
    return np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], dtype="<u8")


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64-bit fingerprint as a signed integer; 0 for a text without words. Counts bits in blocks, however long the text."""
    return _majority(_hashes(text, words))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The distinct hashes of a text's word shingles, sorted."""
    return np.unique(_hashes(text, words)).view("<i8")


def shingle_sets(text: Column, words: int) -> Column:
    @F.pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: shingles(t, words))

    return of(text)


def common_shingles(docs: DataFrame, words: int, sample: int = SAMPLE_DOCS, most: int = SAMPLE_COMMON) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, counts) of the shingles that come most often in a sample of docs (text): they go last in prefixes."""
    n = docs.count()
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) * n < 1_000_000 * sample)
    counts = some.select(F.explode(shingle_sets(F.col("text"), words)).alias("s")).groupBy("s").count().where("count > 2")
    rows = sorted((r.s, r["count"]) for r in counts.orderBy(F.desc("count"), "s").limit(most).collect())
    return np.array([s for s, _ in rows], np.int64), np.array([k for _, k in rows], np.int64)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The parities of a set's hashes by their lowest bits. Sets differ by as many hashes at least as their sketches by bits."""
    n = 64 * len(SKETCH)
    odd = np.bincount((hashes.view("<u8") % np.uint64(n)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def prefixes(text: Column, words: int, least: float, common: Broadcast) -> Column:
    """struct of fp, node (hash of the set of shingles), n (its size), prefix and the set's sketch.

    The prefix is the set's first shingles in an order that all texts share. Two sets of a Jaccard similarity of ``least`` have
    ``least`` * n shingles in common at least, so one of them is in both prefixes, whatever the order.
    """

    @F.pandas_udf("fp long, node long, n int, prefix array<long>, " + ", ".join(f"{p} long" for p in SKETCH))
    def of(texts: pd.Series) -> pd.DataFrame:
        often, counts = common.value
        rows = []
        for t in texts:
            hashes = _hashes(t, words)
            s = np.unique(hashes).view("<i8")
            count = np.zeros(len(s), np.int64)
            if len(often):
                at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                count = np.where(often[at] == s, counts[at], 0)
            prefix = s[np.lexsort((s, count))[: len(s) - _least_common(len(s), least) + 1]]
            rows.append((_majority(hashes), xxhash.xxh64_intdigest(s.tobytes(), SEED) - (1 << 63), len(s), prefix, *sketch(s).view("<i8").tolist()))
        return pd.DataFrame(rows, columns=["fp", "node", "n", "prefix", *SKETCH])

    return of(text)


def _least_common(n: int, least: float) -> int:
    """How many shingles a set of n must have in common with any other to be similar; never more than what floating point admits."""
    return ceil(least * n - 1e-6)


def fingerprints(text: Column, words: int = WORDS) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fingerprint(t, words)).astype("int64")

    return of(text)


def group_bits(sample: np.ndarray, m: int) -> list[list[int]]:
    """m groups of equal size; each grows from the most balanced bit left by the bits most correlated with it."""
    bits = (sample[:, None] >> np.arange(BITS, dtype=np.uint64) & np.uint64(1)).astype(np.float64)
    var = bits.var(axis=0)
    centred = (bits - bits.mean(axis=0)) / np.sqrt(np.maximum(var, 1e-9))
    corr = np.abs(centred.T @ centred) / max(1, len(bits))
    left, groups = set(range(BITS)), []
    for k in range(m):
        group = [max(sorted(left), key=lambda b: var[b])]
        left.discard(group[0])
        while len(group) < BITS // m + (k < BITS % m):
            group.append(max(sorted(left), key=lambda b: corr[b, group].mean()))
            left.discard(group[-1])
        groups.append(sorted(group))
    return groups


def allocate(sample: np.ndarray, n: int, limit: int = LINK_BITS) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each probed group: the cheapest by estimate over all numbers of groups, for n fingerprints."""
    best: tuple[float, list[tuple[list[int], int]]] = (float("inf"), [])
    sample = sample if len(sample) else np.zeros(1, np.uint64)
    for m in range(1, limit + 2):
        groups = group_bits(sample, m)
        costs = []
        for g in groups:
            mask = np.uint64(sum(1 << b for b in g))
            apart = np.bitwise_count((sample[:, None] ^ sample[None, :]) & mask)[np.triu_indices(len(sample), 1)]
            cost = {-1: 0.0}
            for t in range(min(limit, 3) + 1):
                probes = sum(comb(len(g), d) for d in range(t + 1))
                near = max(float((apart <= t).mean()) if len(apart) else 0.0, probes / 2.0 ** len(g))
                cost[t] = n * probes + CANDIDATE_COST * n * n / 2 * near
            costs.append(cost)
        paths: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for cost in costs:
            paths = {s: min(((c + cost[t], [*ts, t]) for was, (c, ts) in paths.items() for t in cost if was + t == s), key=lambda x: x[0]) for s in {was + t for was in paths for t in cost}}
        if (found := paths.get(limit - m + 1)) and found[0] < best[0]:
            best = (found[0], [(g, t) for g, t in zip(groups, found[1], strict=True) if t >= 0])
    return best[1]


def _masks(bits: list[int], t: int) -> list[int]:
    """All ways to flip up to t of the bits, as signed 64-bit masks."""
    masks = [sum(1 << b for b in chosen) for d in range(t + 1) for chosen in combinations(bits, d)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _probed(prints: DataFrame, limit: int, sample: int) -> tuple[DataFrame, DataFrame, Column]:
    """(index, probe, close): rows of fp, part and value as they are stored and as they are looked for; and when a and b are within the limit.

    Any two fingerprints within the limit meet: one of them is looked for where the other is stored.
    """
    some = np.array([r.fp for r in prints.orderBy(F.xxhash64("fp")).limit(sample).collect()], dtype=np.int64).view(np.uint64)
    groups = allocate(some, prints.count(), limit)
    values = [lambda fp, i=i, mask=_all(g): F.struct(F.lit(i).alias("part"), fp.bitwiseAND(F.lit(mask)).alias("value")) for i, (g, _) in enumerate(groups)]
    own = [value(F.col("fp")) for value in values]
    flips = [F.transform(F.array(*[F.lit(m) for m in _masks(g, t)]), lambda m: value(F.col("fp").bitwiseXOR(m))) for value, (g, t) in zip(values, groups, strict=True)]  # noqa: B023
    index = prints.select("fp", F.explode(F.array(*own)).alias("key")).select("fp", "key.*")
    probe = prints.select("fp", F.explode(F.flatten(F.array(*flips))).alias("key")).select("fp", "key.*")
    return index, probe, F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= limit


def star_links(prints: DataFrame, limit: int = LINK_BITS, sample: int = SAMPLE) -> DataFrame:
    """(a, b), a < b: of the values of prints (fp) each that is within the limit of the smallest one of a bucket, with the smallest such.

    A row a value at most, however many are close to each other. It joins most of what is close, not all.
    """
    index, probe, close = _probed(prints, limit, sample)
    low = settle(index.groupBy("part", "value").agg(F.min("fp").alias("a")), "simhash-lowest")
    return probe.withColumnRenamed("fp", "b").join(low, ["part", "value"]).where((F.col("a") < F.col("b")) & close).groupBy("b").agg(F.min("a").alias("a")).select("a", "b")


def near_links(prints: DataFrame, limit: int = LINK_BITS, sample: int = SAMPLE) -> DataFrame:
    """(node, component) of the distinct values of prints (fp) that have another within the limit, whatever links they lead over.

    First the stars of buckets are joined. Then all pairs are looked at that lie in different components: buckets of one component
    alone are left out before the join, so a dense group puts out no pairs.
    """
    stars = settle(star_links(prints, limit, sample), "simhash-stars")
    classes = components(stars, "simhash-stars")
    index, probe, close = _probed(prints, limit, sample)
    known = settle(prints.join(classes, prints.fp == classes.node, "left").select("fp", F.coalesce("component", "fp").alias("class")), "simhash-known")
    bounds = [t.join(known, "fp").groupBy("part", "value").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("n")) for t in (index, probe)]
    both = bounds[0].join(bounds[1].withColumnsRenamed({"low": "low2", "high": "high2", "n": "n2"}), ["part", "value"])
    mixed = settle(both.where(F.least("low", "low2") < F.greatest("high", "high2")).select("part", "value", (F.col("n") + F.col("n2") > CROWDED).alias("crowded")), "simhash-mixed")
    sides = [settle(t.join(mixed, ["part", "value"]).join(known, "fp"), "simhash-open") for t in (probe, index)]
    a, b = sides[0].withColumnsRenamed({"fp": "a", "class": "ca"}), sides[1].withColumnsRenamed({"fp": "b", "class": "cb"})
    rest = across(a, b, ["part", "value"]).where((F.col("a") < F.col("b")) & close).select("a", "b").distinct()
    return components(stars.union(rest), "simhash")


def across(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """a (keys, ca, crowded, ...) joined with b (keys, cb, crowded, ...) where keys are equal and classes differ.

    Where a few classes have most of a crowded key's rows, the classes that meet are found first and then their members: a class of
    many and a stranger make as many rows as the class has, not its square. All other keys are joined at once.
    """
    classes = [settle(t.where("crowded").groupBy(*keys, c).agg(F.count("*").alias("n")), "simhash-classes") for t, c in ((a, "ca"), (b, "cb"))]
    size = [t.groupBy(*keys).agg(F.count("*").alias(f"k{i}"), F.sum("n").alias(f"n{i}")) for i, t in enumerate(classes)]
    dense = settle(size[0].join(size[1], keys).where(F.lit(4.0) * F.col("k0") * F.col("k1") < F.col("n0") * F.col("n1")).select(*keys), "simhash-dense")
    differ = F.col("ca") != F.col("cb")
    b = b.drop("crowded")
    if dense.isEmpty():
        return a.drop("crowded").join(b, keys).where(differ)
    meet = settle(classes[0].drop("n").join(dense, keys, "left_semi").join(classes[1].drop("n"), keys).where(differ), "simhash-meet")
    meet = meet.hint("merge")  # compresses well, so its files are no bound for what a broadcast of it would hold
    return a.drop("crowded").join(dense, keys, "left_anti").join(b, keys).where(differ).unionByName(a.drop("crowded").join(meet, [*keys, "ca"]).join(b, [*keys, "cb"]))


def _all(bits: list[int]) -> int:
    mask = sum(1 << b for b in bits)
    return mask - (1 << 64) if mask >> 63 else mask


def sets_of(wanted: DataFrame, rows: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(node, s): the sorted shingles of the wanted nodes (node), from one document of each; texts are shuffled once.

    rows (doc_id, key, node) says which documents of docs (doc_id, text) have a node's set.
    """
    first = rows.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "key")).alias("of")).select("node", F.col("of.doc_id").alias("_id"), F.col("of.key").alias("_key"))
    keyed = docs.withColumn("_hash", F.xxhash64("text"))
    texts = keyed.join(first, keyed.doc_id.eqNullSafe(first._id) & (keyed._hash == first._key)).dropDuplicates(["node"])
    return texts.select("node", shingle_sets(F.col("text"), words).alias("s"))


def similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose sets (node, s) have a Jaccard similarity of ``least`` or more."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(common >= F.lit(least) * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def shared_prefixes(nodes: DataFrame) -> DataFrame:
    """(token, node, at, n) of the shingles in the prefixes of nodes (node, n, prefix) that more than one node has."""
    entries = nodes.select("node", "n", F.posexplode("prefix").alias("at", "token")).repartition("token")
    spread = entries.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("token")
    return entries.join(spread, "token", "left_semi").distinct()


def _fit(least: float) -> Column:
    """Whether sets of na and nb shingles can be similar by their sizes."""
    return F.least("na", "nb") >= F.lit(least) * F.greatest("na", "nb") - 1e-6


def _met(pairs: DataFrame, least: float) -> DataFrame:
    """(a, b, k) of rows (a, b, na, nb, i, j), one for each shingle that the prefixes of a and b share, at places i and j, without the pairs that can't be similar.

    From the first of the k shared shingles on, sets have 1 + min(na - 1 - i, nb - 1 - j) in common at most. And of the two prefixes
    one ends first in the common order; what it has in common with the other set is in the other's prefix, so all that both have in
    common is k and, at most, what that set has behind its prefix.
    """
    each = pairs.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("k"), F.min("i").alias("i"), F.min("j").alias("j"))
    needed = F.lit(least / (1 + least)) * (F.col("na") + F.col("nb")) - 1e-6
    first = 1 + F.least(F.col("na") - 1 - F.col("i"), F.col("nb") - 1 - F.col("j"))
    behind = F.greatest(F.ceil(F.lit(least) * F.col("na") - 1e-6), F.ceil(F.lit(least) * F.col("nb") - 1e-6)) - 1
    return each.where((first >= needed) & (F.col("k") + behind >= needed)).select("a", "b", "k")


def _open(placed: DataFrame, classes: DataFrame) -> DataFrame:
    """placed (token, node, at, n) with each node's class, without shingles that one class alone has."""
    return _marked(settle(placed.join(classes, "node", "left").select("token", "node", "at", "n", F.coalesce("component", "node").alias("class")), "simhash-placed"))


def _marked(known: DataFrame) -> DataFrame:
    """known (token, node, at, n, class) with crowded, whether many nodes have the shingle; without shingles that one class alone has."""
    spread = known.groupBy("token").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("n")).where("low < high").select("token", (F.col("n") > MANY).alias("crowded"))
    return settle(known.join(settle(spread, "simhash-spread"), "token"), "simhash-open")


def star_pairs(placed: DataFrame, least: float, central: bool = False) -> DataFrame:
    """(a, b): for each node of placed (token, node, at, n, class) the partner of another class that it meets most often, if that is often enough.

    Of each shingle only the nodes of its first and its last class are partners, so rows grow with the nodes, not with pairs. With
    ``central`` (placed has common, too) the node with the smallest share of shingles that no other class has comes before them, and any
    number of meetings is enough: of edited copies of a text that is the one with the fewest edits, which is similar to most others.
    """
    end = F.struct("class", "node", "at", "n")
    firsts = [F.min(end).alias("low"), F.max(end).alias("high")] + ([F.max_by(end, F.struct(F.col("common") / F.col("n"), "node")).alias("mid")] if central else [])
    ends = settle(placed.groupBy("token").agg(*firsts), "simhash-ends")
    to = F.when(F.col("class") != F.col("low.class"), F.col("low")).otherwise(F.col("high"))
    met = placed.join(ends, "token").withColumn("to", F.when(F.col("class") != F.col("mid.class"), F.col("mid")).otherwise(to) if central else to)
    met = met.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("at").alias("i"), F.col("to.node").alias("b"), F.col("to.n").alias("nb"), F.col("to.at").alias("j"))
    met = met.where(_fit(least))
    each = met.groupBy("a", "b").agg(F.count("*").alias("k")) if central else _met(met, least)
    return each.groupBy("a").agg(F.max(F.struct("k", "b")).alias("best")).select("a", F.col("best.b").alias("b"))


def promising(placed: DataFrame, least: float) -> DataFrame:
    """placed (token, node, at, n, class, crowded) without the nodes of crowded shingles that by their prefixes can be similar to none of another class there; crowded is what still is.

    The bounds are those of _met(): a node shares no more shingles of prefixes with another than it has in placed, and none before its
    first there. Two similar nodes that share a crowded shingle both stay in all of theirs. Only prefixes are read, no texts.
    """
    seen = settle(placed.groupBy("node").agg(F.count("*").alias("k"), F.min("at").alias("first"), F.max("crowded").alias("_any")).where("_any").drop("_any"), "simhash-seen")
    some = settle(placed.where("crowded").join(seen, "node"), "simhash-some")
    size = F.floor(F.log("n") / log(SIZE_STEP))
    kinds = some.groupBy("token", size.alias("size")).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("k").alias("k"), F.max(F.col("n") - F.col("first")).alias("behind"), F.min("class").alias("low"), F.max("class").alias("high"))
    kinds = settle(kinds.groupBy("token").agg(F.collect_list(F.struct("least", "most", "k", "behind", "low", "high")).alias("kinds")), "simhash-sizes")
    c, n, part = F.col("class"), F.col("n"), F.lit(least)

    def partner(kind: Column) -> Column:
        needed = F.lit(least / (1 + least)) * (n + kind["least"]) - 1e-6
        fit = (n >= part * kind["least"] - 1e-6) & (kind["most"] >= part * n - 1e-6)
        rest = F.ceil(part * F.greatest(n, kind["most"]) - 1e-6) - 1
        return ((kind["low"] != c) | (kind["high"] != c)) & fit & (F.least("k", kind["k"]) + rest >= needed) & (F.least(n - F.col("first"), kind["behind"]) >= needed)

    live = settle(some.join(kinds, "token").where(F.exists("kinds", partner)).select("node").distinct(), "simhash-promising")
    stay = placed.where("not crowded").unionByName(placed.where("crowded").join(live, "node", "left_semi").select(*placed.columns))
    return _marked(settle(stay.drop("crowded"), "simhash-placed"))


def own_shingles(placed: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, base, own) of the nodes of placed (token, node, at), and (s) of their centres.

    A node's centre is the node that comes first in most of its shingles: of edited copies one with few edits. base is how many of the
    node's shingles its centre has; own are the others, few for an edited copy.
    """
    first = settle(placed.groupBy("token").agg(F.min_by("node", F.struct("at", "node")).alias("centre")), "simhash-first")
    of = placed.join(first, "token").groupBy("node", "centre").agg(F.count("*").alias("k")).groupBy("node").agg(F.max(F.struct("k", "centre")).alias("best"))
    of = settle(of.select("node", F.col("best.centre").alias("centre")), "simhash-centres")
    both = of.join(sets, "node").join(sets.select(F.col("node").alias("centre"), F.col("s").alias("sc")), "centre").select("node", F.size("s").alias("size"), F.array_except("s", "sc").alias("own"))
    own = settle(both.select("node", (F.col("size") - F.size("own")).alias("base"), "own"), "simhash-own")
    hubs = settle(of.select(F.col("centre").alias("node")).distinct().join(sets, "node").select(F.explode("s").alias("s")).distinct(), "simhash-hubs")
    return own, hubs


def matchable(placed: DataFrame, own: DataFrame, hubs: DataFrame, least: float) -> DataFrame:
    """(node, common) of the nodes of placed (token, node, n, class) that can be similar to one of another class there; own and hubs are own_shingles() of them or more.

    common is how many of a node's shingles a centre or another class has: no set of another class has more of them. So for a partner of
    m shingles, both have ``least`` / (1 + ``least``) * (n + m) such at least. Rows grow with the shingles of the nodes, not with pairs.
    """
    nodes = settle(placed.select("node", "class").distinct().join(own, "node"), "simhash-live")
    each = settle(nodes.select("node", "class", F.explode("own").alias("s")), "simhash-each")
    often = each.groupBy("s").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("s")
    spread = settle(often.union(hubs).distinct(), "simhash-spread")
    more = each.join(spread, "s", "left_semi").groupBy("node").agg(F.count("*").alias("more"))
    common = settle(nodes.join(more, "node", "left").select("node", (F.col("base") + F.coalesce("more", F.lit(0))).alias("common")), "simhash-common")
    some = settle(placed.select("token", "node", "n", "class").join(common, "node").where(F.col("common") >= F.lit(least) * F.col("n") - 1e-6), "simhash-some")
    size = F.floor(F.log("n") / log(SIZE_STEP))
    kinds = some.groupBy("token", size.alias("size")).agg(F.min("n").alias("n"), F.max("common").alias("common"), F.min("class").alias("low"), F.max("class").alias("high"))
    kinds = settle(kinds.groupBy("token").agg(F.collect_list(F.struct("n", "common", "low", "high")).alias("kinds")), "simhash-sizes")
    c = F.col("class")
    partner = F.exists("kinds", lambda k: ((k["low"] != c) | (k["high"] != c)) & (F.least("common", k["common"]) >= F.lit(least / (1 + least)) * (F.col("n") + k["n"]) - 1e-6))
    return settle(some.join(kinds, "token").where(partner).select("node", "common").distinct(), "simhash-matchable")


def _matched(placed: DataFrame, own: DataFrame, hubs: DataFrame, least: float, rounds: int) -> DataFrame:
    """placed (token, node, at, n, class, crowded) with common, the most shingles that a set of another class can share.

    Nodes that can be similar to none of another class are left out of crowded shingles, again and again, as without them others have
    fewer shingles in common. Other shingles keep all their nodes, with n as common.
    """
    crowded = placed.where("crowded")
    for _ in range(rounds):
        live = matchable(crowded, own, hubs, least)
        crowded = settle(placed.where("crowded").join(live, "node"), "simhash-crowded")
    return placed.where("not crowded").withColumn("common", F.col("n").cast("long")).unionByName(crowded)


def _alike(least: float) -> Column:
    """Whether sets of na and nb shingles can be similar by their sketches: similar ones differ by few hashes, so by no more bits."""
    apart = sum((F.bit_count(F.col(f"a_{p}").bitwiseXOR(F.col(f"b_{p}"))) for p in SKETCH), F.lit(0))
    return apart <= F.lit((1 - least) / (1 + least)) * (F.col("na") + F.col("nb")) + 1e-5


def prefix_pairs(placed: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """(a, b), a < b: of nodes in placed (token, node, at, n, class, common) all pairs of different classes that can have a Jaccard similarity of ``least``; each once.

    Of two classes one at least isn't the largest of a shingle, so all its nodes meet those of the other classes alone: a class of many
    is not compared with itself. What nodes have in common with other classes, and their sketches (node, SKETCH), are compared as they
    meet: many edited copies of a text that aren't similar to each other share its shingles, but their sketches are too far apart.
    """
    sizes = placed.groupBy("token", "class").agg(F.count("*").alias("of"))
    main = settle(sizes.groupBy("token").agg(F.max_by("class", F.struct("of", "class")).alias("main")), "simhash-main")
    placed = settle(placed.join(main, "token").join(sketches, "node"), "simhash-sketched")
    side = lambda x, at: placed.select("token", "main", F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("at").alias(at), F.col("class").alias(f"c{x}"), F.col("common").alias(f"m{x}"), *[F.col(p).alias(f"{x}_{p}") for p in SKETCH])
    a, b = side("a", "i").where("ca <> main").drop("main"), side("b", "j")
    once = (F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("main")) | (F.col("a") < F.col("b")))
    can = F.least("ma", "mb") >= F.lit(least / (1 + least)) * (F.col("na") + F.col("nb")) - 1e-6
    met = a.join(b, "token").where(once & _fit(least) & can & _alike(least))
    low = F.col("a") < F.col("b")
    met = met.select(*[F.when(low, F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("a", "b"), ("b", "a"), ("na", "nb"), ("nb", "na"), ("i", "j"), ("j", "i"))])
    return _met(met, least).select("a", "b")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, limit: int = LINK_BITS, least: float | None = None) -> DataFrame:
    """One row per document: doc_id, key (hash of its text), fp, fingerprint, component_id.

    Documents link when their fingerprints differ in ``limit`` bits or fewer. If ``least`` is given, they link when their sets of
    shingles have a Jaccard similarity of that or more, however far apart their fingerprints are; ``limit`` then only says which
    pairs are looked at first, and equal fingerprints alone link nothing. component_id is the smallest doc_id that links lead to. Null, empty and blank texts have fingerprint
    zero and link like others. A null id never is a component's id unless all of them are null. Repeated rows stay as they are;
    an empty table gives an empty result; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if least is None:
        rows = settle(docs.select("doc_id", F.xxhash64("text").alias("key"), fingerprints(F.col("text"), words).alias("fp")).withColumn("node", F.col("fp")), "simhash-prints")
        classes = near_links(settle(rows.select("fp").distinct(), "simhash-fps"), limit)
    else:
        common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, words))
        reclaim(docs.sparkSession)
        rows = settle(docs.select("doc_id", F.xxhash64("text").alias("key"), prefixes(F.col("text"), words, least, common).alias("_of")).select("doc_id", "key", "_of.*"), "simhash-prints")
        classes = similar_classes(rows, docs, words, limit, least)
    kinds = rows.groupBy("node").agg(F.min("doc_id").alias("low")).join(classes, "node", "left").select("node", "low", F.coalesce("component", "node").alias("class"))
    kinds = settle(kinds, "simhash-kinds")
    of = kinds.join(kinds.groupBy("class").agg(F.min("low").alias("component_id")), "class").select("node", "component_id")
    return rows.join(of, "node").select("doc_id", "key", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _once(rows: DataFrame) -> DataFrame:
    """rows, of equal sets of shingles one where there are many; a few repeats cost less than shuffling all prefixes."""
    n, nodes = rows.agg(F.count("*"), F.count_distinct("node")).first()
    return rows.dropDuplicates(["node"]) if nodes < 0.9 * n else rows


def similar_classes(rows: DataFrame, docs: DataFrame, words: int, limit: int, least: float) -> DataFrame:
    """(node, component) of the nodes of rows (doc_id, key, fp, node, n, prefix, SKETCH) that are linked with others.

    Each fingerprint is compared with the smallest one of its buckets, and each node with the partner with which it shares most of its
    prefix: a pair or two a node, which join most near copies however many there are of one text. Nodes of crowded shingles are then
    compared with the most central partners. Then the prefixes give every pair of different components that can be similar. Texts of the
    nodes in pairs are read for each step.
    """
    spark = rows.sparkSession
    firsts = settle(rows.groupBy("fp").agg(F.min("node").alias("node")), "simhash-firsts")
    near = star_links(firsts.select("fp"), limit)
    near = near.join(firsts.select(F.col("fp").alias("a"), F.col("node").alias("na")), "a").join(firsts.select(F.col("fp").alias("b"), F.col("node").alias("nb")), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    near = settle(near, "simhash-near")
    reclaim(spark)
    shared = settle(shared_prefixes(_once(rows).select("node", "n", "prefix")), "simhash-shared")
    reclaim(spark)
    stars = star_pairs(shared.withColumn("class", F.col("node")), least)
    pairs = settle(near.union(stars).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "simhash-pairs")
    links = _verified(pairs, rows, docs, words, least)
    placed = _open(shared, components(links, "simhash-close"))
    with scratch() as held:  # the sets of nodes of crowded shingles and what is made of them go when pairs are written
        if not placed.where("crowded").isEmpty():
            placed = promising(placed, least)
        crowded = settle(placed.where("crowded").select("node").distinct(), "simhash-dense")
        if not crowded.isEmpty():
            sets = settle(sets_of(crowded, rows, docs, words), "simhash-sets")
            reclaim(spark)
            own, hubs = own_shingles(placed.where("crowded"), sets)
            reclaim(spark)
            stars = star_pairs(_matched(placed, own, hubs, least, 1).where("crowded"), least, central=True).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            more = settle(similar(settle(stars, "simhash-central"), sets, least), "simhash-links")
            reclaim(spark)
            if not more.isEmpty():
                links = links.union(more)
                placed = _open(placed.select("token", "node", "at", "n"), components(links, "simhash-close"))
            placed = _matched(placed, own, hubs, least, ROUNDS)
            reclaim(spark)
        else:
            placed = placed.withColumn("common", F.col("n").cast("long"))
    rest = settle(prefix_pairs(placed, rows.select("node", *SKETCH).dropDuplicates(["node"]), least), "simhash-rest")
    links = settle(links, "simhash-links")
    release(spark, held)
    reclaim(spark)
    if not rest.isEmpty():
        links = links.union(_verified(rest, rows, docs, words, least))
    return components(links, "simhash")


def _verified(pairs: DataFrame, rows: DataFrame, docs: DataFrame, words: int, least: float) -> DataFrame:
    """Those of the pairs that are similar; the texts of their nodes are shuffled once, and their sets go afterwards."""
    with scratch() as own:
        sets = settle(sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), rows, docs, words), "simhash-sets")
    reclaim(pairs.sparkSession)
    links = settle(similar(pairs, sets, least), "simhash-links")
    release(pairs.sparkSession, own)
    reclaim(pairs.sparkSession)
    return links


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = NEAR_WORDS, limit: int = NEAR_BITS, least: float = NEAR_JACCARD) -> DataFrame:
    """The rows of docs that stay, the one with the smallest id of each group, with all their columns; of repeated rows, one."""
    with scratch() as own:
        groups = simhash_groups(docs, id_col, text_col, words, limit, least)
    of = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component_id").agg(F.min("key").alias("_key"), F.count("*").alias("_n"))
    stay = settle(of.withColumnRenamed("component_id", "_id"), "simhash-stay")
    release(docs.sparkSession, own)
    reclaim(docs.sparkSession)
    repeated = (stay.agg(F.max("_n")).first()[0] or 0) > 1
    keyed = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_own"), F.xxhash64(text_col).alias("_hash"))
    kept = keyed.join(stay, keyed._own.eqNullSafe(stay._id) & (keyed._hash == stay._key), "left_semi")
    return (kept.dropDuplicates(["_own", "_hash"]) if repeated else kept).select("_row.*")

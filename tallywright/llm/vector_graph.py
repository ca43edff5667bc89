"""Near-duplicate vectors by a robust-pruned flat graph.

Vectors are clustered into shards that overlap. Each shard builds a pruned neighbour graph; a vector's lists from all its shards are
united, so edges lead from shard to shard. A vector's search starts at a shard's medoid: greedily towards the vector, and once
among vectors within the range it expands all of those. It begins in every shard that holds the vector. Where edges of vectors within
the range lead to other shards, the search goes on there in the next round, until none leads to a shard that it hasn't seen. Cosines in double precision decide. A search puts out
how many vectors it found and only as many links as join its component; recall is audited against brute force.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import components, settle

LINK_COSINE = 0.95

#: A shard is split while it has more members than MOST, into parts of about PART (64 at a time at most); centroids are fitted
#: on about FITTED of its members, whatever its size. What centroids can't part in DEPTH rounds is dealt out by hash, and each of its
#: vectors is searched for in all of these parts.
MOST, PART, FITTED, DEPTH = 3000, 700, 4096, 5

#: A vector is also put into further shards, OVERLAP in all at most, if their centroids' cosine is at most MARGIN less.
OVERLAP, MARGIN = 3, 0.15

#: Candidates of a vector (the nearest, and some by chance for long ways), its neighbours after pruning, the slack of pruning, and
#: how many of its nearest vectors are made to lead to it.
NEAREST, CHANCE, DEGREE, SLACK, WAYS_IN = 40, 16, 20, 1.2, 4

#: Best vectors that a search keeps until none is left to expand, and how many it expands at a time.
BEAM, STEP = 24, 4

#: Searches of one shard that are one task.
VISITS = 20_000

#: Queries of the audit (a hash picks them), and the recall that a build must reach; else it is done again with more overlap.
AUDITED, LEAST_RECALL = 512, 0.95


def unit(embedding: Column | str) -> Column:
    """The vector in double precision with length 1; null if it, or a component, is null or not finite, or if it is zero.

    Components are divided by the largest of them first, so that no square overflows or vanishes.
    """
    x = F.col(embedding).cast("array<double>") if isinstance(embedding, str) else embedding
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    most = F.array_max(F.transform(x, F.abs))
    scaled = _once(most, lambda m: F.transform(x, lambda v: v / m))
    whole = _once(scaled, lambda s: _once(F.sqrt(F.aggregate(s, F.lit(0.0), lambda a, v: a + v * v)), lambda norm: F.transform(s, lambda v: v / norm)))
    return F.when(~odd & (most > 0), whole)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, not again for each element of an array that is made with it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _centroids(x: np.ndarray, k: int) -> np.ndarray:
    """k-means on the sphere, from rows far apart by chance; the same rows give the same centroids."""
    rng = np.random.default_rng(len(x))
    c = x[rng.choice(len(x), size=min(k, len(x)), replace=False)]
    for _ in range(8):
        near = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), c)
    return c


def shards(points: DataFrame, overlap: int) -> DataFrame:
    """(vec_id, x, n, shard, main) of points (vec_id, x, n): every point in the shard it is closest to (main) and in others nearby.

    Vectors of different lengths are never in one shard. Shards of one clump that had to be dealt out by hash end in #.
    """
    done, todo = None, points.select("vec_id", "x", "n", F.size("x").cast("string").alias("shard"), F.lit(True).alias("main"))
    for depth in range(DEPTH + 1):
        todo = settle(todo.groupBy("shard", "vec_id").agg(F.first("x").alias("x"), F.first("n").alias("n"), F.max("main").alias("main")) if depth else todo, "vector-shards")
        sizes = settle(todo.groupBy("shard").agg(F.count("*").alias("members")), "vector-sizes")
        sized = todo.join(sizes, "shard")
        small = sized.where(F.col("members") <= MOST).select("vec_id", "x", "n", "shard", "main")
        done = small if done is None else done.union(small)
        large = sized.where(F.col("members") > MOST)
        if large.isEmpty():
            return done
        if depth == DEPTH:
            dealt = F.concat("shard", F.lit("#"), F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("members") / PART)).cast("string"))
            return done.union(large.select("vec_id", "x", "n", dealt.alias("shard"), "main"))
        some = large.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) * F.col("members") < F.lit(1_000_000 * FITTED))

        def fit(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("vec_id")
            k = int(min(64, max(2, -(-rows.members.iloc[0] // PART))))
            return pd.DataFrame({"shard": [rows.shard.iloc[0]], "centroids": [_centroids(np.stack(rows.x), k).ravel().tolist()]})

        fitted = settle(some.groupBy("shard").applyInPandas(fit, "shard string, centroids array<double>"), "vector-centroids")

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                for _, part in rows.groupby("shard", sort=False):
                    x = np.stack(part.x)
                    c = np.asarray(part.centroids.iloc[0]).reshape(-1, x.shape[1])
                    cosine = x @ c.T
                    order = np.argsort(-cosine, axis=1, kind="stable")[:, :overlap]
                    near = np.take_along_axis(cosine, order, axis=1)
                    row, rank = np.nonzero(near >= near[:, :1] - MARGIN)
                    out = part.iloc[row]
                    shard = out.shard + "/" + pd.Series(order[row, rank].astype(str), index=out.index)
                    yield pd.DataFrame({"vec_id": out.vec_id, "x": out.x, "n": out.n, "shard": shard, "main": out.main & (rank == 0)})

        # a part's parts: a point may have come here more than once by way of its neighbours
        schema = "vec_id long, x array<double>, n long, shard string, main boolean"
        todo = large.join(fitted, "shard").select("vec_id", "x", "n", "main", "shard", "centroids").mapInPandas(place, schema)
    raise AssertionError("unreachable")


def pruned(x: np.ndarray) -> list[np.ndarray]:
    """Each row's neighbours: of its candidates, nearest first, those that no neighbour chosen before is much closer to.

    In a dense group many rows are nobody's choice, and the few central ones are everybody's. So that every row can be reached,
    WAYS_IN of its nearest rows, those with the fewest such duties so far, name it among their neighbours.
    """
    n = len(x)
    if n < 2:
        return [np.zeros(0, int)] * n
    rng = np.random.default_rng(n)
    lists: list[np.ndarray] = []
    duties, back = np.zeros(n, int), [[] for _ in range(n)]
    for i in range(0, n, 1024):
        cosine = x[i : i + 1024] @ x.T
        cosine[np.arange(len(cosine)), np.arange(i, i + len(cosine))] = -2
        k = min(NEAREST, n - 1)
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        for r in range(len(cosine)):
            far = rng.integers(0, n, CHANCE)
            pool = np.unique(np.concatenate([near[r], far[far != i + r]]))
            lists.append(_prune(x, pool, cosine[r, pool]))
            for j in near[r, np.lexsort((-cosine[r, near[r]], duties[near[r]]))[:WAYS_IN]].tolist():
                back[j].append(i + r)
                duties[j] += 1
    return [np.unique(np.concatenate([mine, np.array(more, dtype=int)])) for mine, more in zip(lists, back, strict=True)]


def _prune(x: np.ndarray, pool: np.ndarray, cosine: np.ndarray) -> np.ndarray:
    order = np.argsort(-cosine, kind="stable")
    pool, away = pool[order], 1 - cosine[order]
    between = 1 - x[pool] @ x[pool].T
    alive, out = np.ones(len(pool), bool), []
    while len(out) < DEGREE and alive.any():
        p = int(np.argmax(alive))
        out.append(pool[p])
        alive &= SLACK * between[p] > away
        alive[p] = False
    return np.array(out, dtype=int)


class Shard:
    """A shard's members (rows in order of vec_id), their edges within it, and the search from its medoid."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values("vec_id")
        self.ids, self.x, self.times, self.main = rows.vec_id.to_numpy(), np.stack(rows.x), rows.n.to_numpy(), rows.main.to_numpy(dtype=bool)
        self.ways = rows.ways.tolist()
        lists = []
        for near in rows.near:
            at = np.minimum(np.searchsorted(self.ids, near), len(self.ids) - 1)
            lists.append(at[self.ids[at] == near])
        self.graph = np.full((len(rows), max([1, *map(len, lists)])), -1)
        for i, mine in enumerate(lists):
            self.graph[i, : len(mine)] = mine
        self.medoid = int(np.argmax(self.x @ self.x.mean(axis=0)))
        self.seen, self.expanded, self.turn = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), 0

    def place(self, vec_id: int) -> int:
        """The row of a vector; -1 for one from elsewhere."""
        at = min(int(np.searchsorted(self.ids, vec_id)), len(self.ids) - 1)
        return at if self.ids[at] == vec_id else -1

    def search(self, own: int, q: np.ndarray, least: float) -> np.ndarray:
        """The rows of cosine ``least`` or more to q that the search comes upon; q itself, row ``own``, is left out."""
        self.turn += 1
        turn, graph, x = self.turn, self.graph, self.x
        nodes = np.array([self.medoid]) if own < 0 else np.unique(np.append(graph[own][graph[own] >= 0], self.medoid))
        cosine = x[nodes] @ q
        self.seen[nodes] = turn
        while True:
            open_ = self.expanded[nodes] != turn
            best = np.zeros(len(nodes), bool)
            top = np.argpartition(-cosine, BEAM)[:BEAM] if len(nodes) > BEAM else np.arange(len(nodes))
            top = top[open_[top]]
            best[top[np.argsort(-cosine[top], kind="stable")[:STEP]]] = True
            go = open_ & (best | (cosine >= least))
            if not go.any():
                break
            self.expanded[nodes[go]] = turn
            new = graph[nodes[go]].ravel()
            new = np.unique(new[new >= 0])
            new = new[self.seen[new] != turn]
            self.seen[new] = turn
            nodes, cosine = np.concatenate([nodes, new]), np.concatenate([cosine, x[new] @ q])
        return nodes[(cosine >= least) & (nodes != own)]


#: Kinds of rows that searches put out: vectors found (a, count), a link (a, b), a shard that the search leads to (a, shard).
FOUND, LINK, WAY = 0, 1, 2


def searched(key: tuple, members: pd.DataFrame, visits: pd.DataFrame, least: float = LINK_COSINE) -> pd.DataFrame:
    """(kind, a, b): what the visits (vec_id, x) to one shard find.

    A vector counts in the shard that it is mainly in only, so that none counts twice. Links that join what earlier ones join
    already are left out. Edges out of the shard are followed from vectors within the range.
    """
    if not len(members) or not len(visits):
        return pd.DataFrame({"kind": pd.Series(dtype="int32"), "a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
    shard = Shard(members)
    label, out = np.arange(len(shard.ids)), []
    visits = visits.sort_values("vec_id")
    for vec_id, q in zip(visits.vec_id.tolist(), visits.x, strict=True):
        own = shard.place(vec_id)
        found = shard.search(own, np.asarray(q), least)
        if not len(found):
            continue
        count = int(shard.times[found[shard.main[found]]].sum())
        if count:
            out.append((FOUND, vec_id, count))
        labels, first = np.unique(label[found], return_index=True)
        mine = label[own] if own >= 0 else -1
        out += [(LINK, vec_id, int(shard.ids[found[j]])) for k, j in zip(labels, first, strict=True) if k != mine]
        if len(labels) > 1 or labels[0] != mine:
            label[np.isin(label, np.append(labels, mine))] = found[first[0]] if own < 0 else own
        out += [(WAY, vec_id, w) for w in set().union(*(shard.ways[i] for i in found))]
    return pd.DataFrame(out, columns=["kind", "a", "b"]).astype({"kind": "int32", "a": "int64", "b": "int64"})


def links(points: DataFrame, least: float = LINK_COSINE, overlap: int = OVERLAP) -> tuple[DataFrame, DataFrame]:
    """(a, near) and (a, b) of distinct points (vec_id, x of length 1, n): the sum of n of those found in range, and links that join all that was found."""
    part = F.xxhash64("shard").alias("part")
    placed = shards(points, overlap).groupBy("shard", "vec_id").agg(F.first("x").alias("x"), F.first("n").alias("n"), F.max("main").alias("main"))
    members = settle(placed.select(part, F.when(F.col("shard").contains("#"), F.xxhash64(F.regexp_replace("shard", "#.*", ""))).alias("clump"), "vec_id", "x", "n", "main"), "vector-members")

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id")
        ids = rows.vec_id.to_numpy()
        return pd.DataFrame({"vec_id": ids, "near": [ids[m].tolist() for m in pruned(np.stack(rows.x))]})

    lists = members.select("part", "vec_id", "x").groupBy("part").applyInPandas(build, "vec_id long, near array<long>")
    united = settle(lists.groupBy("vec_id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "vector-lists")  # OVERLAP lists a level at most
    home = settle(members.where("main").select(F.col("vec_id").alias("_id"), F.col("part").alias("home")), "vector-homes")
    edges = united.select("vec_id", F.explode("near").alias("_id")).join(home, "_id").groupBy("vec_id").agg(F.collect_set("home").alias("ways"))
    graph = settle(united.join(edges, "vec_id", "left").select("vec_id", "near", F.coalesce("ways", F.array().cast("array<long>")).alias("ways")), "vector-graph")
    nodes = settle(members.join(graph, "vec_id").select("part", "clump", "vec_id", "x", "n", "main", "near", F.array_except("ways", F.array("part")).alias("ways")), "vector-nodes")
    siblings = nodes.where("clump is not null").select("clump", "part").distinct().groupBy("clump").agg(F.collect_set("part").alias("parts"))
    first = nodes.select("vec_id", F.array("part").alias("to")).union(nodes.where("main").join(siblings, "clump").select("vec_id", F.col("parts").alias("to")))
    seen = settle(first.select("vec_id", F.explode("to").alias("part")).distinct(), "vector-visits")
    visits, results = seen, None
    while True:
        found = settle(_round(nodes, visits, points, least), "vector-found")
        results = found if results is None else results.union(found)
        new = found.where(F.col("kind") == WAY).select(F.col("a").alias("vec_id"), F.col("b").alias("part")).distinct()
        visits = settle(new.join(seen, ["vec_id", "part"], "left_anti"), "vector-visits")
        if visits.isEmpty():
            break
        seen = seen.union(visits)
    near = results.where(F.col("kind") == FOUND).groupBy("a").agg(F.sum("b").alias("near"))
    return near, results.where(F.col("kind") == LINK).select("a", "b")


def _round(nodes: DataFrame, visits: DataFrame, points: DataFrame, least: float) -> DataFrame:
    """What visits (vec_id, part) find. A shard with many visits is several tasks, each with all its members."""
    tasks = settle(visits.groupBy("part").agg(F.ceil(F.count("*") / VISITS).cast("int").alias("tasks")), "vector-tasks")
    asked = visits.join(tasks, "part").withColumn("task", F.pmod(F.xxhash64("vec_id"), F.col("tasks")).cast("int")).join(points.select("vec_id", "x"), "vec_id").select("part", "task", "vec_id", "x")
    there = nodes.join(tasks, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), "vec_id", "x", "n", "main", "near", "ways")

    def search(key: tuple, members: pd.DataFrame, visits: pd.DataFrame) -> pd.DataFrame:
        return searched(key, members, visits, least)

    return there.groupBy("part", "task").cogroup(asked.groupBy("part", "task")).applyInPandas(search, "kind int, a long, b long")


def audit(points: DataFrame, near: DataFrame, least: float = LINK_COSINE, queries: int = AUDITED) -> float:
    """The share of a sample of queries' links, by brute force over all points (vec_id, x, n), that was found; 1 if there are none."""
    some = points.orderBy(F.xxhash64("vec_id")).limit(queries).select("vec_id", "x").collect()
    if not some:
        return 1.0
    shared = points.sparkSession.sparkContext.broadcast([(r.vec_id, np.array(r.x)) for r in some])  # bounded by ``queries``

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for size, part in rows.groupby(rows.x.map(len), sort=False):
                ids, x, n = part.vec_id.to_numpy(), np.stack(part.x), part.n.to_numpy()
                asked = [(i, q) for i, q in shared.value if len(q) == size]
                if asked:
                    close = np.stack([q for _, q in asked]) @ x.T >= least
                    close &= np.array([i for i, _ in asked])[:, None] != ids[None, :]
                    yield pd.DataFrame({"a": [i for i, _ in asked], "true": (close * n).sum(axis=1)})

    true = points.select("vec_id", "x", "n").mapInPandas(compare, "a long, true long").groupBy("a").agg(F.sum("true").alias("true"))
    row = true.join(near, "a", "left").agg(F.sum("true").alias("true"), F.sum(F.coalesce("near", F.lit(0))).alias("near")).first()
    return row.near / row.true if row.true else 1.0


def near_vectors(vectors: DataFrame, least: float = LINK_COSINE, overlap: int = OVERLAP, least_recall: float = LEAST_RECALL) -> DataFrame:
    """One row per vector of vectors (vec_id, embedding): vec_id, n_links, component_id, kept, recall.

    Vectors that are null or zero or hold null or non-finite components link with nothing; so do vectors with a null id, and
    component_id is their own id. Vectors of different lengths never link. Equal vectors are searched for once and count as often
    as they come; so do repeated rows. An empty table gives an empty result. recall is what the audit found. If that is too little,
    all is built again with twice the overlap; after three builds the operator gives up with an error.
    """
    rows = vectors.select("vec_id", unit("embedding").alias("x"))
    rows = settle(rows.withColumn("x", F.when(F.col("vec_id").isNotNull(), F.col("x"))), "vector-rows")
    known = rows.where("x is not null")
    kinds = settle(known.groupBy("x").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n")), "vector-kinds")
    # an id that stands for several vectors would be one node: such vectors get ids of their own in the graph
    twice = kinds.groupBy("vec_id").agg(F.count("*").alias("k")).where("k > 1")
    points = kinds if twice.isEmpty() else settle(kinds.select("x", "n", F.xxhash64("vec_id", "x").alias("vec_id")), "vector-points")
    for _ in range(3):
        near, found = links(points, least, overlap)
        near = settle(near, "vector-near")
        recall = audit(points, near, least)
        if recall >= least_recall:
            break
        overlap *= 2
    else:
        raise RuntimeError(f"the audit found a recall of {recall:.3f}")
    classes = components(found, "vector")
    of = points.join(near, points.vec_id == near.a, "left").join(classes, points.vec_id == classes.node, "left").select(points.x, points.n, F.coalesce("near", F.lit(0)).alias("near"), F.coalesce("component", points.vec_id).alias("class"))
    of = settle(of.join(kinds.select(F.col("x").alias("_x"), F.col("vec_id").alias("low")), F.col("x") == F.col("_x")).drop("_x"), "vector-classes")
    lowest = settle(of.groupBy("class").agg(F.min("low").alias("component_id")), "vector-lowest")
    of = of.join(lowest, "class").select(F.col("x").alias("_x"), (F.col("near") + F.col("n") - 1).alias("n_links"), "component_id")
    joined = known.join(of, known.x == of._x).select("vec_id", "n_links", "component_id")
    alone = rows.where("x is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))).withColumn("recall", F.lit(float(recall)))

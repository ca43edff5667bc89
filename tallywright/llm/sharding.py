"""Balanced label propagation over groups of linked documents.

Documents that share a group are linked. Those of one group and shard are alike, so the state is a table of cells (group, shard,
n). Each round joins every cell with its group's largest open cell, the neighbours' shard it would move to; counts the wishes
from shard to shard; grants those that go around in cycles or that a shard has room for; and lets the moves with most neighbours go first. Documents
without links then fill every shard to its exact quota of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallywright.llm.common import bucket_of, running, settle

SHARDS = 8
ROUNDS = 12


def _cycle(left: dict[tuple[int, int], int], shards: int) -> list[tuple[int, int]]:
    """Wishes that lead around from a shard to itself, the shortest such way; none if there is none."""
    for start in range(shards):
        ways = {start: [start]}
        todo = [start]
        for i in todo:
            for j in range(shards):
                if left.get((i, j), 0) and j == start:
                    return list(zip(ways[i], [*ways[i][1:], start], strict=True))
                if left.get((i, j), 0) and j not in ways:
                    ways[j] = [*ways[i], j]
                    todo.append(j)
    return []


def _quotas(wishes: dict[tuple[int, int], int], held: list[int], caps: list[int]) -> dict[tuple[int, int], int]:
    """How many may go from shard to shard: around cycles of wishes, which leave sizes as they are, and into what room there is."""
    left, grant = dict(wishes), dict.fromkeys(wishes, 0)
    while way := _cycle(left, len(caps)):
        n = min(left[step] for step in way)
        for step in way:
            left[step] -= n
            grant[step] += n
    room, moved = [cap - h for cap, h in zip(caps, held, strict=True)], True
    while moved:
        moved = False
        for i, j in sorted(left):
            if n := min(left[i, j], max(0, room[j])):
                left[i, j] -= n
                grant[i, j] += n
                room[i], room[j], moved = room[i] + n, room[j] - n, True
    return grant


def _round(cells: DataFrame, caps: list[int], shards: int, turn: int) -> tuple[DataFrame, int]:
    """The cells after one round, and how many documents moved. Of equally large cells another one attracts in each turn."""
    held = {r.shard: r.n for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row a shard
    held = [held.get(j, 0) for j in range(shards)]
    open_to = [j for j in range(shards) if held[j] < caps[j]] or list(range(shards))
    weigh = F.struct("n", F.xxhash64("grp", "shard", F.lit(turn)).alias("tie"), "shard")
    best = cells.where(F.col("shard").isin(open_to)).groupBy("grp").agg(F.max(weigh).alias("best"))
    wish = cells.join(best, "grp").where(weigh < F.col("best")).select("grp", "n", F.col("shard").alias("i"), F.col("best.shard").alias("j"), F.col("best.n").alias("gain"))
    wish = settle(wish, "shard-wishes")
    wanted = {(r.i, r.j): r.n for r in wish.groupBy("i", "j").agg(F.sum("n").alias("n")).collect()}  # a row a pair of shards
    grant = {k: v for k, v in _quotas(wanted, held, caps).items() if v}
    if not grant:
        return cells, 0
    quota = F.create_map(*[F.lit(x) for (i, j), v in grant.items() for x in (i * shards + j, v)])
    order = (F.lit(63) - F.floor(F.log2("gain"))) * 64 + F.pmod(F.xxhash64("grp"), F.lit(64))
    lined = running(wish.withColumn("_part", order.cast("int")), ["i", "j"], "_part", [F.desc("gain"), F.col("grp")], F.col("n"), "before")
    most = F.coalesce(F.element_at(quota, F.col("i") * shards + F.col("j")), F.lit(0))
    moves = settle(lined.withColumn("go", F.least("n", most - F.col("before"))).where("go > 0").select("grp", "i", "j", "go"), "shard-moves")
    change = moves.select("grp", F.col("j").alias("shard"), F.col("go").alias("n")).union(moves.select("grp", "i", (-F.col("go")).alias("n")))
    after = settle(cells.union(change).groupBy("grp", "shard").agg(F.sum("n").alias("n")).where("n > 0"), "shard-cells")
    return after, moves.agg(F.coalesce(F.sum("go"), F.lit(0))).first()[0]


def balanced_shards(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document; row counts of shards differ by one at most.

    Linked are documents of equal text. A null text counts as empty: size 1, CRC-32 of nothing. Null and repeated ids are rows
    like others, each with a slot of its own. An empty table gives an empty result, and other columns of docs are ignored. A
    group larger than a shard fills shards one by one. Placement is a function of the rows alone, not of their order.
    """
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), raw.alias("raw")).select("doc_id", (F.octet_length("raw") + 1).cast("long").alias("size"), F.crc32("raw").alias("text_crc32"), F.unhex(F.sha2("raw", 256)).alias("grp"))
    rows = settle(rows.withColumn("_part", bucket_of("doc_id", "grp")), "shard-rows")
    order, one = [F.col("doc_id"), F.col("grp")], F.lit(1)
    groups = settle(rows.groupBy("grp").agg(F.count("*").alias("of")), "shard-groups")  # written first, so that the join with a large group can be split
    known = settle(rows.join(groups, "grp"), "shard-known")
    n = known.count()
    caps = [n // shards + (j < n % shards) for j in range(shards)]
    linked, alone = known.where("of > 1").drop("of"), known.where("of = 1").drop("of")

    first = running(linked, [], "_part", order, one, "rank").select("grp", F.pmod("rank", F.lit(shards)).cast("int").alias("shard"))
    cells = settle(first.groupBy("grp", "shard").agg(F.count("*").alias("n")), "shard-cells")
    stuck = 0
    for turn in range(rounds):
        cells, moved = _round(cells, caps, shards, turn)
        stuck = 0 if moved else stuck + 1
        if stuck == 2:
            break

    upto = F.sum("n").over(Window.partitionBy("grp").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    spans = settle(cells.withColumn("upto", upto).groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("upto", "shard"))).alias("spans")), "shard-spans")  # a span a shard at most
    ranked = running(linked, ["grp"], "_part", order, one, "rank").join(spans, "grp")
    linked = ranked.withColumn("shard", F.get(F.filter("spans", lambda s: s.upto > F.col("rank")), F.lit(0))["shard"]).drop("rank", "spans")

    held = {r.shard: r.n for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    shard, upto = F.lit(None).cast("int"), n - sum(held.values())
    for j in reversed(range(shards)):
        shard = F.when(F.col("rank") < upto, F.lit(j)).otherwise(shard)
        upto -= caps[j] - held.get(j, 0)
    alone = running(alone, [], "_part", order, one, "rank").withColumn("shard", shard).drop("rank")
    placed = settle(linked.unionByName(alone), "shard-placed")
    return running(placed, ["shard"], "_part", order, one, "slot").select("doc_id", "size", "text_crc32", "shard", "slot")


def cut_share(placed: DataFrame, group: str = "text") -> DataFrame:
    """Of the links between documents of equal text (the pairs, counted without making them), the share that lies across shards; of placed documents with their texts."""
    cells = placed.groupBy(group, "shard").agg(F.count("*").alias("n"))
    groups = cells.groupBy(group).agg((F.sum("n") * (F.sum("n") - 1) / 2).alias("links"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("kept"))
    return groups.agg(F.coalesce(1 - F.sum("kept") / F.sum("links"), F.lit(0.0)).alias("cut_share"))

"""Sharding by balanced label propagation, as DataFrame operations only.

Documents carry links to groups; members of one group are neighbours. A first
guess cuts the corpus, in the order of the groups' hashes, into shards of equal
bytes. Then every round joins the groups' weights per shard to their members: a
document wants the shard that holds most of its neighbours. Wishes between two
shards are granted up to what the other side gives back plus a share of the
room below the quota, whole groups first. A last step moves documents without
neighbours from the fullest shards to the emptiest.

Only numbers per shard or pair of shards come to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabsmith.llm.common import before, c
from tabsmith.session import materialise


def _sizes(nodes: DataFrame, shards: int) -> list[int]:
    """Bytes of each shard."""
    found = {r["shard"]: r["w"] for r in nodes.groupBy("shard").agg(F.sum("size").alias("w")).collect()}
    return [int(found.get(s, 0)) for s in range(shards)]


def _chosen(pairs: list[tuple[Column, Column]], otherwise: Column) -> Column:
    out = otherwise
    for test, value in pairs:
        out = F.when(test, value).otherwise(out)
    return out


def _round(nodes: DataFrame, shards: int, quota: float, rows: int) -> DataFrame | None:
    """One round of propagation; None when no document may move."""
    held = nodes.groupBy("group", "shard").agg(F.sum("size").alias("w"))
    # Of equally heavy shards every group has its own favourite, so wishes go both ways.
    favourite = F.xxhash64("group", "shard").alias("h")
    best = held.groupBy("group").agg(F.max(F.struct("w", favourite, "shard")).alias("b"), F.count("*").alias("k"))
    best = best.filter("k > 1").select("group", F.col("b.shard").alias("want"))
    wishes = materialise(nodes.join(best, "group", "left"), "shard-wishes")
    moving = F.col("want").isNotNull() & (F.col("want") != F.col("shard"))
    flows = {(r["shard"], r["want"]): r["w"] for r in wishes.filter(moving).groupBy("shard", "want").agg(F.sum("size").alias("w")).collect()}
    if not flows:
        return None
    sizes = _sizes(nodes, shards)
    mean = sum(sizes) / shards
    allowed = {}
    for (i, j), w in flows.items():
        room = max(0.0, min(quota * mean - sizes[j], sizes[i] - (2 - quota) * mean)) / shards
        allowed[i, j] = min(w, flows.get((j, i), 0) + room)
    if not any(allowed.values()):
        return None
    # A wish's order is that of its group's hash, so a group moves as a whole where it can.
    ordered = before(materialise(wishes.filter(moving), "shard-moves"), ["shard", "want"], "key", F.col("size"), "_before", rows)
    limit = _chosen([((F.col("shard") == i) & (F.col("want") == j), F.lit(float(a))) for (i, j), a in allowed.items()], F.lit(0.0))
    moved = ordered.withColumn("shard", F.when(F.col("_before") + F.col("size") <= limit, F.col("want")).otherwise(F.col("shard")))
    return wishes.filter(~moving).drop("want").unionByName(moved.drop("want", "_before"))


def _settle(nodes: DataFrame, shards: int, rows: int) -> DataFrame:
    """Move documents without neighbours from shards above the mean to those below."""
    sizes = _sizes(nodes, shards)
    mean = sum(sizes) / shards
    over = [max(0.0, s - mean) for s in sizes]
    alone = nodes.groupBy("group").agg(F.count("*").alias("members")).filter("members = 1").select("group")
    donors = F.col("shard").isin([i for i in range(shards) if over[i] > 0] or [-1])
    free = materialise(nodes.filter(donors).join(alone, "group", "left_semi"), "shard-free")
    rest = nodes.join(free.select("row"), "row", "left_anti")
    placed = before(free, ["shard"], "key", F.col("size"), "_before", rows)
    middle = F.col("_before") + F.col("size") / 2
    surplus = _chosen([(F.col("shard") == i, F.lit(o)) for i, o in enumerate(over)], F.lit(0.0))
    starts = [(F.col("shard") == i, F.lit(float(sum(over[:i])))) for i in range(shards)]
    spot = _chosen(starts, F.lit(0.0)) + middle
    takers, reached = [], 0.0
    for j, s in enumerate(sizes):
        if s < mean:
            takers.append(((spot >= reached) & (spot < reached + mean - s), F.lit(j)))
            reached += mean - s
    shard = F.when(middle < surplus, _chosen(takers, F.col("shard"))).otherwise(F.col("shard"))
    return rest.unionByName(placed.withColumn("shard", shard.cast("int")).drop("_before"))


def shard(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    group: Column | None = None,
    shards: int = 8,
    slack: float = 0.01,
    rounds: int = 3,
) -> DataFrame:
    """Put every document into one of `shards` shards of near equal bytes.

    Columns: doc_id, size (UTF-8 bytes plus 1), text_crc32, law (`bytes`),
    shard, slot (gapless from 0 in its shard) and grown_shard (null under this
    law). `group` names the neighbours of a document, by default its text:
    equal texts stay together as far as the quota of 1 + `slack` times the
    mean allows. A null text has size 1 and is equal to other null texts, not
    to empty ones. Ids are carried along only, so null and repeated ids are
    fine. An empty table gives no rows.
    """
    text = c(text_col).cast("string")
    whole = F.coalesce(text, F.lit(""))
    same = group if group is not None else F.md5(F.coalesce(F.concat(F.lit("t"), text), F.lit("")).cast("binary"))
    rows = docs.select(
        c(id_col).alias("doc_id"),
        (F.octet_length(whole) + 1).cast("long").alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"),
        same.cast("string").alias("group"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumn("key", F.md5(F.coalesce("group", F.lit("")).cast("binary")))
    rows = materialise(rows, "shard-rows").withColumn("_all", F.lit(0))
    n, total = (rows.agg(F.count("*"), F.sum("size")).first())
    placed = before(rows, ["_all"], "key", F.col("size"), "_before", n).drop("_all")
    guess = F.least(F.floor((F.col("_before") + F.col("size") / 2) * shards / F.lit(float(total or 1))), F.lit(shards - 1))
    nodes = materialise(placed.withColumn("shard", guess.cast("int")).drop("_before"), "shard-guess")
    for _ in range(rounds):
        step = _round(nodes, shards, 1 + slack, n)
        if step is None:
            break
        nodes = materialise(step, "shard-round")
    nodes = materialise(_settle(nodes, shards, n), "shard-settled")
    slots = before(nodes.withColumn("_one", F.lit(1)), ["shard"], "key", F.col("_one"), "slot", n)
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )

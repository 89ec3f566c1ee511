"""A dataset manifest: Merkle trees over rows, stored by content and read by descent.

Rows are the leaves of one tree per group; the groups' subroots are the leaves
of a last tree, whose root names the whole dataset. A node is the hash of up to
`FANOUT` children, and the store holds one record per node: its digest and its
children's digests. Nothing else ties the levels together, so a record can be
checked alone and equal subtrees share their records.

A proof is read from the store: requests for leaves descend from the root, the
digits of a leaf's rank in base `FANOUT` choose the child at every level, and
the children that are not chosen are collected. Requests that share a path
travel as one row until it parts. The collected segments, reversed, lead from
the leaf back to the root.

The store is a folder of Parquet tables:
  records  (tree, height, digest, slot, children); `tree` is 'group' or 'top'
  groups   (g, n, height, subroot, rank): one row per group
  leaves   (g, rank, leaf and the columns that were carried along)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tabsmith.llm.common import c
from tabsmith.session import materialise, scratch_path

BITS = 3
FANOUT = 1 << BITS
#: A digest that stands at many places of a tree is looked up in this many slots.
SLOTS = 64
SEGMENT = "struct<before: string, after: string>"


def field(value: Column) -> Column:
    """A value with its length before it, so that no two rows write the same; null is a dash."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def row_digest(values: list[Column]) -> Column:
    """The leaf of a row: the hash of its values, each with its length."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def group_key(value: Column) -> Column:
    """A key that is never null and sorts null first, then by the bytes of the value."""
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), value.cast("string")))


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Add `rank`, from 0 within each group `g` by the order given, and `n`, the group's rows.

    The rows are range-sorted once by group and order, over as many tasks as
    the session has shuffle partitions; a group's counts per range carry the
    ranks on, so a group of any size is spread. Rows that are equal in the
    order, copies included, are told apart by where they were read.
    """
    keys = [F.col("g"), *order, F.col("_read")]
    spread = rows.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    stored = materialise(spread.drop("_read").withColumn("_at", F.monotonically_increasing_id()), "manifest-order")
    stored = stored.withColumn("_part", F.shiftright("_at", 33))
    per = stored.groupBy("g", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    group = W.partitionBy("g")
    earlier = group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    per = per.select(
        "g", "_part", (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_rows").over(group).alias("n")
    )
    return stored.join(per, ["g", "_part"]).withColumn("rank", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def _run(children: Column) -> Column:
    """The digests of one run in one string."""
    return F.array_join(children, "")


def _build(leaves: DataFrame, path: str, tree: str) -> DataFrame:
    """Write the records above the leaves (g, rank, n, digest); returns the roots (g, n, height, digest).

    Each level is one grouping by group and run; a run has at most `FANOUT`
    nodes, so no key is hot, and a level has an eighth of the rows below it.
    """
    spark = leaves.sparkSession
    nodes, height, roots = leaves.select("g", "rank", F.col("n").alias("size"), "n", "digest"), 0, []
    while True:
        roots.append(nodes.filter("n = 1").select("g", F.col("size").alias("n"), F.lit(height).alias("height"), "digest"))
        nodes = nodes.filter("n > 1")
        most = nodes.agg(F.max("n")).first()[0]
        if most is None:
            break
        height += 1
        runs = nodes.groupBy("g", F.shiftright("rank", BITS).alias("rank"), "size", F.shiftright(F.col("n") + (FANOUT - 1), BITS).alias("n"))
        made = runs.agg(F.array_sort(F.collect_list(F.struct("rank", "digest"))).alias("_run"))
        made = made.withColumn("children", F.col("_run.digest")).drop("_run").withColumn("digest", F.sha2(_run(F.col("children")), 256))
        nodes = materialise(made, "manifest-level")
        records = nodes.select("digest", _slot(F.col("rank")).alias("slot"), "children").dropDuplicates(["digest", "slot"])
        records.write.parquet(f"{path}/records/tree={tree}/height={height}")
        nodes = nodes.drop("children")
    found = roots[0]
    for more in roots[1:]:
        found = found.unionByName(more)
    return materialise(found, "manifest-roots")


def _slot(rank: Column) -> Column:
    return (rank % SLOTS).cast("int")


@dataclass
class Manifest:
    """A written manifest: the folder and the digest of the whole dataset (None where it has no rows)."""

    spark: SparkSession
    path: str
    root: str | None
    leaves: DataFrame

    def records(self, tree: str, height: int) -> DataFrame:
        kinds = "digest string, slot int, children array<string>"
        return self.spark.read.schema(kinds).parquet(f"{self.path}/records/tree={tree}/height={height}")

    def groups(self) -> DataFrame:
        kinds = "g string, n long, height int, subroot string, rank long"
        return self.spark.read.schema(kinds).parquet(f"{self.path}/groups")


def write_manifest(rows: DataFrame, path: str, leaf: Column, group: Column, order: list[Column], carry: dict[str, Column] | None = None) -> Manifest:
    """Write the manifest of a table and return it.

    `leaf` is the digest of a row, `group` names its tree (null is a group of
    its own), `order` ranks the rows of a group; rows that agree in it follow
    their leaf. `carry` names columns to keep beside the leaves; their names
    may be any but g, rank, n and leaf. The table is read once and only
    digests, the order and the carried columns are moved. An empty table has
    empty tables and no root.
    """
    spark, carry = rows.sparkSession, carry or {}
    by = [f"_order{i}" for i in range(len(order))]
    read = rows.select(
        group_key(group).alias("g"), leaf.alias("leaf"), *[o.alias(n) for n, o in zip(by, order)], *[v.alias(n) for n, v in carry.items()]
    )
    placed = ranked(materialise(read, "manifest-leaves"), [F.col(n).asc_nulls_last() for n in by] + [F.col("leaf")])
    placed = placed.drop(*by)
    placed.write.parquet(f"{path}/leaves")
    leaves = spark.read.schema(placed.schema).parquet(f"{path}/leaves")
    subroots = _build(leaves.withColumnRenamed("leaf", "digest"), path, "group")
    top = subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("n").alias("rows"), "height", "digest")
    top = materialise(ranked(top, [F.col("name")]), "manifest-top")
    groups = top.select(F.col("name").alias("g"), F.col("rows").alias("n"), "height", F.col("digest").alias("subroot"), "rank")
    groups.write.parquet(f"{path}/groups")
    found = _build(top.select("g", "rank", "n", "digest"), path, "top").select("digest").first()
    return Manifest(spark, path, found["digest"] if found else None, leaves)


def _open(frontier: DataFrame, records: DataFrame) -> DataFrame:
    """The children of each node of the frontier, looked up by digest."""
    nodes = frontier.withColumn("slot", _slot(F.col("pos")))
    return nodes.join(records, ["digest", "slot"]).drop("digest", "slot")


def _choose(opened: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of `wanted` (g, pos, ...) with the chosen child's digest and one segment more."""
    digit = F.col("pos").bitwiseAND(F.lit(FANOUT - 1)).cast("int")
    before = _run(F.slice("children", F.lit(1), digit))
    after = _run(F.slice("children", digit + 2, F.lit(FANOUT)))
    segment = F.array(F.struct(before.alias("before"), after.alias("after")))
    met = wanted.withColumn("_up", F.shiftright("pos", BITS)).join(opened.withColumnRenamed("pos", "_up"), ["g", "_up"])
    return met.withColumn("digest", F.get("children", digit)).withColumn("segments", F.concat("segments", segment)).drop("children", "_up")


def _descend(store: Manifest, tree: str, starts: DataFrame, requests: DataFrame) -> DataFrame:
    """From the trees' roots `starts` (g, height, digest, segments, ...) to the requested leaves (g, pos, ...).

    At every height the frontier has one row per node that some request passes,
    so what is collected above is carried once for all leaves below it.
    """
    heights = [r[0] for r in starts.select("height").distinct().collect()]
    top = max(heights, default=0)
    wanted = [requests]
    for _ in range(1, top):
        wanted.append(materialise(wanted[-1].select("g", F.shiftright("pos", BITS).alias("pos")).distinct(), "manifest-wanted"))
    carried = None
    for height in range(top, 0, -1):
        fresh = starts.filter(F.col("height") == height).drop("height").withColumn("pos", F.lit(0).cast("long"))
        carried = fresh if carried is None else carried.unionByName(fresh)
        carried = _choose(_open(carried, store.records(tree, height)), wanted[height - 1])
    lone = requests.filter("pos = 0").join(starts.filter("height = 0").drop("height"), "g")
    return lone if carried is None else carried.unionByName(lone)


def prove(store: Manifest, requests: DataFrame) -> DataFrame:
    """Paths for requested leaves: rows of (g, rank) and any further columns.

    Adds `digest` (the leaf as the store has it), `subroot` and `path`, an
    array of (before, after) from the leaf to the root: the siblings' digests
    on either side, joined. A rank that the group does not have, or a group
    that the manifest does not have, gives no row; repeated requests give one
    row each. Further columns may not be named pos, digest, subroot or path.
    """
    groups = store.groups()
    if store.root is None:
        kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields] + ["digest string", "subroot string", f"path array<{SEGMENT}>"])
        return store.spark.createDataFrame([], kinds)
    whole = groups.agg(F.max("rank").alias("last")).first()["last"] + 1
    height = 0
    while whole > 1:
        whole, height = -(-whole // FANOUT), height + 1
    empty = F.array().cast(f"array<{SEGMENT}>")
    one = store.spark.range(1).select(F.lit("").alias("g"), F.lit(height).alias("height"), F.lit(store.root).alias("digest"), empty.alias("segments"))
    names = groups.select(F.lit("").alias("g"), F.col("rank").alias("pos"), F.col("g").alias("name"), F.col("height").alias("own"), "n")
    tops = materialise(_descend(store, "top", one, names), "manifest-subroots")
    starts = tops.select(F.col("name").alias("g"), F.col("own").alias("height"), F.col("digest").alias("subroot"), "digest", "segments")
    found = _descend(store, "group", starts, requests.withColumnRenamed("rank", "pos"))
    return found.filter("digest is not null").withColumn("path", F.reverse("segments")).withColumnRenamed("pos", "rank").drop("segments")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda digest, s: F.sha2(F.concat(s["before"], digest, s["after"]), 256))


def proof_digest(path: Column) -> Column:
    """The hash of all siblings, level by level from the leaf, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


#: Letters that tampering changes.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tampered_proofs(docs: DataFrame) -> DataFrame:
    """Leaf, subroot, root and proof of every document, checked against tampered texts.

    Columns: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.
    Texts are put in lower case where 3 divides the CRC-32 of the id; their
    paths then lead to another root unless nothing changed. Nulls are leaves of
    their own kind: a null language is a group, a null id is never tampered
    with and stands last in its group, a null text stays null. Documents that
    share an id follow their leaf, equal rows get proofs of neighbouring
    places. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    rows = docs.select(*[c(n) for n in names])
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate("text", UPPER, LOWER))
    other = F.when(changed.isNotNull() & (changed != F.col("text")), row_digest([*[F.col(n) for n in names[:-1]], changed]))
    store = write_manifest(
        rows, scratch_path(spark, "manifest"), row_digest([F.col(n) for n in names]), F.col("lang"), [F.col("doc_id")],
        {"doc_id": F.col("doc_id"), "tampered": other},
    )
    found = prove(store, store.leaves.select("g", "rank", "doc_id", "leaf", "tampered"))
    folded = fold(F.coalesce("tampered", "leaf"), F.col("path"))
    root = F.lit(store.root).cast("string")
    done = found.select("doc_id", "leaf", "subroot", root.alias("root"), proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))

"""Near-duplicate vectors: random-hyperplane signs in several tables, exact cosines, components.

Equal vectors of one label are one class. A class gets a signature of `bits`
signs per table; classes that agree on a whole signature meet in a bucket. Two
vectors at an angle agree in a sign with probability 1 - angle / pi. A label of
1024 classes has 16 bits, and a bit comes with every doubling of the largest
label, so buckets keep their size while the table grows. The number of tables
follows the bits, so that of the pairs at the least cosine, the hardest ones,
less than one in 30 000 is missed: 25 tables of 16 bits at 0.98, 31 of 19, 42
of 23.

Buckets are compared block by block: a bucket's rows are dealt to blocks by
hash, and each pair of blocks is one group, so a hot bucket becomes many tasks
of bounded size. A group multiplies two matrices, counts links per row and
keeps a spanning forest of them; pairs are never written out. A pair is counted
in the first table in which it meets, which both signatures tell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tabsmith.llm.common import c
from tabsmith.llm.components import components
from tabsmith.session import materialise

#: Rows of a bucket's block, about.
BLOCK = 1024
#: Bits for a label of so many classes, the most bits, and the share of pairs at the least cosine that may be missed.
LEAST_BITS, LABEL_ROWS, MOST_BITS, MISSED = 16, 1024, 30, 1 / 30_000


def table_plan(most: int, least: float) -> tuple[int, int]:
    """(tables, bits) for the classes of the largest label and the least cosine."""
    bits = min(MOST_BITS, LEAST_BITS + max(0, math.ceil(math.log2(max(most, 1) / LABEL_ROWS))))
    meet = (1 - math.acos(max(-1.0, min(1.0, least))) / math.pi) ** bits
    return (1 if meet == 1 else math.ceil(math.log(MISSED) / math.log1p(-meet))), bits


def _planes(dims: int, tables: int, bits: int) -> np.ndarray:
    """The hyperplanes: fixed by the dimension, so that every task and every run has the same."""
    return np.random.default_rng([7, dims]).standard_normal((dims, tables * bits))


def _signatures(classes: DataFrame, tables: int, bits: int) -> DataFrame:
    """Add `sigs`, one signature per table, to (node, label, members, embedding)."""
    schema = T.StructType([*classes.schema.fields, T.StructField("sigs", T.ArrayType(T.IntegerType()))])
    at = classes.columns.index("embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = (1 << np.arange(bits)).astype(np.int64)
        for b in batches:
            rows = b.column(at).to_pylist()
            out: list = [None] * len(rows)
            lengths = np.array([len(r) for r in rows])
            for dims in np.unique(lengths):
                where = np.flatnonzero(lengths == dims)
                signs = np.array([rows[i] for i in where], dtype=np.float64) @ _planes(int(dims), tables, bits) > 0
                sigs = signs.reshape(len(where), tables, bits) @ powers
                for i, s in zip(where, sigs):
                    out[i] = s.tolist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int32()))], names=[*b.schema.names, "sigs"])

    return classes.mapInArrow(run, schema)


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Of the edges (a[i], b[i]) those that join two trees."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = top(x), top(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    least: float = 0.98,
    tables: int | None = None,
    bits: int | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of `vectors`.

    Two rows link when their labels are equal and not null, their vectors have
    the same length and the cosine in double precision is at least `least`.
    Null, empty and zero vectors and those with null or non-finite components
    link with nothing, so do rows without a label; their component is their own
    id. `n_links` counts the other rows that link directly, equal vectors
    included. `tables` and `bits` are worked out by `table_plan` where one is
    not given. Rows of one id are rows of their own; a component's id is the
    smallest id in it, null where it has none. An empty table gives no rows.
    """
    rows = vectors.select(
        c(id_col).alias("vec_id"), c(label_col).alias("label"), c(vector_col).cast("array<double>").alias("embedding")
    ).withColumn("row", F.monotonically_increasing_id())
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    key = F.when(usable, F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.hex(F.to_json(F.struct("embedding")).cast("binary"))), 256))
    rows = materialise(rows.withColumn("key", key), "vectors")
    classes = rows.filter("key is not null").groupBy("key").agg(
        F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count("*").alias("members")
    ).withColumn("node", F.monotonically_increasing_id())
    classes = materialise(classes, "vector-classes")
    if tables is None or bits is None:
        most = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        tables, bits = table_plan(most, least)
    signed = materialise(_signatures(classes.select("node", "label", "members", "embedding"), tables, bits), "vector-signatures")
    spots = signed.select("node", "label", F.size("embedding").alias("dims"), F.posexplode("sigs").alias("t", "sig"))
    bucket = ["t", "sig", "label", "dims"]
    sizes = spots.groupBy(*bucket).agg(F.count("*").alias("n")).filter("n > 1")
    spots = spots.join(sizes, bucket).withColumn("k", F.ceil(F.col("n") / block).cast("int"))
    # Block i meets all blocks j: the row is sent to the pairs (i, j) and (j, i) with i <= j.
    own = F.pmod(F.xxhash64("node"), F.col("k")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    spots = spots.select("node", *bucket, own.alias("own"), F.explode(pairs).alias("pair"))
    sent = spots.join(signed.select("node", "members", "embedding", "sigs"), "node").select(
        "t", F.xxhash64(*bucket, "pair").alias("group"), "pair", "own", "node", "members", "embedding", "sigs"
    )
    schema = "u long, v long, node long, n long"

    def compare(group: pa.Table) -> pa.Table:
        node, members = group.column("node").to_numpy(), group.column("members").to_numpy()
        x = np.array(group.column("embedding").to_pylist(), dtype=np.float64)
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        sigs = np.array(group.column("sigs").to_pylist(), dtype=np.int32)
        own, t, pair = group.column("own").to_numpy(), group.column("t")[0].as_py(), group.column("pair")[0].as_py()
        left = np.flatnonzero(own == pair["i"])
        right = np.flatnonzero(own == pair["j"])
        hit = x[left] @ x[right].T >= least
        if pair["i"] == pair["j"]:
            hit = np.triu(hit, 1)
        i, j = np.nonzero(hit)
        i, j = left[i], right[j]
        new = ~(sigs[i, :t] == sigs[j, :t]).any(1)
        i, j = i[new], j[new]
        n = np.bincount(i, members[j], len(node)) + np.bincount(j, members[i], len(node))
        counted = np.flatnonzero(n)
        edges = _forest(node[i], node[j])
        none = [None] * len(counted)
        return pa.table({
            "u": pa.array([e[0] for e in edges] + none, pa.int64()),
            "v": pa.array([e[1] for e in edges] + none, pa.int64()),
            "node": pa.array([None] * len(edges) + node[counted].tolist(), pa.int64()),
            "n": pa.array([None] * len(edges) + n[counted].astype(np.int64).tolist(), pa.int64()),
        })

    found = materialise(sent.groupBy("group").applyInArrow(compare, schema), "vector-links")
    links = found.filter("node is not null").groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(found.filter("u is not null").select("u", "v")).withColumnRenamed("root", "of")
    placed = classes.select("key", "node", "members").join(links, "node", "left").join(roots, "node", "left")
    placed = placed.select("key", (F.coalesce("n", F.lit(0)) + F.col("members") - 1).alias("n_links"), F.coalesce("of", "node").alias("of"))
    held = materialise(rows.select("vec_id", "key", "row").join(placed, "key", "left"), "vector-placed")
    least_id = held.filter("of is not null").groupBy("of").agg(F.min("vec_id").alias("component_id"))
    out = held.join(least_id, "of", "left").withColumn(
        "component_id", F.when(F.col("of").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    )
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id",
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )

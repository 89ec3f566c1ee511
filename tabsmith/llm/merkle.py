"""Document fingerprints: a Merkle tree over paragraphs and sections, as DataFrame operations only.

Leaves are paragraphs (lines with their line break), hashed with SHA-256. A
paragraph whose hash ends in one of two digits closes a section, and so does a
blank one; sections therefore find their bounds again after an edit. A section
hashes its paragraphs' hashes, the root hashes the sections'. Roots test
equality, differing sections and then paragraphs locate edits. For a likeness
finer than a paragraph every tree also carries the hashes of its phrases, the
pieces of a paragraph up to a punctuation mark.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tabsmith.llm.common import c, text_of

PARAGRAPH_END = r"(?<=\n)"
PHRASE_END = r"(?<=[.,;:!?|\n])"


def _marked(text: Column) -> Column:
    """The hashes of all paragraphs in one string; `;` closes a section, `,` does not."""

    def leaf(p: Column) -> Column:
        h = F.sha2(p, 256)
        closes = F.substring(h, 64, 1).isin("0", "8") | (F.trim(F.translate(p, "\r\n\t", "   ")) == "")
        return F.concat(h, F.when(closes, ";").otherwise(","))

    return F.array_join(F.transform(F.split(text, PARAGRAPH_END), leaf), "")


def sections(text: Column) -> Column:
    """Per section a struct of its hash and the joined hashes of its paragraphs."""
    parts = F.split(F.regexp_replace(_marked(text), "[;,]$", ""), ";")
    return F.transform(parts, lambda s: F.struct(F.sha2(s, 256).alias("hash"), s.alias("paragraphs")))


def root(text: Column) -> Column:
    """The fingerprint: 64 hexadecimal digits, equal for equal texts only. A null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    parts = F.split(F.regexp_replace(_marked(text), "[;,]$", ""), ";")
    return F.sha2(F.array_join(F.transform(parts, lambda s: F.sha2(s, 256)), ""), 256)


def phrases(text: Column) -> Column:
    """The distinct phrase hashes of a text."""
    return F.array_distinct(F.transform(F.split(F.coalesce(text, F.lit("")), PHRASE_END), lambda p: F.xxhash64(p)))


def likeness(root_a: Column, phrases_a: Column, root_b: Column, phrases_b: Column) -> Column:
    """0 to 1: one for equal roots, else twice the shared phrases by all phrases of both."""
    shared = F.size(F.array_intersect(phrases_a, phrases_b))
    return F.when(root_a == root_b, 1.0).otherwise(F.lit(2.0) * shared / (F.size(phrases_a) + F.size(phrases_b)))


def locate_edits(pairs: DataFrame, id_col: str, text_a: str, text_b: str) -> DataFrame:
    """(id, paragraph): the paragraphs of `text_a`, counted from 0, that `text_b` does not have.

    The trees are compared from the top: equal roots give no rows, sections
    with a hash that the other tree has are skipped, and only the paragraphs
    of the others are compared. A null text is an empty one.
    """
    rows = pairs.select(c(id_col).alias("id"), text_of(text_a).alias("_a"), text_of(text_b).alias("_b"))
    rows = rows.filter(root(F.col("_a")) != root(F.col("_b")))
    rows = rows.select("id", sections(F.col("_a")).alias("_sa"), sections(F.col("_b")).alias("_sb"))
    other = F.transform("_sb", lambda s: s["hash"])
    leaves = F.flatten(F.transform("_sb", lambda s: F.split(s["paragraphs"], ",")))
    rows = rows.select("id", "_sa", other.alias("_known"), leaves.alias("_leaves"))
    rows = rows.select("id", "_known", "_leaves", F.posexplode("_sa").alias("_k", "_s"))
    count = F.size(F.split(F.col("_s.paragraphs"), ","))
    first = F.coalesce(F.sum(count).over(W.partitionBy("id").orderBy("_k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_first", first).filter(~F.array_contains("_known", F.col("_s.hash")))
    rows = rows.select("id", "_first", "_leaves", F.posexplode(F.split(F.col("_s.paragraphs"), ",")).alias("_j", "_leaf"))
    return rows.filter(~F.array_contains("_leaves", F.col("_leaf"))).select("id", (F.col("_first") + F.col("_j")).alias("paragraph"))


def _bounds(ids: DataFrame, rows: int, per_range: int) -> list:
    """The smallest id of each range; ranges hold about `per_range` rows and never split an id."""
    n = max(1, math.ceil(rows / per_range))
    ranged = ids.repartitionByRange(n, F.col("id").asc_nulls_last())
    found = ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.min("id").alias("low")).filter("low is not null")
    return sorted(r["low"] for r in found.select("low").collect())


def _range_of(value: Column, bounds: list) -> Column:
    """How many of the bounds are at or below the value, less one; two steps of about sqrt(n) comparisons."""
    step = max(1, math.isqrt(len(bounds)))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    block = F.size(F.filter(F.lit([b[0] for b in blocks]), lambda x: x <= value))
    inner = F.size(F.filter(F.element_at(F.array(*[F.lit(b) for b in blocks]), F.greatest(block, F.lit(1))), lambda x: x <= value))
    return F.greatest((block - 1) * step + inner - 1, F.lit(0))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_range: int = 8192) -> DataFrame:
    """(id, text, phrases, next_text, next_phrases): every document beside the next by ascending id.

    After the last comes the first. A null text is empty. Null ids come last;
    rows of the same id follow the order of their text's hash. One shuffle:
    ranges of ids, whose bounds come from the ids alone, and each range also
    gets the first rows of the one after it.
    """
    rows = docs.select(c(id_col).alias("id"), text_of(text_col).alias("text"))
    ids = rows.select("id")
    bounds = _bounds(ids, ids.count(), per_range)
    n = max(1, len(bounds))
    at = F.when(F.col("id").isNull(), F.lit(n - 1)).otherwise(_range_of(F.col("id"), bounds)) if bounds else F.lit(0)
    first = F.col("id").isin(bounds) if n <= 100 else F.array_contains(F.lit(bounds), F.col("id"))
    first = F.coalesce(first, F.lit(not bounds))
    own = F.struct(at.alias("r"), F.lit(0).alias("halo"))
    ahead = F.struct(((at + n - 1) % n).alias("r"), F.lit(1).alias("halo"))
    spread = rows.withColumn("_to", F.explode(F.when(first, F.array(own, ahead)).otherwise(F.array(own))))
    spread = spread.select("id", "text", F.col("_to.r").alias("_r"), F.col("_to.halo").alias("_halo")).repartition("_r")
    spread = spread.withColumn("phrases", phrases(F.col("text"))).withColumn("_h", F.xxhash64("text"))
    order = W.partitionBy("_r").orderBy("_halo", F.col("id").asc_nulls_last(), "_h")
    return spread.select(
        "id", "text", "phrases", "_halo",
        F.lead("text").over(order).alias("next_text"), F.lead("phrases").over(order).alias("next_phrases"),
    ).filter("_halo = 0").drop("_halo")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. The edited text has its last floor(n_chars / 4)
    code points replaced by the first as many (or all) of the next document.
    A null or empty text has an empty paragraph as its only leaf; edited it is
    the same. Repeated rows stand beside each other in the order, so their
    next text is their own. An empty table gives no rows; other columns are
    not read.
    """
    rows = with_next(docs, id_col, text_col, **options)
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    rows = rows.withColumn("_n", n).withColumn(
        "edited", F.concat(F.substring("text", F.lit(1), F.col("_n") - cut), F.substring("next_text", F.lit(1), cut))
    )
    rows = rows.withColumn("fingerprint", root(F.col("text"))).withColumn("edited_fingerprint", root(F.col("edited")))
    near_next = F.when(F.col("text") == F.col("next_text"), 1.0).otherwise(
        F.lit(2.0) * F.size(F.array_intersect("phrases", "next_phrases")) / (F.size("phrases") + F.size("next_phrases"))
    )
    rows = rows.withColumn("_edited", phrases(F.col("edited")))
    near_edited = likeness(F.col("fingerprint"), F.col("phrases"), F.col("edited_fingerprint"), F.col("_edited"))
    return rows.select(
        F.col("id").alias("doc_id"),
        F.col("_n").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint",
        near_edited.alias("near_edited"), near_next.alias("near_next"),
    )

"""Mixing sources to target weights with a curriculum that changes over time.

Each source has a schedule: its weight as a piecewise linear function of the
training time 0 to 1. The integral of the schedule is the source's weight in the
whole mix; with the budget it gives the source's target. The cumulative demand
of a source up to time t is target * integral(0, t) / integral(0, 1). A document
sits at some cumulative number of words in its source's shuffled order, and the
time at which the demand reaches that number is its training position.

Everything is a native plan over (id, source, size) rows; texts are not moved
until the chosen documents are range-sorted by position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tabsmith.llm.common import before, c, n_words, text_of
from tabsmith.session import materialise

Schedule = Sequence[tuple[float, float]]

#: Weights 3, 1 and 2 in the mean: a source that grows, one that stays, one that fades.
SCHEDULES: tuple[Schedule, ...] = (((0.0, 2.0), (1.0, 4.0)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 3.0), (1.0, 1.0)))


def weight_of(schedule: Schedule) -> float:
    """Integral of the schedule over the training time."""
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:]))


def check_schedule(schedule: Schedule) -> None:
    times = [t for t, _ in schedule]
    if len(times) < 2 or times[0] != 0 or times[-1] != 1 or times != sorted(set(times)):
        raise ValueError("a schedule goes from time 0 to time 1 in rising steps")
    if any(w < 0 for _, w in schedule) or weight_of(schedule) <= 0:
        raise ValueError("a schedule needs weights of at least 0 and a positive integral")


def time_of(schedule: Schedule, share: Column) -> Column:
    """The time at which `share` (0 to 1) of a source's whole demand is reached."""
    whole, reached, out = weight_of(schedule), 0.0, None
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        area, slope = (t1 - t0) * (w0 + w1) / 2, (w1 - w0) / (t1 - t0)
        rest = F.greatest(share * F.lit(whole) - F.lit(reached), F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * rest, F.lit(0.0)))
        here = F.lit(t0) + F.when(rest > 0, F.lit(2.0) * rest / (F.lit(w0) + root)).otherwise(0.0)
        reached += area
        out = here if out is None else F.when(share * F.lit(whole) >= F.lit(reached - area), here).otherwise(out)
    return F.least(out, F.lit(1.0))


def targets(sized: DataFrame, schedules: Sequence[Schedule], budget: float, most: float) -> DataFrame:
    """One row per source: its size, its schedule's number and its target.

    Sources by code point, null last, take the schedules in turn. The budget
    is shared by weight; a target stops at `most` times the source's size and
    the excess is shared again. Sorted by limit per weight, the sources that
    stop are a prefix, so one pass of running sums finds the common level.
    """
    weights = [weight_of(s) for s in schedules]
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    pattern = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    per = per.withColumn("pattern", pattern).withColumn("weight", F.element_at(F.lit([float(w) for w in weights]), F.col("pattern") + 1))
    per = per.withColumn("limit", F.lit(float(most)) * F.col("source_size"))
    rank = [F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()]
    ahead = W.orderBy(*rank).rowsBetween(W.unboundedPreceding, -1)
    level = (
        F.lit(float(budget)) * F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("limit").over(ahead), F.lit(0.0))
    ) / F.sum("weight").over(W.orderBy(*rank).rowsBetween(0, W.unboundedFollowing))
    per = per.withColumn("_level", level).withColumn("_rank", F.row_number().over(W.orderBy(*rank)))
    free = F.when(F.col("_level") * F.col("weight") <= F.col("limit"), F.struct("_rank", "_level"))
    per = per.withColumn("_common", F.min(free).over(W.partitionBy())["_level"])
    stop = F.coalesce(F.col("_common") * F.col("weight"), F.col("limit"))
    return per.select("source", "source_size", "pattern", F.least(F.col("limit"), stop).alias("target"))


def plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    schedules: Sequence[Schedule] = SCHEDULES,
    budget: float = 1.5,
    most: int = 2,
) -> DataFrame:
    """Training positions of every document, one row per input row.

    Columns: doc_id, source, size (words), source_size, target, key (order in
    the source), positions, an array with one time per copy that the mix
    takes, at most `most`, and text_hash. A document is in a round over its source when its
    middle word is still demanded, so a source's words miss its target by at
    most half a document. Null and wordless texts have size 0 and are taken by
    no demand: positions is empty. A null source is a source of its own, a null
    id sorts by its own hash. Repeated rows are documents of their own. An
    empty table gives no rows. Other columns are not read.
    """
    for schedule in schedules:
        check_schedule(schedule)
    sized = docs.select(
        c(id_col).alias("doc_id"),
        c(source_col).alias("source"),
        n_words(text_of(text_col)).alias("size"),
        F.xxhash64(text_of(text_col)).alias("text_hash"),
        F.md5(F.coalesce(c(id_col).cast("string"), F.lit("")).cast("binary")).alias("key"),
    )
    sized = materialise(sized, "mix-sizes")
    per = materialise(targets(sized, schedules, budget, most), "mix-targets")
    known = per.withColumn("_source", F.col("source")).drop("source")
    joined = sized.join(known, F.col("source").eqNullSafe(F.col("_source"))).withColumn(
        "_group", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    ).drop("_source")
    joined = materialise(joined, "mix-joined")
    placed = before(joined, ["_group"], "key", F.col("size"), "_before", joined.count())
    middle = F.col("_before") + F.col("size") / F.lit(2.0)
    rounds = F.sequence(F.lit(0), F.lit(most - 1))
    demand = F.transform(rounds, lambda k: middle + k * F.col("source_size"))
    wanted = F.when(F.col("size") > 0, F.filter(demand, lambda d: d < F.col("target"))).otherwise(F.array().cast("array<double>"))

    def at(d: Column) -> Column:
        out = F.lit(None).cast("double")
        for k, schedule in enumerate(schedules):
            out = F.when(F.col("pattern") == k, time_of(schedule, d / F.col("target"))).otherwise(out)
        return out

    return placed.withColumn("positions", F.transform(wanted, at)).select(
        "doc_id", "source", "size", "source_size", "target", "key", "positions", "text_hash"
    )


def arrange(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mixed corpus: the rows of `docs`, repeated as the plan says, range-sorted by position.

    The result has the columns of `docs`. Rows that share id, source and text
    are told apart by nothing the plan knows, so they are counted and each
    takes a place of its own. Texts are shuffled twice: to their positions and
    into order.
    """
    text_col, source_col = options.get("text_col", "text"), options.get("source_col", "source")
    names = docs.columns
    same = ["_id", "_source", "_hash"]
    held = docs.select(
        F.struct(*[c(x) for x in names]).alias("_row"),
        c(id_col).alias("_id"),
        c(source_col).alias("_source"),
        F.xxhash64(text_of(text_col)).alias("_hash"),
    )
    rows = plan(docs, id_col, **options).select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("text_hash").alias("_hash"), "key", "positions"
    )
    places = F.sort_array(F.collect_list(F.struct((-F.size("positions")).alias("k"), "positions")))
    rows = materialise(rows.groupBy(*same).agg(F.first("key").alias("key"), places.alias("places")), "mix-places")
    rows = rows.filter(F.exists("places", lambda p: F.size(p["positions"]) > 0))
    on = [F.col(f"h.{x}").eqNullSafe(F.col(f"p.{x}")) for x in same]
    both = held.alias("h").join(rows.alias("p"), on).select("h.*", "p.key", "p.places")
    alone = both.filter(F.size("places") == 1).withColumn("_place", F.lit(0)).drop(*same)
    number = F.row_number().over(W.partitionBy(*same).orderBy("key")) - 1
    twins = both.filter(F.size("places") > 1).withColumn("_place", number).drop(*same)
    taken = alone.unionByName(twins).select(
        "_row", "key", F.explode(F.get("places", F.col("_place"))["positions"]).alias("_position")
    )
    sorted_rows = taken.repartitionByRange("_position", "key").sortWithinPartitions("_position", "key")
    return sorted_rows.select(*[F.col("_row").getField(x).alias(x) for x in names])

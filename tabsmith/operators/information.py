"""Information of numbers about a class, by nearest neighbours in order (M1).

For a row, r is the distance to its k-th nearest row of the same class in one
feature, and m the number of rows of any class that are nearer than r, itself
among them. Where more than k rows of the class share the row's value, r is
zero: then m counts the rows of that value and k those of them in the class,
so a feature of few values is as well served as a continuous one. With N rows
and n rows of the class, the mean of digamma(N) + digamma(k) - digamma(n) -
digamma(m) estimates the information in nats; no bins are needed. One feature
is one line, so the neighbours are the rows beside a row in order, and m is a
difference of running counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabsmith.functions.columns import col, string_columns
from tabsmith.operators.features import label_encode
from tabsmith.operators.ordered import over_preceding, running_total
from tabsmith.session import materialise

#: What is nearer than r by less than this share of r counts as no nearer, so that rounding can not decide.
SLACK = 1e-6


def digamma(n: Column) -> Column:
    """Digamma of a number of one or more: shifted up by eight, then the series for large numbers."""
    x = n.cast("double") + 8
    down = sum((1 / (n.cast("double") + i) for i in range(8)), F.lit(0.0))
    s = 1 / (x * x)
    series = s * (F.lit(1 / 12) - s * (F.lit(1 / 120) - s * (F.lit(1 / 252) - s * F.lit(1 / 240))))
    return F.log(x) - 0.5 / x - series - down


def _values(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, y, x, w): different values with their number of rows; nulls are means or a text of their own."""
    texts = [c for c in features if c in string_columns(df)]
    means = df.agg(*[F.avg(col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(features) if c not in texts] or [F.lit(0)]).first()
    label = "_target"
    while label in df.columns:
        label += "_"
    coded = label_encode(df.withColumn(label, F.coalesce(col(target).cast("string"), F.lit("missing"))), texts)
    number = lambda i, c: col(c).cast("double") if c in texts else F.coalesce(col(c).cast("double"), F.lit(means[f"m{i}"]), F.lit(0.0))
    cells = F.array(*[F.struct(F.lit(i).alias("f"), number(i, c).alias("x")) for i, c in enumerate(features)])
    spread = coded.select(col(label).alias("y"), F.explode(cells).alias("c"))
    return spread.groupBy(F.col("c.f").alias("f"), "y", F.col("c.x").alias("x")).agg(F.count("*").alias("w"))


def _radius(values: DataFrame, k: int, chunk_rows: int | None) -> DataFrame:
    """Adds `r`: the distance to the k-th nearest row of the class, rows of the same value first."""

    def beside(w):
        return {f"_{n}{i}": F.lag(c, i).over(w) for i in range(1, k + 1) for n, c in (("x", F.col("x")), ("w", F.col("w")))}

    def pairs(side: str) -> list[Column]:
        return [F.when(F.col(f"_x{i}").isNotNull(), F.struct(F.abs(F.col(f"_x{i}") - F.col("x")).alias("d"), F.col(f"_w{i}").alias("w"))) for i in range(1, k + 1)]

    keys = ["f", "y"]
    below = over_preceding(values, keys, "x", k, beside, chunk_rows).select(*values.columns, F.array_compact(F.array(*pairs("below"))).alias("below"))
    turned = below.withColumn("_back", -F.col("x"))
    both = over_preceding(turned, keys, "_back", k, beside, chunk_rows)
    near = F.array_sort(F.concat(F.col("below"), F.array_compact(F.array(*pairs("above")))))
    # Walk outwards until k rows are met; the row itself is one of its own value.
    start = F.struct((F.col("w") - 1).alias("seen"), F.lit(0.0).alias("r"))
    walked = F.aggregate(
        near, start, lambda s, p: F.when(s["seen"] >= F.col("k"), s).otherwise(F.struct((s["seen"] + p["w"]).alias("seen"), p["d"].alias("r")))
    )
    return both.select(*values.columns, walked["r"].alias("r"))


def neighbour_information(df: DataFrame, features: list[str], target: str, k: int = 3, chunk_rows: int | None = None) -> DataFrame:
    """M1: (feature, importance) in nats, none below zero.

    Rows whose class has no other row are left out; a class of k rows or fewer
    uses all its rows. Texts are taken as codes in their order, missing numbers
    as the mean, a missing class as one of its own. Equal values are one row
    with a count, so a hot value is no hot group; lines of any length are cut
    into chunks.
    """
    values = _values(df, features, target)
    sizes = df.groupBy(F.coalesce(col(target).cast("string"), F.lit("missing")).alias("y")).agg(F.count("*").alias("n")).filter("n > 1")
    sizes = sizes.withColumn("k", F.least(F.lit(k), F.col("n") - 1))
    known = materialise(values.join(sizes, "y"), "values")
    near = materialise(_radius(known, k, chunk_rows), "radius")
    reach = F.col("r") * (1 - SLACK)
    same = F.col("r") == 0
    # A bound below asks for the rows at or before it, a bound above for those before it; where r is zero all at it count.
    low = F.struct((F.col("x") - reach).alias("v"), F.when(same, F.lit(0)).otherwise(F.lit(2)).alias("side"), F.lit(-1).alias("sign"))
    high = F.struct((F.col("x") + reach).alias("v"), F.when(same, F.lit(2)).otherwise(F.lit(0)).alias("side"), F.lit(1).alias("sign"))
    asked = near.select("f", "y", "x", F.explode(F.array(low, high)).alias("q")).select("f", "y", "x", "q.v", "q.side", "q.sign", F.lit(0).cast("long").alias("w"))
    none = F.lit(None)
    held = known.groupBy("f", F.col("x").alias("v")).agg(F.sum("w").alias("w"))
    held = held.select("f", none.cast("string").alias("y"), none.cast("double").alias("x"), "v", F.lit(1).alias("side"), F.lit(0).alias("sign"), "w")
    counted = running_total(materialise(asked.unionByName(held), "line"), ["f"], "v", "w", "upto", chunk_rows, ["side"])
    m = counted.filter("sign != 0").groupBy("f", "y", "x").agg(F.sum(F.col("sign") * F.col("upto")).alias("m"))
    rows = near.join(m, ["f", "y", "x"])
    own = F.when(same, F.col("w")).otherwise(F.col("k"))
    each = digamma(own) - digamma(F.col("n")) - digamma(F.greatest(F.col("m"), F.lit(1)))
    total = rows.groupBy("f").agg((F.sum(F.col("w") * each) / F.sum("w")).alias("mean"), F.sum("w").alias("rows"))
    names = F.array(*map(F.lit, features))
    found = total.select(F.get(names, F.col("f")).alias("feature"), F.greatest(digamma(F.col("rows")) + F.col("mean"), F.lit(0.0)).alias("importance"))
    # Features are given back even where no class has two rows.
    every = df.sparkSession.createDataFrame([(c,) for c in features], "feature string")
    return every.join(found, "feature", "left").select("feature", F.coalesce("importance", F.lit(0.0)).alias("importance"))

"""Rating tables in long form against forecasts in long form: an as-of lookup with both neighbours, in sorted ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import settle

PAIR = "struct<q:double,y:double>"


def _line(e: Column, f: Column, x: Column) -> Column:
    return e["y"] + (x - e["q"]) * (f["y"] - e["y"]) / (f["q"] - e["q"])


def levels_at(ratings: DataFrame, asked: DataFrame, key: str, q: str = "q", y: str = "y", x: str = "x", to: str = "level") -> DataFrame:
    """``asked`` (key, x, any columns) with the value at x of the line through its key's points (key, q, y).

    Points with a missing or non-finite member are left out, of equal q the least y counts; beyond the points the first
    or last two are followed; one point gives its y; a key without points, or an x that is missing or NaN, gives null.

    Points and different x are put in order together, by ranges of key and x, so a key with any share of the rows is
    spread over as many tasks as it needs. Neighbours come from the rows around in a range and, at its ends, from the
    outermost points of the ranges before and after, of which there are four a range and key at most.
    """
    bad = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))
    points = ratings.where(~bad(q) & ~bad(y)).groupBy(key, F.col(q).cast("double").alias("__x")).agg(F.min(F.col(y).cast("double")).alias("__y"))
    points = points.select(key, "__x", F.struct(F.col("__x").alias("q"), F.col("__y").alias("y")).alias("p"))
    wanted = asked.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))).select(key, F.col(x).cast("double").alias("__x")).distinct()
    # Before a point of the same q, so that those before are less and those after are not.
    rows = points.withColumn("point", F.lit(True)).unionByName(wanted.select(key, "__x", F.lit(None).cast(PAIR).alias("p"), F.lit(False).alias("point")))
    order = [key, "__x", "point"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id())
    ranged = settle(ranged, "ranges")
    inside = "OVER (PARTITION BY range, `{0}` ORDER BY __x, point)".format(key)
    near = ranged.select("*", *[F.expr(f"{f}(p, {n}) IGNORE NULLS {inside}").alias(f"{f}{n}") for f in ("lag", "lead") for n in (1, 2)]).where("NOT point")
    part = Window.partitionBy("range", key)
    placed = ranged.where("point").select("*", F.row_number().over(part.orderBy("__x")).alias("i"), F.row_number().over(part.orderBy(F.desc("__x"))).alias("j"))
    outer = placed.where("i <= 2 OR j <= 2").select("range", key, "__x", "p", F.lit(0).alias("mark"))
    marks = ranged.select("range", key).distinct().select("range", key, F.explode(F.array(F.lit(-1), F.lit(1))).alias("mark"))
    along = outer.unionByName(marks.withColumns({"__x": F.lit(0.0), "p": F.lit(None).cast(PAIR)}))
    across = "OVER (PARTITION BY `{0}` ORDER BY range, mark, __x)".format(key)
    around = along.select("range", key, "mark", *[F.expr(f"{f}(p, {n}) IGNORE NULLS {across}").alias(f"far_{f}{n}") for f in ("lag", "lead") for n in (1, 2)])
    before, after = around.where("mark = -1").select("range", key, "far_lag1", "far_lag2"), around.where("mark = 1").select("range", key, "far_lead1", "far_lead2")
    both = near.join(before, ["range", key], "left").join(after, ["range", key], "left")
    first = lambda f: F.coalesce(f"{f}1", f"far_{f}1")
    second = lambda f: F.when(F.col(f"{f}2").isNotNull(), F.col(f"{f}2")).when(F.col(f"{f}1").isNotNull(), F.col(f"far_{f}1")).otherwise(F.col(f"far_{f}2"))
    both = both.select(key, "__x", first("lag").alias("a"), second("lag").alias("b"), first("lead").alias("c"), second("lead").alias("d"))
    a, b, c, d, at = (F.col(n) for n in ("a", "b", "c", "d", "__x"))
    value = F.when(a.isNotNull() & c.isNotNull(), _line(a, c, at)).when(a.isNotNull() & b.isNotNull(), _line(b, a, at)).when(c.isNotNull() & d.isNotNull(), _line(c, d, at)).otherwise(F.coalesce(a, c)["y"])
    found = both.select(key, "__x", value.alias(to))
    return asked.withColumn("__x", F.col(x).cast("double")).join(found, [key, "__x"], "left").drop("__x")

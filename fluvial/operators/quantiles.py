"""Exact percentiles by group, where a group may hold any share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import forget, settle

#: A group of more rows is searched by histograms; an aggregation's state, which holds a group's different values, stays
#: below that. Buckets of a histogram.
HOT_ROWS, BUCKETS = 1_000_000, 1024


def _scaled(column: str) -> Column:
    """Values, or where the bounds lo and hi differ in sign or by a factor of four, logarithms with the values' signs."""
    lo, hi, x = F.abs("lo"), F.abs("hi"), F.col(column)
    wide = (F.signum("lo") * F.signum("hi") <= 0) | (F.greatest(lo, hi) > 4 * F.least(lo, hi))
    # The logarithm of the least double is above -745.
    return F.when(~wide, x).when(x == 0, 0.0).otherwise(F.signum(x) * (F.ln(F.abs(x)) + 760.0))


def percentiles(rows: DataFrame, key: str, value: str, probabilities: list[float], hot_rows: int = HOT_ROWS, buckets: int = BUCKETS) -> DataFrame:
    """key and p: the percentiles of each group, interpolated as Spark's percentile does, in the order asked for.

    Missing and NaN values are left out, values must be finite; a group without any has no row. Rows are read several
    times, so they should be written ones. In a large group the value of each rank is searched: a histogram between the
    bounds known so far (counted in tasks, then summed) gives the bucket that holds it, whose least and greatest values
    are the next bounds, until they are equal. What a round needs is bounded by groups and buckets, not by rows, and
    rows beyond all bounds drop out.
    """
    values = rows.select(key, F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    hot = settle(values.groupBy(key).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).where(F.col("n") > hot_rows), "hot")
    asked = F.array(*[F.lit(p) for p in probabilities])
    if hot.isEmpty():
        return values.groupBy(key).agg(F.percentile("v", asked).alias("p"))
    # At most one group in so many rows is hot; Spark broadcasts them below its own threshold, and joins them above it.
    usual = values.join(hot.select(key), key, "left_anti").groupBy(key).agg(F.percentile("v", asked).alias("p"))
    at = F.transform(asked, lambda p: p * (F.col("n") - 1))
    ranks = F.array_distinct(F.concat(F.transform(at, lambda x: F.floor(x)), F.transform(at, lambda x: F.ceil(x))))
    state = settle(hot.select(key, F.explode(ranks).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("below")), "ranks")
    found, data = state.where("lo = hi"), values.join(hot.select(key), key, "left_semi")
    state = state.where("lo < hi")
    while not state.isEmpty():
        # Bounds of two ranks are the same or lie apart, so a row is within one pair at most.
        bounds = state.select(key, "lo", "hi", "below").distinct()
        met = data.join(bounds, key).where("v BETWEEN lo AND hi")
        share = (_scaled("v") - _scaled("lo")) / (_scaled("hi") - _scaled("lo"))
        bucket = F.least(F.floor(share * buckets), F.lit(buckets - 1)).alias("bucket")
        counted = settle(met.groupBy(key, "lo", "hi", "below", bucket).agg(F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("most")), "histogram")
        before = Window.partitionBy(key, "lo", "hi").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        starts = counted.withColumn("start", F.col("below") + F.coalesce(F.sum("c").over(before), F.lit(0)))
        narrowed = state.join(starts.drop("below"), [key, "lo", "hi"]).where("rank >= start AND rank < start + c")
        following = settle(narrowed.select(key, "rank", F.col("least").alias("lo"), F.col("most").alias("hi"), F.col("start").alias("below"), "c"), "ranks")
        found = found.unionByName(following.where("lo = hi").drop("c"))
        within = following.where("lo < hi").select(key, "lo", "hi", "below", "c").distinct()
        data = settle(data.join(within, key).where("v BETWEEN lo AND hi").select(key, "v", "lo", "hi", "below", "c"), "within")
        order = Window.partitionBy(key, "lo", "hi").orderBy("v")
        few = data.where(F.col("c") <= hot_rows).select(key, (F.col("below") + F.row_number().over(order) - 1).alias("rank"), "v")
        ended = few.join(following.where((F.col("lo") < F.col("hi")) & (F.col("c") <= hot_rows)).select(key, "rank"), [key, "rank"])
        found = found.unionByName(ended.select(key, "rank", F.col("v").alias("lo"), F.col("v").alias("hi"), "rank").toDF(key, "rank", "lo", "hi", "below"))
        forget(counted)
        state, data = following.where((F.col("lo") < F.col("hi")) & (F.col("c") > hot_rows)).drop("c"), data.where(F.col("c") > hot_rows).select(key, "v")
    held = found.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("rank", "lo"))).alias("held")).join(hot.select(key, "n"), key)  # two a percentile

    def between(p):
        x = p * (F.col("n") - 1)
        low, high = F.floor(x), F.ceil(x)
        a, b = F.element_at("held", low), F.element_at("held", high)
        return F.when((low == high) | (a == b), a).otherwise((high - x) * a + (x - low) * b)

    return usual.unionByName(held.select(key, F.array(*[between(F.lit(p)) for p in probabilities]).alias("p")))

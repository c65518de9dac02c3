"""Rating-curve lookup and the filters around it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import rounded
from ..plans.lineage import settle
from .batches import kinds
from .quantiles import percentiles


def evaluate_curves(curves: DataFrame, forecast: DataFrame, key: str = "COMID") -> DataFrame:
    """Depth, width, velocity and water level of each curve row at its reach's forecast; levels must be positive.

    The forecast's first two columns are its key and its flow, whatever their names.
    """
    flow = forecast.select(F.col(forecast.columns[0]).alias(key), F.col(forecast.columns[1]).cast("double").alias("qout"))
    at = lambda name: rounded(F.col(f"{name}_a") * F.pow("qout", F.col(f"{name}_b")))
    made = {"CurveDepth": at("depth"), "TopWidth": at("tw"), "Velocity": at("vel")}
    out = curves.join(flow, key).withColumns(made)
    out = out.withColumn("WaterSurfaceElev_m", rounded(F.col("CurveDepth") + F.col("BaseElev")))
    return out.where(F.col("WaterSurfaceElev_m").isNotNull() & ~F.isnan("WaterSurfaceElev_m") & (F.col("WaterSurfaceElev_m") > 0))


def with_group_median(df: DataFrame, value: str, to: str, key: str = "COMID") -> DataFrame:
    """Median of the group beside each row (null without a value), joined back, so no task holds a large group."""
    rows = settle(df, "medians")
    return rows.join(percentiles(rows, key, value, [0.5]).select(key, F.col("p")[0].alias(to)), key, "left")


def depth_outliers_dropped(df: DataFrame, depth: str = "CurveDepth", key: str = "COMID") -> DataFrame:
    """Rows of reaches with a positive median depth that are less than three times as deep."""
    return with_group_median(df, depth, "MedianDepth", key).where((F.col("MedianDepth") > 0) & (F.col(depth) < 3 * F.col("MedianDepth")))


def within_two_sigma(df: DataFrame, value: str, key: str = "COMID") -> DataFrame:
    """Rows within two sample deviations of their group's mean; a group of one row has none and goes."""
    stats = df.groupBy(key).agg(F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s"))
    return df.join(stats, key).where((F.col(value) >= F.col("__m") - 2 * F.col("__s")) & (F.col(value) <= F.col("__m") + 2 * F.col("__s"))).drop("__m", "__s")


def interpolated(pairs: Column, x: Column) -> Column:
    """Value at x of the line through an array of (q, y) structs, extended beyond its ends.

    Pairs with a missing or non-finite member are left out and the first of equal q is taken; none: null; one: its y.
    One pass over the array keeps the two largest flows under x (a, b) and the two smallest from it on (c, d).
    """
    none = F.lit(None).cast("struct<q:double,y:double>")
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))

    def step(s: Column, p: Column) -> Column:
        p = F.struct(p["q"].cast("double").alias("q"), p["y"].cast("double").alias("y"))
        q, under = p["q"], p["q"] < x
        over_a, over_b = under & (s["a"].isNull() | (q > s["a"]["q"])), under & (s["a"]["q"] > q) & (s["b"].isNull() | (q > s["b"]["q"]))
        under_c, under_d = ~under & (s["c"].isNull() | (q < s["c"]["q"])), ~under & (s["c"]["q"] < q) & (s["d"].isNull() | (q < s["d"]["q"]))
        made = F.struct(
            F.when(over_a, p).otherwise(s["a"]).alias("a"), F.when(over_a, s["a"]).when(over_b, p).otherwise(s["b"]).alias("b"),
            F.when(under_c, p).otherwise(s["c"]).alias("c"), F.when(under_c, s["c"]).when(under_d, p).otherwise(s["d"]).alias("d"),
        )
        return F.when(bad(p["q"]) | bad(p["y"]), s).otherwise(made)

    def line(s: Column) -> Column:
        def through(e: Column, f: Column) -> Column:
            return e["y"] + (x - e["q"]) * (f["y"] - e["y"]) / (f["q"] - e["q"])

        below, above = s["a"].isNotNull(), s["c"].isNotNull()
        lone = F.coalesce(s["a"], s["c"])["y"]
        return F.when(below & above, through(s["a"], s["c"])).when(below & s["b"].isNotNull(), through(s["b"], s["a"])).when(above & s["d"].isNotNull(), through(s["c"], s["d"])).otherwise(lone)

    return F.aggregate(pairs, F.struct(*[none.alias(k) for k in "abcd"]), step, line)


def _ends(q: np.ndarray, good: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each column of q (pairs x rows), the places of the two good pairs whose line is read at x, whether there are two,
    and whether there is one (then both places are its)."""
    rows = np.arange(len(x))
    under = good & ((q < x) | np.isnan(x))
    over = good & ~under
    last = lambda there: (np.where(there, q, -np.inf).argmax(axis=0), there.any(axis=0))
    first = lambda there: (np.where(there, q, np.inf).argmin(axis=0), there.any(axis=0))
    (a, has_a), (c, has_c) = last(under), first(over)
    (b, has_b), (d, has_d) = last(under & (q < q[a, rows])), first(over & (q > q[c, rows]))
    # From the pair under x to that from it on, else through the two next to it on one side.
    lone = np.where(has_a, a, c)
    two = np.where(has_a, has_c | has_b, has_c & has_d)
    e, f = np.where(has_a, np.where(has_c, a, b), c), np.where(has_a, np.where(has_c, c, a), d)
    return np.where(two, e, lone), np.where(two, f, lone), two, has_a | has_c


def _read(q: np.ndarray, ys: list[np.ndarray], x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What ``interpolated`` gives for the pairs (q, y) of each row (pairs x rows, NaN where missing), and where it is null."""
    rows, known = np.arange(len(x)), None
    for y in ys:
        good = np.isfinite(q) & np.isfinite(y)
        if known is None or not np.array_equal(good, known):
            known, (e, f, two, some) = good, _ends(q, good, x)
        y0, y1, q0, q1 = y[e, rows], y[f, rows], q[e, rows], q[f, rows]
        with np.errstate(all="ignore"):
            yield np.where(two, y0 + (x - q0) * (y1 - y0) / (q1 - q0), y0), ~some


def with_interpolated(df: DataFrame, increments: int, x: str, values: dict[str, str], keep: list[str]) -> DataFrame:
    """Columns of ``keep`` and ``values`` (new column -> name): what ``interpolated`` gives at x for the pairs (q_i, name_i),
    in Arrow batches, vectorised over rows."""
    names = list(dict.fromkeys(["q", *values.values()]))
    of = {n: [f"{n}_{i}" for i in range(1, increments + 1)] for n in names}
    types = dict(df.dtypes)
    sent = {c: c if c in keep and types[c] == "double" else f"__{c}" for c in [x, *(c for n in names for c in of[n])]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = lambda c: batch.column(sent[c]).to_numpy(zero_copy_only=False)
            at, table = number(x), {n: np.stack([number(c) for c in of[n]]) for n in names}
            missing = batch.column(sent[x]).is_null().to_numpy(zero_copy_only=False)
            made = _read(table["q"], [table[n] for n in values.values()], at)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(v, mask=none | missing) for v, none in made)], [*keep, *values])

    told = df.select(*keep, *[F.col(c).cast("double").alias(s) for c, s in sent.items() if s != c])
    return told.mapInArrow(run, ", ".join([kinds(df, keep), *(f"`{c}` double" for c in values)]))


def evaluate_vdt(vdt: DataFrame, forecast: DataFrame, increments: int, key: str = "COMID", round_level: bool = True, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Velocity, width and water level of each VDT row at its reach's forecast, without rows whose level is missing,
    not positive, or more than two deviations from its reach's mean. ``keep``: columns beside the key (default: all).
    Levels are written, as they are read twice."""
    flow = forecast.select(F.col(forecast.columns[0]).alias(key), F.col(forecast.columns[1]).cast("double").alias("qout"))
    rated = vdt.join(flow, key)
    out = with_interpolated(rated, increments, "qout", {"Velocity": "v", "TopWidth": "t", "WaterSurfaceElev_m": "wse"}, rated.columns if keep is None else [key, *keep])
    out = out.withColumns({c: rounded(c) for c in ("Velocity", "TopWidth", *(["WaterSurfaceElev_m"] if round_level else []))})
    out = within_two_sigma(settle(out, "levels").where("WaterSurfaceElev_m IS NOT NULL"), "WaterSurfaceElev_m", key)
    return out.where(F.col("WaterSurfaceElev_m") > 0)


def cell_centres(df: DataFrame, minx: float, maxy: float, dx: float, dy: float, row: str = "Row", col: str = "Col") -> DataFrame:
    """x and y of cell centres; rows grow downwards."""
    return df.withColumns({"x": F.lit(minx) + dx / 2 + F.col(col) * dx, "y": F.lit(maxy) - dy / 2 - F.col(row) * dy})


def difference_percent(a: Column, b: Column) -> Column:
    """Difference of two levels in percent of their mean."""
    return F.abs(a - b) / ((a + b) / 2) * 100


def critical_success(hit: Column, miss: Column, false_alarm: Column) -> Column:
    """TP / (TP + FN + FP), as an aggregate."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return F.try_divide(n(hit).cast("double"), n(hit) + n(miss) + n(false_alarm))

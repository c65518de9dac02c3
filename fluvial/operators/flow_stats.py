"""Flow statistics of reaches from long series and return periods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import rounded
from ..plans.lineage import settle

RETURN_PERIODS = (2, 5, 10, 25, 50, 100)


def yearly(series: DataFrame, how: str | tuple[str, ...], key: str = "rivid", time: str = "time", flow: str = "Qout") -> DataFrame:
    """Mean of yearly means, median of yearly medians, or maximum of yearly maxima; rounded at both levels. Several of
    them are found in one pass over the series."""
    known = {"mean": F.avg, "median": F.median, "max": F.max}
    asked = {h: known[h] for h in ((how,) if isinstance(how, str) else how)}
    # The second level works on whole thousandths, whose sums are exact in any order.
    by_year = series.groupBy(key, F.year(time).alias("__year")).agg(*[F.rint(f(flow) * 1000).alias(f"__{h}") for h, f in asked.items()])
    return by_year.groupBy(key).agg(*[(F.rint(f(f"__{h}")) / 1000).alias(f"qout_{h}") for h, f in asked.items()])


def summary(series: DataFrame, key: str = "rivid", flow: str = "Qout") -> DataFrame:
    """Mean, median and maximum of the whole series of each reach."""
    return series.groupBy(key).agg(*[rounded(f(flow)).alias(f"qout_{n}") for n, f in (("mean", F.avg), ("median", F.median), ("max", F.max))])


def pivoted(periods: DataFrame, key: str = "rivid", period: str = "return_period", flow: str = "return_period_flow", which: tuple[int, ...] = RETURN_PERIODS) -> DataFrame:
    """rp2 ... rp100: mean flow of each return period, one row a reach. The periods are given, so no extra pass finds them."""
    return periods.groupBy(key).agg(*[rounded(F.avg(F.when(F.col(period) == p, F.col(flow)))).alias(f"rp{p}") for p in which])


def flow_table(return_periods: DataFrame, series: DataFrame, key: str = "rivid") -> DataFrame:
    """Return periods (wide, with qout_max) with mean and absolute median, in the order that runs expect."""
    mean, median = yearly(series, "mean", key), yearly(series, "median", key)
    out = return_periods.join(mean, key, "left").join(median, key, "left").withColumn("qout_median", F.abs("qout_median"))
    return out.select(F.col(key).alias("COMID"), "qout_mean", "qout_median", "qout_max", *[f"rp{p}" for p in RETURN_PERIODS])


def retrospective(series: DataFrame, periods: DataFrame, key: str = "rivid") -> DataFrame:
    """Summary and return periods of all reaches that either has (a full outer join); the reach id stays."""
    return summary(series, key).join(pivoted(periods, key), key, "full")


def duration_points(curve: DataFrame, key: str = "rivid", exceed: str = "p_exceed", flow: str = "fdc") -> DataFrame:
    """qout_median at 50 % exceedance and qout_max at 0 %."""
    at = lambda p: rounded(F.max(F.when(F.col(exceed) == p, F.col(flow))))
    return curve.groupBy(key).agg(at(50).alias("qout_median"), at(0).alias("qout_max"))


def with_premium(df: DataFrame, factor: float = 1.5) -> DataFrame:
    """Flows with a safety factor: qout_max_premium and rp100_premium."""
    return df.withColumns({f"{c}_premium": rounded(F.col(c) * factor) for c in ("qout_max", "rp100")})


def tile_table(curve: DataFrame, periods: DataFrame, reaches: DataFrame, box: tuple[float, float, float, float], key: str = "rivid") -> DataFrame:
    """Flow table of the reaches that lie wholly in a box (minx, miny, maxx, maxy): reaches hold key and pts, an array of
    (x, y). A box is convex, so a line is inside when its vertices are."""
    minx, miny, maxx, maxy = box
    inside = reaches.where(F.forall("pts", lambda p: p["x"].between(minx, maxx) & p["y"].between(miny, maxy))).select(key).distinct()
    return with_premium(duration_points(curve.join(inside, key, "left_semi"), key).join(pivoted(periods.join(inside, key, "left_semi"), key), key, "full"))


def in_tiles(reaches: DataFrame, tiles: DataFrame, key: str = "rivid", tile: str = "tile") -> DataFrame:
    """Which reaches (key, pts) lie wholly in which tiles (tile, minx, miny, maxx, maxy), edges included: tile, key.

    A line is in a box when the lower left corner and the upper right one of its own box are. So a reach goes to the one
    cell of its lower left corner, a tile to the cells that it touches (four at most, cells being as large as the largest
    tile), and an equi-join finds the pairs: no reach is copied, and reaches far from all tiles meet none. Reaches
    without a vertex are in no tile.
    """
    at = lambda f, c: f(F.transform("pts", lambda p: p[c]))
    corners = {"x0": at(F.array_min, "x"), "y0": at(F.array_min, "y"), "x1": at(F.array_max, "x"), "y1": at(F.array_max, "y")}
    size = tiles.agg(F.max(F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")))).first()[0] or 1.0
    cell = lambda c: F.floor(F.col(c) / size)
    spots = reaches.select(key, *[v.alias(n) for n, v in corners.items()]).where("x0 IS NOT NULL").withColumns({"cx": cell("x0"), "cy": cell("y0")})
    touched = tiles.withColumn("cx", F.explode(F.sequence(cell("minx"), cell("maxx")))).withColumn("cy", F.explode(F.sequence(cell("miny"), cell("maxy"))))
    return spots.join(touched, ["cx", "cy"]).where("x0 >= minx AND y0 >= miny AND x1 <= maxx AND y1 <= maxy").select(tile, key).distinct()


def tile_tables(curve: DataFrame, periods: DataFrame, reaches: DataFrame, tiles: DataFrame, key: str = "rivid", tile: str = "tile") -> DataFrame:
    """tile_table of many tiles at once: each reach's flows are worked out once, and joined to the tiles that hold it."""
    pairs = settle(in_tiles(reaches, tiles, key, tile), "tiles")
    wanted = pairs.select(key).distinct()
    points, wide = (f(rows.join(wanted, key, "left_semi"), key) for f, rows in ((duration_points, curve), (pivoted, periods)))
    return with_premium(pairs.join(points.join(wide, key, "full"), key))


def headwaters(reaches: DataFrame, key: str, downstream: str) -> DataFrame:
    """Reaches that no other one flows into; rows without an id are left out on both sides."""
    fed = reaches.where(F.col(downstream).isNotNull()).select(F.col(downstream).alias(key)).distinct()
    return reaches.where(F.col(key).isNotNull()).join(fed, key, "left_anti")


def on_flow(cells: DataFrame, flows: DataFrame, key: str = "comid") -> DataFrame:
    """Cells of reaches that have a flow."""
    return cells.join(flows, key, "left_semi")


def with_flow(cells: DataFrame, flows: DataFrame, key: str = "comid") -> DataFrame:
    """Cells with their reach's flows; reaches without one give no row."""
    return cells.join(flows, key)

"""Registered queries by name, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hydraulics
from ..functions.rounding import round_sig, rounded, signs_differ
from ..operators import bathymetry, flow_stats, neighbourhood, rating, sections, solver, spatial
from . import carriers
from .carriers import CELL_SQL, GRID_SQL, LENGTH, REACH_SQL, ROWS, STRIP, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL twin."""

    def wrap(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return wrap


def r(x: str, places: int = 3) -> str:
    return f"round_even(({x}) * {10**places}, 0) / {10**places}"


# --- selections, joins, derived columns -----------------------------------------------------------------------------
@query(f"WITH {CELL_SQL}, {REACH_SQL} SELECT comid, r, c FROM cell WHERE EXISTS (SELECT 1 FROM reach WHERE reach.comid = cell.comid AND q_max > 12)")
def select_cells_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow_stats.on_flow(carriers.cells(spark, sf_dir), carriers.reach(spark, sf_dir).where("q_max > 12")).select("comid", "r", "c")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')")
def headwater_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as reaches, urgent orders as reaches that flow into them."""
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    reaches = customers.select(F.col("c_custkey").alias("id"), F.lit(None).cast("long").alias("down"), "c_nationkey")
    feeds = orders.where("o_orderpriority LIKE '1%'").select(F.lit(None).cast("long").alias("id"), F.col("o_custkey").alias("down"), F.lit(0).alias("c_nationkey"))
    return flow_stats.headwaters(reaches.unionByName(feeds), "id", "down").select(F.col("id").alias("c_custkey"), "c_nationkey")


@query(f"WITH {CELL_SQL}, {REACH_SQL} SELECT comid, r, c, {r('q_max')} AS q_max, q_base FROM cell JOIN reach USING (comid)")
def flow_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow_stats.with_flow(carriers.cells(spark, sf_dir), carriers.reach(spark, sf_dir)).select("comid", "r", "c", rounded("q_max").alias("q_max"), "q_base")


@query("""SELECT p_partkey, lc, CASE WHEN n > 10 THEN 0.035::DOUBLE WHEN n <= 0 THEN 0.005::DOUBLE ELSE n END AS n FROM
    (SELECT p_partkey, p.lc, coalesce(m.n, 0.0)::DOUBLE AS n FROM (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 80 ELSE p_size END AS lc FROM part) p
    LEFT JOIN (VALUES (1, 0.03::DOUBLE), (2, 0.1::DOUBLE), (5, 12.0::DOUBLE), (10, 0.05::DOUBLE), (20, 0.035::DOUBLE), (30, 0.12::DOUBLE), (40, 0.0::DOUBLE), (80, 0.025::DOUBLE)) m(lc, n) ON p.lc = m.lc)""")
def landcover_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tables import roughness_of

    manning = spark.createDataFrame([(1, 0.03), (2, 0.1), (5, 12.0), (10, 0.05), (20, 0.035), (30, 0.12), (40, 0.0), (80, 0.025)], "lc int, n double")
    cover = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 == 0, 80).otherwise(F.col("p_size")).alias("lc"))
    return roughness_of(cover, manning)


@query("SELECT c_custkey, c_acctbal + CASE WHEN (SELECT min(c_acctbal) FROM customer) < 0 THEN 100 ELSE 0 END AS z FROM customer")
def negative_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tables import shift_negative

    return shift_negative(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("z")))[0]


CURVES_SQL = f"""{CELL_SQL}, curve AS (SELECT cell.comid AS "COMID", r, c, 0.2::DOUBLE + c / 10.0::DOUBLE AS da, 0.5::DOUBLE - c / 100.0::DOUBLE AS db,
    2.0::DOUBLE + side AS ta, 0.3::DOUBLE AS tb, 0.5::DOUBLE AS va, 0.4::DOUBLE AS vb, qty - 10.0::DOUBLE AS base FROM cell), {REACH_SQL},
    lit AS (SELECT curve."COMID", r, c, {r('da * pow(q_max, db)')} AS d, {r('ta * pow(q_max, tb)')} AS t, {r('va * pow(q_max, vb)')} AS v, base FROM curve JOIN reach ON reach.comid = curve."COMID"),
    curves AS (SELECT "COMID", r, c, d AS depth, t AS width, v AS velocity, {r('d + base')} AS wse FROM lit WHERE {r('d + base')} > 0)"""


def _curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = carriers.cells(spark, sf_dir).select(
        F.col("comid").alias("COMID"), "r", "c", (0.2 + F.col("c") / 10.0).alias("depth_a"), (0.5 - F.col("c") / 100.0).alias("depth_b"), (2.0 + F.col("side")).alias("tw_a"), F.lit(0.3).alias("tw_b"),
        F.lit(0.5).alias("vel_a"), F.lit(0.4).alias("vel_b"), (F.col("qty") - 10.0).alias("BaseElev"),
    )
    return rating.evaluate_curves(curve, carriers.reach(spark, sf_dir).select("comid", "q_max"))


@query(f"WITH {CURVES_SQL} SELECT * FROM curves")
def power_curve_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _curves(spark, sf_dir).select("COMID", "r", "c", F.col("CurveDepth").alias("depth"), F.col("TopWidth").alias("width"), F.col("Velocity").alias("velocity"), F.col("WaterSurfaceElev_m").alias("wse"))


@query(f'WITH {CURVES_SQL}, m AS (SELECT *, median(depth) OVER (PARTITION BY "COMID") AS md FROM curves) SELECT "COMID", r, c, depth, {r("md")} AS median_depth FROM m WHERE md > 0 AND depth < 3 * md')
def reach_median_depth_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rating.depth_outliers_dropped(_curves(spark, sf_dir)).select("COMID", "r", "c", F.col("CurveDepth").alias("depth"), rounded("MedianDepth").alias("median_depth"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, avg(l_extendedprice) OVER w AS m, stddev_samp(l_extendedprice) OVER w AS s FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)) WHERE l_extendedprice BETWEEN m - 2 * s AND m + 2 * s")
def outlier_2sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rating.within_two_sigma(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice", "l_suppkey")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, {r('abs(l_extendedprice - l_quantity) / ((l_extendedprice + l_quantity) / 2) * 100')} AS pct, (CASE WHEN l_discount > 0.05 THEN 1 ELSE -1 END) * {r('l_quantity - 25', 5)} < 0 AS differ FROM lineitem")
def wse_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    sign = F.when(F.col("l_discount") > 0.05, 1.0).otherwise(-1.0)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", rounded(rating.difference_percent(F.col("l_extendedprice"), F.col("l_quantity"))).alias("pct"), signs_differ(sign, F.col("l_quantity") - 25).alias("differ")
    )


@query("SELECT o_orderkey, CASE WHEN o_totalprice = 0 THEN 0.0 ELSE floor(o_totalprice / 7.0::DOUBLE * pow(10.0::DOUBLE, 3 - floor(log10(abs(o_totalprice / 7.0::DOUBLE)))) + 0.5::DOUBLE) / pow(10.0::DOUBLE, 3 - floor(log10(abs(o_totalprice / 7.0::DOUBLE)))) END AS sig FROM orders")
def significant_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", round_sig(F.col("o_totalprice") / 7.0, 4).alias("sig"))


@query(f'WITH {GRID_SQL} SELECT "row", col, 1000.0::DOUBLE + 15.0::DOUBLE + col * 30.0::DOUBLE AS x, 5000.0::DOUBLE - 15.0::DOUBLE - "row" * 30.0::DOUBLE AS y FROM grid')
def cell_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rating.cell_centres(carriers.grid(spark, sf_dir), 1000.0, 5000.0, 30.0, 30.0, "row", "col").select("row", "col", "x", "y")


@query("SELECT sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END)::DOUBLE / sum(CASE WHEN quality = 1 OR toxic = 0 THEN 1 ELSE 0 END) AS csi FROM labels")
def csi_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, t = F.col("quality") == 1, F.col("toxic") == 0
    return table(spark, sf_dir, "labels").agg(rating.critical_success(q & t, ~q & t, q & ~t).alias("csi"))


# --- flow statistics ------------------------------------------------------------------------------------------------
SERIES = "series AS (SELECT o_custkey AS rivid, year(o_orderdate) AS y, o_totalprice / 7.0::DOUBLE AS q FROM orders)"
YEARLY = {
    how: f"{how}s AS (SELECT rivid, round_even({f}(yq), 0) / 1000 AS qout_{how} FROM (SELECT rivid, y, round_even({f}(q) * 1000, 0) AS yq FROM series GROUP BY rivid, y) GROUP BY rivid)"
    for how, f in (("mean", "avg"), ("median", "median"), ("max", "max"))
}
PERIODS = "periods AS (SELECT o_custkey AS rivid, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 2 WHEN '2' THEN 5 WHEN '3' THEN 10 WHEN '4' THEN 25 ELSE 100 END AS rp, o_totalprice / 100.0::DOUBLE AS q FROM orders)"
PIVOT = "pivoted AS (SELECT rivid, " + ", ".join(f"{r(f'avg(q) FILTER (rp = {p})')} AS rp{p}" for p in flow_stats.RETURN_PERIODS) + " FROM periods GROUP BY rivid)"


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("rivid"), F.col("o_orderdate").alias("time"), (F.col("o_totalprice") / 7.0).alias("Qout"))


def _periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.substring("o_orderpriority", 1, 1)
    period = F.when(first == "1", 2).when(first == "2", 5).when(first == "3", 10).when(first == "4", 25).otherwise(100)
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("rivid"), period.alias("return_period"), (F.col("o_totalprice") / 100.0).alias("return_period_flow"))


@query(f"WITH {SERIES}, {YEARLY['mean']} SELECT * FROM means")
def mean_of_yearly_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow_stats.yearly(_series(spark, sf_dir), "mean")


@query(f"WITH {SERIES}, {YEARLY['median']} SELECT * FROM medians")
def median_of_yearly_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow_stats.yearly(_series(spark, sf_dir), "median")


@query(f"WITH {SERIES}, {YEARLY['max']} SELECT * FROM maxs")
def max_of_yearly_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow_stats.yearly(_series(spark, sf_dir), "max")


@query(f"WITH {PERIODS}, {PIVOT} SELECT * FROM pivoted")
def return_period_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow_stats.pivoted(_periods(spark, sf_dir))


@query(f"""WITH {SERIES}, {PERIODS}, {PIVOT}, {YEARLY['mean']}, {YEARLY['median']}, {YEARLY['max']} SELECT p.rivid AS "COMID", qout_mean, abs(qout_median) AS qout_median, qout_max, rp2, rp5, rp10, rp25, rp50, rp100
    FROM (SELECT * FROM pivoted JOIN maxs USING (rivid)) p LEFT JOIN means USING (rivid) LEFT JOIN medians USING (rivid)""")
def flow_table_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = _series(spark, sf_dir)
    wide = flow_stats.pivoted(_periods(spark, sf_dir)).join(flow_stats.yearly(series, "max"), "rivid")
    return flow_stats.flow_table(wide, series)


@query(f"""WITH series AS (SELECT o_custkey AS rivid, year(o_orderdate) AS y, o_totalprice / 7.0123457::DOUBLE AS q FROM orders),
    periods AS (SELECT c_custkey + 40 AS rivid, CASE c_mktsegment WHEN 'BUILDING' THEN 2 WHEN 'MACHINERY' THEN 5 ELSE 100 END AS rp, c_acctbal / 100.0::DOUBLE AS q FROM customer), {PIVOT},
    whole AS (SELECT rivid, {r('avg(q)')} AS qout_mean, {r('median(q)')} AS qout_median, {r('max(q)')} AS qout_max FROM series GROUP BY rivid)
    SELECT coalesce(s.rivid, p.rivid) AS rivid, s.* EXCLUDE (rivid), p.* EXCLUDE (rivid) FROM whole s FULL JOIN pivoted p ON s.rivid = p.rivid""")
def outer_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of orders by customer, periods of customers 40 numbers on: some keys are on one side only."""
    series = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("rivid"), F.col("o_orderdate").alias("time"), (F.col("o_totalprice") / 7.0123457).alias("Qout"))
    period = F.when(F.col("c_mktsegment") == "BUILDING", 2).when(F.col("c_mktsegment") == "MACHINERY", 5).otherwise(100)
    periods = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 40).alias("rivid"), period.alias("return_period"), (F.col("c_acctbal") / 100.0).alias("return_period_flow"))
    return flow_stats.retrospective(series, periods)


@query(f"SELECT user_id AS rivid, {r('max(value) FILTER (event_id % 10 = 5)')} AS qout_median, {r('max(value) FILTER (event_id % 10 = 0)')} AS qout_max FROM events GROUP BY user_id")
def fdc_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = table(spark, sf_dir, "events").select(F.col("user_id").alias("rivid"), ((F.col("event_id") % 10) * 10).cast("double").alias("p_exceed"), F.col("value").alias("fdc"))
    return flow_stats.duration_points(curve)


@query(f"WITH {PERIODS}, {PIVOT}, {SERIES}, {YEARLY['max']} SELECT rivid, qout_max, rp100, {r('qout_max * 1.5::DOUBLE')} AS qout_max_premium, {r('rp100 * 1.5::DOUBLE')} AS rp100_premium FROM pivoted JOIN maxs USING (rivid)")
def premium_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = flow_stats.pivoted(_periods(spark, sf_dir)).join(flow_stats.yearly(_series(spark, sf_dir), "max"), "rivid")
    return flow_stats.with_premium(wide).select("rivid", "qout_max", "rp100", "qout_max_premium", "rp100_premium")


# --- hydraulics -----------------------------------------------------------------------------------------------------
def sides_sql(stages: str) -> str:
    """CTE geo: area, perimeter, pn and width (both sides) of each row of ``stages`` (any columns, side, n, w), in closed
    form: a triangle of ordinates i / side that is filled to w. Under water to its end (at ordinate {LENGTH - 1}), a side
    leaves its first segment out of area and perimeter."""
    last = LENGTH - 1
    return f"""geo AS (SELECT *, CASE WHEN dry THEN w * w * side ELSE {last - 1} * (2 * w - {last + 1} / side) END AS area,
        CASE WHEN dry THEN 2 * w * sqrt(side * side + 1) ELSE {2 * (last - 1)} * sqrt(1 + 1 / (side * side)) END AS perimeter,
        CASE WHEN dry THEN 2 * w * sqrt(side * side + 1) ELSE {2 * last} * sqrt(1 + 1 / (side * side)) END * pow(n, 1.5::DOUBLE) AS pn,
        CASE WHEN dry THEN 2 * w * side ELSE {2 * last} END AS width FROM (SELECT *, w * side <= {last} AS dry FROM ({stages})))"""


STAGE_SQL = "SELECT comid, r, c, side, n, slope, qty, 0.2::DOUBLE + (qty % 10) AS w FROM cell JOIN reach USING (comid)"
FLOW_SQL = f"area * pow(area / greatest(perimeter, 1e-6::DOUBLE), 2.0::DOUBLE / 3) * sqrt(slope) / (CASE WHEN {r('pow(pn / greatest(perimeter, 1e-6::DOUBLE), 2.0::DOUBLE / 3)', 4)} < 1e-4 THEN 0.035::DOUBLE ELSE {r('pow(pn / greatest(perimeter, 1e-6::DOUBLE), 2.0::DOUBLE / 3)', 4)} END)"


def _staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.with_geometry(carriers.sections(spark, sf_dir).withColumn("w", 0.2 + F.col("qty") % 10), "w", ("comid", "r", "c", "slope"))


@query(f"WITH {CELL_SQL}, {REACH_SQL}, {sides_sql(STAGE_SQL)} SELECT comid, r, c, {r('width')} AS width FROM geo")
def side_top_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = carriers.sections(spark, sf_dir).withColumn("w", 0.2 + F.col("qty") % 10)
    wide = sections.with_top_width(sections.with_top_width(wide, "p1", "w", "t1"), "p2", "w", "t2")
    return wide.select("comid", "r", "c", rounded(F.col("t1") + F.col("t2")).alias("width"))


@query(f"WITH {CELL_SQL}, {REACH_SQL}, {sides_sql(STAGE_SQL)} SELECT comid, r, c, {r('area')} AS area, {r('perimeter')} AS perimeter, {r('pn', 4)} AS pn, {r('width')} AS width FROM geo")
def section_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _staged(spark, sf_dir).select("comid", "r", "c", rounded("area").alias("area"), rounded("perimeter").alias("perimeter"), rounded("pn", 4).alias("pn"), rounded("width").alias("width"))


@query(f"WITH {CELL_SQL}, {REACH_SQL}, {sides_sql(STAGE_SQL)} SELECT comid, r, c, {r(FLOW_SQL)} AS q FROM geo")
def manning_discharge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _staged(spark, sf_dir).select("comid", "r", "c", rounded(hydraulics.discharge(F.col("area"), F.col("perimeter"), F.col("pn"), F.col("slope"))).alias("q"))


INCREMENTS = 4
WMAX = r("1.0::DOUBLE + (qty % 5)")
INC_SQL = f"""{CELL_SQL}, {REACH_SQL}, {sides_sql(f"SELECT comid, r, c, side, n, slope, q_base, k, {r(f'{r(f'({WMAX}) / {INCREMENTS}')} * k')} AS w FROM (SELECT *, unnest(range(1, {INCREMENTS + 1})) AS k FROM cell JOIN reach USING (comid))")},
    rows_ AS (SELECT comid, r, c, k, w, q_base, slope, {r('area')} AS a, {r('perimeter')} AS p, {r('width')} AS t, pn FROM geo),
    full_ AS (SELECT comid, r, c, k, w AS wse, a, p, t, q_base, slope, {r(f"a * pow(a / p, 2.0::DOUBLE / 3) * sqrt(slope) / ({r('pow(pn / p, 2.0::DOUBLE / 3)', 4)})")} AS q FROM rows_),
    inc AS (SELECT comid, r, c, k, slope, CASE WHEN k = 1 AND q_base > 0.001 AND q >= q_base THEN q_base - 0.001 ELSE q END AS q, {r('q / a')} AS v, t, wse, p FROM full_)"""


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = carriers.sections(spark, sf_dir).withColumn("w", rounded(1.0 + F.col("qty") % 5))
    return solver.rating_tables(rows, INCREMENTS, ("comid", "r", "c"), "w")


@query(f"WITH {INC_SQL} SELECT comid, r, c, k, {r('q')} AS q, v, t, wse, p FROM inc")
def increment_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _tables(spark, sf_dir).select("comid", "r", "c", F.posexplode("inc").alias("k", "x"))
    return out.select("comid", "r", "c", (F.col("k") + 1).cast("long").alias("k"), rounded("x.q").alias("q"), "x.v", "x.t", "x.wse", "x.p")


@query(f"""WITH {INC_SQL} SELECT comid AS "COMID", r AS "Row", c AS "Col", {", ".join(f'max({r(x)}) FILTER (k = {i}) AS {x if x != "w" else "wse"}_{i}' for i in range(1, INCREMENTS + 1) for x in ("q", "v", "t", "wse"))} FROM inc GROUP BY comid, r, c""")
def vdt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.outputs import vdt

    named = _tables(spark, sf_dir).select(F.col("comid").alias("COMID"), F.col("r").alias("Row"), F.col("c").alias("Col"), "inc")
    return vdt(named, INCREMENTS, ["COMID", "Row", "Col"], table(spark, sf_dir, "lineitem").count())  # no more cells than line items


@query(f"""WITH {INC_SQL} SELECT comid AS "COMID", r AS "Row", c AS "Col", {", ".join(f'max({x}) FILTER (k = {i}) AS {n}_{i}' for i in range(1, INCREMENTS + 1) for n, x in (("q", r("q")), ("a", r("CASE WHEN v = 0 THEN 0 ELSE q / v END")), ("p", r("p"))))} FROM inc GROUP BY comid, r, c""")
def ap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.outputs import area_perimeter

    named = _tables(spark, sf_dir).select(F.col("comid").alias("COMID"), F.col("r").alias("Row"), F.col("c").alias("Col"), "inc")
    return area_perimeter(named, INCREMENTS, ["COMID", "Row", "Col"], table(spark, sf_dir, "lineitem").count())  # as in vdt_rows


NORMAL = "pow(q_max * n / (sqrt(slope) * side * pow(side / (2 * sqrt(side * side + 1)), 2.0::DOUBLE / 3)), 3.0::DOUBLE / 8)"


@query(f"""WITH {CELL_SQL}, {REACH_SQL} SELECT comid, r, c, true AS near FROM (SELECT *, {NORMAL} AS w FROM cell JOIN reach USING (comid)) WHERE w * side < {LENGTH - 2}""")
def solved_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full stage solve (bracketing root and staged search) against normal depth in closed form, which triangular
    sections have as long as they hold it: within half a centimetre."""
    solved = solver.rating_tables(carriers.sections(spark, sf_dir), 3, ("comid", "r", "c")).select("comid", "r", "c", "wse_max")
    every = carriers.cells(spark, sf_dir).join(carriers.reach(spark, sf_dir), "comid").withColumn("w", F.expr(NORMAL.replace("::DOUBLE", "D")))
    both = every.where(F.col("w") * F.col("side") < LENGTH - 2).join(solved, ["comid", "r", "c"], "left")
    return both.select("comid", "r", "c", F.coalesce(F.abs(F.col("wse_max") - F.col("w")) <= 0.005, F.lit(False)).alias("near"))


def _power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that follow power laws exactly, one a reach, in cells of different flows."""
    law = carriers.cells(spark, sf_dir).withColumns({"u": F.col("comid") % 7, "q0": 1 + F.col("qty") % 9})
    q = lambda k: F.col("q0") * (k + 1)
    item = lambda k: F.struct(q(k).alias("q"), ((0.5 + F.col("u") / 10) * F.pow(q(k), F.lit(0.4))).alias("v"), ((3 + F.col("u")) * F.pow(q(k), F.lit(0.3))).alias("t"), (5 + (0.2 + F.col("u") / 20) * F.pow(q(k), F.lit(0.5))).alias("wse"))
    return law.select(F.col("comid").alias("COMID"), "r", "c", F.lit(5.0).alias("base_elev"), F.array(*[item(k) for k in range(5)]).alias("inc"))


LAWS = f"{r('0.2::DOUBLE + comid % 7 / 20.0::DOUBLE')} AS depth_a, 0.5::DOUBLE AS depth_b, 3.0::DOUBLE + comid % 7 AS tw_a, 0.3::DOUBLE AS tw_b, {r('0.5::DOUBLE + comid % 7 / 10.0::DOUBLE')} AS vel_a, 0.4::DOUBLE AS vel_b"


@query(f'WITH {CELL_SQL} SELECT comid AS "COMID", r, c, {LAWS} FROM cell')
def cell_power_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.fits import cell_curves

    return cell_curves(_power(spark, sf_dir), ["COMID", "r", "c"])


@query(f'WITH {CELL_SQL} SELECT DISTINCT comid AS "COMID", {LAWS} FROM cell')
def pooled_power_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.fits import pooled_curves

    return pooled_curves(_power(spark, sf_dir))


# --- neighbourhoods -------------------------------------------------------------------------------------------------
PAIRS = """pairs AS (SELECT a.comid, a."row", a.col, a.z, b."row" AS nrow, b.col AS ncol, b.z AS nz FROM grid a JOIN grid b ON a.comid = b.comid AND abs(b."row" - a."row") <= 10 AND abs(b.col - a.col) <= 10)"""
OPEN = """nrow < "row" + 10 AND ncol < col + 10"""
STEEP = """abs(z - nz) / sqrt((ncol - col) * (ncol - col) * 900.0::DOUBLE + (nrow - "row") * (nrow - "row") * 900.0::DOUBLE)"""
LOCAL = f"""local AS (SELECT g.comid, g."row", g.col, coalesce(s, 0) AS slope FROM grid g LEFT JOIN (SELECT comid, "row", col, avg({STEEP}) AS s FROM pairs WHERE {OPEN} AND (nrow <> "row" OR ncol <> col) GROUP BY ALL) USING (comid, "row", col))"""
IQR = f"""slopes AS (SELECT comid, {r(STEEP, 8)} AS s FROM pairs WHERE (nrow > "row" OR (nrow = "row" AND ncol > col)) AND {r(STEEP, 8)} > 0),
    bounds AS (SELECT comid, {r('quantile_cont(s, 0.25)', 8)} AS p25, {r('quantile_cont(s, 0.75)', 8)} AS p75 FROM slopes GROUP BY comid),
    med AS (SELECT comid, median(s) AS slope FROM slopes JOIN bounds USING (comid) WHERE s BETWEEN p25 AND p75 GROUP BY comid),
    iqr AS (SELECT comid, coalesce(slope, 0.0002::DOUBLE) AS slope, coalesce(p25, 0.0002::DOUBLE) AS p25, coalesce(p75, 0.0002::DOUBLE) AS p75 FROM (SELECT DISTINCT comid FROM grid) LEFT JOIN bounds USING (comid) LEFT JOIN med USING (comid))"""


@query(f'WITH {GRID_SQL}, {PAIRS}, {LOCAL} SELECT comid, "row", col, {r("slope", 6)} AS slope FROM local')
def local_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbourhood.local_slope(carriers.grid(spark, sf_dir), 30.0, 30.0, 10).select("comid", "row", "col", rounded("slope", 6).alias("slope"))


@query(f"WITH {GRID_SQL}, {PAIRS}, {IQR} SELECT comid, {r('slope', 6)} AS slope, {r('p25', 6)} AS p25, {r('p75', 6)} AS p75 FROM iqr")
def reach_slope_iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = neighbourhood.reach_slope(carriers.grid(spark, sf_dir), 30.0, 30.0, 10)
    return out.select("comid", *[rounded(c, 6).alias(c) for c in ("slope", "p25", "p75")])


@query(f'WITH {GRID_SQL}, {PAIRS}, {LOCAL}, {IQR} SELECT comid, l."row", l.col, {r("least(greatest(l.slope, p25), p75)", 6)} AS slope FROM local l JOIN iqr USING (comid)')
def corrected_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = carriers.grid(spark, sf_dir)
    out = neighbourhood.corrected_slope(neighbourhood.local_slope(grid, 30.0, 30.0, 10), neighbourhood.reach_slope(grid, 30.0, 30.0, 10))
    return out.select("comid", "row", "col", rounded("slope", 6).alias("slope"))


@query(f"""WITH {GRID_SQL}, {PAIRS}, s AS (SELECT comid, "row", col, count(*) AS n, sum(ncol - col) AS sx, sum(nrow - "row") AS sy, sum((ncol - col) * (nrow - "row")) AS sxy, sum((ncol - col) * (ncol - col)) AS sxx,
    max(abs(ncol - col)) AS mx, max(abs(nrow - "row")) AS my FROM pairs WHERE {OPEN} GROUP BY ALL),
    d AS (SELECT comid, "row", col, n, CASE WHEN n <= 1 THEN 0.0::DOUBLE WHEN n * sxx - sx * sx <= 1e-6 OR abs(n * sxy - sx * sy) <= 1e-6 THEN CASE WHEN mx > my THEN 0.0::DOUBLE ELSE {pi / 2} END
        ELSE atan((n * sxy - sx * sy)::DOUBLE / (n * sxx - sx * sx)::DOUBLE) + CASE WHEN n * sxy - sx * sy < 0 THEN {2 * pi} ELSE 0 END END AS dir FROM s)
    SELECT comid, "row", col, {r('dir', 6)} AS stream_direction, {r(f'CASE WHEN n <= 1 THEN 0 WHEN dir - {pi / 2} < 0 THEN dir - {pi / 2} + {pi} ELSE dir - {pi / 2} END', 6)} AS xs_direction FROM d""")
def stream_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = neighbourhood.stream_direction(carriers.grid(spark, sf_dir), 10)
    return out.select("comid", "row", "col", rounded("stream_direction", 6).alias("stream_direction"), rounded("xs_direction", 6).alias("xs_direction"))


@query(f"""WITH {GRID_SQL} SELECT a."row", a.col, a.comid, count(*) AS n_around FROM grid a JOIN (SELECT "row" + i AS "row", col + j AS col FROM grid, (VALUES (-1), (0), (1)) x(i), (VALUES (-1), (0), (1)) y(j)) b
    ON a."row" = b."row" AND a.col = b.col GROUP BY ALL HAVING count(*) <= 2""")
def terminal_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbourhood.terminal_cells(carriers.grid(spark, sf_dir)).select("row", "col", "comid", "n_around")


@query(f"WITH {GRID_SQL} SELECT comid, min(z) AS min_elev, max(z) AS max_elev FROM grid GROUP BY comid")
def reach_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbourhood.elevation_range(carriers.grid(spark, sf_dir))


# --- sections -------------------------------------------------------------------------------------------------------
ORD = 12
ORDINATES_SQL = f"""t AS (SELECT angle_idx, i, angle_idx * {pi / 30} AS theta FROM (SELECT unnest(range(31)) AS angle_idx), (SELECT unnest(range({ORD})) AS i)),
    u AS (SELECT *, theta >= {pi / 4} AND theta <= {3 * pi / 4} AS steep, CASE WHEN theta >= {pi / 4} AND theta <= {3 * pi / 4} THEN abs(cos(theta)) < 1e-12 ELSE abs(sin(theta)) < 1e-12 END AS snap,
        round_even(CASE WHEN theta >= {pi / 4} AND theta <= {3 * pi / 4} THEN i * cos(theta) ELSE i * sin(theta) END * 1e9, 0) / 1e9 AS u FROM t),
    o AS (SELECT *, CASE WHEN snap THEN 0 ELSE floor(u) END AS m, CASE WHEN snap THEN 0 ELSE round_even(u + CASE WHEN steep AND u < 0 THEN -0.5 ELSE 0.5 END, 0) END AS s FROM u),
    ords AS (SELECT angle_idx, i, CASE WHEN steep THEN i ELSE m END AS rm, CASE WHEN steep THEN m WHEN theta >= {pi / 2} THEN -i ELSE i END AS cm,
        CASE WHEN steep THEN i ELSE s END AS rs, CASE WHEN steep THEN s WHEN theta >= {pi / 2} THEN -i ELSE i END AS cs, CASE WHEN snap THEN 0 ELSE abs(u - s) END AS ws FROM o)"""
DENSE_SQL = f"""size AS (SELECT {STRIP} * (max(l_suppkey) + 1) AS m FROM lineitem),
    dense AS (SELECT "row", col, coalesce(z, 50.0::DOUBLE) AS z FROM (SELECT * FROM (SELECT unnest(range({ROWS})) AS "row"), (SELECT unnest(range(m)) AS col FROM size)) LEFT JOIN grid USING ("row", col))"""
SECTION_SQL = f"""cell AS (SELECT "row" * m + col AS cell_seq, "row" AS r, col AS c, ("row" + col) % 31 AS angle_idx FROM grid, size),
    pts AS (SELECT cell_seq, side, i, r + side * rm AS a, c + side * cm AS b, r + side * rs AS a2, c + side * cs AS b2, ws FROM cell JOIN ords USING (angle_idx), (VALUES (1), (-1)) v(side)),
    ok AS (SELECT *, min(CASE WHEN least(a, a2, b, b2) <= 0 OR greatest(a, a2) >= {ROWS - 1} OR greatest(b, b2) >= m - 1 THEN i END) OVER (PARTITION BY cell_seq, side) AS cut FROM pts, size),
    drawn AS (SELECT cell_seq, side, i, g.z * (1 - ws) + h.z * ws AS z, a, b FROM ok JOIN dense g ON g."row" = a AND g.col = b JOIN dense h ON h."row" = a2 AND h.col = b2 WHERE i < coalesce(cut, {ORD}))"""


def _dense(spark: SparkSession, sf_dir: str, columns: int) -> DataFrame:
    every = spark.range(ROWS * columns).select((F.col("id") / columns).cast("long").alias("row"), (F.col("id") % columns).alias("col"))
    z = F.coalesce("z", F.lit(50.0))
    return every.join(carriers.grid(spark, sf_dir), ["row", "col"], "left").select("row", "col", z.alias("z"), F.lit(1).alias("lc"), F.lit(0.03).alias("n"))


def _sampled(spark: SparkSession, sf_dir: str, *wanted: str) -> DataFrame:
    m = carriers.columns(spark, sf_dir)
    cells = carriers.grid(spark, sf_dir).select((F.col("row") * m + F.col("col")).alias("cell_seq"), "row", "col", ((F.col("row") + F.col("col")) % 31).cast("int").alias("angle_idx"))
    return sections.sample(cells, _dense(spark, sf_dir, m), sections.ordinates(spark, ORD, 1.0, 1.0), ROWS, m, wanted=wanted)


@query(f"WITH {GRID_SQL}, {DENSE_SQL}, {ORDINATES_SQL}, {SECTION_SQL} SELECT cell_seq, count(*) FILTER (side = 1) AS n1, count(*) FILTER (side = -1) AS n2, {r('coalesce(sum(z) FILTER (side = 1), 0)', 5)} AS z1, {r('coalesce(sum(z) FILTER (side = -1), 0)', 5)} AS z2 FROM drawn GROUP BY cell_seq")
def section_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = lambda p: rounded(F.aggregate(p, F.lit(0.0), lambda s, z: s + z), 5)  # noqa: E731  half weights end in 5 at the fourth place
    return _sampled(spark, sf_dir, "p").select("cell_seq", F.size("p1").cast("long").alias("n1"), F.size("p2").cast("long").alias("n2"), total("p1").alias("z1"), total("p2").alias("z2"))


@query(f"""WITH {GRID_SQL}, {DENSE_SQL}, {ORDINATES_SQL}, {SECTION_SQL}, mid AS (SELECT cell_seq, z AS z0, a, b FROM drawn WHERE side = 1 AND i = 0),
    low AS (SELECT cell_seq, arg_min(a, (z, i, -side)) AS ra, arg_min(b, (z, i, -side)) AS cb FROM drawn JOIN mid USING (cell_seq) WHERE i < 5 AND drawn.z > 0 AND drawn.z < z0 GROUP BY cell_seq)
    SELECT cell_seq, coalesce(ra, a)::BIGINT AS "row", coalesce(cb, b)::BIGINT AS col FROM mid LEFT JOIN low USING (cell_seq)""".replace("arg_min(a,", "arg_min(drawn.a,").replace("arg_min(b,", "arg_min(drawn.b,"))
def low_spot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.low_spot(_sampled(spark, sf_dir, "p", "rc").where(F.size("p1") > 0), 5).select("cell_seq", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))


@query(f"WITH {CELL_SQL}, {REACH_SQL}, {sides_sql('SELECT comid, r, c, try, side * (1 + (try * 7 + c) % 3) AS side, n, slope, 0.5::DOUBLE AS w FROM (SELECT *, unnest(range(4)) AS try FROM cell JOIN reach USING (comid))')} SELECT comid, r, c, arg_min(try * 0.1::DOUBLE, ({r('width', 9)}, try)) AS xs_angle, {r('min(width)')} AS top_width FROM geo GROUP BY comid, r, c")
def best_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = F.col("side") * (1 + (F.col("try") * 7 + F.col("c")) % 3)
    p = F.transform(F.sequence(F.lit(0), F.lit(LENGTH - 1)), lambda i: i * F.lit(1.0) / F.col("side"))
    tries = carriers.cells(spark, sf_dir).withColumn("try", F.explode(F.array(*map(F.lit, range(4))))).withColumn("side", wide)
    tries = tries.withColumns({"p1": p, "dz": F.lit(1.0), "angle": F.col("try") * F.lit(0.1)}).withColumn("p2", F.col("p1"))
    out = sections.best_angle(tries, keys=("comid", "r", "c"))
    return out.join(carriers.reach(spark, sf_dir).select("comid"), "comid").select("comid", "r", "c", "xs_angle", rounded("top_width").alias("top_width"))


@query("""SELECT l_suppkey AS comid, count(*) AS n, sum(l_quantity) AS total FROM lineitem GROUP BY l_suppkey""")
def manual_section_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tables import parse_arrays

    text = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("comid"), (F.col("l_orderkey") % 50).alias("k")).agg(F.to_json(F.collect_list("l_quantity")).alias("XS1_Profile"))
    parsed = parse_arrays(text, {"XS1_Profile": "double"})
    return parsed.select("comid", F.size("XS1_Profile").alias("m"), F.aggregate("XS1_Profile", F.lit(0.0), lambda s, x: s + x).alias("t")).groupBy("comid").agg(F.sum("m").alias("n"), F.sum("t").alias("total"))


# --- rating lookup, fits, bathymetry --------------------------------------------------------------------------------
@query("""WITH pts AS (SELECT l_partkey AS k, l_quantity AS q, min(l_extendedprice) AS y FROM lineitem GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY q) - 1 AS i, count(*) OVER (PARTITION BY k) AS m FROM pts),
    b AS (SELECT k, m, least(greatest(count(*) FILTER (q < 20.5), 1), m - 1) AS j FROM o GROUP BY k, m),
    e AS (SELECT b.k, m, max(q) FILTER (i = j - 1) AS q0, max(y) FILTER (i = j - 1) AS y0, max(q) FILTER (i = j) AS q1, max(y) FILTER (i = j) AS y1, min(y) AS lone FROM b JOIN o USING (k, m) GROUP BY ALL)
    SELECT k, round_even(CASE WHEN m = 1 THEN lone ELSE y0 + (20.5 - q0) * (y1 - y0) / (q1 - q0) END * 100, 0) / 100 AS y FROM e""")
def rating_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("k"), F.col("l_quantity").cast("double").alias("q")).agg(F.min("l_extendedprice").alias("y"))
    lists = pts.groupBy("k").agg(F.collect_list(F.struct("q", "y")).alias("pairs"))
    return lists.select("k", rounded(rating.interpolated(F.col("pairs"), F.lit(20.5)), 2).alias("y"))


@query(f"""WITH {CELL_SQL}, {REACH_SQL}, x AS (SELECT comid, ln(qty) AS x, ln(5 + side * pow(qty, 0.4::DOUBLE)) AS y FROM cell), s AS (SELECT comid, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * y) AS sxy, sum(x * x) AS sxx FROM x GROUP BY comid)
    SELECT comid, {r('(n * sxy - sx * sy) / (n * sxx - sx * sx)')} AS b, {r('exp((sy - (n * sxy - sx * sy) / (n * sxx - sx * sx) * sx) / n)')} AS a FROM s WHERE n * sxx - sx * sx <> 0""")
def power_fit_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.fits import log_line

    pts = carriers.cells(spark, sf_dir).select("comid", F.col("qty").alias("q"), (5 + F.col("side") * F.pow("qty", F.lit(0.4))).alias("y"))
    return log_line(pts, "comid").select("comid", rounded("b").alias("b"), rounded("a").alias("a")).where("b IS NOT NULL")


def _banked(spark: SparkSession, sf_dir: str, *wanted: str) -> DataFrame:
    """Triangular sections with water on the first ordinates, and their banks by some methods."""
    wet = F.transform(F.sequence(F.lit(0), F.lit(LENGTH - 1)), lambda i: F.when(i <= F.col("qty") % 7, 80).otherwise(10))
    return bathymetry.with_banks(carriers.sections(spark, sf_dir).withColumn("lc1", wet).withColumn("lc2", wet), wanted=wanted, keep=("comid", "r", "c"))


@query(f"WITH {CELL_SQL}, {REACH_SQL} SELECT comid, r, c, least(ceil(0.1::DOUBLE * side - 1e-9)::INTEGER, {LENGTH}) AS bank, least(ceil(0.1::DOUBLE * side - 1e-9)::INTEGER, {LENGTH + 1}) - 1 AS level_bank FROM cell JOIN reach USING (comid)")
def bank_flat_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First ordinate that is 0.1 above the centre, i / side >= 0.1 at ceil(0.1 side), and the one before it."""
    return _banked(spark, sf_dir, "flat", "level").select("comid", "r", "c", F.get("flat", F.lit(0)).alias("bank"), F.get("level", F.lit(1)).alias("level_bank"))


@query(f"WITH {CELL_SQL}, {REACH_SQL} SELECT comid, r, c, (1 + qty % 7)::INTEGER AS bank, 0.1::DOUBLE AS level FROM cell JOIN reach USING (comid)")
def bank_landcover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The centre is the lowest ordinate, so the water's level is the one that stands for none: 0.1 above it."""
    return _banked(spark, sf_dir, "cover", "cover_level").select("comid", "r", "c", F.get("cover", F.lit(1)).alias("bank"), rounded("cover_level").alias("level"))


@query(f"""WITH RECURSIVE {REACH_SQL}, f(comid, q, slope, stage, start, depth, done) AS (
    SELECT comid, q_max, slope, 1, 0.0::DOUBLE, 0.0::DOUBLE, false FROM reach
    UNION ALL
    SELECT comid, q, slope, CASE WHEN full_ THEN stage + 1 ELSE stage END, CASE WHEN full_ THEN d - h ELSE start END, CASE WHEN full_ THEN d - h ELSE d END, full_ AND stage = 4 FROM (
        SELECT *, (1 / 0.03::DOUBLE * d * 16.0::DOUBLE * pow(d * 16.0::DOUBLE / (12.0::DOUBLE + 2.0::DOUBLE * sqrt(16.0::DOUBLE + d * d)), 2.0::DOUBLE / 3) * sqrt(slope) > q) OR d >= start + 25 AS full_ FROM (
            SELECT *, CASE stage WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.5::DOUBLE WHEN 3 THEN 0.1::DOUBLE ELSE 0.01::DOUBLE END AS h, depth + CASE stage WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.5::DOUBLE WHEN 3 THEN 0.1::DOUBLE ELSE 0.01::DOUBLE END AS d FROM f WHERE NOT done)))
    SELECT comid, {r('depth', 2)} AS depth FROM f WHERE done""")
def trapezoid_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pandas as pd

    depth = F.pandas_udf(lambda q, s: pd.Series(bathymetry.trapezoid_depth(q, 12.0, 20.0, s)), "double")
    return carriers.reach(spark, sf_dir).select("comid", rounded(depth("q_max", "slope"), 2).alias("depth"))


@query(f"""WITH RECURSIVE {REACH_SQL}, f(comid, q, slope, depth, done) AS (
    SELECT comid, q_max, slope, 0.0::DOUBLE, false FROM reach
    UNION ALL
    SELECT comid, q, slope, d, (1 / 0.03::DOUBLE * a * pow(a / p, 2.0::DOUBLE / 3) * sqrt(slope) > q) OR d >= 25 FROM (SELECT *, 0.5::DOUBLE * d * w1 + 0.5::DOUBLE * d * w2 AS a, sqrt(w1 * w1 + d * d) + sqrt(w2 * w2 + d * d) AS p FROM (
        SELECT *, 5.0::DOUBLE - 5.0::DOUBLE * (1.0::DOUBLE / (1.0::DOUBLE + d)) AS w1, 5.0::DOUBLE - 5.0::DOUBLE * (2.0::DOUBLE / (2.0::DOUBLE + d)) AS w2 FROM (SELECT *, depth + 0.1::DOUBLE AS d FROM f WHERE NOT done))))
    SELECT comid, {r('depth', 2)} AS depth FROM f WHERE done""")
def triangle_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pandas as pd

    depth = F.pandas_udf(lambda q, s: pd.Series(bathymetry.triangle_depth(q, 5.0, 0.0, 1.0, 2.0, s)), "double")
    return carriers.reach(spark, sf_dir).select("comid", rounded(depth("q_max", "slope"), 2).alias("depth"))


@query(f"""WITH {CELL_SQL} SELECT (r + i)::BIGINT AS "row", (c + side_ * i)::BIGINT AS col, arg_max({r('i / side')}, (comid * 100000 + r * 100 + c, side_, i)) AS z FROM cell, (SELECT unnest(range(4)) AS i), (VALUES (1), (2)) v(side_) GROUP BY ALL""")
def bathy_last_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.struct((F.col("r") + k % 4).alias("row"), (F.col("c") + F.floor(k / 4 + 1) * (k % 4)).alias("col"), rounded((k % 4) / F.col("side")).alias("z"), F.floor(k / 4 + 1).alias("side"), (k % 4).alias("i")))
    cells = carriers.cells(spark, sf_dir).select((F.col("comid") * 100000 + F.col("r") * 100 + F.col("c")).alias("cell_seq"), item.alias("burnt"))
    return bathymetry.bathymetry_grid(cells).select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "z")


# --- points ---------------------------------------------------------------------------------------------------------
POINTS_SQL = "pts AS (SELECT vec_id, (vec_id * 37) % 400 * 5.0::DOUBLE + round_even(embedding[1]::DOUBLE * 100, 0) AS x, (vec_id * 91) % 300 * 5.0::DOUBLE + round_even(embedding[2]::DOUBLE * 100, 0) AS y, 100.0::DOUBLE + (vec_id % 7) * 0.02::DOUBLE AS wse, label AS comid FROM embeddings)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    at = lambda i, k, m: (F.col("vec_id") * k) % m * 5.0 + F.rint(F.get("embedding", F.lit(i)).cast("double") * 100)
    return e.select("vec_id", at(0, 37, 400).alias("x"), at(1, 91, 300).alias("y"), (100.0 + (F.col("vec_id") % 7) * 0.02).alias("wse"), F.col("label").alias("comid"))


@query(f"WITH {POINTS_SQL} SELECT a.vec_id AS a, b.vec_id AS b FROM pts a JOIN pts b ON a.vec_id < b.vec_id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 50")
def within_distance_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.pairs_within(_points(spark, sf_dir), 50.0, "vec_id").select("a", "b")


@query(f"""WITH {POINTS_SQL}, d AS (SELECT s.vec_id AS seed, p.vec_id, sqrt((s.x - p.x) * (s.x - p.x) + (s.y - p.y) * (s.y - p.y)) AS dist FROM pts s, pts p WHERE s.vec_id % 25 = 0 AND p.vec_id % 25 <> 0)
    SELECT seed, vec_id, {r('dist')} AS dist FROM (SELECT *, rank() OVER (PARTITION BY seed ORDER BY dist) AS k FROM d) WHERE k = 1""")
def nearest_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = _points(spark, sf_dir)
    seeds = pts.where("vec_id % 25 = 0").select(F.col("vec_id").alias("seed"), "x", "y")
    return spatial.nearest(seeds, pts.where("vec_id % 25 <> 0"), "seed").select("seed", "vec_id", rounded("dist").alias("dist"))


@query(f"""WITH RECURSIVE {POINTS_SQL}, edges AS (SELECT a.vec_id AS a, b.vec_id AS b FROM pts a JOIN pts b ON a.vec_id < b.vec_id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 50 AND abs(a.wse - b.wse) / ((a.wse + b.wse) / 2) * 100 <= 0.05),
    fate(id, stays) USING KEY (id) AS (SELECT vec_id, true FROM pts WHERE vec_id NOT IN (SELECT b FROM edges) UNION
        (SELECT e.b, NOT bool_or(coalesce(f.stays, false)) FROM edges e LEFT JOIN recurring.fate f ON f.id = e.a WHERE e.b NOT IN (SELECT id FROM recurring.fate) AND EXISTS (SELECT 1 FROM fate)
            GROUP BY e.b HAVING bool_or(coalesce(f.stays, false)) OR count(f.id) = count(*)))
    SELECT vec_id, x, y, wse FROM pts JOIN fate ON id = vec_id WHERE stays""")
def thin_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy thinning in row order; the twin settles all points whose earlier neighbours are settled, round by round."""
    return spatial.thin(_points(spark, sf_dir), 50.0, 0.05, "vec_id", "wse").select("vec_id", "x", "y", "wse")


@query(f"WITH b AS (SELECT user_id, radians(value) AS a FROM events) SELECT user_id, {r('degrees(atan2(avg(sin(a)), avg(cos(a))))', 2)} AS bearing FROM b GROUP BY user_id")
def circular_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(rounded(F.degrees(spatial.circular_mean(F.radians("value"))), 2).alias("bearing"))


@query(f"""WITH {CELL_SQL}, {REACH_SQL}, lit AS (SELECT cell.comid AS "COMID", r, c, {r('0.1::DOUBLE * q_max')} AS velocity, {r('side / 5 * q_max')} AS width, {r('qty + 0.14::DOUBLE * q_max')} AS wse FROM cell JOIN reach USING (comid)),
    m AS (SELECT *, avg(wse) OVER w AS a, stddev_samp(wse) OVER w AS s FROM lit WINDOW w AS (PARTITION BY "COMID")) SELECT "COMID", r, c, velocity, width, wse FROM m WHERE wse BETWEEN a - 2 * s AND a + 2 * s AND wse > 0""")
def vdt_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rating tables that are lines, read between and beyond their increments."""
    made = {f"{n}_{i}": e for i in (1, 2, 3) for n, e in (("q", F.lit(5.0 * i)), ("v", F.lit(0.5 * i)), ("t", F.col("side") * i), ("wse", F.col("qty") + 0.7 * i))}
    vdt = carriers.cells(spark, sf_dir).withColumnRenamed("comid", "COMID").withColumns(made)
    out = rating.evaluate_vdt(vdt, carriers.reach(spark, sf_dir).select("comid", "q_max"), 3, keep=("r", "c"))
    return out.select("COMID", "r", "c", F.col("Velocity").alias("velocity"), F.col("TopWidth").alias("width"), F.col("WaterSurfaceElev_m").alias("wse"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level lines: supplier s along row s % 600, through the middles of 5 + s % 7 cells."""
    at = lambda n: F.struct((n + 0.5).alias("x"), (-(F.col("s_suppkey") % 600) - 0.5).alias("y"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array(at(F.lit(0.0)), at((4 + F.col("s_suppkey") % 7).cast("double"))).alias("pts"))


@query("""SELECT "row", col, max(s_suppkey) AS comid FROM (SELECT s_suppkey, s_suppkey % 600 AS "row", unnest(range(5 + s_suppkey % 7)) AS col FROM supplier) GROUP BY "row", col""")
def rasterised_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.rasterise(_lines(spark, sf_dir), (0.0, 1.0, 0.0, 0.0, 0.0, -1.0), "s_suppkey")


@query(f"SELECT s_suppkey, {r('atan2(s_acctbal, 100.0::DOUBLE + s_nationkey)', 6)} AS bearing FROM supplier")
def reach_bearings(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    pts = F.array(at(F.lit(1), F.lit(2)), at(F.lit(50), F.lit(-3)), at(F.col("s_nationkey") + 101, F.col("s_acctbal") + 2))
    return spatial.reach_bearing(table(spark, sf_dir, "supplier").withColumn("pts", pts)).select("s_suppkey", rounded("bearing", 6).alias("bearing"))


ENDS_SQL = """ends AS (SELECT comid, arg_min(z, ("row", col)) AS z0, arg_max(z, ("row", col)) AS z1, min("row") AS r0, max("row") AS r1, arg_min(col, ("row", col)) AS c0, arg_max(col, ("row", col)) AS c1 FROM grid GROUP BY comid)"""


@query(f"""WITH {GRID_SQL}, {ENDS_SQL} SELECT comid, {r('abs(z1 - z0) / sqrt((r1 - r0) * (r1 - r0) + (c1 - c0) * (c1 - c0))', 6)} AS slope FROM ends""")
def end_point_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines from a stream's first cell to its last, in row-major order."""
    grid = carriers.grid(spark, sf_dir)
    at = lambda p: F.struct((F.col(f"{p}.col") + 0.5).alias("x"), (-F.col(f"{p}.row") - 0.5).alias("y"))
    ends = grid.groupBy("comid").agg(F.min(F.struct("row", "col")).alias("a"), F.max(F.struct("row", "col")).alias("b"))
    out = spatial.end_point_slope(ends.select("comid", F.array(at("a"), at("b")).alias("pts")), grid, (0.0, 1.0, 0.0, 0.0, 0.0, -1.0), "comid")
    return out.select("comid", rounded("slope", 6).alias("slope"))


@query(f"""WITH {GRID_SQL}, pts AS (SELECT l_orderkey AS k, l_linenumber AS l, l_suppkey * 4 + 1 AS pc, l_orderkey % 600 AS pr FROM lineitem),
    near AS (SELECT k, l, z, greatest(abs("row" - pr), abs(col - pc)) AS ring, ("row" - pr) * ("row" - pr) + (col - pc) * (col - pc) AS d2, "row", col FROM pts JOIN (SELECT *, unnest(range(5)) - 2 AS i FROM grid) g ON g.col - pc BETWEEN -2 AND 2 AND "row" + i = pr)
    SELECT k, l, arg_min(z, (ring, d2, "row", col)) AS z FROM near GROUP BY k, l""")
def values_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elevation under a point in each line item's strip, or else the nearest within two cells."""
    lines = table(spark, sf_dir, "lineitem")
    pts = lines.select(F.struct("l_orderkey", "l_linenumber").alias("id"), (F.col("l_suppkey") * STRIP + 1.5).alias("x"), (-(F.col("l_orderkey") % ROWS) - 0.5).alias("y"))
    out = spatial.value_near(pts, carriers.grid(spark, sf_dir), (0.0, 1.0, 0.0, 0.0, 0.0, -1.0), "id")
    return out.select(F.col("id.l_orderkey").alias("k"), F.col("id.l_linenumber").alias("l"), "z")


@query(f"""WITH {GRID_SQL}, size AS (SELECT {STRIP} * (max(l_suppkey) + 1) AS m FROM lineitem), ends AS (SELECT a."row", a.col, a.comid FROM grid a JOIN (SELECT "row" + i AS "row", col + j AS col FROM grid, (VALUES (-1), (0), (1)) x(i), (VALUES (-1), (0), (1)) y(j)) b
    ON a."row" = b."row" AND a.col = b.col GROUP BY ALL HAVING count(*) <= 2 UNION SELECT "row", col, comid FROM grid, size WHERE "row" < 1 OR col < 1 OR "row" >= {ROWS - 1} OR col >= m - 1),
    span AS (SELECT comid, min(z) AS lo, max(z) AS hi FROM grid GROUP BY comid)
    SELECT ends.comid AS "COMID", 100.0::DOUBLE - 5.0::DOUBLE - "row" * 10.0::DOUBLE AS "Lat", 5.0::DOUBLE + col * 10.0::DOUBLE AS "Long", "row" AS "Row", col AS "Col", lo AS "MinElev", hi AS "MaxElev" FROM ends JOIN span USING (comid)""")
def raster_seed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .features import raster_seeds

    return raster_seeds(carriers.grid(spark, sf_dir), (0.0, 10.0, 0.0, 100.0, 0.0, -10.0), ROWS, carriers.columns(spark, sf_dir))


@query(f"""WITH {PERIODS}, {PIVOT}, inside AS (SELECT c_custkey AS rivid FROM customer WHERE c_acctbal BETWEEN 0 AND 5000 AND c_nationkey <= 12),
    points AS (SELECT o_custkey AS rivid, {r("max(o_totalprice / 3.0::DOUBLE) FILTER (o_orderkey % 2 = 0)")} AS qout_median, {r("max(o_totalprice / 3.0::DOUBLE) FILTER (o_orderkey % 2 = 1)")} AS qout_max FROM orders WHERE o_custkey IN (SELECT rivid FROM inside) GROUP BY o_custkey)
    SELECT rivid, p.* EXCLUDE (rivid), v.* EXCLUDE (rivid), {r('qout_max * 1.5::DOUBLE')} AS qout_max_premium, {r('rp100 * 1.5::DOUBLE')} AS rp100_premium FROM points p FULL JOIN (SELECT * FROM pivoted WHERE rivid IN (SELECT rivid FROM inside)) v USING (rivid)""")
def tile_flow_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow table of the reaches in a box: each customer is a line between two points."""
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    reaches = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("rivid"), F.array(at(F.lit(1), F.lit(1)), at(F.col("c_acctbal"), F.col("c_nationkey"))).alias("pts"))
    curve = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("rivid"), F.when(F.col("o_orderkey") % 2 == 0, 50.0).otherwise(0.0).alias("p_exceed"), (F.col("o_totalprice") / 3.0).alias("fdc"))
    return flow_stats.tile_table(curve, _periods(spark, sf_dir), reaches, (0.0, 0.0, 5000.0, 12.0))


@query("SELECT p_partkey, t.* FROM part LEFT JOIN (VALUES (11, 'Water', 0.03::DOUBLE), (21, 'Dev_Open_Space', 0.013::DOUBLE), (22, 'Dev_Low_Intesity', 0.05::DOUBLE), (23, 'Dev_Med_Intensity', 0.075::DOUBLE), (24, 'Dev_High_Intensity', 0.1::DOUBLE), (31, 'Barren_Land', 0.03::DOUBLE), (41, 'Decid_Forest', 0.12::DOUBLE), (42, 'Evergreen_Forest', 0.12::DOUBLE), (43, 'Mixed_Forest', 0.12::DOUBLE), (52, 'Shrub', 0.05::DOUBLE), (71, 'Grass_Herb', 0.03::DOUBLE), (81, 'Pasture_Hay', 0.04::DOUBLE), (82, 'Cultivated_Crops', 0.035::DOUBLE), (90, 'Woody_Wetlands', 0.1::DOUBLE), (95, 'Emergent_Herb_Wet', 0.1::DOUBLE)) t(\"LC_ID\", \"Description\", \"Manning_n\") ON p_size = \"LC_ID\"")
def default_roughness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as cells whose size is their land-cover class; a class that is not listed has no row in the table."""
    from ..sources import tables

    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("int").alias("LC_ID"))
    classes = tables.default_roughness(spark).withColumn("class", F.col("LC_ID"))
    return parts.join(F.broadcast(classes), "LC_ID", "left").select("p_partkey", F.col("class").alias("LC_ID"), "Description", "Manning_n")  # fifteen classes


@query()
def cleaned_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Swept in row-major order, so no SQL twin; tested against an array version."""
    from ..operators import streams

    return streams.clean_streams(carriers.grid(spark, sf_dir))


@query(f"""WITH {GRID_SQL} SELECT DISTINCT comid FROM grid""")
def distinct_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carriers.grid(spark, sf_dir).select("comid").distinct()


@query(f"""WITH {GRID_SQL}, fine AS (SELECT "row", col, floor("row" * 3 / 7.0::DOUBLE)::BIGINT AS sr, floor(col * 3 / 7.0::DOUBLE)::BIGINT AS sc FROM grid) SELECT f."row", f.col, g.z AS v FROM fine f JOIN grid g ON g."row" = sr AND g.col = sc""")
def resample_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = carriers.grid(spark, sf_dir)
    return spatial.resample(g.select("row", "col"), g.select("row", "col", F.col("z").alias("v")), (0.0, 3.0, 0.0, 0.0, 0.0, -3.0), (0.0, 7.0, 0.0, 0.0, 0.0, -7.0), centre=False)


from . import registry_io  # noqa: E402, F401  more queries, which register themselves

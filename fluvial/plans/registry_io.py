"""Registered queries over gridded files, stores and line networks that Spark makes of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bathymetry, flow_stats, lookup, networks
from ..sources import arrays, raster
from . import carriers, discharge
from .carriers import CELL_SQL, GRID_SQL, LENGTH, REACH_SQL, ROWS, table
from .lineage import new_folder
from .registry import PERIODS, PIVOT, YEARLY, query, r
from .registry import _periods as return_periods


# --- gridded files --------------------------------------------------------------------------------------------------
def _file(spark: SparkSession, sf_dir: str, compression: str) -> DataFrame:
    """The grid as a GeoTIFF, read back. The file lies in the shared folder."""
    n_cols = carriers.columns(spark, sf_dir)
    like = raster.Header("<", ROWS, n_cols, "f8", 1, 1, (ROWS, n_cols), [], [], (0.0, 10.0, 0.0, 6000.0, 0.0, -10.0), False, 26912, None, False, {"geo": (1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, 26912)})
    path = f"{new_folder(spark, 'grid')}/grid.tif"
    raster.write_grid(carriers.grid(spark, sf_dir).withColumnRenamed("z", "v"), path, like, "f8", compression=compression, strip_values=20_000)
    return raster.read_grid(spark, path, 200_000)[0].select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "v")


@query(f'WITH {GRID_SQL} SELECT "row", col, z AS v FROM grid')
def raster_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell of the grid, written with LZW and differences and read again."""
    return _file(spark, sf_dir, "lzw")


@query(f'WITH {GRID_SQL} SELECT "row", col, z AS v FROM grid WHERE "row" BETWEEN 100 AND 180 AND col IN (8, 9, 10, 41)')
def raster_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window, which only the strips that hold it are read for."""
    return _file(spark, sf_dir, "none").where("row BETWEEN 100 AND 180 AND col IN (8, 9, 10, 41)")


# --- series in stores -----------------------------------------------------------------------------------------------
SERIES = "series AS (SELECT o_custkey AS rivid, year(o_orderdate) AS y, max(o_totalprice / 7.0123457::DOUBLE) AS q FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey <= 12 AND c_acctbal BETWEEN 0 AND 5000) GROUP BY o_custkey, o_orderdate)"


def _series(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Series of all customers in a Zarr store, and the reaches that are asked for: customers in a region and credit."""
    from ..sources.zarr_store import write_zarr

    group = new_folder(spark, "series")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("rivid"), F.col("o_orderdate").cast("timestamp").alias("time"), (F.col("o_totalprice") / 7.0123457).alias("Qout"))  # no exact halves to round
    write_zarr(orders, group, "Qout", {"time": 500, "rivid": 200})
    asked = table(spark, sf_dir, "customer").where("c_nationkey <= 12 AND c_acctbal BETWEEN 0 AND 5000")
    return discharge.of_reaches(arrays.read_zarr(spark, group, "Qout"), asked, "rivid", "c_custkey").where("Qout IS NOT NULL"), asked


@query(f"WITH {SERIES}, {YEARLY['mean']}, {YEARLY['median']}, {YEARLY['max']} SELECT * FROM means JOIN medians USING (rivid) JOIN maxs USING (rivid)")
def store_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the series of some reaches, whose ids choose the chunks that are read, once."""
    rows = _series(spark, sf_dir)[0]
    return flow_stats.yearly(rows.where("rivid IS NOT NULL"), ("mean", "median", "max"))


# --- line networks --------------------------------------------------------------------------------------------------
#: Points of a reach: so many places along a slanted line, so that lengths are whole numbers.
PLACES = 2003
NETWORK_SQL = f"""e AS (SELECT DISTINCT l_suppkey AS k, (l_orderkey % {PLACES})::BIGINT AS a, ((l_orderkey % {PLACES} + 1 + l_linenumber) % {PLACES})::BIGINT AS b FROM lineitem),
    reach AS (SELECT DISTINCT k, CASE WHEN k % 5 <> 0 THEN k // 2 END AS down FROM e), head AS (SELECT * FROM reach WHERE k NOT IN (SELECT down FROM reach WHERE down IS NOT NULL)),
    way AS (SELECT k, a AS p, b AS q, 5 * abs(a - b) AS len FROM e JOIN head USING (k) UNION ALL SELECT k, b, a, 5 * abs(a - b) FROM e JOIN head USING (k)),
    ends AS (SELECT DISTINCT k, p FROM way), below AS (SELECT DISTINCT head.k, down FROM head JOIN e ON e.k = head.down),
    off AS (SELECT ends.k, p, min(sqrt(pow(3 * p - x - t * dx, 2) + pow(4 * p + 10000 * ends.k - y - t * dy, 2))) AS v FROM ends JOIN (
        SELECT ends.k, p, 3.0::DOUBLE * a AS x, 4.0::DOUBLE * a + 10000 * down AS y, 3.0::DOUBLE * (b - a) AS dx, 4.0::DOUBLE * (b - a) AS dy,
            least(1, greatest(0, ((3 * p - 3 * a) * 3.0::DOUBLE * (b - a) + (4 * p + 10000 * ends.k - 4 * a - 10000 * down) * 4.0::DOUBLE * (b - a)) / (25.0::DOUBLE * (b - a) * (b - a)))) AS t
        FROM ends JOIN below USING (k) JOIN e ON e.k = below.down) USING (k, p) GROUP BY ends.k, p),
    high AS (SELECT k, p, (p * 37 % 101)::DOUBLE AS v FROM way WHERE k NOT IN (SELECT k FROM below) GROUP BY k, p HAVING count(DISTINCT q) = 1),
    scored AS (SELECT *, min(v) OVER w AS least, max(v) OVER w AS most, 1e-9 AS slack FROM off WINDOW w AS (PARTITION BY k) UNION ALL SELECT *, min(v) OVER w, max(v) OVER w, 0.01 FROM high WINDOW w AS (PARTITION BY k)),
    marked AS (SELECT k, p, v <= least + greatest(slack, abs(least) * 1e-9) AS outlet FROM scored),
    far(k, p, d) USING KEY (k, p) AS (SELECT k, p, 0::BIGINT FROM marked WHERE outlet UNION
        (SELECT way.k, way.q, min(far.d + way.len)::BIGINT FROM far JOIN way USING (k, p) LEFT JOIN recurring.far AS old ON old.k = way.k AND old.p = way.q WHERE old.d IS NULL OR far.d + way.len < old.d GROUP BY way.k, way.q)),
    falls AS (SELECT k, p, q FROM way JOIN far USING (k, p) JOIN (SELECT k, p AS q, d AS e FROM far) USING (k, q) WHERE d > e),
    passed(k, p) AS (SELECT k, q FROM falls JOIN marked USING (k, p) WHERE NOT outlet UNION SELECT k, q FROM passed JOIN falls USING (k, p))"""


@query(f"WITH RECURSIVE {NETWORK_SQL} SELECT k, 3.0::DOUBLE * p AS x, 4.0::DOUBLE * p + 10000.0::DOUBLE * k AS y FROM marked WHERE NOT outlet AND (k, p) NOT IN (SELECT k, p FROM passed)")
def reach_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as reaches: each line item is a part between two places of a slanted line; a supplier flows into that of
    half its number, every fifth into none. No reach has all its ends at its outlet."""
    at = lambda n: F.struct((3.0 * n).alias("x"), (4.0 * n + 10000.0 * F.col("k")).alias("y"))
    a = (F.col("l_orderkey") % PLACES).alias("a")
    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), a, ((F.col("l_orderkey") % PLACES + 1 + F.col("l_linenumber")) % PLACES).alias("b")).distinct()
    parts = F.transform(F.sort_array(F.collect_set(F.struct("a", "b"))), lambda s: F.array(at(s["a"]), at(s["b"])))
    down = F.when(F.col("k") % 5 != 0, F.floor(F.col("k") / 2)).cast("long").alias("down")
    reaches = e.groupBy("k").agg(parts.alias("parts")).select("k", down, "parts")
    points = e.select("k", F.explode(F.array("a", "b")).alias("n")).distinct()
    heights = points.select("k", (3.0 * F.col("n")).alias("x"), (4.0 * F.col("n") + 10000.0 * F.col("k")).alias("y"), (F.col("n") * 37 % 101).cast("double").alias("z"))
    return networks.headwater_seeds(reaches, heights, "k", "down")


# --- tiles ----------------------------------------------------------------------------------------------------------
@query(f"""WITH {PERIODS}, {PIVOT}, tiles AS (SELECT n_nationkey AS tile, 100.0::DOUBLE * n_regionkey - 900 AS minx, 0.0::DOUBLE AS miny, 400.0::DOUBLE * (n_nationkey + 1) AS maxx, n_nationkey::DOUBLE AS maxy FROM nation),
    inside AS (SELECT tile, c_custkey AS rivid FROM customer JOIN tiles ON least(1, c_acctbal) >= minx AND least(1, c_nationkey) >= miny AND greatest(1, c_acctbal) <= maxx AND greatest(1, c_nationkey) <= maxy),
    points AS (SELECT o_custkey AS rivid, {r("max(o_totalprice / 3.0::DOUBLE) FILTER (o_orderkey % 2 = 0)")} AS qout_median, {r("max(o_totalprice / 3.0::DOUBLE) FILTER (o_orderkey % 2 = 1)")} AS qout_max FROM orders GROUP BY o_custkey)
    SELECT tile, rivid, p.* EXCLUDE (rivid), v.* EXCLUDE (rivid), {r('qout_max * 1.5::DOUBLE')} AS qout_max_premium, {r('rp100 * 1.5::DOUBLE')} AS rp100_premium FROM inside JOIN points p USING (rivid) JOIN pivoted v USING (rivid)""")
def tile_flow_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow tables of all tiles at once: a tile a nation; each customer is a line between two points."""
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    reaches = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("rivid"), F.array(at(F.lit(1), F.lit(1)), at(F.col("c_acctbal"), F.col("c_nationkey"))).alias("pts"))
    n = F.col("n_nationkey")
    tiles = table(spark, sf_dir, "nation").select(n.alias("tile"), (100.0 * F.col("n_regionkey") - 900).alias("minx"), F.lit(0.0).alias("miny"), (400.0 * (n + 1)).alias("maxx"), n.cast("double").alias("maxy"))
    curve = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("rivid"), F.when(F.col("o_orderkey") % 2 == 0, 50.0).otherwise(0.0).alias("p_exceed"), (F.col("o_totalprice") / 3.0).alias("fdc"))
    return flow_stats.tile_tables(curve, return_periods(spark, sf_dir), reaches, tiles)


# --- long rating tables -----------------------------------------------------------------------------------------------
@query("""WITH pts AS (SELECT l_partkey AS k, l_quantity::DOUBLE AS q, min(l_extendedprice) AS y FROM lineitem GROUP BY ALL), asked AS (SELECT l_orderkey, l_linenumber, l_partkey AS k, 60.0::DOUBLE * l_discount * 10 AS x FROM lineitem),
    o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY q) - 1 AS i, count(*) OVER (PARTITION BY k) AS m FROM pts),
    b AS (SELECT k, x, m, least(greatest(count(*) FILTER (q < x), 1), m - 1) AS j FROM o JOIN (SELECT DISTINCT k, x FROM asked) USING (k) GROUP BY k, x, m),
    e AS (SELECT b.k, x, m, max(q) FILTER (i = j - 1) AS q0, max(y) FILTER (i = j - 1) AS y0, max(q) FILTER (i = j) AS q1, max(y) FILTER (i = j) AS y1, min(y) AS lone FROM b JOIN o USING (k, m) GROUP BY ALL)
    SELECT l_orderkey, l_linenumber, round_even(CASE WHEN m = 1 THEN lone ELSE y0 + (x - q0) * (y1 - y0) / (q1 - q0) END * 10, 0) / 10 AS level FROM asked LEFT JOIN e USING (k, x)""")
def long_rating_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rating tables of prices over quantities; each line item asks for one flow."""
    lines = table(spark, sf_dir, "lineitem")
    asked = lines.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("k"), (60.0 * F.col("l_discount") * 10).alias("x"))
    found = lookup.levels_at(lines.select(F.col("l_partkey").alias("k"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("y")), asked, "k")
    return found.select("l_orderkey", "l_linenumber", (F.rint(F.col("level") * 10) / 10).alias("level"))


# --- bathymetry -------------------------------------------------------------------------------------------------------
#: Depths in closed steps: of trapezoids with a fifth of their width under each slope, and of triangles whose sides rise
#: by 1 / side a metre.
STEP = "CASE stage WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.5::DOUBLE WHEN 3 THEN 0.1::DOUBLE ELSE 0.01::DOUBLE END"


def _depths(width: str, single: str) -> str:
    return f"""{CELL_SQL}, {REACH_SQL}, sized AS (SELECT comid, r, c, qty, side, slope, q_base, ({width})::DOUBLE AS width FROM cell JOIN reach USING (comid)),
    t(width, slope, q, stage, start, depth, done) AS (
        SELECT DISTINCT width, slope, q_base, 1, 0.0::DOUBLE, 0.0::DOUBLE, false FROM sized WHERE NOT ({single})
        UNION ALL
        SELECT width, slope, q, CASE WHEN over THEN stage + 1 ELSE stage END, CASE WHEN over THEN d - h ELSE start END, CASE WHEN over THEN d - h ELSE d END, over AND stage = 4 FROM (
            SELECT *, (1 / 0.03::DOUBLE * d * 0.8::DOUBLE * width * pow(d * 0.8::DOUBLE * width / (0.6::DOUBLE * width + 2 * sqrt(0.04::DOUBLE * width * width + d * d)), 2.0::DOUBLE / 3) * sqrt(slope) > q) OR d >= start + 25 AS over
            FROM (SELECT *, {STEP} AS h, depth + {STEP} AS d FROM t WHERE NOT done))),
    v(qty, side, slope, q, depth, done) AS (
        SELECT DISTINCT qty, side, slope, q_base, 0.0::DOUBLE, false FROM sized WHERE {single}
        UNION ALL
        SELECT qty, side, slope, q, d, (1 / 0.03::DOUBLE * d * w * pow(d * w / (2 * sqrt(w * w + d * d)), 2.0::DOUBLE / 3) * sqrt(slope) > q) OR d >= 25
            FROM (SELECT *, 1 - 1 / (1 + d * side) AS w FROM (SELECT *, depth + 0.1::DOUBLE AS d FROM v WHERE NOT done))),
    deep AS (SELECT comid, r, c, qty, side, width, coalesce(td, vd) AS depth FROM sized LEFT JOIN (SELECT width, slope, depth AS td FROM t WHERE done) USING (width, slope) LEFT JOIN (SELECT qty, slope, depth AS vd FROM v WHERE done) USING (qty, slope))"""


def _burnt(spark: SparkSession, sf_dir: str, least: int, by_banks: bool) -> DataFrame:
    """Triangular sections with water on the first ordinates, and the channel burnt into them."""
    every = F.sequence(F.lit(0), F.lit(LENGTH - 1))
    wet = F.transform(every, lambda i: F.when(i <= least + F.col("qty") % 7, 80).otherwise(10))
    at = F.transform(every, lambda i: F.struct(i.alias("r"), F.lit(1).alias("c")))
    made = carriers.sections(spark, sf_dir).withColumns({"lc1": wet, "lc2": wet, "rc1": at, "rc2": at})
    burnt = bathymetry.with_bathymetry(made, 0.2, by_banks, True, keep=("comid", "r", "c")).select("comid", "r", "c", F.explode("burnt").alias("b"))
    return burnt.select("comid", "r", "c", "b.side", "b.i", (F.rint(F.col("b.z") * 1e4) / 1e4).alias("z"))


@query(f"""WITH RECURSIVE {_depths('1 + 2 * (qty % 7)', 'qty % 7 = 0')},
    shape AS (SELECT comid, r, c, s AS side, i, i / side AS ground, CASE WHEN qty % 7 = 0 THEN -depth ELSE -depth + depth * CASE WHEN 1 + qty % 7 - i > 0.2::DOUBLE * width THEN 0 ELSE 1 - (1 + qty % 7 - i) / (0.2::DOUBLE * width) END END AS z
        FROM deep, (VALUES (1), (2)) sides(s), (SELECT unnest(range({LENGTH})) AS i) WHERE i <= CASE WHEN qty % 7 = 0 THEN 0 ELSE 1 + qty % 7 END)
    SELECT comid, r, c, side, i::INTEGER AS i, {r('z', 4)} AS z FROM shape WHERE z < ground""")
def burnt_below_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trapezoids under the water's level between banks by land cover; a single cell of water is a triangle."""
    return _burnt(spark, sf_dir, 0, False)


@query(f"""WITH RECURSIVE {_depths('3 + 2 * (qty % 7)', 'false')},
    shape AS (SELECT comid, r, c, s AS side, i, (2 + qty % 7) / side - depth AS low, depth, 3 + qty % 7 - i AS off, 0.2::DOUBLE * width AS slant
        FROM deep, (VALUES (1), (2)) sides(s), (SELECT unnest(range({LENGTH})) AS i) WHERE i <= 3 + qty % 7)
    SELECT comid, r, c, side, i::INTEGER AS i, {r('low + depth * CASE WHEN off > slant THEN 0 ELSE 1 - off / slant END', 4)} AS z FROM shape""")
def burnt_below_banks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trapezoids under the lower bank's level, banks by land cover; what is lower already is filled."""
    return _burnt(spark, sf_dir, 2, True)

"""A hydraulic run from gridded inputs to rating tables, curves, sections and bathymetry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rounding import rounded
from ..operators import bathymetry, fits, flow_stats, neighbourhood, sections, solver, spatial
from ..sources import outputs, raster, tables, vectors
from ..sources.config import Config
from .lineage import settle


@dataclass
class Inputs:
    """Grids as rows (row, col, ...), flows, roughness classes, and the georeference."""

    dem: DataFrame  # row, col, z
    streams: DataFrame  # row, col, comid (no row where there is no stream)
    cover: DataFrame  # row, col, lc
    flows: DataFrame  # comid, q_base, q_max
    roughness: DataFrame  # lc, n
    n_rows: int
    n_cols: int
    dx: float
    dy: float
    reaches: DataFrame | None = None  # comid, pts
    transform: tuple = (0.0, 1.0, 0.0, 0.0, 0.0, -1.0)
    manual: DataFrame | None = None


def load(spark: SparkSession, config: Config) -> tuple[Inputs, raster.Header]:
    """Read the inputs that a configuration names; grids that do not match are refused."""
    dem, head = raster.read_grid(spark, config.dem)
    streams, s_head = raster.read_grid(spark, config.streams)
    cover, c_head = raster.read_grid(spark, config.cover)
    for other in (s_head, c_head):
        if (other.n_rows, other.n_cols) != (head.n_rows, head.n_cols):
            raise ValueError("grids differ in rows or columns")
        if other.geographic != head.geographic:
            raise ValueError("grids differ in their coordinate systems")
    dx, dy = spatial.cell_size(head.transform, head.n_rows, head.geographic)
    reaches = None
    if config.reaches:
        reaches = vectors.longest_part(vectors.read_lines(spark, config.reaches)).select(F.col(config.flow_id).cast("long").alias("comid"), "pts")
    return Inputs(
        dem.withColumnRenamed("v", "z"), streams.where("v <> 0").select("row", "col", F.col("v").cast("long").alias("comid")), cover.select("row", "col", F.col("v").cast("int").alias("lc")),
        tables.read_flows(spark, config.flows, config.flow_id, config.flow_base or None, config.flow_max), tables.read_roughness(spark, config.roughness), head.n_rows, head.n_cols, dx, dy, reaches, head.transform,
        tables.read_manual_sections(spark, config.manual, config.flow_id) if config.manual else None,
    ), head


class Engine:
    """One run. ``results`` holds a row a cell: COMID, Row, Col, Elev, QBaseflow, QMax, Slope, XS_Angle, BaseElev, inc."""

    def __init__(self, spark: SparkSession, config: Config, inputs: Inputs | None = None):
        self.spark, self.config = spark, config
        self.inputs, self.head = (inputs, None) if inputs is not None else load(spark, config)
        self.dem, self.shifted = tables.shift_negative(self.inputs.dem)

    def cells(self) -> DataFrame:
        """Stream cells of reaches with a flow: cell_seq in row-major order, row, col, z, comid, flows, slope."""
        i, c = self.inputs, self.config
        on_stream = i.streams.join(self.dem, ["row", "col"]).withColumn("cell_seq", F.col("row").cast("long") * i.n_cols + F.col("col"))
        cells = flow_stats.on_flow(on_stream, i.flows)
        method = c.slope_method
        if method == "end_points":
            reaches = i.reaches
            if self.head is not None and self.head.geographic:  # lengths in metres, in the zone of the grid
                zone = int((i.transform[0] + 180) // 6) + 1
                at = F.transform("pts", lambda p: F.struct(*[x.alias(n) for x, n in zip(spatial.utm(p["x"], p["y"], zone, i.transform[3] < 0), "xy")]))
                metres = reaches.withColumn("m", at)
                length = F.expr("aggregate(sequence(1, size(m) - 1), 0.0D, (s, k) -> s + hypot(m[k].x - m[k - 1].x, m[k].y - m[k - 1].y))")
                degrees = F.expr("aggregate(sequence(1, size(pts) - 1), 0.0D, (s, k) -> s + hypot(pts[k].x - pts[k - 1].x, pts[k].y - pts[k - 1].y))")
                scale = metres.select("comid", (length / degrees).alias("scale"))
                slopes = spatial.end_point_slope(reaches, self.dem, i.transform, "comid").join(scale, "comid").select("comid", rounded(F.col("slope") / F.col("scale"), 8).alias("slope"))
            else:
                slopes = spatial.end_point_slope(reaches, self.dem, i.transform, "comid")
            sloped = cells.join(slopes, "comid")
        elif method == "reach_average":
            sloped = cells.join(neighbourhood.reach_slope(cells, i.dx, i.dy, c.slope_cells).select("comid", "slope"), "comid")
        else:
            local = neighbourhood.local_slope(cells, i.dx, i.dy, c.slope_cells)
            if method == "local_average_corrected":
                local = neighbourhood.corrected_slope(local, neighbourhood.reach_slope(cells, i.dx, i.dy, c.slope_cells))
            sloped = cells.join(local.select("comid", "row", "col", "slope"), ["comid", "row", "col"])
        return flow_stats.with_flow(sloped, i.flows)

    def ground(self) -> DataFrame:
        """row, col, z, lc, n; stream cells carry the water class."""
        i = self.inputs
        wet = i.streams.select("row", "col").distinct().withColumn("wet", F.lit(True))
        cover = i.cover.join(wet, ["row", "col"], "left").select("row", "col", F.when(F.col("wet"), self.config.water).otherwise(F.col("lc")).alias("lc"))
        return self.dem.join(tables.roughness_of(cover, i.roughness), ["row", "col"])

    def sections(self) -> DataFrame:
        """Sampled sections with their cells' columns, after low spot and angle search; manual ones replace sampling.

        What several later steps read is written once: else each would hold the whole plan before it, and the plans
        would multiply.
        """
        i, c = self.inputs, self.config
        ground = self.ground()
        cells = self.cells()
        if i.manual is not None:
            return self._manual(cells, ground)
        cells = settle(cells, "cells")
        directed = settle(cells.join(neighbourhood.stream_direction(cells, c.direction_cells).select("comid", "row", "col", "xs_direction"), ["comid", "row", "col"]), "directed")
        ground = settle(ground, "ground")
        length = sections.section_length(c.distance, i.dx, i.dy)
        table = sections.ordinates(self.spark, length, i.dx, i.dy)
        draw = lambda rows, keys=("cell_seq",): sections.sample(rows, ground, table, i.n_rows, i.n_cols, keys)
        placed = directed.withColumn("angle_idx", sections.angle_index(F.col("xs_direction")))
        if c.low_spot > 0:
            moved = sections.low_spot(draw(placed.select("cell_seq", "row", "col", "angle_idx")), c.low_spot)
            placed = settle(placed.drop("row", "col").join(moved, "cell_seq"), "placed")
        offsets = sections.test_angles(c.turn, c.turn_step)
        tested = len(offsets) > 1 or (c.turn > 0 and c.turn_step > 0)
        from math import pi

        if len(offsets) > 1:
            turned = lambda d: F.pmod(F.col("xs_direction") + F.col("offset"), F.lit(pi))
            tries = placed.withColumn("o", F.explode(F.array(*[F.struct(F.lit(k).alias("try"), F.lit(x).alias("offset")) for k, x in enumerate(offsets)])))
            tries = tries.select("cell_seq", "row", "col", "xs_direction", "o.try", "o.offset").withColumn("angle", turned(None)).withColumn("angle_idx", F.rint(F.col("angle") / sections.STEP).cast("int"))
            # Many candidates share one of the 31 directions: each is sampled once.
            drawn = draw(tries.select("cell_seq", "row", "col", "angle_idx").distinct(), ("cell_seq", "angle_idx"))
            best = sections.best_angle(tries.select("cell_seq", "angle_idx", "angle", "try").join(drawn.select("cell_seq", "angle_idx", "p1", "p2", "dz"), ["cell_seq", "angle_idx"]))
            placed = settle(placed.join(best.select("cell_seq", "xs_angle"), "cell_seq"), "placed").withColumn("xs_direction", F.col("xs_angle")).drop("xs_angle").withColumn("angle_idx", F.rint(F.col("xs_direction") / sections.STEP).cast("int"))
        elif tested:
            placed = placed.withColumn("xs_direction", F.pmod("xs_direction", F.lit(pi)))
        return placed.drop("z").join(draw(placed.select("cell_seq", "row", "col", "angle_idx")), "cell_seq")

    def _manual(self, cells: DataFrame, ground: DataFrame) -> DataFrame:
        """Manual sections of reaches with a flow; their roughness is the grid's under each ordinate."""
        i = self.inputs
        slopes = cells.groupBy(F.col("comid").alias("source_id")).agg(F.median("slope").alias("slope"))
        rows = i.manual.join(i.flows, "comid").join(slopes, "source_id").withColumn("cell_seq", F.col("row") * i.n_cols + F.col("col"))
        if rows.isEmpty():
            raise ValueError("no manual section is of a reach with a flow")
        lift = 100.0 if self.shifted else 0.0
        for s in (1, 2):
            under = rows.select("cell_seq", F.posexplode(f"rc{s}").alias("i", "rc")).select("cell_seq", "i", F.col("rc.r").alias("row"), F.col("rc.c").alias("col")).join(ground.select("row", "col", "n"), ["row", "col"])
            n = under.groupBy("cell_seq").agg(F.sort_array(F.collect_list(F.struct("i", "n"))).alias(f"n{s}")).select("cell_seq", F.col(f"n{s}.n").alias(f"n{s}"))
            rows = rows.join(n, "cell_seq").withColumn(f"p{s}", F.transform(f"p{s}", lambda z: z + lift))
        return rows

    def solved(self) -> DataFrame:
        c = self.config
        drawn = self.sections()
        if c.bathymetry:
            drawn = bathymetry.with_bathymetry(drawn, c.bank_share, c.by_banks, c.by_cover, c.water)
        self._drawn = drawn = settle(drawn, "sections")
        keep = ("cell_seq", "comid", "row", "col", "xs_direction")
        raw = solver.rating_tables(drawn, c.increments, keep)
        ground = self.dem.select("row", "col", F.col("z").cast("double").alias("elev"))
        lift = 100.0 if self.shifted else 0.0
        down = F.transform("inc", lambda x: x.withField("wse", x["wse"] - lift))
        return raw.join(ground, ["row", "col"]).select(
            "cell_seq", F.col("comid").alias("COMID"), F.col("row").alias("Row"), F.col("col").alias("Col"), (F.col("elev") - lift).alias("Elev"), F.col("q_base").alias("QBaseflow"), F.col("q_max").alias("QMax"),
            F.col("slope").alias("Slope"), F.col("xs_direction").alias("XS_Angle"), (F.col("base_elev") - lift).alias("BaseElev"), "start", "last", down.alias("inc"),
        )

    @property
    def results(self) -> DataFrame:
        if not hasattr(self, "_results"):
            self._results = settle(self.solved(), "results")  # every output reads it
        return self._results

    def vdt(self) -> DataFrame:
        return outputs.vdt(self.results, self.config.increments, ["COMID", "Row", "Col", "Elev", "QBaseflow", "Slope", "XS_Angle"])

    def area_perimeter(self) -> DataFrame:
        return outputs.area_perimeter(self.results, self.config.increments, ["COMID", "Row", "Col"])

    def curves(self) -> DataFrame:
        """Power-law curves a cell (from its own table), or a reach (pooled over its cells)."""
        columns = ["COMID", "Row", "Col", "BaseElev", "DEM_Elev", "QMax", "Slope", "XS_Angle"]
        usable = self.results.where("last > start + 1").withColumn("DEM_Elev", F.col("Elev")).withColumn("base_elev", F.col("BaseElev"))
        head = [rounded(c, {"XS_Angle": 7, "Slope": 8}.get(c, 3)).alias(c) if c not in ("COMID", "Row", "Col") else F.col(c) for c in columns]
        if self.config.reach_curves:
            return usable.select(*head).join(fits.pooled_curves(usable), "COMID").where("depth_a > 0 AND tw_a > 0 AND vel_a > 0")
        return fits.cell_curves(usable, columns + ["base_elev"]).select(*head, "depth_a", "depth_b", "tw_a", "tw_b", "vel_a", "vel_b")

    def section_rows(self) -> DataFrame:
        self.results  # noqa: B018  draws the sections
        return outputs.section_rows(self._drawn.select(F.col("comid").alias("COMID"), F.col("row").alias("Row"), F.col("col").alias("Col"), "p1", "p2", "n1", "n2", "rc1", "rc2", "dz"))

    def bathymetry_grid(self) -> DataFrame:
        self.results  # noqa: B018
        merged = bathymetry.bathymetry_grid(self._drawn)
        return bathymetry.below_ground(merged, self.dem, self.shifted, self.config.by_banks)

    def flood_grid(self) -> DataFrame:
        """3 at every cell that was worked on."""
        self.results  # noqa: B018
        return self._drawn.select("row", "col", F.lit(3).alias("v")).distinct()

    def run(self) -> DataFrame:
        """Write every output that the configuration names; returns the results."""
        c = self.config
        for path, made in ((c.vdt, self.vdt), (c.ap, self.area_perimeter), (c.curves, self.curves)):
            if path:
                outputs.write_table(made(), path)
        if c.sections:
            outputs.write_table(self.section_rows(), c.sections, "\t")
        if c.bathymetry and self.head is not None:
            raster.write_grid(self.bathymetry_grid().withColumnRenamed("z", "v"), c.bathymetry, self.head)
        if c.flood and self.head is not None:
            raster.write_grid(self.flood_grid(), c.flood, self.head, "u1", 0)
        return self.results


def main(argv: list[str] | None = None) -> None:
    """fluvial <configuration file>"""
    import argparse

    parser = argparse.ArgumentParser(description="Rating curves of stream cells from grids")
    parser.add_argument("config")
    parser.add_argument("--log-level", default="WARN", choices=["ALL", "DEBUG", "ERROR", "FATAL", "INFO", "OFF", "TRACE", "WARN"])
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    spark.sparkContext.setLogLevel(args.log_level)
    Engine(spark, Config.read(args.config)).run()


if __name__ == "__main__":
    main()

"""Inputs of a run from a folder: land cover and streams on the elevation grid, roughness classes, the configuration;
bearings of reaches, angles of stream cells, and a forecast file a scenario."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import projections
from ..operators import rating, spatial, streams
from ..sources import arrays, files, outputs, raster, tables, vectors
from ..sources.config import Config

#: Places of inputs and of what is made, under the main folder (fixed by the layout of such folders).
DEM, COVER, LINES = "DEM/DEM.tif", "LandCover/LandCover.tif", "StrmShp/StreamShapefile.shp"
MADE = {
    "cover": "LAND/LAND_Raster.tif", "roughness": "LAND/AR_Manning_n_for_NLCD_MED.txt", "streams": "STRM/STRM_Raster_Clean.tif", "vdt": "VDT/VDT_Database.txt", "curves": "VDT/CurveFile.csv",
    "flood": "FloodMap/ARC_Flood.tif", "bathymetry": "Bathymetry/ARC_Bathy.tif", "sections": "XS/XS_File.txt",
}
CONFIG = "ARC_InputFiles/ARC_Input_File.txt"


def every_cell(spark: SparkSession, like: raster.Header) -> DataFrame:
    return spark.range(like.n_rows * like.n_cols).select((F.col("id") / like.n_cols).cast("long").alias("row"), (F.col("id") % like.n_cols).alias("col"))


def prepare(spark: SparkSession, main: str, id_field: str, max_flow: str, base_flow: str, flow_file: str, use_banks: bool, by_cover: bool, delete: bool = False) -> Config:
    """Write land cover and cleaned streams on the grid of the elevations, the default roughness and a configuration.

    Folders that hold something already are refused unless ``delete`` is set. Returns the configuration.
    """
    for folder in dict.fromkeys(p.partition("/")[0] for p in (*MADE.values(), CONFIG)):
        files.fresh_folder(f"{main}/{folder}", delete)
    head = raster.read_header(f"{main}/{DEM}")
    cover, cover_head = raster.read_grid(spark, f"{main}/{COVER}")
    landed = spatial.resample(every_cell(spark, head), cover, head.transform, cover_head.transform)
    raster.write_grid(landed, f"{main}/{MADE['cover']}", head, "i4", 0)
    lines = vectors.read_lines(spark, f"{main}/{LINES}").select(F.col(id_field).cast("long").alias("comid"), F.explode("parts").alias("pts"))
    drawn = spatial.rasterise(lines, head.transform, "comid").where(f"row BETWEEN 0 AND {head.n_rows - 1} AND col BETWEEN 0 AND {head.n_cols - 1}")
    raster.write_grid(streams.clean_streams(drawn).withColumnRenamed("comid", "v"), f"{main}/{MADE['streams']}", head, "i4", 0)
    written = tables.default_roughness(spark).coalesce(1)
    written.select(F.concat_ws("\t", F.col("LC_ID").cast("string"), "Description", F.format_string("%.3f", "Manning_n"))).write.mode("overwrite").text(f"{main}/{MADE['roughness']}.parts")
    files.joined(f"{main}/{MADE['roughness']}.parts", f"{main}/{MADE['roughness']}", b"LC_ID\tDescription\tManning_n\n")
    made = {name: f"{main}/{path}" for name, path in MADE.items()}
    config = Config(**{**made, "dem": f"{main}/{DEM}", "flows": flow_file, "flow_id": id_field, "flow_base": base_flow, "flow_max": max_flow, "by_banks": use_banks, "by_cover": by_cover}).checked()
    config.write(f"{main}/{CONFIG}")
    return config


def netcdf_columns(table: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """Named variables of a table of return periods, as COMID and the names given: new name -> variable."""
    return table.select(F.col(key).cast("long").alias("COMID"), *[F.col(c).cast("double").alias(n) for n, c in columns.items()])


def write_bearings(spark: SparkSession, lines: str, key: str, path: str) -> None:
    """Ids and directions (radians) from each line's first vertex to its last, of all its parts."""
    parts = vectors.read_lines(spark, lines).withColumn("pts", F.flatten("parts"))
    outputs.write_angles(spatial.reach_bearing(parts), path, key)


def write_stream_angles(spark: SparkSession, lines: str, streams_path: str, path: str) -> None:
    """Whole degrees at each stream cell, 0 elsewhere, on the streams' grid: the mean direction from the cell's centre to
    the second to fifth nearest vertices of the lines, which are brought into the grid's system where they state another."""
    cells, head = raster.read_grid(spark, streams_path)
    placed = rating.cell_centres(cells.where("v > 0").select("row", "col"), head.transform[0], head.transform[3], head.transform[1], -head.transform[5], "row", "col")
    layer, stated = vectors.read_lines(spark, lines), vectors.system_of(lines)
    if stated is not None:
        layer = projections.reproject(layer, stated, raster.system_of(head))
    vertices = layer.select(F.explode(F.flatten("parts")).alias("p")).select("p.x", "p.y").distinct()
    angles = spatial.stream_angles(placed.withColumn("cell", F.struct("row", "col")), vertices, "cell")
    raster.write_grid(angles.select("cell.row", "cell.col", F.col("angle").alias("v")), path, head, "i4", 0, compression="none")


def write_scenarios(spark: SparkSession, netcdf: str, key: str, columns: dict[str, str], folder: str) -> None:
    """A forecast file (COMID, qout) for each named variable of a NetCDF table: scenario -> variable."""
    table = netcdf_columns(arrays.read_netcdf(spark, netcdf, list(dict.fromkeys(columns.values()))), key, columns)
    outputs.scenario_flows(table, {name: name for name in columns}, folder)


def main(argv: list[str] | None = None) -> None:
    """Prepare inputs of runs."""
    parser = argparse.ArgumentParser(description=main.__doc__)
    kinds = parser.add_subparsers(dest="kind", required=True)
    inputs, angles, bearings, scenarios = (kinds.add_parser(k) for k in ("inputs", "angles", "bearings", "scenarios"))
    for name in ("main_folder", "id_field", "max_flow", "base_flow", "flow_file"):
        inputs.add_argument(f"--{name}", required=True)
    for name in ("use_banks", "by_cover", "delete"):
        inputs.add_argument(f"--{name}", action="store_true")
    for kind, names in ((angles, ("strm_shp", "strm_raster_file", "out_file")), (bearings, ("strm_shp", "stream_id_field", "out_file")), (scenarios, ("netcdf_file", "id_field", "out_folder"))):
        for name in names:
            kind.add_argument(f"--{name}", required=True)
    scenarios.add_argument("--flows", nargs="+", required=True, metavar="NAME=VARIABLE")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.kind == "inputs":
        prepare(spark, args.main_folder, args.id_field, args.max_flow, args.base_flow, args.flow_file, args.use_banks, args.by_cover, args.delete)
    elif args.kind == "angles":
        write_stream_angles(spark, args.strm_shp, args.strm_raster_file, args.out_file)
    elif args.kind == "bearings":
        write_bearings(spark, args.strm_shp, args.stream_id_field, args.out_file)
    else:
        write_scenarios(spark, args.netcdf_file, args.id_field, dict(f.split("=", 1) for f in args.flows), args.out_folder)

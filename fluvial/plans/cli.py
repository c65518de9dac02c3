"""Console commands: seeds of a stream raster, and features of a forecast."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import projections
from ..operators import networks, spatial
from ..sources import outputs, raster, tables, vectors
from .features import curve_features, raster_seeds


def _flag(text: str) -> bool:
    return str(text).strip().lower() not in ("false", "0", "no", "")


def seeds(argv: list[str] | None = None) -> None:
    """Write the seed points of a stream raster."""
    parser = argparse.ArgumentParser(description=seeds.__doc__)
    for name in ("strm_raster_file", "dem_raster_file", "seed_point_file"):
        parser.add_argument(f"--{name}", required=True)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    streams, head = raster.read_grid(spark, args.strm_raster_file)
    dem, _ = raster.read_grid(spark, args.dem_raster_file)
    cells = streams.where("v > 0").select("row", "col", F.col("v").cast("long").alias("comid")).join(dem.select("row", "col", F.col("v").alias("z")), ["row", "col"])
    outputs.write_table(raster_seeds(cells, head.transform, head.n_rows, head.n_cols), args.seed_point_file)


def features(argv: list[str] | None = None) -> None:
    """Write point features of a forecast from rating curves and stream lines."""
    parser = argparse.ArgumentParser(description=features.__doc__)
    for name in ("curve_param_file", "out_geojson_file", "out_projection", "strm_shp", "stream_id_field", "downstream_id_field", "seed_output_file", "comid_q_file"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--dem_raster_file", "--strm_raster_file", dest="dem_raster_file", required=True)
    for name in ("thin_output", "thin_geojson"):
        parser.add_argument(f"--{name}", type=_flag, default=True)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    dem, head = raster.read_grid(spark, args.dem_raster_file)
    raster.with_crs(head, args.dem_raster_file)
    system, lines_in = raster.system_of(head), vectors.system_of(args.strm_shp)
    reaches = vectors.read_lines(spark, args.strm_shp)
    if lines_in is not None:  # a layer without a system is taken to lie in the grid's
        reaches = projections.reproject(reaches, lines_in, system)
    ends = reaches.select(args.stream_id_field, F.explode(F.flatten("parts")).alias("p")).select(args.stream_id_field, "p.x", "p.y").distinct()
    at = spatial.value_near(ends.withColumn("k", F.struct(args.stream_id_field, "x", "y")), dem.withColumnRenamed("v", "z"), head.transform, "k").select("k.*", "z")
    found = networks.headwater_seeds(reaches, at, args.stream_id_field, args.downstream_id_field)
    outputs.write_vector(found.withColumn("parts", F.array(F.array(F.struct("x", "y")))), args.seed_output_file)
    named = found.select(F.col(args.stream_id_field).alias("seed"), "x", "y")
    rows = curve_features(tables.read_curves(spark, args.curve_param_file), tables.read_forecast(spark, args.comid_q_file), named, head.transform, args.thin_output and args.thin_geojson, geographic=head.geographic)
    placed = projections.reproject(rows, system, projections.of_epsg(args.out_projection))
    outputs.write_geojson(placed, args.out_geojson_file, args.out_projection)

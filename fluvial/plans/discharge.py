"""Tables of discharges for runs, from retrospective series and return periods in gridded files and stores."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import flow_stats
from ..sources import arrays, outputs, raster, vectors

#: Reaches up to this number are named in a filter, which prunes chunks; more are joined.
MOST_NAMED = 20_000


def of_reaches(rows: DataFrame, reaches: DataFrame, key: str, id_field: str) -> DataFrame:
    """The rows of a network's reaches. The ids of a tile or a basin reach the source as a filter; a network of more than
    MOST_NAMED reaches is joined, since most chunks hold one of its reaches anyway."""
    ids = reaches.select(F.col(id_field).cast("long").alias(key)).distinct()
    named = [r[0] for r in ids.limit(MOST_NAMED + 1).collect()]
    if len(named) <= MOST_NAMED:
        return rows.where(F.col(key).isin(named) if named else F.lit(False))
    return rows.join(ids, key, "left_semi")


def from_netcdf(spark: SparkSession, periods: str, yearly: str, key: str = "rivid", flow: str = "Qout") -> DataFrame:
    """COMID, qout_mean, qout_median, qout_max and the return periods, from a file of return periods (its variables
    qout_max and rp2 ... rp100) and a folder with a file of series a year."""
    wide = arrays.read_netcdf(spark, periods, ["qout_max", *(f"rp{p}" for p in flow_stats.RETURN_PERIODS)])
    return flow_stats.flow_table(wide, arrays.read_netcdf(spark, yearly, [flow]), key)


def from_stores(spark: SparkSession, series: str, periods: str, reaches: DataFrame, id_field: str, key: str = "rivid", flow: str = "Qout") -> DataFrame:
    """Statistics of whole series and return periods of a network's reaches, from two Zarr stores."""
    long = of_reaches(arrays.read_zarr(spark, series, flow), reaches, key, id_field)
    return flow_stats.retrospective(long.withColumnRenamed(flow, "Qout"), of_reaches(arrays.read_zarr(spark, periods), reaches, key, id_field), key)


def of_tile(spark: SparkSession, curve: str, periods: str, reaches: DataFrame, id_field: str, head: raster.Header, key: str = "rivid", curve_key: str = "river_id") -> DataFrame:
    """The same from a store of duration curves, of the reaches that lie wholly in a grid, with a safety factor."""
    x0, dx, _, y0, _, dy = head.transform
    x1, y1 = x0 + dx * head.n_cols, y0 + dy * head.n_rows
    box = (min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1))
    lines = reaches.withColumn("pts", F.flatten("parts"))
    inside = lines.where(F.forall("pts", lambda p: p["x"].between(box[0], box[2]) & p["y"].between(box[1], box[3])))
    points = of_reaches(arrays.read_zarr(spark, curve, "fdc").where("p_exceed IN (0.0, 50.0)"), inside, curve_key, id_field)
    period = of_reaches(arrays.read_zarr(spark, periods), inside, key, id_field)
    wide = flow_stats.duration_points(points.withColumnRenamed(curve_key, key), key).join(flow_stats.pivoted(period, key), key, "full")
    return flow_stats.with_premium(wide).withColumnRenamed(key, "COMID")


def main(argv: list[str] | None = None) -> None:
    """Write a table of discharges."""
    parser = argparse.ArgumentParser(description=main.__doc__)
    kinds = parser.add_subparsers(dest="kind", required=True)
    netcdf, stores, tile = (kinds.add_parser(k) for k in ("netcdf", "stores", "tile"))
    netcdf.add_argument("--yearly_folder", required=True)
    stores.add_argument("--series", required=True)
    tile.add_argument("--duration_curves", required=True)
    tile.add_argument("--dem_raster_file", required=True)
    for kind in (stores, tile):
        kind.add_argument("--strm_shp", required=True)
        kind.add_argument("--stream_id_field", required=True)
    for kind in (netcdf, stores, tile):
        kind.add_argument("--return_periods", required=True)
        kind.add_argument("--out_file", required=True)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.kind == "netcdf":
        made = from_netcdf(spark, args.return_periods, args.yearly_folder)
    else:
        reaches = vectors.read_lines(spark, args.strm_shp)
        if args.kind == "stores":
            made = from_stores(spark, args.series, args.return_periods, reaches, args.stream_id_field)
        else:
            made = of_tile(spark, args.duration_curves, args.return_periods, reaches, args.stream_id_field, raster.read_header(args.dem_raster_file))
    outputs.write_table(made, args.out_file)

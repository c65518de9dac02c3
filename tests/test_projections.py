"""Projections against published examples, there and back, and the descriptions of systems."""

import pytest
from pyspark.sql import functions as F

from fluvial.functions import projections as P
from fluvial.functions.projections import System

CLARKE = {"a": 6378206.4, "f": 1 / 294.97870}
FOOT = 1200 / 3937
dms = lambda d, m, s=0.0: d + m / 60 + s / 3600
#: System, degrees, published coordinates, and how far they are stated.
EXAMPLES = {
    "texas": (System("lcc", **CLARKE, lon0=-99.0, lat0=dms(27, 50), first=dms(28, 23), second=dms(30, 17), fe=2_000_000 * FOOT, unit=FOOT), (-96.0, 28.5), (2963503.91, 254759.80), 0.01),
    "jamaica": (System("lcc", **CLARKE, lon0=-77.0, lat0=18.0, fe=250_000, fn=150_000), (-dms(76, 56, 37.26), dms(17, 55, 55.80)), (255966.58, 142493.51), 0.01),
    "britain": (System("tmerc", 6377563.396, 1 / 299.32496, lon0=-2.0, lat0=49.0, k=0.9996012717, fe=400_000, fn=-100_000), (0.5, 50.5), (577274.99, 69740.50), 0.01),
    "arctic": (System("stere", f=P.WGS84, lat0=90.0, k=0.994, fe=2_000_000, fn=2_000_000), (44.0, 73.0), (3320416.75, 632668.43), 0.01),
    "makassar": (System("merc", 6377397.155, 1 / 299.15281, lon0=110.0, k=0.997, fe=3_900_000, fn=900_000), (120.0, -3.0), (5009726.58, 569150.82), 0.01),
    "albers": (System("albers", 6378206.4, 1 / 294.978698, lon0=-96.0, lat0=23.0, first=29.5, second=45.5), (-75.0, 35.0), (1885472.7, 1535925.0), 0.1),
    "web": (P.of_epsg(3857), (-dms(100, 20), dms(24, 22, 54.433)), (-11169055.58, 2800000.0), 0.02),
}


@pytest.mark.parametrize("name", sorted(EXAMPLES))
def test_published_examples(spark, name):
    system, (lon, lat), want, near = EXAMPLES[name]
    x, y = P.project(F.lit(lon), F.lit(lat), system)
    row = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert abs(row.x - want[0]) < near and abs(row.y - want[1]) < near, row


@pytest.mark.parametrize("name,code", [*((n, None) for n in sorted(EXAMPLES)), *((None, c) for c in (32633, 32733, 26912, 5070, 6933, 3395, 3413, 3031, 2154, 4326))])
def test_there_and_back(spark, name, code):
    system = P.of_epsg(code) if code else EXAMPLES[name][0]
    south = system.kind == "stere" and (system.first or system.lat0) < 0 or code == 32733
    lat0 = -70.0 if south else 70.0 if system.kind == "stere" else 40.0
    at = [(system.lon0 + d, lat0 + e) for d in (-2.9, 0.0, 1.7) for e in (-14.0, 0.0, 9.5)]
    df = spark.createDataFrame(at, "lon double, lat double")
    df = df.select("lon", "lat", *[c.alias(n) for n, c in zip("xy", P.project(F.col("lon"), F.col("lat"), system))])
    df = df.select("lon", "lat", *[c.alias(n) for n, c in zip("uv", P.unproject(F.col("x"), F.col("y"), system))])
    for r in df.collect():  # a tenth of a millimetre
        assert abs((r.lon - r.u + 180) % 360 - 180) < 1e-9 and abs(r.lat - r.v) < 1e-9, r


def test_datum_and_shapes(spark):
    paris = System("geographic", 6378249.2, 1 / 293.4660213, shift=(-168.0, -60.0, 320.0))
    rows = spark.createDataFrame([(1, [[(2.3, 48.85), (3.0, 47.0)]])], "k int, parts array<array<struct<x:double,y:double>>>")
    there = P.reproject(rows, paris, P.of_epsg(32631))
    back = P.reproject(there, P.of_epsg(32631), paris).first().parts[0]
    assert all(abs(a - b) < 1e-7 for p, q in zip(back, rows.first().parts[0]) for a, b in zip(p, q))
    moved = P.reproject(P.reproject(rows, paris, P.of_epsg(4326)).select("k", F.col("parts")[0].alias("pts")), P.of_epsg(4326), P.of_epsg(4326)).first().pts[0]
    assert 1e-5 < abs(moved.x - 2.3) + abs(moved.y - 48.85) < 3e-3
    seven = System("geographic", 6377397.155, 1 / 299.1528128, shift=(565.2, 50.3, 465.6, -0.35, 0.35, -1.87, 4.08))
    point = P.reproject(P.reproject(spark.createDataFrame([(5.4, 52.2)], "x double, y double"), seven, P.of_epsg(4326)), P.of_epsg(4326), seven).first()
    assert abs(point.x - 5.4) < 1e-7 and abs(point.y - 52.2) < 1e-7


WKT_1 = 'PROJCS["NAD83 / UTM zone 12N",GEOGCS["NAD83",DATUM["North_American_Datum_1983",SPHEROID["GRS 1980",6378137,298.257222101],TOWGS84[0,0,0,0,0,0,0]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]],PROJECTION["Transverse_Mercator"],PARAMETER["latitude_of_origin",0],PARAMETER["central_meridian",-111],PARAMETER["scale_factor",0.9996],PARAMETER["false_easting",500000],PARAMETER["false_northing",0],UNIT["metre",1],AUTHORITY["EPSG","26912"]]'
ESRI = 'PROJCS["Texas",GEOGCS["GCS",DATUM["D",SPHEROID["Clarke_1866",6378206.4,294.9786982]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]],PROJECTION["Lambert_Conformal_Conic"],PARAMETER["False_Easting",2000000.0],PARAMETER["False_Northing",0.0],PARAMETER["Central_Meridian",-99.0],PARAMETER["Standard_Parallel_1",28.5],PARAMETER["Standard_Parallel_2",30.25],PARAMETER["Latitude_Of_Origin",27.75],UNIT["Foot_US",0.3048006096012192]]'
WKT_2 = 'PROJCRS["NAD83 / Conus Albers",BASEGEOGCRS["NAD83",DATUM["North American Datum 1983",ELLIPSOID["GRS 1980",6378137,298.257222101,LENGTHUNIT["metre",1]]],PRIMEM["Greenwich",0,ANGLEUNIT["degree",0.0174532925199433]]],CONVERSION["Conus Albers",METHOD["Albers Equal Area",ID["EPSG",9822]],PARAMETER["Latitude of false origin",23,ANGLEUNIT["degree",0.0174532925199433]],PARAMETER["Longitude of false origin",-96,ANGLEUNIT["degree",0.0174532925199433]],PARAMETER["Latitude of 1st standard parallel",29.5],PARAMETER["Latitude of 2nd standard parallel",45.5],PARAMETER["Easting at false origin",0,LENGTHUNIT["metre",1]],PARAMETER["Northing at false origin",0,LENGTHUNIT["metre",1]]],CS[Cartesian,2],AXIS["easting (X)",east,ORDER[1],LENGTHUNIT["metre",1]],ID["EPSG",5070]]'


def test_descriptions():
    assert P.of_wkt(WKT_1) == P.of_epsg(26912) and P.of_wkt(WKT_2) == P.of_epsg(5070)
    texas = P.of_wkt(ESRI)
    assert (texas.kind, texas.first, texas.second, texas.lat0) == ("lcc", 28.5, 30.25, 27.75) and abs(texas.fe - 609601.2192) < 1e-3 and abs(texas.unit - FOOT) < 1e-9
    assert P.of_wkt('GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563]],UNIT["degree",0.0174532925199433]]') == P.of_epsg("EPSG:4326")
    assert P.of_geokeys((1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, 32633)) == P.of_epsg(32633) and P.of_geokeys((1, 1, 0, 2, 1024, 0, 1, 2, 2048, 0, 1, 4269)) == P.of_epsg(4269)
    keys = (1, 1, 0, 8, 1024, 0, 1, 1, 2048, 0, 1, 4269, 3072, 0, 1, 32767, 3075, 0, 1, 11, 3078, 34736, 1, 0, 3079, 34736, 1, 1, 3084, 34736, 1, 2, 3085, 34736, 1, 3)
    assert P.of_geokeys(keys, (29.5, 45.5, -96.0, 23.0)) == P.of_epsg(5070)
    for wrong in (lambda: P.of_epsg(9999), lambda: P.of_epsg(32699), lambda: P.of_wkt('LOCAL_CS["x"]'), lambda: P.of_wkt(WKT_1.replace("Transverse_Mercator", "Bonne")), lambda: P.of_geokeys((1, 1, 0, 0))):
        with pytest.raises(ValueError):
            wrong()

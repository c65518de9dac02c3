"""Points, lines and grids: distance joins on buckets, nearest joins, thinning, projections, rasterising."""

from __future__ import annotations

from collections.abc import Iterator
from math import asinh, atan, atan2, atanh, cos, cosh, degrees, hypot, pi, radians, sin, sinh, sqrt, tan

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from . import tiles
from .batches import kinds

# GRS80 (WGS84's flattening differs after the eighth digit).
AXIS, FLATTENING = 6378137.0, 1 / 298.257222101


def _around() -> list[tuple[int, int]]:
    return [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]


def _bucket(c: str, size: float) -> Column:
    return F.floor(F.col(c) / size)


def pairs_within(points: DataFrame, distance: float, order: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (a, b) of points at most ``distance`` apart, a before b, with dist: a join on buckets of that size."""
    left = points.select(F.col(order).alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), *[F.col(c).alias(f"a_{c}") for c in extra], F.explode(F.array(*[F.struct((_bucket("x", distance) + i).alias("bx"), (_bucket("y", distance) + j).alias("by")) for i, j in _around()])).alias("k"))
    right = points.select(F.col(order).alias("b"), F.col("x").alias("bx_"), F.col("y").alias("by_"), *[F.col(c).alias(f"b_{c}") for c in extra], _bucket("x", distance).alias("bx"), _bucket("y", distance).alias("by"))
    dist = F.hypot(F.col("ax") - F.col("bx_"), F.col("ay") - F.col("by_"))
    out = left.select("*", "k.bx", "k.by").drop("k").join(right, ["bx", "by"]).where(F.col("a") < F.col("b")).withColumn("dist", dist)
    return out.where(F.col("dist") <= distance).select("a", "b", "dist", *[f"{s}_{c}" for s in "ab" for c in extra])


#: Buckets along a side of a ring's bucket, by which far points are told apart before any is met.
FINE = 16


def nearest(seeds: DataFrame, points: DataFrame, key: str, start: float = 64.0, k: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """The k nearest points of each seed with dist; all ties stay. Seeds: key, x, y. Points: x, y and any columns.

    Rings of buckets, four times as wide each time: a seed is settled when k points lie within the ring's inner radius.
    A seed meets occupied fine buckets with their counts first, and then only the points of those that can hold one of
    its nearest: wide rings cost buckets, not points. ``by``: columns that must be equal.
    """
    size, left, out = start, seeds, None
    span = points.agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d")).first()
    reach = seeds.agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d")).first()
    if span["a"] is None or reach["a"] is None:
        return seeds.select(key).join(points.withColumn("dist", F.lit(0.0)).limit(0).drop("x", "y"), F.lit(False))
    most = hypot(max(span["b"], reach["b"]) - min(span["a"], reach["a"]), max(span["d"], reach["d"]) - min(span["c"], reach["c"])) + 1
    rest = [c for c in points.columns if c not in ("x", "y", *by)]
    rank = F.rank().over(_by(key))
    while True:
        fine = size / FINE
        near = left.select(key, *by, F.col("x").alias("sx"), F.col("y").alias("sy"), F.explode(F.array(*[F.struct((_bucket("x", size) + i).alias("kx"), (_bucket("y", size) + j).alias("ky")) for i, j in _around()])).alias("w")).select("*", "w.kx", "w.ky").drop("w")
        boxes = points.groupBy(*by, _bucket("x", fine).alias("fx"), _bucket("y", fine).alias("fy")).agg(F.count("*").alias("held"))
        boxes = boxes.withColumns({"kx": F.floor(F.col("fx") / FINE), "ky": F.floor(F.col("fy") / FINE)})
        # How near and how far the points of a box can be.
        inner = lambda s, f: F.greatest(F.col(f) * fine - F.col(s), F.col(s) - (F.col(f) + 1) * fine, F.lit(0.0))
        outer = lambda s, f: F.greatest(F.abs(F.col(f) * fine - F.col(s)), F.abs((F.col(f) + 1) * fine - F.col(s)))
        asked = near.join(boxes, [*by, "kx", "ky"]).withColumns({"low": F.hypot(inner("sx", "fx"), inner("sy", "fy")), "high": F.hypot(outer("sx", "fx"), outer("sy", "fy"))})
        sure = asked.withColumn("sum", F.sum("held").over(_by(key, "high"))).where(F.col("sum") >= k).groupBy(key).agg(F.min("high").alias("enough"))
        asked = asked.join(sure, key, "left").where(F.col("enough").isNull() | (F.col("low") <= F.col("enough") + 1e-9 * size)).select(key, *by, "sx", "sy", "fx", "fy")
        held = points.select(*by, *rest, "x", "y", _bucket("x", fine).alias("fx"), _bucket("y", fine).alias("fy"))
        met = asked.join(held, [*by, "fx", "fy"]).withColumn("dist", F.hypot(F.col("x") - F.col("sx"), F.col("y") - F.col("sy")))
        last = size >= most
        met = (met if last else met.where(F.col("dist") <= size)).withColumn("k", rank).where(F.col("k") <= k)
        full = met if last else met.join(met.groupBy(key).count().where(F.col("count") >= k).select(key), key, "left_semi")
        full = cut(full.select(key, *by, *rest, "x", "y", "dist"))
        out = full if out is None else out.unionByName(full)
        if last:
            return out
        left = cut(left.join(full.select(key).distinct(), key, "left_anti"))
        if left.isEmpty():
            return out
        size *= 4


def _by(key: str, order: str = "dist"):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(order)


#: Tiles of the thinning are this many distances wide at first, and grow by four a round while none would hold more edges.
TILE_WIDTH, TILE_EDGES = 64, 1_000_000
#: Where more points than this share a bucket of the distance, the first ones are decided before the others meet them: so
#: many at first and at most, and no more than have so many pairs of one bucket.
CROWD, FIRST, MOST_FIRST, FIRST_PAIRS = 64, 4096, 1_000_000, 2_000_000
#: Points whose neighbourhoods go to all tasks.
MOST_SENT = 20_000


def _differ(a: Column, b: Column) -> Column:
    """Difference of two levels in percent of their mean."""
    return F.abs(a - b) / ((a + b) / 2) * 100


def thin(points: DataFrame, distance: float, percent: float, order: str, level: str) -> DataFrame:
    """Greedy thinning in order: a point that stays drops every later one within the distance whose level differs by at
    most ``percent``.

    Where points crowd, the first ones by order are decided by themselves, and what they drop meets nothing else: the
    pairs of points grow with those that stay around, not with all that are near. Twice as many follow each time, until
    no bucket is crowded and the rest is decided at once.
    """
    alive = cut(points.select(order, "x", "y", level).dropna(subset=[order, "x", "y"]))
    dropped, most = None, FIRST
    crowd = lambda p: p.groupBy(_bucket("x", distance), _bucket("y", distance)).count().agg(F.max("count"), F.sum(F.col("count") * F.col("count"))).first()
    while (crowd(alive)[0] or 0) > CROWD:
        while True:
            first = cut(alive.orderBy(order).limit(most))
            if most <= 2 or crowd(first)[1] <= FIRST_PAIRS:
                break
            most //= 4
        gone = _thinned_out(first, distance, percent, order, level)
        stay = cut(first.join(gone, order, "left_anti"))
        # The order tells points apart: what follows the last of the first ones is left.
        later = alive.join(F.broadcast(first.agg(F.max(order).alias("__last"))), F.col(order) > F.col("__last")).drop("__last").withColumns({"bx": _bucket("x", distance), "by": _bucket("y", distance)})
        around = stay.select(F.col("x").alias("__x"), F.col("y").alias("__y"), F.col(level).alias("__level"), F.explode(F.array(*[F.struct((_bucket("x", distance) + i).alias("bx"), (_bucket("y", distance) + j).alias("by")) for i, j in _around()])).alias("k")).select("*", "k.*").drop("k")
        met = (F.hypot(F.col("__x") - F.col("x"), F.col("__y") - F.col("y")) <= distance) & (_differ(F.col("__level"), F.col(level)) <= percent)
        around = F.broadcast(around) if stay.count() <= MOST_SENT else around
        hit = later.join(around, (later["bx"] == around["bx"]) & (later["by"] == around["by"]) & met, "left_semi").select(order)
        hit = cut(hit)
        alive = cut(later.drop("bx", "by").join(hit, order, "left_anti"))
        dropped = gone.unionByName(hit) if dropped is None else dropped.unionByName(gone).unionByName(hit)
        most = min(2 * most, MOST_FIRST)
    gone = _thinned_out(alive, distance, percent, order, level)
    dropped = gone if dropped is None else dropped.unionByName(gone)
    return points.join(dropped.distinct(), order, "left_anti")


def _thinned_out(points: DataFrame, distance: float, percent: float, order: str, level: str) -> DataFrame:
    """The numbers of the points that are dropped.

    A point's fate hangs on its earlier neighbours only. Each round decides, tile by tile and in order, all points whose
    earlier neighbours are decided, in the tile or before; tiles shift and widen from round to round, so rounds grow with
    the tiles that a chain crosses, not with its points.
    """
    diff = _differ(F.col(f"a_{level}"), F.col(f"b_{level}"))
    edges = cut(pairs_within(points, distance, order, (level,)).where(diff <= percent).select("a", "b"))
    kind = points.schema[order].dataType.simpleString()
    fate = f"id {kind}, stays boolean"
    # Points without an earlier neighbour stay.
    known = cut(edges.select(F.col("a").alias("id")).distinct().join(edges.select(F.col("b").alias("id")), "id", "left_anti").withColumn("stays", F.lit(True)))
    where = points.select(F.col(order).alias("b"), "x", "y")
    dropped = known.where("NOT stays").select("id")
    size, shift, alive = TILE_WIDTH * distance, 0.0, edges.join(where, "b").withColumn("fate", F.lit(None).cast("boolean"))

    def decide(edges: pd.DataFrame) -> pd.DataFrame:
        state, earlier = {}, {}
        for a, b, known in zip(edges["a"], edges["b"], edges["fate"]):
            earlier.setdefault(b, []).append(a)
            if not pd.isna(known):
                state[a] = bool(known)
        made = []
        for b in sorted(earlier):
            fates = [state.get(a) for a in earlier[b]]
            if True in fates:
                state[b] = False
            elif None not in fates:
                state[b] = True
            else:
                continue
            made.append((b, state[b]))
        return pd.DataFrame(made, columns=["id", "stays"])

    news = known
    while True:
        # What the last round has decided goes to the edges that wait for it.
        fresh = news.select(F.col("id").alias("a"), F.col("stays").alias("now"))
        alive = cut(alive.join(fresh, "a", "left").withColumn("fate", F.coalesce("fate", "now")).drop("now"))
        if alive.isEmpty():
            break
        while True:
            tiled = alive.select("a", "b", "fate", *[F.floor((F.col(c) + shift) / size).alias(f"t{c}") for c in "xy"])
            most = tiled.groupBy("tx", "ty").count().agg(F.max("count")).first()[0]
            if most <= TILE_EDGES or size <= 2 * distance:
                break
            size /= 4
        news = cut(tiled.groupBy("tx", "ty").applyInPandas(decide, fate))
        dropped = dropped.unionByName(news.where("NOT stays").select("id"))
        alive = alive.join(news.select(F.col("id").alias("b")), "b", "left_anti")
        size, shift = (size * 4 if most * 16 <= TILE_EDGES else size), size / 2 if not shift else 0.0
    return dropped.select(F.col("id").alias(order))


def circular_mean(angle: Column) -> Column:
    """Mean direction (radians), as an aggregate."""
    return F.atan2(F.avg(F.sin(angle)), F.avg(F.cos(angle)))


def stream_angles(cells: DataFrame, vertices: DataFrame, key: str = "cell_seq") -> DataFrame:
    """Rounded degrees from each cell to its nearest vertices but the first: circular mean of up to four bearings."""
    near = nearest(cells.select(key, "x", "y"), vertices.select(F.col("x").alias("vx"), F.col("y").alias("vy"), "x", "y"), key, k=5)
    from pyspark.sql import Window

    placed = near.drop("x", "y").join(cells.select(key, "x", "y"), key).withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("dist", "vx", "vy"))).where("n BETWEEN 2 AND 5")
    return placed.groupBy(key).agg(F.rint(F.degrees(circular_mean(F.atan2(F.col("vy") - F.col("y"), F.col("vx") - F.col("x"))))).alias("angle"))


def reach_bearing(reaches: DataFrame) -> DataFrame:
    """Bearing from the first to the last vertex of pts, in radians."""
    a, b = F.get("pts", F.lit(0)), F.element_at("pts", -1)
    return reaches.withColumn("bearing", F.atan2(b["y"] - a["y"], b["x"] - a["x"]))


def resample(target: DataFrame, source: DataFrame, to: tuple, of: tuple, centre: bool = True) -> DataFrame:
    """Value v of the source cell in which each target cell lies: index arithmetic of two geotransforms, one join."""
    shift = 0.5 if centre else 0.0
    x, y = to[0] + (F.col("col") + shift) * to[1], to[3] + (F.col("row") + shift) * to[5]
    placed = target.withColumns({"__sc": F.floor((x - of[0]) / of[1]), "__sr": F.floor((y - of[3]) / of[5])})
    held = source.select(F.col("row").alias("__sr"), F.col("col").alias("__sc"), "v")
    return placed.join(held, ["__sr", "__sc"]).drop("__sr", "__sc")


def rasterise(reaches: DataFrame, transform: tuple, key: str) -> DataFrame:
    """row, col, comid of the cells that the lines (pts) run through, by steps of a quarter of a cell; the last reach by
    key wins a shared cell."""
    x0, dx, _, y0, _, dy = transform
    seg = reaches.select(key, F.posexplode(F.expr("transform(sequence(1, greatest(size(pts) - 1, 1)), i -> struct(pts[i - 1] AS a, coalesce(get(pts, i), pts[0]) AS b))")).alias("k", "s"))
    cells = F.greatest(F.abs((F.col("s.b.x") - F.col("s.a.x")) / dx), F.abs((F.col("s.b.y") - F.col("s.a.y")) / dy))
    steps = F.explode(F.sequence(F.lit(0), F.ceil(cells * 4).cast("int") + 1)).alias("t")
    pt = seg.select(key, "s", cells.alias("n"), steps).withColumn("f", F.least(F.col("t") / F.greatest(F.ceil(F.col("n") * 4), F.lit(1)), F.lit(1.0)))
    at = lambda v: F.col(f"s.a.{v}") + (F.col(f"s.b.{v}") - F.col(f"s.a.{v}")) * F.col("f")
    placed = pt.select(key, F.floor((at("y") - y0) / dy).alias("row"), F.floor((at("x") - x0) / dx).alias("col"))
    return placed.groupBy("row", "col").agg(F.max(key).alias("comid"))


# --- projections ----------------------------------------------------------------------------------------------------
def equal_area(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Cylindrical equal-area coordinates with standard parallels at 30 degrees (a distance CRS for geographic data)."""
    e = sqrt(FLATTENING * (2 - FLATTENING))
    k0 = cos(radians(30)) / sqrt(1 - e * e * sin(radians(30)) ** 2)
    s = F.sin(F.radians(lat))
    q = (1 - e * e) * (s / (1 - e * e * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
    return F.radians(lon) * AXIS * k0, q * AXIS / (2 * k0)


def utm(lon: Column, lat: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Transverse Mercator coordinates of a zone, by Krueger's series to the third order."""
    n = FLATTENING / (2 - FLATTENING)
    radius = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    s = F.sin(F.radians(lat))
    c = 2 * sqrt(n) / (1 + n)
    t = F.sinh(F.atanh(s) - c * F.atanh(c * s))
    dl = F.radians(lon - (zone * 6 - 183))
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500_000 + 0.9996 * radius * east, (10_000_000 if south else 0) + 0.9996 * radius * north


def geographic(x: Column, y: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Longitude and latitude of transverse Mercator coordinates: the series back, then two steps for the latitude."""
    n = FLATTENING / (2 - FLATTENING)
    radius = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi0, eta0 = (y - (10_000_000 if south else 0)) / (0.9996 * radius), (x - 500_000) / (0.9996 * radius)
    xi, eta = xi0, eta0
    for j, b in enumerate(beta, 1):
        xi = xi - b * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta - b * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    lat = chi
    for j, d in enumerate(delta, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return F.degrees(F.atan2(F.sinh(eta), F.cos(xi))) + (zone * 6 - 183), F.degrees(lat)


def geodesic(lon1: float, lat1: float, lon2: float, lat2: float) -> float:
    """Length of the geodesic in metres: Vincenty's inverse iteration."""
    b = AXIS * (1 - FLATTENING)
    u1, u2 = atan((1 - FLATTENING) * tan(radians(lat1))), atan((1 - FLATTENING) * tan(radians(lat2)))
    dl = lam = radians(lon2 - lon1)
    for _ in range(200):
        x = cos(u2) * sin(lam)
        y = cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam)
        ss = hypot(x, y)
        if ss == 0:
            return 0.0
        cs = sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam)
        sigma = atan2(ss, cs)
        sa = cos(u1) * cos(u2) * sin(lam) / ss
        ca = 1 - sa * sa
        cm = cs - 2 * sin(u1) * sin(u2) / ca if ca else 0.0
        c = FLATTENING / 16 * ca * (4 + FLATTENING * (4 - 3 * ca))
        before, lam = lam, dl + (1 - c) * FLATTENING * sa * (sigma + c * ss * (cm + c * cs * (2 * cm * cm - 1)))
        if abs(lam - before) < 1e-13:
            break
    u = ca * (AXIS**2 - b**2) / b**2
    a_ = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
    b_ = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
    ds = b_ * ss * (cm + b_ / 4 * (cs * (2 * cm * cm - 1) - b_ / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))
    return b * a_ * (sigma - ds)


def cell_size(transform: tuple, n_rows: int, geographic: bool) -> tuple[float, float]:
    """Cell width and height in metres; of a geographic grid along geodesics at its middle latitude."""
    dx, dy = abs(transform[1]), abs(transform[5])
    if not geographic:
        return dx, dy
    middle = transform[3] + transform[5] * n_rows / 2
    return geodesic(0, middle, dx, middle), geodesic(0, middle - dy / 2, 0, middle + dy / 2)


# --- seeds ----------------------------------------------------------------------------------------------------------
def tag_seeds(points: DataFrame, seeds: DataFrame, keys: tuple[str, ...] = ("COMID", "Row", "Col")) -> DataFrame:
    """SEED: "1" at the points nearest to a seed (all ties), "0" elsewhere."""
    hit = nearest(seeds.select("seed", "x", "y"), points.select(*keys, "x", "y"), "seed").select(*keys).distinct().withColumn("__hit", F.lit(True))
    return points.join(hit, list(keys), "left").withColumn("SEED", F.when(F.col("__hit"), "1").otherwise("0")).drop("__hit")


def tag_seeds_of_reach(points: DataFrame, seeds: DataFrame, elevation: str = "BaseElev", keys: tuple[str, ...] = ("COMID", "Row", "Col")) -> DataFrame:
    """SEED: "1" at the highest point of each reach that is the nearest to one of the reach's own seeds, "0" elsewhere.

    ``seeds``: seed, COMID, x, y. A seed whose nearest point is of another reach counts for none; of equally near points
    the first by its keys is taken, and of equally high ones too.
    """
    from pyspark.sql import Window

    near = nearest(seeds.select("seed", F.col("COMID").alias("__own"), "x", "y").select("seed", "x", "y"), points.select(*keys, elevation, "x", "y"), "seed")
    near = near.join(seeds.select("seed", F.col("COMID").alias("__own")), "seed").where(F.col("__own") == F.col(keys[0]))
    first = near.groupBy("seed").agg(F.min(F.struct("dist", *keys, elevation)).alias("p")).select("p.*")
    best = first.withColumn("__n", F.row_number().over(Window.partitionBy(keys[0]).orderBy(F.desc(elevation), *keys))).where("__n = 1")
    hit = best.select(*keys).withColumn("__hit", F.lit(True))
    return points.join(hit, list(keys), "left").withColumn("SEED", F.when(F.col("__hit"), "1").otherwise("0")).drop("__hit")


def value_near(points: DataFrame, grid: DataFrame, transform: tuple, key: str, reach: int = 2) -> DataFrame:
    """Grid value under each point; where there is none, the nearest within rings of up to ``reach`` cells, in scan
    order among equals. ``grid``: row, col, z without missing cells."""
    x0, dx, _, y0, _, dy = transform
    around = sorted(((i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)), key=lambda o: (max(map(abs, o)), o[0] ** 2 + o[1] ** 2, o))
    # Of points that share a key, those as near by ring and distance are told apart by the cell, as one point's are.
    level = np.unique([(2 * reach * reach + 1) * max(map(abs, o)) + o[0] ** 2 + o[1] ** 2 for o in around], return_inverse=True)[1]
    own = points.select(key, F.floor((F.col("y") - y0) / dy).alias("__r"), F.floor((F.col("x") - x0) / dx).alias("__c"))
    ground = grid.select(F.col("row").cast("long").alias("__r"), F.col("col").cast("long").alias("__c"), "z")

    def run(first: tuple[int, int], side: int, mine: pa.Table, seen: pa.Table) -> Iterator[pa.RecordBatch]:
        at = tiles.matrix(first, side, seen)
        r, c = (tiles.numbers(mine.column(x))[0] - first[k] for k, x in enumerate(("__r", "__c")))
        found, rank = np.full(len(r), -1), np.zeros(len(r), np.int64)
        left = np.arange(len(r))
        for k, (i, j) in enumerate(around):
            met = at[r[left] + i, c[left] + j]
            found[left], rank[left] = met, k
            left = left[met < 0]
        some = np.flatnonzero(found >= 0)
        if len(some):
            row, col = (np.asarray([o[n] for o in around])[rank[some]] + x[some] + first[n] for n, x in ((0, r), (1, c)))
            made = [mine.column(key).take(pa.array(some)), *map(pa.array, (level[rank[some]], row, col)), seen.column("z").take(pa.array(found[some]))]
            yield from pa.table(made, [key, "level", "row", "col", "z"]).to_batches()

    near = tiles.over_tiles(own, ground, reach, run, f"{kinds(points, [key])}, level long, row long, col long, {kinds(grid, ['z'])}")
    return near.groupBy(key).agg(F.min_by("z", F.struct("level", "row", "col")).alias("z"))


def end_point_slope(reaches: DataFrame, grid: DataFrame, transform: tuple, key: str, length: Column | None = None) -> DataFrame:
    """|z_end - z_start| / length of each line (pts), to 8 decimals; an end off the grid is walked inwards in steps of a
    fiftieth of the line."""
    fifty = F.expr("transform(sequence(0, 50), k -> k / 50.0D)")
    total = F.expr("aggregate(sequence(1, size(pts) - 1), 0.0D, (s, i) -> s + hypot(pts[i].x - pts[i - 1].x, pts[i].y - pts[i - 1].y))")
    runs = F.expr("transform(pts, (p, i) -> aggregate(slice(sequence(0, greatest(i, 1)), 2, i), 0.0D, (s, j) -> s + hypot(pts[j].x - pts[j - 1].x, pts[j].y - pts[j - 1].y)))")
    lines = reaches.where(F.size("pts") > 1).withColumns({"len": total, "run": runs})
    steps = lines.select(key, "pts", "len", "run", F.explode(fifty).alias("f")).withColumn("at", F.col("f") * F.col("len"))
    seg = F.greatest(F.lit(1), F.least(F.size("pts") - 1, F.size(F.expr("filter(run, r -> r < at)"))))
    steps = steps.withColumn("k", seg).withColumns({"p": F.get("pts", F.col("k") - 1), "q": F.get("pts", F.col("k")), "w": F.try_divide(F.col("at") - F.get("run", F.col("k") - 1), F.get("run", F.col("k")) - F.get("run", F.col("k") - 1))})
    x0, dx, _, y0, _, dy = transform
    x = F.col("p.x") + (F.col("q.x") - F.col("p.x")) * F.coalesce("w", F.lit(0.0))
    y = F.col("p.y") + (F.col("q.y") - F.col("p.y")) * F.coalesce("w", F.lit(0.0))
    placed = steps.select(key, "f", "len", x.alias("x"), y.alias("y"), F.floor((y - y0) / dy).alias("row"), F.floor((x - x0) / dx).alias("col"))
    met = placed.join(grid.select("row", "col", "z"), ["row", "col"])
    ends = met.groupBy(key).agg(F.min_by("z", "f").alias("z0"), F.max_by("z", "f").alias("z1"), F.min("f").alias("f0"), F.max("f").alias("f1"), F.first("len").alias("len"))
    slope = F.try_divide(F.abs(F.col("z1") - F.col("z0")), F.col("len") * (F.col("f1") - F.col("f0")))
    return ends.select(key, (F.rint(slope * 1e8) / 1e8).alias("slope"))

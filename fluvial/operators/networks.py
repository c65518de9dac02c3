"""Line networks as joins: ends of reaches, distances along lines, and seeds at the upper ends of head reaches.

A reach is a row: key, downstream (the key of the one it flows into) and parts, arrays of (x, y). A point is named by its
coordinates, which have to be equal where lines meet.

A reach of bounded length meets in one task, as matrices; longer ones, and those whose lines have no length, are joined
and take a round an edge of the longest way.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import forget, settle
from . import flow_stats
from .batches import kinds

#: Two distances along a reach, or to another one, count as equal within this part of them (and so much at least).
EQUAL = 1e-9
#: Elevations at a reach's lower end may differ by a centimetre.
LEVEL = 0.01
#: Vertices of a reach that meets in one task, segments of a box that ends pass by or look into, and pairs at once.
MOST, BOX, PAIRS = 200_000, 8, 60_000


def one_of_each(reaches: DataFrame, key: str, downstream: str) -> DataFrame:
    """One row a key: of repeated ones the least by downstream key and parts."""
    return reaches.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(downstream, "parts")).alias("r")).select(key, "r.*")


def lines(reaches: DataFrame, key: str) -> DataFrame:
    """A row a part of two vertices or more: key, n_parts, part, pts, a and b (its ends), closed, len."""
    length = "aggregate(sequence(1, size(pts) - 1), 0.0D, (s, i) -> s + hypot(pts[i].x - pts[i - 1].x, pts[i].y - pts[i - 1].y))"
    parts = reaches.select(key, F.size("parts").alias("n_parts"), F.posexplode("parts").alias("part", "pts")).where(F.size("pts") > 1)
    ends = parts.withColumns({"a": F.element_at("pts", 1), "b": F.element_at("pts", -1)})
    return ends.withColumns({"closed": F.col("a") == F.col("b"), "len": F.expr(length)})


def terminals(parts: DataFrame, key: str) -> DataFrame:
    """Ends of the open parts of each reach, once each: key, p, order (of their first appearance)."""
    ends = F.array(F.struct(F.col("a").alias("p"), (2 * F.col("part")).alias("order")), F.struct(F.col("b").alias("p"), (2 * F.col("part") + 1).alias("order")))
    return parts.where("NOT closed").select(key, F.explode(ends).alias("e")).groupBy(key, F.col("e.p").alias("p")).agg(F.min("e.order").alias("order"))


def exposed(ends: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """The ends that are next to one vertex only, over all parts that begin or end there: what joins two parts is no end."""
    first = F.struct(F.col("a").alias("p"), F.element_at("pts", 2).alias("beside"))
    last = F.struct(F.col("b").alias("p"), F.element_at("pts", -2).alias("beside"))
    around = parts.select(key, F.explode(F.when(F.col("closed"), F.array(first)).otherwise(F.array(first, last))).alias("e"))
    inner = around.groupBy(key, F.col("e.p").alias("p")).agg(F.min("e.beside").alias("x"), F.max("e.beside").alias("y")).where("x <> y")
    return ends.join(inner.select(key, "p"), [key, "p"], "left_anti")


def to_segment(p: Column, a: Column, b: Column) -> Column:
    """Distance of a point from the segment between two others."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    along = F.coalesce(F.try_divide((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    return F.hypot(p["x"] - a["x"] - t * dx, p["y"] - a["y"] - t * dy)


def _segments(x: np.ndarray, y: np.ndarray, ends: tuple[np.ndarray, ...]) -> np.ndarray:
    """Distance of each point from the nearest of some segments (ax, ay, bx, by).

    Segments lie in boxes of some neighbours; a point looks into those only that can hold its nearest.
    """
    ends = np.stack(ends)
    middle = np.stack((ends[0] + ends[2], ends[1] + ends[3]))
    ends = ends[:, np.argsort(middle[np.argmax(np.ptp(middle, axis=1))], kind="stable")]
    ends = np.pad(ends, ((0, 0), (0, -ends.shape[1] % BOX)), mode="edge").reshape(4, -1, BOX)
    low = [np.minimum(ends[i], ends[i + 2]).min(axis=1) for i in (0, 1)]
    high = [np.maximum(ends[i], ends[i + 2]).max(axis=1) for i in (0, 1)]
    out, step = np.empty(len(x)), max(1, PAIRS // (4 * ends.shape[1]))
    for first in range(0, len(x), step):
        at = x[first : first + step], y[first : first + step]
        # Squares: a vertex is far within the numbers whose squares are finite.
        inner = sum(np.square(np.maximum(np.maximum(lo - v[:, None], v[:, None] - hi), 0.0)) for v, lo, hi in zip(at, low, high))
        outer = sum(np.square(np.maximum(np.abs(lo - v[:, None]), np.abs(hi - v[:, None]))) for v, lo, hi in zip(at, low, high))
        point, box = np.nonzero(inner <= outer.min(axis=1)[:, None] * (1 + EQUAL))
        least = np.empty(len(point))
        for k in range(0, len(point), PAIRS // BOX):
            here = slice(k, k + PAIRS // BOX)
            ax, ay, bx, by = ends[:, box[here]]
            px, py, dx, dy = at[0][point[here], None] - ax, at[1][point[here], None] - ay, bx - ax, by - ay
            square = dx * dx + dy * dy
            t = np.clip((px * dx + py * dy) / np.where(square > 0, square, 1.0), 0.0, 1.0)
            least[here] = np.sqrt((np.square(px - t * dx) + np.square(py - t * dy)).min(axis=1))
        out[first : first + step] = np.minimum.reduceat(least, np.searchsorted(point, np.arange(len(at[0]))))
    return out


def _nearest_segments(ends: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """v of the ends of reaches whose segments (key, s: those of the reach below) meet in one task."""
    mine = ends.select(key, "order", F.col("p.x").alias("ax"), F.col("p.y").alias("ay"))
    seen = segments.select(key, *[F.col(f"s.{e}.{v}").alias(f"{e}{v}") for e in "ab" for v in "xy"])

    def run(table: pa.Table) -> pa.Table:
        own = np.asarray(table.column("order").is_valid())
        ax, ay, bx, by = (table.column(c).to_numpy() for c in ("ax", "ay", "bx", "by"))
        far = _segments(ax[own], ay[own], tuple(c[~own] for c in (ax, ay, bx, by))) if own.any() else np.empty(0)
        found = table.filter(pa.array(own)).select([key, "order", "ax", "ay"])
        return found.append_column("v", pa.array(far))

    made = mine.unionByName(seen, allowMissingColumns=True).groupBy(key).applyInArrow(run, f"{kinds(mine, mine.columns)}, v double")
    return made.select(key, F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")).alias("p"), "order", "v")


def to_downstream(ends: DataFrame, heads: DataFrame, parts: DataFrame, key: str, downstream: str, long: DataFrame | None = None) -> DataFrame:
    """The ends of reaches whose downstream reach has a line, with v, the distance from it.

    ``long``: keys of reaches that do not meet in one task, above or below; without it, none do.
    """
    # The nearest segment of each end: a reach's ends meet the segments of the one reach below it.
    flows = heads.select(key, downstream)
    cut_up = lambda parts: parts.select(F.col(key).alias(downstream), F.explode(F.expr("transform(sequence(1, size(pts) - 1), i -> struct(pts[i - 1] AS a, pts[i] AS b))")).alias("s"))
    joined = flows
    if long is not None:
        apart = flows.join(long, key, "left_semi").unionByName(flows.join(long.withColumnRenamed(key, downstream), downstream, "left_semi").select(key, downstream)).distinct()
        short, joined = flows.join(apart.select(key), key, "left_anti"), apart
    near = ends.join(joined, key).join(cut_up(parts), downstream)
    near = near.groupBy(key, "p", "order").agg(F.min(to_segment(F.col("p"), F.col("s.a"), F.col("s.b"))).alias("v"))
    if long is None:
        return near
    below = cut_up(parts).join(short, downstream).select(key, "s")
    made = _nearest_segments(ends.join(short, key, "left_semi"), below, key)
    return made if long.isEmpty() else made.unionByName(near)


def upper_ends(scored: DataFrame, key: str, tolerance: Callable[[Column], Column]) -> DataFrame:
    """Which ends are at the outlet of their reach (least v, within a tolerance) and which are candidates for seeds: all
    others, those without a v too; where all are at the outlet, the first of the greatest v."""
    v = F.col("v")
    known = F.when(v.isNotNull(), F.struct(v, -F.col("order"), "p"))
    reach = Window.partitionBy(key)
    by = {"least": F.min("v"), "most": F.max("v"), "top": F.max(known), "open": F.bool_or(v.isNull())}
    scored = scored.withColumns({n: f.over(reach) for n, f in by.items()})
    limit = F.col("least") + tolerance(F.col("least"))
    outlet = F.coalesce(v <= limit, F.lit(False))
    level = ~F.col("open") & (F.col("most") <= limit) & (F.col("p") == F.col("top.p"))
    return scored.select(key, "p", outlet.alias("outlet"), (~outlet | level).alias("candidate"))


def _rounds(state: DataFrame, advance: Callable[[DataFrame], DataFrame], label: str) -> DataFrame:
    """Advance a state, whose rows are ``fresh`` or not, until none is. A round's table replaces the one before."""
    state = settle(state, label)
    while not state.where("fresh").isEmpty():
        following = settle(advance(state), label)
        forget(state)
        state = following
    return state.drop("fresh")


def spread(edges: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Least distance ``d`` of each point from the nearest source along edges (key, p, q, len, both ways), within a key.

    Shortest paths by frontier: in a round, the points that came nearer in the last one pass their distance on. Keys may
    be as many, and a key's graph as large, as the cluster holds; rounds are as many as the edges of the longest way.
    Points that no source reaches have no row.
    """

    def advance(state: DataFrame) -> DataFrame:
        passed = state.where("fresh").join(edges, [key, "p"]).groupBy(key, F.col("q").alias("p")).agg(F.min(F.col("d") + F.col("len")).alias("new"))
        nearer = F.col("new").isNotNull() & (F.col("d").isNull() | (F.col("new") < F.col("d")))
        return state.drop("fresh").join(passed, [key, "p"], "full").select(key, "p", F.least("d", "new").alias("d"), F.coalesce(nearer, F.lit(False)).alias("fresh"))

    return _rounds(sources.select(key, "p", F.lit(0.0).alias("d"), F.lit(True).alias("fresh")).distinct(), advance, "distances")


def reached(edges: DataFrame, starts: DataFrame, key: str) -> DataFrame:
    """Points that a way along directed edges (key, p, q) of one edge or more leads to from a start."""
    step = lambda rows: rows.join(edges, [key, "p"]).select(key, F.col("q").alias("p")).distinct()

    def advance(state: DataFrame) -> DataFrame:
        new = step(state.where("fresh")).join(state, [key, "p"], "left_anti").withColumn("fresh", F.lit(True))
        return state.withColumn("fresh", F.lit(False)).unionByName(new)

    return _rounds(step(starts).withColumn("fresh", F.lit(True)), advance, "reached")


def _passed(ends: np.ndarray, length: np.ndarray, outlets: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Which points (by number) a way down leads to from a candidate. Edges: ends (2 x edges) and lengths, in their
    order; of edges between the same two points the last counts."""
    n = len(outlets)
    pair = np.minimum(*ends) * n + np.maximum(*ends)
    last = len(pair) - 1 - np.unique(pair[::-1], return_index=True)[1]
    p, q = np.concatenate((ends[:, last], ends[::-1, last]), axis=1)
    weight, far = np.tile(length[last], 2), np.where(outlets, 0.0, np.inf)
    order = np.argsort(q, kind="stable")
    p, q, weight = p[order], q[order], weight[order]
    at, first = np.unique(q, return_index=True)
    while len(at):  # all edges at once, as often as the longest way has edges
        nearer = np.minimum(far[at], np.minimum.reduceat(far[p] + weight, first))
        if (nearer == far[at]).all():
            break
        far[at] = nearer
    there = np.isfinite(far[p]) & np.isfinite(far[q])
    p, q = p[there], q[there]
    down = far[p] > far[q] + np.maximum(EQUAL, np.maximum(far[p], far[q]) * EQUAL)
    p, q, passed, fresh = p[down], q[down], np.zeros(n, bool), candidates
    while fresh.any():
        met = np.zeros(n, bool)
        met[q[fresh[p]]] = True
        fresh = met & ~passed
        passed |= fresh
    return passed


def _kept(marked: DataFrame, ways: DataFrame, key: str) -> DataFrame:
    """Candidates that no other one leads to, of reaches that meet in one task."""
    points = marked.select(key, "outlet", "candidate", F.col("p.x").alias("ax"), F.col("p.y").alias("ay"))
    edges = ways.select(key, "part", "len", *[F.col(f"{e}.{v}").alias(f"{e}{v}") for e in "ab" for v in "xy"])

    def run(table: pa.Table) -> pa.Table:
        way = np.asarray(table.column("part").is_valid())
        ax, ay, bx, by, length = (table.column(c).to_numpy() for c in ("ax", "ay", "bx", "by", "len"))
        # Points by number: the marked ones first, then both ends of the edges. Zeros have no sign.
        places = np.stack([np.concatenate(v) + 0.0 for v in ((ax[~way], ax[way], bx[way]), (ay[~way], ay[way], by[way]))])
        number = np.unique(places[0] + 1j * places[1], return_inverse=True)[1].ravel()
        own, edges, n = number[: (~way).sum()], number[(~way).sum() :].reshape(2, -1), number.max(initial=-1) + 1
        order = np.argsort(table.column("part").to_numpy()[way])
        mine = table.filter(pa.array(~way))
        outlet, candidate = (np.asarray(mine.column(c).to_numpy(), bool) for c in ("outlet", "candidate"))
        where = [np.zeros(n, bool) for _ in range(2)]
        for there, flag in zip(where, (outlet, candidate)):
            there[own[flag]] = True
        passed = _passed(edges[:, order], length[way][order], *where)
        return mine.filter(pa.array(candidate & ~passed[own])).select([key, "ax", "ay"])

    made = points.unionByName(edges, allowMissingColumns=True).groupBy(key).applyInArrow(run, f"{kinds(marked, [key])}, ax double, ay double")
    return made.select(key, F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")).alias("p"))


def without_downstream(marked: DataFrame, parts: DataFrame, key: str, long: DataFrame | None = None) -> DataFrame:
    """Candidates that no other candidate of their reach lies upstream of.

    The parts of a reach are edges between their ends (of parts between the same two ends the last counts). Distances
    from the outlets direct them; what a candidate leads to goes. Reaches of one part, of one candidate or without an
    outlet keep all. ``long``: keys of reaches that do not meet in one task; without it, none do.
    """
    candidates = marked.where("candidate")
    several = marked.groupBy(key).agg(F.count_if("candidate").alias("n"), F.bool_or("outlet").alias("known")).where("n > 1 AND known")
    several = several.join(parts.where("n_parts > 1").select(key).distinct(), key, "left_semi").select(key)
    if long is not None:
        several = settle(several, "several")
        short = several.join(long, key, "left_anti")
        made = candidates.join(several, key, "left_anti").select(key, "p").unionByName(_kept(marked.join(short, key, "left_semi"), parts.where("NOT closed").join(short, key, "left_semi"), key))
        if long.isEmpty():
            return made
        several = several.join(long, key, "left_semi")
        return made.unionByName(_by_rounds(candidates.join(several, key, "left_semi"), marked, parts, several, key))
    return _by_rounds(candidates, marked, parts, several, key)


def _by_rounds(candidates: DataFrame, marked: DataFrame, parts: DataFrame, several: DataFrame, key: str) -> DataFrame:
    """Candidates that no other one leads to, in rounds over all tasks."""
    ways = parts.where("NOT closed").join(several, key, "left_semi")
    pair = ways.groupBy(key, F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q")).agg(F.max_by("len", "part").alias("len"))
    edges = settle(pair.unionByName(pair.select(key, F.col("q").alias("p"), F.col("p").alias("q"), "len")), "ways")
    outlets = marked.where("outlet").join(several, key, "left_semi")
    far = spread(edges, outlets, key)
    both = edges.join(far, [key, "p"]).join(far.select(key, F.col("p").alias("q"), F.col("d").alias("e")), [key, "q"])
    down = settle(both.where(F.col("d") > F.col("e") + F.greatest(F.lit(EQUAL), F.greatest("d", "e") * EQUAL)).select(key, "p", "q"), "downstream")
    passed = reached(down, candidates.join(several, key, "left_semi").select(key, "p"), key)
    return candidates.join(passed, [key, "p"], "left_anti").select(key, "p")


def headwater_seeds(reaches: DataFrame, elevation: DataFrame | None, key: str, downstream: str) -> DataFrame:
    """Seed points (key, x, y) at the upper ends of reaches that no other one flows into.

    The outlet of such a reach is the end nearest to the downstream reach's line; where there is none, the lowest of its
    exposed ends in ``elevation`` (key, x, y, z), to a centimetre. Ends without an elevation stay seeds; where no end has
    one, all do. Closed and empty lines have no ends; reaches without a key give none.
    """
    once = settle(one_of_each(reaches, key, downstream), "reaches")
    parts = lines(once, key)
    vertices = F.aggregate("parts", F.lit(0), lambda n, p: n + F.coalesce(F.size(p), F.lit(0)))
    measured = "forall(parts, p -> forall(p, v -> v.x IS NOT NULL AND v.y IS NOT NULL AND abs(v.x) < 1e150 AND abs(v.y) < 1e150))"
    long = settle(once.where((vertices > MOST) | ~F.coalesce(F.expr(measured), F.lit(False))).select(key), "long")
    heads = settle(flow_stats.headwaters(once, key, downstream).select(key, downstream), "heads")
    ends = terminals(parts.join(heads.select(key), key, "left_semi"), key)
    lined = once.where("exists(parts, p -> size(p) > 1)").select(F.col(key).alias(downstream))
    lone = heads.join(lined, downstream, "left_anti").select(key)
    below = to_downstream(ends, heads.join(lined, downstream, "left_semi"), parts, key, downstream, long)
    apart = exposed(ends.join(lone, key, "left_semi"), parts.join(lone, key, "left_semi"), key)
    if elevation is None:
        heights = apart.withColumn("v", F.lit(None).cast("double"))
    else:
        known = elevation.join(lone, key, "left_semi")
        at = known.groupBy(key, F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).alias("p")).agg(F.min("z").cast("double").alias("v"))
        heights = apart.join(at, [key, "p"], "left")
    near = upper_ends(below, key, lambda v: F.greatest(F.lit(EQUAL), v * EQUAL))
    low = upper_ends(heights.select(key, "p", "order", "v"), key, lambda v: F.greatest(F.lit(LEVEL), F.abs(v) * EQUAL))
    marked = settle(near.unionByName(low), "ends")
    return without_downstream(marked, parts, key, long).select(key, "p.x", "p.y")

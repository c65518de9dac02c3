"""Power-law fits y = a q^b by damped least squares, per cell and per reach."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import rounded
from ..plans.lineage import settle
from .batches import kinds

#: First guesses of top width, velocity and depth, and what a fit that fails gives.
STARTS = {"tw": (12.0, 0.3), "vel": (1.0, 0.3), "depth": (0.2, 0.5)}
FAILED = -9999.9
STARTS_ORDER = ("depth", "tw", "vel")


def fit_power(x: np.ndarray, y: np.ndarray, mask: np.ndarray, start: tuple[float, float], rounds: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Levenberg-Marquardt for many rows at once; rows with fewer than two points, or that do not settle, fail."""
    m = len(x)
    a, b, damp = np.full(m, start[0]), np.full(m, start[1]), np.full(m, 1e-3)
    usable = mask.sum(axis=1) >= 2
    done = ~usable
    x = np.where(mask & (x > 0), x, 1.0)
    logs = np.log(x)
    def residual(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            return np.where(mask, a[:, None] * np.exp(np.clip(b[:, None] * logs, -700, 700)) - y, 0.0)

    r = residual(a, b)
    cost = (r * r).sum(axis=1)
    for _ in range(rounds):
        if done.all():
            break
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            p = np.where(mask, np.exp(np.clip(b[:, None] * logs, -700, 700)), 0.0)
            jb = a[:, None] * p * logs
            aa, ab, bb = (p * p).sum(axis=1), (p * jb).sum(axis=1), (jb * jb).sum(axis=1)
            ga, gb = (p * r).sum(axis=1), (jb * r).sum(axis=1)
            da, db = aa * (1 + damp), bb * (1 + damp)
            det = da * db - ab * ab
            sa, sb = -(db * ga - ab * gb) / det, -(da * gb - ab * ga) / det
            na, nb = a + sa, b + sb
            nr = residual(na, nb)
            ncost = (nr * nr).sum(axis=1)
        better = np.isfinite(ncost) & (ncost <= cost) & ~done
        small = (np.abs(sa) <= 1e-8 * (np.abs(a) + 1e-8)) & (np.abs(sb) <= 1e-8 * (np.abs(b) + 1e-8))
        settled = better & (small | (cost - ncost <= 1e-8 * 1e-6 * cost))
        a, b, cost = np.where(better, na, a), np.where(better, nb, b), np.where(better, ncost, cost)
        r = np.where(better[:, None], nr, r)
        damp = np.where(better, np.maximum(damp / 10, 1e-12), np.minimum(damp * 10, 1e12))
        done |= settled | (damp >= 1e12)
    good = usable & np.isfinite(a) & np.isfinite(b) & done
    return np.where(good, a, FAILED), np.where(good, b, FAILED)


def cell_curves(results: DataFrame, keep: list[str]) -> DataFrame:
    """depth_a, depth_b, tw_a, tw_b, vel_a, vel_b of each rating table (inc, base_elev); rows where a coefficient is not
    positive go."""
    names = [f"{n}_{c}" for n in ("depth", "tw", "vel") for c in "ab"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            inc = batch.column("inc")
            size = pc.fill_null(pc.list_value_length(inc), 0).to_numpy()
            mask = np.arange(max(1, size.max())) < size[:, None]
            flat = pc.list_flatten(inc)

            def get(name: str) -> np.ndarray:
                out = np.full(mask.shape, np.nan)
                out[mask] = pc.struct_field(flat, name).cast(pa.float64()).to_numpy(zero_copy_only=False)
                return out

            q, base = get("q"), batch.column("base_elev").cast(pa.float64()).to_numpy(zero_copy_only=False)
            used = ~np.isnan(q) & (q > 0)
            values = {"depth": get("wse") - base[:, None], "tw": get("t"), "vel": get("v")}
            found = [c for n, y in values.items() for c in fit_power(q, np.nan_to_num(y), used, STARTS[n])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *map(pa.array, found)], [*keep, *names])

    columns = [*keep, "inc", *[c for c in ("base_elev",) if c not in keep]]
    fitted = results.select(*columns).mapInArrow(run, kinds(results, keep) + ", " + ", ".join(f"{n} double" for n in names))
    fitted = fitted.withColumns({n: rounded(n) for n in names})
    return fitted.where("depth_a > 0 AND tw_a > 0 AND vel_a > 0")


def log_line(points: DataFrame, key: str) -> DataFrame:
    """a and b of y = a q^b from the least-squares line of the logarithms: one aggregation by key."""
    x, y = F.log("q"), F.log("y")
    s = points.groupBy(key).agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * y).alias("sxy"), F.sum(x * x).alias("sxx"))
    s = s.withColumn("b", F.try_divide(F.expr("n * sxy - sx * sy"), F.expr("n * sxx - sx * sx")))
    return s.select(key, F.exp((F.col("sy") - F.col("b") * F.col("sx")) / F.col("n")).alias("a"), "b")


#: Exponents that are tried at first, steps between two of them then, and Newton's steps after that.
EXPONENTS, COARSE, FINE, NEWTON = 8.0, 32, 16, 4
#: A reach of more increments is fitted in passes over all tasks; points whose powers are held at once.
LONG_REACH, BLOCK = 500_000, 20_000


def pooled_fit(x: np.ndarray, y: np.ndarray, start: float) -> tuple[float, float]:
    """a and b of one fit, as `pooled_curves` has it, from logarithms of flows and values in memory."""
    if len(x) < 2:
        return FAILED, FAILED
    flat, yy, b, half, inner = x.min() == x.max(), (y * y).sum(), 0.0, EXPONENTS, True
    wide = np.abs(x).max() > 40  # where powers under- or overflow, none is got from the one before
    blocks = [slice(i, i + BLOCK) for i in range(0, len(x), BLOCK)]
    with np.errstate(all="ignore"):
        for steps in () if flat else (COARSE, FINE):
            t = b + half * (2.0 * np.arange(steps + 1) / steps - 1)
            s, u = np.zeros(steps + 1), np.zeros(steps + 1)
            for i in blocks:
                v, w = x[i], y[i]
                p, on = np.exp(t[0] * v), np.exp((t[1] - t[0]) * v)
                for k in range(steps + 1):
                    s[k], u[k] = s[k] + (p * w).sum(), u[k] + (p * p).sum()
                    p = np.exp(t[k + 1] * v) if wide and k < steps else p * on
            cost = np.where(u == 0, -np.inf, yy - s * s / u)
            k = np.lexsort((np.abs(t - start), cost))[0]
            inner &= steps == FINE or 0 < k < steps
            b, half = t[k], half * 2 / steps
        b = start if flat else b
        for _ in range(NEWTON):
            s0 = s1 = s2 = t0 = t1 = t2 = 0.0
            for i in blocks:
                p, v = np.exp(b * x[i]), x[i]
                py, pp = p * y[i], p * p
                s0, s1, s2 = s0 + py.sum(), s1 + (py * v).sum(), s2 + (py * v * v).sum()
                t0, t1, t2 = t0 + pp.sum(), t1 + 2 * (pp * v).sum(), t2 + 4 * (pp * v * v).sum()
            slope = 2 * s0 * s1 / t0 - s0 * s0 * t1 / (t0 * t0)
            bend = 2 * s1 * s1 / t0 + 2 * s0 * s2 / t0 - 4 * s0 * s1 * t1 / (t0 * t0) - s0 * s0 * t2 / (t0 * t0) + 2 * s0 * s0 * t1 * t1 / (t0 * t0 * t0)
            # Less cost lies where S S / T bends down; a step stays within the fine grid's.
            step = 0.0 if flat or bend >= 0 else max(-half, min(half, -slope / bend))
            a, b = (s0 + step * s1 + step * step / 2 * s2) / (t0 + step * t1 + step * step / 2 * t2), b + step
            if abs(step) <= 1e-9:
                break
    return (a, b) if (inner or flat) and not np.isnan(a) and abs(step) <= 1e-4 else (FAILED, FAILED)


def pooled_curves(results: DataFrame, key: str = "COMID", long_reach: int = LONG_REACH) -> DataFrame:
    """One fit a reach over all increments of all its cells, as depth_a .. vel_b.

    For a given exponent b the best factor is S / T, with S the sum of y q^b and T that of q^2b, which leaves a cost of
    sum(y y) - S S / T: a function of b alone. It is tried on a coarse grid from -8 to 8 and on a fine one around the
    least cost, then Newton's steps follow. A fit with fewer than two points, with its best exponent at the end of the
    grid, or whose steps do not end is FAILED; where exponents do not matter (one flow only, or no y), the first guess's
    is taken. A reach of at most ``long_reach`` increments meets in one task, longer ones are fitted in passes.
    """
    opened = results.where("inc IS NOT NULL").select(key, F.explode("inc").alias("i"), "base_elev").where("i.q > 0")
    opened = opened.select(key, F.ln("i.q").alias("x"), (F.col("i.wse") - F.col("base_elev")).cast("double").alias("depth"), F.col("i.t").cast("double").alias("tw"), F.col("i.v").cast("double").alias("vel"))
    long = settle(results.groupBy(key).agg(F.sum(F.coalesce(F.size("inc"), F.lit(0))).alias("n")).where(F.col("n") > long_reach).select(key), "long")
    names = [f"{n}_{c}" for n in STARTS_ORDER for c in "ab"]

    def run(group: tuple[pa.Scalar], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        x, found = table.column("x").to_numpy(), []
        for n in STARTS_ORDER:
            there = pc.is_valid(table.column(n)).to_numpy() & group[0].is_valid
            found += pooled_fit(x[there], table.column(n).to_numpy()[there], STARTS[n][1])
        if any(pc.any(pc.is_valid(table.column(n))).as_py() for n in STARTS_ORDER):
            yield pa.RecordBatch.from_arrays([pa.array([group[0].as_py()], table.schema.field(key).type), *[pa.array([float(v)]) for v in found]], [key, *names])

    schema = f"{kinds(results, [key])}, " + ", ".join(f"{n} double" for n in names)
    if long.isEmpty():
        return opened.groupBy(key).applyInArrow(run, schema).withColumns({n: rounded(n) for n in names})
    usual = opened.join(long, key, "left_anti").groupBy(key).applyInArrow(run, schema).withColumns({n: rounded(n) for n in names})
    return usual.unionByName(_in_passes(opened.join(long, key, "left_semi"), key))


def _in_passes(opened: DataFrame, key: str) -> DataFrame:
    """The same fits from sums over all tasks, a row a fit and task: six passes at most, whatever the data."""
    values = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("y")) for n in STARTS_ORDER])
    points = opened.select(key, "x", F.explode(values).alias("v")).select(key, "x", "v.name", "v.y").where("y IS NOT NULL")
    points = settle(points, "points")
    starts = F.map_from_arrays(F.array(*map(F.lit, STARTS)), F.array(*[F.lit(b) for _, b in STARTS.values()]))
    fits = points.groupBy(key, "name").agg(F.count("*").alias("n"), F.sum(F.col("y") * F.col("y")).alias("yy"), (F.min("x") == F.max("x")).alias("flat"))
    fits = fits.select(key, "name", "n", "flat", "yy", F.lit(0.0).alias("b"), F.lit(EXPONENTS).alias("half"), F.lit(True).alias("inner"))
    fits = settle(fits, "fits")
    for steps in (COARSE, FINE):
        tried = F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("k")
        asked = fits.where("n > 1").select(key, "name", F.col("b").alias("c"), "half", "yy")
        at = F.col("c") + F.col("half") * (2.0 * F.col("k") / steps - 1)
        each = points.join(asked, [key, "name"]).select(key, "name", "x", "y", "yy", "half", tried, "c").withColumn("t", at)
        sums = each.groupBy(key, "name", "k", "t", "yy", "half").agg(F.sum(F.col("y") * F.exp(F.col("t") * F.col("x"))).alias("s"), F.sum(F.exp(2 * F.col("t") * F.col("x"))).alias("u"))
        cost = F.col("yy") - F.try_divide(F.col("s") * F.col("s"), F.col("u"))
        best = sums.groupBy(key, "name").agg(F.min_by(F.struct("t", "k"), F.struct(cost, F.abs(F.col("t") - starts[F.col("name")]))).alias("best"))
        inner = F.col("inner") & F.coalesce((F.col("best.k") > 0) & (F.col("best.k") < steps), F.lit(False)) if steps == COARSE else F.col("inner")
        fits = settle(fits.join(best, [key, "name"], "left").select(key, "name", "n", "flat", "yy", F.col("best.t").alias("b"), (F.col("half") * 2 / steps).alias("half"), inner.alias("inner")), "fits")
    guess = starts[F.col("name")]
    fits = fits.withColumns({"b": F.when(F.col("flat"), guess).otherwise(F.col("b")), "a": F.lit(None).cast("double"), "step": F.lit(None).cast("double")})
    for _ in range(NEWTON):
        p, pp, x = F.exp(F.col("b") * F.col("x")), F.exp(2 * F.col("b") * F.col("x")), F.col("x")
        terms = {"s0": F.col("y") * p, "s1": F.col("y") * x * p, "s2": F.col("y") * x * x * p, "t0": pp, "t1": 2 * x * pp, "t2": 4 * x * x * pp}
        asked = fits.where("n > 1 AND b IS NOT NULL").select(key, "name", "b")
        sums = points.join(asked, [key, "name"]).groupBy(key, "name").agg(*[F.sum(t).alias(c) for c, t in terms.items()])
        slope = F.expr("2 * s0 * s1 / t0 - s0 * s0 * t1 / (t0 * t0)")
        bend = F.expr("2 * s1 * s1 / t0 + 2 * s0 * s2 / t0 - 4 * s0 * s1 * t1 / (t0 * t0) - s0 * s0 * t2 / (t0 * t0) + 2 * s0 * s0 * t1 * t1 / (t0 * t0 * t0)")
        # Less cost lies where S S / T bends down; a step stays within the fine grid's.
        free = F.when(F.col("flat") | (bend >= 0), 0.0).otherwise(-slope / bend)
        now = fits.drop("a", "step").join(sums, [key, "name"], "left").withColumn("step", F.greatest(-F.col("half"), F.least(F.col("half"), free)))
        a = F.expr("(s0 + step * s1 + step * step / 2 * s2) / (t0 + step * t1 + step * step / 2 * t2)")
        fits = settle(now.select(key, "name", "n", "flat", "yy", (F.col("b") + F.col("step")).alias("b"), "half", "inner", a.alias("a"), "step"), "fits")
        if fits.where("n > 1 AND abs(step) > 1e-9").isEmpty():
            break
    good = (F.col("n") > 1) & (F.col("inner") | F.col("flat")) & F.col("a").isNotNull() & ~F.isnan("a") & (F.abs("step") <= 1e-4)
    of = lambda n, c: rounded(F.coalesce(F.max(F.when((F.col("name") == n) & good, F.col(c))), F.lit(FAILED))).alias(f"{n}_{c}")
    return fits.groupBy(key).agg(*[of(n, c) for n in STARTS_ORDER for c in "ab"])

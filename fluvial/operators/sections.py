"""Cross-sections: ordinates in 31 directions, sampling from a grid, low spots and angle search.

Offsets of all directions are one small table (31 times the section length). Sampling deals cells and grid to tiles, looks
ordinates up in a tile's matrix and gives each section as a row with arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.hydraulics import first_index
from . import tiles
from .batches import kinds, padded
from .solver import Side

DIRECTIONS = 30
STEP = pi / DIRECTIONS
#: Sections whose matrices are worked on at once.
GEOMETRY_ROWS = 2_000


def section_length(distance: float, dx: float, dy: float) -> int:
    """Ordinates on each side, the centre counted."""
    return int((distance / ((dx + dy) / 2)) / 2) + 1


def ordinates(spark: SparkSession, length: int, dx: float, dy: float) -> DataFrame:
    """angle_idx, i, main and second cell offsets (rm, cm, rs, cs), their weights (wm, ws) and the spacing dz."""
    table = spark.range(0, DIRECTIONS + 1).select(F.col("id").cast("int").alias("angle_idx")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(length - 1))))
    theta = F.col("angle_idx") * F.lit(STEP)
    cos, sin = F.cos(theta), F.sin(theta)
    steep = (theta >= pi / 4) & (theta <= 3 * pi / 4)
    snapped = F.when(steep, F.abs(cos) < 1e-12).otherwise(F.abs(sin) < 1e-12)
    # To nine decimals: whole offsets (at 30 and 60 degrees) must not hang on the last bit of a cosine.
    u = F.rint(F.when(steep, F.col("i") * dy * cos / dx).otherwise(F.col("i") * dx * sin / dy) * 1e9) / 1e9
    main = F.when(snapped, F.lit(0)).otherwise(F.floor(u)).cast("int")
    second = F.when(snapped, F.lit(0)).otherwise(F.rint(u + F.when(steep & (u < 0), -0.5).otherwise(0.5))).cast("int")
    ws = F.when(snapped, 0.0).otherwise(F.abs(u - second))
    along = F.when(theta >= pi / 2, -F.col("i")).otherwise(F.col("i")).cast("int")
    dz = F.when(steep, F.when(snapped, F.lit(float(dy))).otherwise(F.sqrt(F.pow(dy * cos, 2) + dy * dy))).otherwise(F.when(snapped, F.lit(float(dx))).otherwise(F.sqrt(F.pow(dx * sin, 2) + dx * dx)))
    return table.select(
        "angle_idx",
        "i",
        F.when(steep, F.col("i").cast("int")).otherwise(main).alias("rm"),
        F.when(steep, main).otherwise(along).alias("cm"),
        F.when(steep, F.col("i").cast("int")).otherwise(second).alias("rs"),
        F.when(steep, second).otherwise(along).alias("cs"),
        (1 - ws).alias("wm"),
        ws.alias("ws"),
        dz.alias("dz"),
    )


def angle_index(direction: Column) -> Column:
    """Nearest direction of the table, half to even."""
    return F.rint(F.when(direction > pi, direction - pi).otherwise(direction) / F.lit(STEP)).cast("int")


def sample(
    cells: DataFrame, grid: DataFrame, table: DataFrame, n_rows: int, n_cols: int, keys: tuple[str, ...] = ("cell_seq",), wanted: tuple[str, ...] = ("p", "lc", "n", "rc")
) -> DataFrame:
    """Both sides of each section: p1, lc1, n1, rc1 and p2, lc2, n2, rc2 (arrays from the centre), and dz.

    ``cells``: keys, row, col, angle_idx. ``grid``: row, col, z and, where they are ``wanted``, lc and n; one row a cell.
    A side ends before the first ordinate of which a cell touches the outermost ring of the grid or is not in it; a
    section without any ordinate gives no row. Sections meet the grid tile by tile, so what is shuffled grows with cells
    and grid, not with ordinates. The ordinate table goes to all tasks: its size is fixed by the section length, not by
    the data.
    """
    rows = table.select("angle_idx", "i", "rm", "cm", "rs", "cs", "wm", "ws", "dz").toPandas()
    shape = (int(rows["angle_idx"].max()) + 1, int(rows["i"].max()) + 1)
    known = np.zeros(shape[0], bool)
    known[rows["angle_idx"]] = True
    ords = {c: np.zeros(shape, rows[c].dtype) for c in ("rm", "cm", "rs", "cs", "wm", "ws", "dz")}
    for c, m in ords.items():
        m[rows["angle_idx"], rows["i"]] = rows[c]
    rim = max(1, int(max(np.abs(ords[c]).max() for c in ("rm", "cm", "rs", "cs"))))
    held = [c for c in ("lc", "n") if c in wanted]
    own = cells.select(*keys, F.col("row").alias("__r"), F.col("col").alias("__c"), F.col("angle_idx").cast("int").alias("__angle"))
    place, schema = (f"struct<r:{cells.schema['row'].dataType.simpleString()},c:{cells.schema['col'].dataType.simpleString()}>", [kinds(cells, list(keys))])
    cover = grid.schema["lc"].dataType.simpleString() if "lc" in wanted else ""
    for k in (1, 2):
        schema += [f"{f}{k} array<{kind}>" for f, kind in (("p", "double"), ("lc", cover), ("n", "double"), ("rc", place)) if f in wanted]
    ground = grid.select(F.col("row").alias("__r"), F.col("col").alias("__c"), F.col("z").cast("double").alias("z"), *[F.col(c).cast("double") if c == "n" else F.col(c) for c in held])
    whole = {"r": cells.schema["row"].dataType, "c": cells.schema["col"].dataType}

    def run(first: tuple[int, int], side: int, mine: pa.Table, seen: pa.Table) -> Iterator[pa.RecordBatch]:
        if not seen.num_rows:
            return
        at = tiles.matrix(first, side, seen)
        z, held_z = tiles.numbers(seen.column("z"))
        others = {c: (*tiles.numbers(seen.column(c)), seen.schema.field(c).type) for c in held}
        step = max(1, tiles.VALUES // shape[1])
        for start in range(0, mine.num_rows, step):
            part = mine.slice(start, step)
            angle, there = tiles.numbers(part.column("__angle"))
            part = part.filter(pa.array(there & (angle >= 0) & (angle < shape[0]) & known[np.clip(angle, 0, shape[0] - 1)]))
            (r, _), (c, _), (angle, _) = (tiles.numbers(part.column(f"__{x}")) for x in ("r", "c", "angle"))
            sides, some = [], np.zeros(len(r), bool)
            for sign in (1, -1):
                rm, cm, rs, cs = (x[:, None] + sign * ords[o][angle].astype(np.int64) for o, x in (("rm", r), ("cm", c), ("rs", r), ("cs", c)))
                inside = (np.minimum(rm, rs) > 0) & (np.maximum(rm, rs) < n_rows - 1) & (np.minimum(cm, cs) > 0) & (np.maximum(cm, cs) < n_cols - 1)
                main, second = at[rm - first[0], cm - first[1]], at[rs - first[0], cs - first[1]]
                there = np.logical_and.accumulate(inside & (main >= 0) & (second >= 0), axis=1)
                some |= there[:, 0]
                sides.append((there, main, second, rm, cm))
            made = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (part.column(k).filter(pa.array(some)) for k in keys)]
            for there, main, second, rm, cm in sides:
                there, main, second, rm, cm = there[some], main[some], second[some], rm[some], cm[some]
                if "p" in wanted:
                    made.append(tiles.listed(z[main] * ords["wm"][angle[some]] + z[second] * ords["ws"][angle[some]], held_z[main] & held_z[second], there, pa.float64()))
                made += [tiles.listed(v[main], ok[main], there, kind) for v, ok, kind in others.values()]
                if "rc" in wanted:
                    offsets = pa.array(np.concatenate([[0], there.sum(axis=1).cumsum()]).astype(np.int32))
                    made.append(pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(x[there]).cast(to_arrow_type(whole[n])) for n, x in (("r", rm), ("c", cm))], ["r", "c"])))
            made.append(pa.array(ords["dz"][angle[some], 0]))
            yield pa.RecordBatch.from_arrays(made, names)

    names = [*keys, *[f"{f}{k}" for k in (1, 2) for f in ("p", "lc", "n", "rc") if f in wanted], "dz"]
    return tiles.over_tiles(own, ground, rim, run, ", ".join([*schema, "dz double"]))


def low_spot(sections: DataFrame, reach: int, keys: tuple[str, ...] = ("cell_seq",)) -> DataFrame:
    """row and col of the lowest positive elevation among the first ``reach`` ordinates, nearer first, side 1 first; the
    centre where nothing is strictly lower."""
    def side(k: int) -> Column:
        return F.transform(F.slice(f"p{k}", 1, reach), lambda z, i: F.struct(z.alias("z"), i.alias("i"), F.lit(k).alias("k"), F.get(f"rc{k}", i).alias("rc")))

    items = F.concat(side(1), side(2))
    lower = F.filter(items, lambda x: (x["z"] > 0) & (x["z"] < F.get("p1", F.lit(0))))
    best = F.array_min(lower)
    return sections.select(*keys, F.coalesce(best["rc"]["r"], F.get("rc1", F.lit(0))["r"]).alias("row"), F.coalesce(best["rc"]["c"], F.get("rc1", F.lit(0))["c"]).alias("col"))


def test_angles(manipulation: float, interval: float) -> list[float]:
    """Angle offsets (radians) to test: 0, then each multiple of the interval on both sides up to half the range."""
    if manipulation <= 0 or interval <= 0:
        return [0.0]
    steps = int(manipulation / (2 * interval))
    return [0.0] + [s * k * interval * pi / 180 for k in range(1, steps + 1) for s in (1, -1)]


def with_top_width(df: DataFrame, profile: str, wse: str, to: str, dz: str = "dz") -> DataFrame:
    """Width of one side at a water level (columns); 0 where the centre is dry. The first dry ordinate is found once, in
    a column of its own, so that no plan holds the search more than once."""
    k = f"__{to}_k"
    df = df.withColumn(k, first_index(F.col(profile), lambda z: z >= F.col(wse)))
    last, first = F.get(profile, F.col(k) - 1), F.get(profile, F.col(k))
    edge = F.col(dz) * (F.col(k) - 1) + F.col(dz) * (F.col(wse) - last) / (F.abs(F.col(wse) - last) + F.abs(F.col(wse) - first))
    wet = F.col(wse) - F.get(profile, F.lit(0)) > 1e-16  # null without ordinates
    return df.withColumn(to, F.when(wet, F.coalesce(edge, F.col(dz) * (F.size(profile) - 1))).otherwise(0.0)).drop(k)


def with_geometry(sections: DataFrame, wse: str, keep: tuple[str, ...], dz: str = "dz", profiles: tuple[str, str] = ("p1", "p2"), roughness: tuple[str, str] = ("n1", "n2")) -> DataFrame:
    """Columns of ``keep`` with area, perimeter, pn (sum of perimeter times n^1.5) and width, both sides summed: what
    ``hydraulics.with_sides`` gives, over batches of sections at once. Its profiles hold no missing elevations."""
    names = ["area", "perimeter", "pn", "width"]
    plain = sections.select(*keep, *[F.col(p).cast("array<double>").alias(f"__{n}{k}") for n, of in (("p", profiles), ("n", roughness)) for k, p in enumerate(of)], F.col(dz).cast("double").alias("__dz"), F.col(wse).cast("double").alias("__wse"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, GEOMETRY_ROWS):
                part = batch.slice(start, GEOMETRY_ROWS)
                space, level = (part.column(c).to_numpy(zero_copy_only=False) for c in ("__dz", "__wse"))
                sides = [Side.read(part.column(f"__p{k}"), part.column(f"__n{k}"), space).geometry(level) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], *[pa.array(x + y) for x, y in zip(*sides)]], [*keep, *names])

    return plain.mapInArrow(run, ", ".join([kinds(sections, list(keep))] * bool(keep) + [f"{n} double" for n in names]))


def _top_width(profile: pa.Array, level: np.ndarray, dz: np.ndarray) -> np.ndarray:
    """As ``with_top_width``, of a list column; what is missing is no number."""
    z, there, count = padded(profile, np.inf, float)
    dry = there & (z >= level[:, None])
    dry[:, 0] = False
    k, rows = dry.argmax(axis=1), np.arange(len(z))
    inner, outer = level - z[rows, np.maximum(k - 1, 0)], level - z[rows, k]
    with np.errstate(invalid="ignore", divide="ignore"):
        edge = dz * (k - 1) + dz * inner / (np.abs(inner) + np.abs(outer))
    whole = np.where(dry.any(axis=1) & ~np.isnan(edge), edge, dz * (count - 1))
    return np.where((count > 0) & (level - z[:, 0] > 1e-16), whole, 0.0)


def best_angle(candidates: DataFrame, test_depth: float = 0.5, keys: tuple[str, ...] = ("cell_seq",)) -> DataFrame:
    """Of sampled candidates (keys, angle, try, p1, p2, dz) the angle of the least top width at the test depth; the
    first tried of equals.

    Widths are found for batches of candidates at once. Width and try make one number, so that cells are aggregated in a
    hash table; by a struct all of them would be sorted.
    """
    plain = candidates.select(*keys, "angle", F.col("try").cast("int").alias("try"), *[F.col(p).cast("array<double>").alias(p) for p in ("p1", "p2")], F.col("dz").cast("double").alias("dz"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, GEOMETRY_ROWS):
                part = batch.slice(start, GEOMETRY_ROWS)
                dz = part.column("dz").to_numpy(zero_copy_only=False)
                level = padded(part.column("p1"), np.nan, float)[0][:, 0] + test_depth
                tw = _top_width(part.column("p1"), level, dz) + _top_width(part.column("p2"), level, dz)
                # The bits of numbers that are not negative are in their order.
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in (*keys, "angle", "try")], pa.array(tw), pa.array((tw + 0.0).view(np.int64))], [*keys, "angle", "try", "tw", "__bits"])

    widths = plain.mapInArrow(run, f"{kinds(plain, [*keys, 'angle', 'try'])}, tw double, __bits long")
    order = F.col("__bits").cast("decimal(19,0)") * F.lit(2**32).cast("decimal(11,0)") + (F.col("try").cast("long") + 2**31).cast("decimal(19,0)")
    return widths.groupBy(*keys).agg(F.min_by("angle", order).alias("xs_angle"), F.min("tw").alias("top_width"))

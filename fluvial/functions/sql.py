"""Functions for SQL: register(spark), then ``SELECT manning_q(area, perimeter, pn, slope) FROM sections``.

manning_q, hydraulic_radius, composite_n and power_curve are SQL expressions, which Spark puts in the place of a
call; rating_interp takes an array of (q, y). ordinates(n, dx, dy) is a table of a section's ordinates.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from . import hydraulics

#: name -> parameters, result, body. Numbers that the column functions use too are put in.
SQL_FUNCTIONS = {
    "hydraulic_radius": ("area DOUBLE, perimeter DOUBLE", "DOUBLE", f"area / greatest(perimeter, {hydraulics.LEAST_PERIMETER}D)"),
    "composite_n": ("pn DOUBLE, perimeter DOUBLE", "DOUBLE", f"CASE WHEN rint(pow(pn / greatest(perimeter, {hydraulics.LEAST_PERIMETER}D), 2D / 3) * 10000) / 10000 < {hydraulics.LEAST_N}D THEN {hydraulics.FALLBACK_N}D ELSE rint(pow(pn / greatest(perimeter, {hydraulics.LEAST_PERIMETER}D), 2D / 3) * 10000) / 10000 END"),
    "manning_q": ("area DOUBLE, perimeter DOUBLE, pn DOUBLE, slope DOUBLE", "DOUBLE", "area * pow(hydraulic_radius(area, perimeter), 2D / 3) * sqrt(slope) / composite_n(pn, perimeter)"),
    "power_curve": ("a DOUBLE, q DOUBLE, b DOUBLE", "DOUBLE", "rint(a * pow(q, b) * 1000) / 1000"),
    # The pairs in order of q, one each, without missing ones; a flow beyond them follows the first or last two.
    "rating_pairs": (
        "pairs ARRAY<STRUCT<q: DOUBLE, y: DOUBLE>>", "ARRAY<STRUCT<q: DOUBLE, y: DOUBLE>>",
        "transform(array_sort(array_distinct(transform(filter(pairs, p -> p.q IS NOT NULL AND p.y IS NOT NULL AND NOT isnan(p.q) AND NOT isnan(p.y) AND abs(p.q) < double('Infinity') AND abs(p.y) < double('Infinity')), p -> p.q))), "
        "x -> element_at(filter(pairs, p -> p.q = x AND p.y IS NOT NULL AND NOT isnan(p.y) AND abs(p.y) < double('Infinity')), 1))",
    ),
    "rating_line": (
        "pairs ARRAY<STRUCT<q: DOUBLE, y: DOUBLE>>, x DOUBLE, i INT", "DOUBLE",
        "pairs[i - 1].y + (x - pairs[i - 1].q) * (pairs[i].y - pairs[i - 1].y) / (pairs[i].q - pairs[i - 1].q)",
    ),
    "rating_interp": (
        "pairs ARRAY<STRUCT<q: DOUBLE, y: DOUBLE>>, x DOUBLE", "DOUBLE",
        "CASE size(rating_pairs(pairs)) WHEN 0 THEN NULL WHEN 1 THEN rating_pairs(pairs)[0].y ELSE rating_line(rating_pairs(pairs), x, greatest(1, least(size(rating_pairs(pairs)) - 1, size(filter(rating_pairs(pairs), p -> p.q < x))))) END",
    ),
}


@udtf(returnType="angle_idx int, side int, i int, row_offset double, col_offset double, distance double")
class Ordinates:
    """Offsets in cells of the ordinates of sections in 31 directions, on both sides."""

    def eval(self, n: int, dx: float, dy: float):
        from math import cos, hypot, pi, sin

        for angle in range(31):
            theta = angle * pi / 30
            for side in (1, -1):
                for i in range(n):
                    r, c = side * i * sin(theta), side * i * cos(theta)
                    yield angle, side, i, r, c, hypot(r * dy, c * dx)


def register(spark: SparkSession) -> None:
    """Make the functions known to a session, as temporary ones."""
    for name, (parameters, result, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    spark.udtf.register("ordinates", Ordinates)

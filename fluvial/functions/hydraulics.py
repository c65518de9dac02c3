"""Hydraulic geometry of one side of a cross-section, and Manning's equation, as column expressions.

A side is an array of elevations from the centre outwards with one spacing; roughness is an array beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rounding import rounded

#: Composite roughness that replaces a vanishing one, the least that counts, and the least wetted perimeter.
FALLBACK_N, LEAST_N, LEAST_PERIMETER = 0.035, 1e-4, 1e-6


def first_index(values: Column, test) -> Column:
    """0-based index of the first element from index 1 on that passes; null if none does."""
    at = F.array_position(F.transform(F.slice(values, 2, F.greatest(F.size(values), F.lit(1))), test), F.lit(True))
    return F.when(at > 0, at.cast("int"))


def with_side(df: DataFrame, profile: str, roughness: str, wse: str, dz: str, to: str) -> DataFrame:
    """Add <to>_a, _p, _n, _t: area, wetted perimeter, sum of perimeter times n^1.5, and top width of one side.

    Dry (centre not under water, or no ordinate): all 0. With a dry ordinate the last segment ends where the water
    meets the bank. A side that is wet to its end leaves the first segment out of area and perimeter.
    """
    d, k, u = f"__{to}_d", f"__{to}_k", f"__{to}_u"
    df = df.withColumn(d, F.transform(profile, lambda z: F.col(wse) - z))
    df = df.withColumn(k, first_index(F.col(d), lambda x: x <= 0))
    at = lambda i: F.get(F.col(d), i)
    df = df.withColumn(u, F.col(dz) * at(F.col(k) - 1) / (F.abs(at(F.col(k) - 1)) + F.abs(at(F.col(k)))))
    last = F.coalesce(F.col(k) - 1, F.size(d) - 1)
    from_, bank = F.when(F.col(k).isNull(), 2).otherwise(1), F.col(k).isNotNull()

    def total(start: Column, term) -> Column:
        return F.when(start > last, F.lit(0.0)).otherwise(F.aggregate(F.sequence(start, F.greatest(last, start)), F.lit(0.0), lambda s, j: s + term(j)))

    hyp = lambda j: F.hypot(F.col(dz), at(j) - at(j - 1))
    edge = F.hypot(F.col(u), at(F.col(k) - 1))
    wet = (F.size(d) > 0) & (at(F.lit(0)) > 1e-16)
    made = {
        "a": total(from_, lambda j: F.col(dz) * (at(j) + at(j - 1)) / 2) + F.when(bank, F.col(u) * at(F.col(k) - 1) / 2).otherwise(0.0),
        "p": total(from_, hyp) + F.when(bank, edge).otherwise(0.0),
        "n": total(F.lit(1), lambda j: hyp(j) * F.pow(F.get(roughness, j), F.lit(1.5))) + F.when(bank, edge * F.pow(F.get(roughness, F.col(k) - 1), F.lit(1.5))).otherwise(0.0),
        "t": F.when(bank, F.col(dz) * (F.col(k) - 1) + F.col(u)).otherwise(F.col(dz) * (F.size(d) - 1)),
    }
    return df.withColumns({f"{to}_{name}": F.when(wet, c).otherwise(0.0) for name, c in made.items()}).drop(d, k, u)


def with_sides(df: DataFrame, wse: str, dz: str = "dz", profiles: tuple[str, str] = ("p1", "p2"), roughness: tuple[str, str] = ("n1", "n2")) -> DataFrame:
    """Both sides summed: area, perimeter, pn (sum of perimeter times n^1.5), width."""
    for side, (p, n) in enumerate(zip(profiles, roughness), 1):
        df = with_side(df, p, n, wse, dz, f"__s{side}")
    both = {name: F.col(f"__s1_{c}") + F.col(f"__s2_{c}") for name, c in (("area", "a"), ("perimeter", "p"), ("pn", "n"), ("width", "t"))}
    return df.withColumns(both).drop(*[f"__s{s}_{c}" for s in (1, 2) for c in "apnt"])


def discharge(area: Column, perimeter: Column, pn: Column, slope: Column) -> Column:
    """Manning's flow, unrounded: composite roughness to 4 decimals, replaced where it vanishes."""
    p = F.greatest(perimeter, F.lit(LEAST_PERIMETER))
    n = rounded(F.pow(pn / p, F.lit(2.0) / 3), 4)
    n = F.when(n < LEAST_N, F.lit(FALLBACK_N)).otherwise(n)
    return area * F.pow(area / p, F.lit(2.0) / 3) * F.sqrt(slope) / n


def full_row(df: DataFrame, slope: str = "slope") -> DataFrame:
    """From area, perimeter, pn and width: a, p, q, v, t rounded to 3 decimals; zeros but t where there is no water."""
    a, p = rounded("area"), rounded("perimeter")
    n = rounded(F.pow(F.col("pn") / F.greatest(p, F.lit(LEAST_PERIMETER)), F.lit(2.0) / 3), 4)
    q = rounded(F.try_divide(a * F.pow(F.try_divide(a, p), F.lit(2.0) / 3) * F.sqrt(slope), n))
    wet = (a > 0) & (p > 0)
    zero = lambda c: F.when(wet, c).otherwise(0.0)
    return df.withColumns({"a": zero(a), "p": zero(p), "q": zero(q), "v": zero(rounded(F.try_divide(q, a))), "t": rounded("width")})


def power(a: Column | str, q: Column | str, b: Column | str) -> Column:
    """a * q^b."""
    return F.col(a) * F.pow(F.col(q), F.col(b)) if isinstance(a, str) else a * F.pow(q, b)

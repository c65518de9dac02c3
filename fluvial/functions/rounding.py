"""Rounding as scaled half-even, and significant figures half up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column | str, places: int = 3) -> Column:
    """Half-even on the scaled value, as numpy rounds."""
    c = F.col(x) if isinstance(x, str) else x
    scale = float(10**places)
    return F.rint(c * scale) / scale


def round_sig(x: Column | str, figures: int = 8) -> Column:
    """Half up at the given number of significant figures; 0 stays 0."""
    c = F.col(x) if isinstance(x, str) else x
    factor = F.pow(F.lit(10.0), F.lit(float(figures - 1)) - F.floor(F.log10(F.abs(c))))
    return F.when(c == 0, F.lit(0.0)).otherwise(F.floor(c * factor + 0.5) / factor)


def signs_differ(a: Column | str, b: Column | str) -> Column:
    """Whether two values have opposite signs once rounded to 5 decimals; false if either is missing."""
    x, y = rounded(a, 5), rounded(b, 5)
    return F.coalesce(x * y < 0, F.lit(False))

"""Filters that Spark pushes into a data source, as masks over a column's values."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, datetime, timezone

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, IsNotNull, LessThan, LessThanOrEqual

COMPARED = {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal}


def allow_pushdown(spark: SparkSession) -> None:
    """Spark offers filters to sources in Python only where the session says so."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def _plain(value):
    if isinstance(value, datetime):
        return round(value.timestamp() * 1_000_000)
    if isinstance(value, date):
        return round(datetime(value.year, value.month, value.day, tzinfo=timezone.utc).timestamp() * 1_000_000)
    return value


class Pushed:
    """The filters on some columns without nulls; they are applied in full, so Spark need not look again."""

    def __init__(self, columns: Iterable[str]):
        self.columns, self.tests = set(columns), []

    def take(self, filters: list[Filter]) -> Iterable[Filter]:
        """Keep what can be applied; give back the others."""
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if column not in self.columns:
                yield f
            elif type(f) in COMPARED and f.value is not None:
                self.tests.append((column, COMPARED[type(f)], _plain(f.value)))
            elif isinstance(f, In) and None not in f.value:
                self.tests.append((column, np.isin, np.array([_plain(v) for v in f.value])))
            elif not isinstance(f, IsNotNull):
                yield f

    def mask(self, column: str, values: np.ndarray) -> np.ndarray:
        keep = np.ones(len(values), bool)
        for name, test, value in self.tests:
            if name == column:
                keep &= test(values, value)
        return keep

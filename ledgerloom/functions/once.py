"""Evaluate costly columns once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select_once(df: DataFrame, keep: list[str | Column], computed: list[Column]) -> DataFrame:
    """Like ``select(*keep, *computed)``, but later filters on computed columns do not repeat them.

    Spark pushes a filter below a projection by copying the projected
    expressions into it, even down to the scan. For regular expressions, XML and
    JSON that doubles the work. A generator is not crossed by such a filter.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*computed))))


def filled_once(c: Column) -> Column:
    """Null for an empty text, like ``nullif(c, '')``, which mentions a costly text twice.

    Spark evaluates both mentions where they stand in a branch that is not always taken.
    """
    return F.get(F.array_remove(F.array(c), F.lit("")), 0)

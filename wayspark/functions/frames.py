"""Helpers over whole frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are evaluated once a row. A generator of one row stands
    between them and what uses them: filters on the results aren't pushed below it,
    where each use would be computed anew."""
    made = F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select("*", made)

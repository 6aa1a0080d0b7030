"""One row per array element.

The optimizer adds ``size(array) > 0`` below a plain generator and pushes it towards the
scan, which computes an expensive array expression twice. The outer form followed by a
null check on the element has the same result and computes the array once. Elements
must not be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rows(df: DataFrame, array: Column | str, alias: str, *keep: Column | str) -> DataFrame:
    return df.select(*keep, F.explode_outer(array).alias(alias)).filter(F.col(alias).isNotNull())


def posexplode_rows(df: DataFrame, array: Column | str, pos: str, alias: str, *keep: Column | str) -> DataFrame:
    return df.select(*keep, F.posexplode_outer(array).alias(pos, alias)).filter(F.col(pos).isNotNull())


def inline_rows(df: DataFrame, array: Column | str, *keep: str) -> DataFrame:
    """Fields of an array of structs as columns next to ``keep``."""
    return explode_rows(df, array, "_row", *keep).select(*keep, "_row.*")

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import TypeVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.session import discard, materialise, scratch

T = TypeVar("T")

#: ASCII white space, U+0020 and U+0009 to U+000D.
SPACE = "[ \\t\\n\\x0B\\f\\r]+"


def columns(df: DataFrame, **named: str) -> DataFrame:
    """Only the named columns under the operator's own names; further columns never clash."""
    return df.select(*[df[source].alias(name) for name, source in named.items()])


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def int_table(values: list[int]) -> Column:
    """A constant array, folded once when the query is planned."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def worker_memory(name: str, make: Callable[[], T]) -> T:
    """An object that a Python worker keeps from task to task, made at its first use."""
    store = sys.modules.setdefault("docketry_worker_memory", types.ModuleType("docketry_worker_memory"))
    if not hasattr(store, name):
        setattr(store, name, make())
    return getattr(store, name)


def forget() -> None:
    """Let go of what earlier tasks of other operators left in this Python worker."""
    sys.modules.pop("docketry_worker_memory", None)


@contextmanager
def passing(df: DataFrame, label: str) -> Iterator[DataFrame]:
    """``df`` as a stored table that is deleted at the end of the block; what is read from it must be stored within."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    yield spark.read.schema(df.schema).parquet(path)
    discard(spark, [path])


def ordered(df: DataFrame, label: str, *keys: str) -> DataFrame:
    """Store ``df`` in the order of ``keys`` with ``rank``, each row's place from 0.

    Rows go to tasks by ranges of the whole key, so a frequent leading value is divided
    as well. A row's place is its task's first place plus its place in the task; only one count
    per task is summed up in one place. The ordered table is stored before tasks are
    counted, so both readings see the same ranges. ``df`` should be a stored table, for range bounds
    are sampled from it in a pass of its own.
    """
    placed = materialise(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()),
        label,
    )
    part = F.shiftright("_at", 33).alias("_part")
    counts = placed.groupBy(part).agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()
    first, starts = 0, {}
    for row in counts:
        starts[row["_part"]] = first
        first += row["n"]
    table = int_table([starts.get(i, 0) for i in range(max(starts, default=0) + 1)])
    place = F.get(table, part.cast("int")) + F.col("_at").bitwiseAND((1 << 33) - 1)
    return placed.withColumn("rank", place).drop("_at")

"""Small records in shared storage that are created once.

A record is written to a hidden file and then given its name, which fails if the name is taken; so of two writers one fails,
and a reader never sees half a record. This is as strict as the file system's rename without overwriting.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Taken(RuntimeError):
    """Another writer has created the record."""


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def create(spark: SparkSession, path: str, record: Mapping) -> None:
    """Create ``path`` with ``record`` as JSON, or raise :class:`Taken`."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    target, fs = _place(spark, path)
    hidden = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}.tmp")
    out = fs.create(hidden, False)
    out.write(bytearray(json.dumps(dict(record), sort_keys=True, separators=(",", ":")).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(hidden.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(hidden), fs.makeQualified(target), gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
    except Py4JJavaError as error:
        fs.delete(hidden, False)
        if "FileAlreadyExists" in str(error.java_exception.getClass().getName()):
            raise Taken(path) from None
        raise


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the records in ``folder``; none if it does not exist."""
    place, fs = _place(spark, folder)
    if not fs.exists(place):
        return []
    found = (status.getPath().getName() for status in fs.listStatus(place))
    return sorted(name for name in found if name.endswith(".json") and not name.startswith("."))

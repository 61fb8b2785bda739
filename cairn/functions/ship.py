"""Makes this package importable in Python workers, wherever the driver found it."""

from __future__ import annotations

import os
import sys
import tempfile
import zipfile

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource

_TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the session's files once; Spark hands them to every executor."""
    context = spark.sparkContext
    if getattr(context, "_cairn_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="cairn-"), "cairn_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(_TOP):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(_TOP)))
    context.addPyFile(path)
    context._cairn_shipped = True


def register(spark: SparkSession, source: type[DataSource]) -> None:
    """Registers a data source with its code pickled by value: Spark plans it in a worker that sees no added files."""
    cloudpickle.register_pickle_by_value(sys.modules[source.__module__])
    spark.dataSource.register(source)

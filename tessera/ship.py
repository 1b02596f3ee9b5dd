"""Send this package to the executors, so that their Python workers can import it from any working folder."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def shipped(spark: SparkSession) -> SparkSession:
    """Once an application: the package as a zip file on the Python path of all workers."""
    context = spark.sparkContext
    if context.applicationId not in _sent:
        here = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera.zip")
        with zipfile.ZipFile(path, "w") as out:
            for folder, _, names in os.walk(here):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        out.write(full, os.path.join("tessera", os.path.relpath(full, here)))
        context.addPyFile(path)
        _sent.add(context.applicationId)
    return spark

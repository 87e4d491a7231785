"""The package's own code on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import prosegauge


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers, once for each Spark context, so that they find it wherever the driver was started."""
    sc = spark.sparkContext
    if getattr(sc, "_prosegauge_shipped", False):
        return
    sc._prosegauge_shipped = True
    top = os.path.dirname(os.path.abspath(prosegauge.__file__))
    if not os.path.isdir(top):  # it came in an archive, as --py-files do
        return
    path = os.path.join(os.path.realpath(tempfile.mkdtemp()), "prosegauge.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in sorted(os.walk(top)):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("prosegauge", os.path.relpath(full, top)))
    sc.addPyFile(path)

"""The package on the executors: Python workers import the functions of a job by name."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the session's executors, once; unnecessary where it is installed, harmless there.

    The archive is made on the driver, which serves it to the executors as it does with any file of `--py-files`.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="surveyframe-ship-"), "surveyframe.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("surveyframe", os.path.relpath(full, here)))
    spark.sparkContext.addPyFile(path)

"""Sessions, and sending this package to executors that do not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def create_session(name: str = "rillflow", **conf: str) -> SparkSession:
    """A UTC session with adaptive execution; further settings by keyword, dots written as ``__``."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def send_package(spark: SparkSession) -> None:
    """Let Python workers import this package, once for each application; Spark hands the archive out."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-rillflow-"), "rillflow.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(here)))
    context.addPyFile(archive)
    _SENT.add(context.applicationId)

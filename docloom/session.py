"""Sessions and what executors need."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="docloom-code-"), "docloom.zip")
    with zipfile.ZipFile(target, "w") as out:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("docloom", os.path.relpath(path, top)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def local_session(name: str = "docloom", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark."""
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "6g",
        "spark.checkpoint.dir": "file://" + tempfile.mkdtemp(prefix="docloom-"),
        "spark.sql.adaptive.enabled": "true",
    }
    spark = SparkSession.builder.master(f"local[{cores}]").appName(name).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

"""A session with the settings the library is tested with; any other session works too."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of the batches in which texts go to Python workers. Spark's own bounds, 64 MB and 10,000 rows, let a worker's memory grow with
#: the rows of its partition; the scanners take a text at a time, so small batches cost them nothing.
ARROW_BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": "2m"}


def session(app: str = "parchment", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true").config("spark.sql.adaptive.enabled", "true")
    for key, value in {**ARROW_BATCH, **{key.replace("__", "."): value for key, value in settings.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

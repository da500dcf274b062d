"""Archives that land in a folder become members, papers and finished files as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..sources.archives import expand
from ..sources.tree import decoded

LANDED = "path string, modificationTime timestamp, length long, content binary"


def landed_archives(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """A stream of paper_id (the file's name without its suffix), landed, content. A paper that lands again, corrected, comes again."""
    rows = spark.readStream.format("binaryFile").schema(LANDED).option("maxFilesPerTrigger", per_batch).load(folder)
    name = F.regexp_extract(F.url_decode("path"), r"([^/]*)$", 1)
    paper = F.regexp_replace(name, r"\.(tar\.gz|tgz|tar|zip|gz|tex)$", "")
    return rows.select(paper.alias("paper_id"), F.col("modificationTime").alias("landed"), "content")


def latest(rows: DataFrame) -> DataFrame:
    """rows: paper_id, landed, and any others. Those of each paper's latest landing; all of them, where two have one time."""
    return rows.join(rows.groupBy("paper_id").agg(F.max("landed").alias("landed")), ["paper_id", "landed"], "left_semi")


def landed_files(archives: DataFrame) -> DataFrame:
    """archives: paper_id, landed, content, a batch of the stream. paper_id, landed, path, text, status of the latest landings in it."""
    last = latest(archives)
    return expand(last).select("paper_id", "path", decoded(F.col("content")).alias("text"), "status").join(last.select("paper_id", "landed").distinct(), "paper_id")


def process(archives: DataFrame, plan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> DataStreamWriter:
    """plan turns a batch of files (paper_id, landed, path, text, status) into rows that are appended to out, a folder per batch, so a repeated batch replaces its own.

    Where plan keeps landed, latest() of what out holds leaves out papers that landed again.
    """

    def batch(rows: DataFrame, number: int) -> None:
        plan(landed_files(rows)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return archives.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)

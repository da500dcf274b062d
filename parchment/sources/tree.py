"""Source trees as DataFrames, and texts back to storage."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DOCUMENT_SUFFIXES, STYLE_SUFFIXES
from ..functions.text import normalized_lines


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 text; bytes that are no UTF-8 are left out, line ends become \\n."""

    def decode(values: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else bytes(b).decode("utf-8", "ignore") for b in values], dtype=object)

    valid = F.try_validate_utf8(content.cast("string"))
    text = F.when(valid.isNotNull(), valid).otherwise(F.pandas_udf(decode, "string")(F.when(valid.isNull(), content)))
    return normalized_lines(text)


def of_suffix(path: Column, suffixes) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)).isin(*suffixes)


def read_tree(spark: SparkSession, root: str, suffixes=(*DOCUMENT_SUFFIXES, *STYLE_SUFFIXES)) -> DataFrame:
    """Files below root/<paper>/: paper_id (the folder's name), path below it, parts (for the order of paths), suffix, content.

    Suffixes are compared without regard to case. Paths are in order by parts, not as strings: a/b.tex comes before a.tex.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1].lstrip("/")
    below = F.url_decode(F.regexp_replace(F.regexp_replace(F.regexp_replace("path", r"\+", "%2B"), r"^[A-Za-z0-9.+-]+:/*", ""), "^.*?" + _escaped(base) + "/+", ""))
    told = files.withColumn("_below", below)
    told = told.withColumn("paper_id", F.substring_index("_below", "/", 1)).withColumn("path", F.regexp_replace("_below", "^[^/]*/", ""))
    told = told.withColumn("parts", F.split("path", "/")).withColumn("suffix", F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)))
    return told.filter(F.col("suffix").isin(*suffixes)).select("paper_id", "path", "parts", "suffix", "content")


def _escaped(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def documents(files: DataFrame) -> DataFrame:
    return files.filter(of_suffix(F.col("path"), DOCUMENT_SUFFIXES))


def papers_with_documents(files: DataFrame) -> DataFrame:
    """paper_id of papers that have a document."""
    return documents(files).select("paper_id").distinct()


def with_text(files: DataFrame) -> DataFrame:
    return files.withColumn("text", decoded(F.col("content"))).drop("content")


def write_texts(files: DataFrame, at: str, buckets: int = 256) -> None:
    """files: paper_id, path, text. As Parquet in a fixed number of folders, each paper in one of them, in order; nothing is rewritten in place."""
    dealt = files.select("paper_id", "path", "text").withColumn("bucket", F.pmod(F.xxhash64("paper_id"), F.lit(buckets)).cast("int"))
    dealt.repartition("bucket").sortWithinPartitions("bucket", "paper_id", "path").write.partitionBy("bucket").parquet(at)

"""The batches in which texts go to Python workers are bounded by their bytes, for every query of the library's own."""

import sys

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

import __spark_entry__ as entry
from parchment.session import ARROW_BATCH

cloudpickle.register_pickle_by_value(sys.modules[__name__])
TEXTS, LENGTH = 400, 50_000


def rows_of_batch(texts: pd.Series) -> pd.Series:
    return pd.Series([len(texts)] * len(texts))


@pytest.mark.parametrize("query", ["outline", "safe_chunks", "titles_carried"])
def test_batches_are_bounded_by_bytes(spark, tmp_path, query):
    rows = spark.range(0, TEXTS, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a word "), LENGTH // 7).alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source"), F.lit(LENGTH).cast("long").alias("n_chars"))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    for key in ARROW_BATCH:
        spark.conf.unset(key)
    try:
        assert entry.queries()[query](spark, str(tmp_path)).limit(1).count() == 1
        udf = F.pandas_udf(rows_of_batch, "long")
        most = spark.read.parquet(f"{tmp_path}/documents.parquet").coalesce(1).select(udf("text").alias("n")).agg(F.max("n")).first()[0]
        assert most * LENGTH <= 4 << 20
    finally:
        for key in ARROW_BATCH:
            spark.conf.unset(key)

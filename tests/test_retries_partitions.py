"""A stream of retries keeps no more state stores than tasks run at a time, whatever the number of shuffle partitions."""

from pyspark.sql import functions as F

from parchment import state_queries
from parchment.streaming import retries


def test_state_partitions(spark, tmp_path):
    chunk = F.concat(F.lit("These results hold for every single case which the authors have studied within their longest paper \\emph{x} & "), "key")
    items = spark.range(4).select(F.col("id").cast("string").alias("key")).select("key", chunk.alias("chunk"), *(F.lit("").alias(c) for c in ("ctx_before", "ctx_after", "guide")), F.lit("main").alias("route"))
    stream = retries.TranslationStream(spark, f"file://{tmp_path}/run", asked=state_queries._scripted, clock=retries.LeapingClock())
    stream.add(items)
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        assert stream.run().count() == 4
        assert spark.conf.get("spark.sql.shuffle.partitions") == "32"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    stores = spark.read.format("state-metadata").load(f"file://{tmp_path}/run/checkpoint")
    assert stores.agg(F.max("numPartitions")).first()[0] <= spark.sparkContext.defaultParallelism

"""Spans and running states: in ranges that are stitched, and within arrays for what one text holds."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import running
from ..storage import stored
from .chunking import offsets


def _islands(spans: DataFrame) -> DataFrame:
    """spans: _key, _part, start, end, no two of one start in a part. Those that overlap or touch as one, by a walk over each key in each part."""
    w = Window.partitionBy("_key", "_part").orderBy("start")
    fresh = F.coalesce(F.col("start") > F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int")
    walked = spans.withColumn("_fresh", fresh).withColumn("_island", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return walked.groupBy("_key", "_part", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def merge_spans(spans: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """spans: keys, start, end (exclusive). Spans that overlap or touch are one; null bounds are left out.

    Two phases, so that one key's spans are the work of many tasks. Ranges of (keys, start) are walked each on its own. Then the borders
    are stitched: a table of the keys that lie in several ranges, which has two rows for each range at most, tells by running
    maxima how far earlier ranges reach, and where the island begins that a range's first ones go on with.
    """
    n = parts or int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # of spans that begin together the longest tells all: it is found before the shuffle
    longest = spans.dropna(subset=["start", "end"]).groupBy(*keys, "start").agg(F.max("end").alias("end"))
    ranged = longest.repartitionByRange(n, *keys, "start").select(F.struct(*keys).alias("_key"), F.spark_partition_id().alias("_part"), "start", "end")
    local = stored(_islands(ranged), "islands")
    ends = local.groupBy("_key", "_part").agg(F.max("end").alias("_end"))
    several = ends.groupBy("_key").agg(F.count("*").alias("_n")).filter("_n > 1").select("_key")
    earlier = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    borders = ends.join(F.broadcast(several), "_key", "left_semi").select("_key", "_part", F.max("_end").over(earlier).alias("_reach"), F.lit(True).alias("_border"))
    told = local.join(F.broadcast(stored(borders, "borders")), ["_key", "_part"], "left")
    inner = told.filter("_border is null").select("_key", "start", "end")
    # what begins within reach goes on with the last island of an earlier range that does not
    split = told.filter("_border").withColumn("_on", F.coalesce(F.col("start") <= F.col("_reach"), F.lit(False)))
    heads = split.groupBy("_key", "_part").agg(F.max(F.when(~F.col("_on"), F.col("start"))).alias("_last"))
    heads = stored(heads.select("_key", "_part", F.last("_last", ignorenulls=True).over(earlier).alias("_head")), "heads")
    joined = split.join(F.broadcast(heads), ["_key", "_part"]).withColumn("start", F.when(F.col("_on"), F.col("_head")).otherwise(F.col("start")))
    stitched = joined.groupBy("_key", "start").agg(F.max("end").alias("end")).select("_key", "start", "end")
    return inner.unionByName(stitched).select("_key.*", "start", "end")


def in_spans(position: Column, spans: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] <= position) & (position < s["end"]))


_OPENS, _CLOSES = r"^\s*\\if[A-Za-z@]*(?=\s|\\|$)", r"^\s*\\fi(?![A-Za-z])"


def depths(lines: Column) -> Column:
    r"""How many \if... are open at each line of an array, never below 0; a line of \fi counts as outside, one of \if as well.

    The walk that stops at 0 is the running sum less its running minimum (0 at most).
    """
    steps = F.flatten(F.transform(lines, lambda x: F.array(F.when(F.rlike(x, F.lit(_CLOSES)), -1).otherwise(0), F.when(F.rlike(x, F.lit(_OPENS)), 1).otherwise(0))))
    # arrays of one bind what is used more than once
    bound = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    walk = lambda sums: bound(running(sums, F.least), lambda low: F.transform(lines, lambda x, i: F.get(sums, 2 * i) - F.least(F.lit(0), F.get(low, 2 * i))))
    return F.when(F.exists(lines, lambda x: F.rlike(x, F.lit(_OPENS))), bound(running(steps, lambda a, b: a + b), walk)).otherwise(F.transform(lines, lambda x: F.lit(0)))


def text_lines(files: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    r"""keys, line_no from 0, offset of the line's first character, line without its \n, depth as of depths(). A text's own row tells them: no shuffle."""
    split = files.select(*keys, F.split(text, "\n", -1).alias("_lines"))
    told = split.withColumn("_at", offsets(F.col("_lines"), 1)).withColumn("_depth", depths(F.col("_lines")))
    rows = told.select(*keys, F.posexplode(F.arrays_zip("_lines", "_at", "_depth")).alias("line_no", "_l"))
    return rows.select(*keys, "line_no", F.col("_l._at").alias("offset"), F.col("_l._lines").alias("line"), F.col("_l._depth").alias("depth"))


def next_nonblank(lines: Column) -> Column:
    """For each line of an array the next one with text, null at the end. A text's own row tells them: no shuffle."""
    filled = F.transform(F.reverse(lines), lambda x: F.when(F.trim(x) != "", x))
    # from behind: the latest line with text up to each one
    seen = F.reverse(running(filled, lambda a, b: F.coalesce(b, a)))
    bound = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    return bound(seen, lambda xs: F.transform(lines, lambda x, i: F.get(xs, i + 1)))

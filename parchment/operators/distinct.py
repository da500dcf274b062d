"""Distinct by key with order kept, multisets, and ordered concatenation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import HISTORY
from ..functions.ids import paper_id


def first_of_key(rows: DataFrame, key: Column, order: list[Column], within: list[str] | None = None) -> DataFrame:
    """The first row of each key, by order, in each group of within."""
    w = Window.partitionBy(*(within or []), key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def history_key(line: Column) -> Column:
    """Lines that name the same paper are the same; others are, if they are equal."""
    return F.coalesce(F.concat(F.lit("paper "), paper_id(line)), F.concat(F.lit("line "), line))


def history(lines: DataFrame, limit: int = HISTORY) -> DataFrame:
    """lines: pos, line. The last line of each key in the order of the positions, the latest limit of them.

    A partition's rows of one key are one row before the shuffle, and a partition's latest limit rows are all that is sorted together.
    """
    rows = lines.select("pos", F.trim("line").alias("line")).filter("line <> ''")
    last = rows.groupBy(history_key(F.col("line")).alias("_key")).agg(F.max(F.struct("pos", "line")).alias("_last"))
    return last.select("_last.pos", "_last.line").orderBy(F.desc("pos")).limit(limit)


def history_appended(lines: DataFrame, new: DataFrame, limit: int = HISTORY) -> DataFrame:
    """lines: a history of that limit, in place of all lines that it was made of; new: lines with positions after those.

    The same as the history of all: a key that fell out of the latest limit comes back with a new line only.
    """
    return history(lines.unionByName(new), limit)


def sorted_distinct(values: Column) -> Column:
    """Distinct values in order without regard to case, equal ones in order with regard to it."""
    key = lambda x: F.lower(x)
    return F.array_sort(F.array_distinct(values), lambda a, b: F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))


def ordered_concat(rows: DataFrame, keys: list[str], order: str, text: str, separator: str = "") -> DataFrame:
    """The texts of each group in order, as one column text. A null text is empty; a group is one value and meets in one task."""
    parts = F.array_sort(F.collect_list(F.struct(order, F.coalesce(text, F.lit("")).alias("t"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["t"]), separator).alias("text"))


def counts(rows: DataFrame, keys: list[str], items: Column, name: str = "item") -> DataFrame:
    """How often each item of an array column occurs in each group."""
    return rows.select(*keys, F.explode(items).alias(name)).groupBy(*keys, name).agg(F.count("*").alias("n"))


def count_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Multiset difference of two tables of counts: what left has more of, with how many more."""
    joined = left.join(right.withColumnRenamed("n", "_n"), keys, "left").withColumn("n", F.col("n") - F.coalesce("_n", F.lit(0)))
    return joined.filter("n > 0").drop("_n")

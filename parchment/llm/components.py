"""Connected components of a graph given as an edge table, in rounds of two joins, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import bloom_filter, with_maybe
from .shared import free_names, stored


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _downward(edges: DataFrame) -> DataFrame:
    """Every edge once, from its larger to its smaller end, without loops."""
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each node's larger neighbours to the least node of its neighbourhood."""
    both = _both(edges)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return _downward(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return _downward(edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))))


def components(edges: DataFrame) -> DataFrame:
    """edges: a and b, of one ordered type. Returns node and root, the least node of its component; nodes without edges are not in it.

    The number of rounds grows with the logarithm of the number of nodes. An edge with a null end is left out.
    """
    now = stored(_downward(edges.select("a", "b").dropna()), "edges")
    while not _are_stars(now):
        now = stored(_small_star(_large_star(now)), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Whether each larger end has one smaller end, and that none below it: then that is the least node of its component."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up > 0 and down > 0").isEmpty()


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (key, root) with more links (a, b) between keys, old or new: only the roots that these join are worked on."""
    of = lambda end, name: roots.select(F.col("key").alias(end), F.col("root").alias(name))
    between = links.join(of("a", "p"), "a", "left").join(of("b", "q"), "b", "left").select(F.coalesce("p", "a").alias("a"), F.coalesce("q", "b").alias("b"))
    new = stored(components(between), "merged")
    moved = roots.join(new.select(F.col("node").alias("root"), F.col("root").alias("least")), "root", "left").select("key", F.coalesce("least", "root").alias("root"))
    added = new.select(F.col("node").alias("key"), "root").join(roots.select("key"), "key", "left_anti")
    return stored(moved.unionByName(added), "roots")


def first_of_classes(docs: DataFrame, rows: DataFrame, roots: DataFrame) -> DataFrame:
    """docs without all but one row of each class: the one of the least doc_id, of equal ids that of the least text hash.

    rows: doc_id, tag (xxhash64 of the text) and key of each row of docs; roots: key, root, for the keys that are linked.
    Rows of one key are a class, linked keys too. A null doc_id comes last. Only rows whose class may have others cross
    the shuffle with their texts; a Bloom filter of text hashes tells which.
    """
    least = rows.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")).alias("k"), F.count("*").alias("n"))
    keyed = stored(least.join(roots.select("key", "root"), "key", "left").withColumn("root", F.coalesce("root", "key")), "classes")
    several = keyed.groupBy("root").agg(F.min("k").alias("first"), F.sum("n").alias("n")).filter("n > 1").drop("n")
    # written down, so that the join with it deals both sides anew and can split the rows of a key that very many copies share
    several = stored(keyed.select("key", "root").join(several, "root").select("key", "first"), "several")
    kept = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag").eqNullSafe(F.col("first"))
    marked = stored(rows.join(several, "key").select("doc_id", "tag", kept.alias("keep")).distinct(), "marked")
    blooms, n_blocks = bloom_filter(marked.select(F.col("tag").alias("key")).distinct(), marked.count())
    tag, none, of, maybe, keep, one = free_names(docs, "tag", "none", "of", "maybe", "keep", "one")
    tagged = with_maybe(docs.withColumn(tag, F.xxhash64("text")), F.col(tag), stored(blooms, "blooms"), n_blocks, maybe)
    alone = tagged.filter(~F.col(maybe)).select(*docs.columns)
    wanted = marked.select(F.col("tag").alias(tag), F.col("doc_id").isNull().alias(none), F.coalesce("doc_id", F.lit(0)).alias(of), F.col("keep").alias(keep))
    met = tagged.filter(maybe).withColumn(none, F.col("doc_id").isNull()).withColumn(of, F.coalesce("doc_id", F.lit(0))).join(wanted, [tag, none, of], "left")
    once = met.filter(F.coalesce(keep, F.lit(True))).withColumn(one, F.when(F.col(keep), F.lit(0)).otherwise(F.monotonically_increasing_id() + 1))
    return alone.unionByName(once.dropDuplicates([tag, none, of, one]).select(*docs.columns))

"""URL filters: a table of host and path rules, and a list of canonical URLs behind a blocked Bloom filter.

The list's keys set one bit in each of the eight words of one 512-bit block. The filter's size has a fixed bound
(MAX_BLOCKS), so it is broadcast; urls that it passes go on to a hash join with the list itself, which removes
false positives. Urls that it does not pass are on no list for sure; they meet neither the shuffle nor the join. A list of
more keys than the bound allows for lets more urls through to the join, whose answer is the same.

A null url, or one without `://`, has an empty host and path, fits no rule and is on no list. Repeated pages are judged
one by one; extra columns are not read; an empty list lists nothing; null entries of the list are left out. Urls of any
length are judged whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import MAX_BLOCKS, bloom_filter, with_maybe
from .shared import stored

#: Verdict, host, path start.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    after = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)).otherwise("")
    return F.coalesce(F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise(""), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without www. or m., path without .html or final slashes, query without utm_ parameters; null for a url without `://`."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.startswith("utm_")), "&")
    # plain trims: a pattern with slashes at the end would start anew at each slash of a long run
    path = F.rtrim(path_of(url), F.lit("/"))
    path = F.when(path.endswith(".html"), F.left(path, F.length(path) - 5)).when(path.endswith(".htm"), F.left(path, F.length(path) - 4)).otherwise(path)
    return F.when(F.instr(url, "://") > 0, F.concat(F.regexp_replace(host_of(url), r"^(www|m)\.", ""), path, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept))))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null if none does."""
    fits = lambda r: ((host == r[1]) | host.endswith("." + r[1])) & path.startswith(r[2])
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(ordered):
        name, verdict = F.when(fits(r), r[1] + r[2]).otherwise(name), F.when(fits(r), r[0]).otherwise(verdict)
    return name, verdict


def judge_urls(pages: DataFrame, listed: DataFrame, rules=RULES, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """pages: page_id, url. listed: url, the urls to block where no rule fits.

    Returns page_id, host, path, rule, verdict, canonical_url, maybe_listed (the filter's answer), listed (the list's).
    """
    keys = stored(listed.select(canonical(F.col("url")).alias("key")).dropna().distinct(), "listed")
    blooms, n_blocks = bloom_filter(keys, keys.count(), max_blocks)
    url = F.col("url")
    seen = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("canonical_url"))
    probe = with_maybe(seen, F.col("canonical_url"), blooms, n_blocks, "maybe_listed")
    hits = probe.filter("maybe_listed").join(keys.select(F.col("key").alias("canonical_url"), F.lit(True).alias("listed")), "canonical_url", "left")
    joined = hits.withColumn("listed", F.coalesce("listed", F.lit(False))).unionByName(probe.filter("not maybe_listed").withColumn("listed", F.lit(False)))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return joined.select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
        "canonical_url", "maybe_listed", "listed",
    )

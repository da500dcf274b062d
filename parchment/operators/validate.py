"""The gate that every output passes: mends, then rules on the structure that source and output share."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import PLACEHOLDER, PRESERVED_TERMS
from ..functions.text import (
    braces_balanced,
    commands,
    english_words,
    environment_bounds,
    identifiers_unescaped,
    multiset_difference,
    plain_quotes,
    prose,
    protocol_violation,
    spaced_commands,
    structural,
    unescaped_count,
    visible,
)


def normalized_output(output: Column) -> Column:
    return spaced_commands(identifiers_unescaped(plain_quotes(output)))


def named(names: Column) -> Column:
    r"""Up to five names as `\a, \b`, or `none`."""
    return F.when(F.size(names) == 0, "none").otherwise(F.array_join(F.transform(F.slice(names, 1, 5), lambda n: F.concat(F.lit("\\"), n)), ", "))


def _placeholders(text: Column) -> Column:
    return F.array_sort(F.regexp_extract_all(text, F.lit(re.escape(PLACEHOLDER) + r"\s*\{\s*(\d+)\s*\}"), F.lit(1)))


def validated(rows: DataFrame, source: str = "source", output: str = "output", terms=PRESERVED_TERMS) -> DataFrame:
    """Adds: output mended, violations (codes in the order of the rules, empty if it passes), missing and added commands, style_changed, untranslated.

    Codes: fence, echo or quote, braces, environments, commands, alignment, placeholders. An empty source has no structure
    to keep. Unbalanced braces count only where the source's own are balanced. untranslated: English prose that was kept,
    160 characters of it, if the source had English prose at all.
    """
    rows = rows.withColumn(output, normalized_output(F.col(output)))
    s, o = F.col(source), F.col(output)
    # a column for each step: an expression that uses another one twice would compute it twice
    rows = rows.withColumn("_s", visible(s)).withColumn("_o", visible(o))
    rows = rows.withColumn("_a", commands(s, F.col("_s"))).withColumn("_b", commands(o, F.col("_o")))
    rows = rows.withColumn("_same", F.sort_array("_a") == F.sort_array("_b"))
    rows = rows.withColumn("_ka", structural(F.col("_a"))).withColumn("_kb", structural(F.col("_b")))
    # of equal multisets, the usual case, nothing is missing and nothing added
    none = F.slice("_a", 1, 0)
    rows = rows.withColumn("_kept", F.col("_same") | (F.sort_array("_ka") == F.sort_array("_kb")))
    told = (
        rows.withColumn("missing", F.when(F.col("_kept"), none).otherwise(multiset_difference(F.col("_ka"), F.col("_kb"))))
        .withColumn("added", F.when(F.col("_kept"), none).otherwise(multiset_difference(F.col("_kb"), F.col("_ka"))))
        .withColumn("style_changed", (s != "") & ~F.col("_same") & F.col("_kept"))
    )
    some = s != ""
    told = told.withColumn(
        "violations",
        F.array_compact(
            F.array(
                protocol_violation(o),
                F.when(~braces_balanced(o) & (~some | braces_balanced(s)), "braces"),
                F.when(some & (environment_bounds(s, F.col("_s")) != environment_bounds(o, F.col("_o"))), "environments"),
                F.when(some & ~F.col("_kept"), "commands"),
                F.when(some & (unescaped_count(s, "&", F.col("_s")) != unescaped_count(o, "&", F.col("_o"))), "alignment"),
                F.when(some & (_placeholders(s) != _placeholders(o)), "placeholders"),
            )
        ),
    ).drop("_s", "_o", "_same", "_ka", "_kb", "_kept")
    told = told.withColumn("_a", prose(s, terms)).withColumn("_b", prose(o, terms))
    told = told.withColumn("_a", english_words(F.col("_a"))).withColumn("_b", english_words(F.col("_b")))
    return told.withColumn("untranslated", F.when((F.col("_a") != "") & (F.col("_b") != ""), F.substring("_b", 1, 160)).otherwise("")).drop("_a", "_b")


def warnings(rows: DataFrame, keys: list[str], where: str = "") -> DataFrame:
    """keys, message: for outputs that pass but changed text styles, or kept English prose."""
    place = f" on {where}" if where else ""
    styles = rows.filter("size(violations) = 0 and style_changed").select(*keys, F.lit(f"warning: accepted translation with changed non-structural LaTeX text commands{place}").alias("message"))
    english = rows.filter("size(violations) = 0 and untranslated <> ''").select(*keys, F.concat(F.lit(f"warning: accepted translation after repeated untranslated-English warnings{place}. span: "), "untranslated").alias("message"))
    return styles.unionByName(english)


def warning_kind(message: Column) -> Column:
    kind = F.trim(F.substring_index(F.trim(F.regexp_replace(message, "^warning: ", "")), " on ", 1))
    return F.when(kind == "", "warning").otherwise(kind)


def warning_summary(messages: DataFrame) -> DataFrame:
    """messages: message. kind and n, in order of kind."""
    return messages.groupBy(warning_kind(F.col("message")).alias("kind")).agg(F.count("*").alias("n")).orderBy("kind")


def warning_report(messages: DataFrame) -> DataFrame:
    """messages: paper_id, pos, message. One text per paper that has any: a total, counts by kind, and the numbered messages."""
    kinds = messages.groupBy("paper_id", warning_kind(F.col("message")).alias("kind")).agg(F.count("*").alias("n"))
    summary = kinds.groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "n"))), lambda k: F.concat(F.lit("- "), k["kind"], F.lit(": "), k["n"].cast("string"))), "\n").alias("summary"), F.sum("n").alias("total"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "message"))), lambda m, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), m["message"]))
    details = messages.groupBy("paper_id").agg(F.array_join(listed, "\n").alias("details"))
    head = "Translation warnings\n====================\n\nTotal: "
    return summary.join(details, "paper_id").select("paper_id", F.concat(F.lit(head), F.col("total").cast("string"), F.lit("\n\nSummary:\n"), "summary", F.lit("\n\nDetails:\n"), "details", F.lit("\n")).alias("report"))

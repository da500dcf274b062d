"""Bibliographic metadata from landed responses: Atom parsed once for each, and patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import page_url
from ..functions.text import collapsed

_TERM = "struct<_term:string>"
#: The elements of an entry that are read, by their names without namespaces.
_FEED = (
    "entry array<struct<title:string,summary:string,published:string,updated:string,doi:string,journal_ref:string,comment:string,"
    f"author:array<struct<name:array<string>>>,category:array<{_TERM}>,primary_category:{_TERM}>>"
)


def _optional(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def citation_key(bibtex: Column) -> Column:
    """The key of the first entry; null if there is none."""
    return _optional(F.regexp_extract(bibtex, r"@\w+\s*\{\s*([^,\s]+)\s*,", 1))


def parse_metadata(responses: DataFrame) -> DataFrame:
    """responses: paper_id, body (Atom), bibtex. One row each, of the feed's first entry; status is ok, `no entry` (also for what is no XML) or `no key`."""
    parsed = responses.withColumn("_e", F.get(F.from_xml("body", _FEED, {"ignoreNamespace": "true"})["entry"], F.lit(0)))
    one = lambda name: collapsed(F.coalesce(F.col(f"_e.{name}"), F.lit("")))
    many = lambda values: F.coalesce(F.filter(F.transform(values, collapsed), lambda x: x != ""), F.array().cast("array<string>"))
    out = parsed.select(
        "paper_id",
        one("title").alias("title"),
        many(F.flatten(F.transform("_e.author", lambda a: a["name"]))).alias("authors"),
        one("summary").alias("abstract"),
        one("published").alias("published"),
        one("updated").alias("updated"),
        many(F.transform("_e.category", lambda c: c["_term"])).alias("categories"),
        _optional(one("primary_category._term")).alias("primary_category"),
        *(_optional(one(x)).alias(x) for x in ("doi", "journal_ref", "comment")),
        citation_key(F.col("bibtex")).alias("citation_key"),
        F.when(F.col("_e").isNull(), "no entry").when(citation_key(F.col("bibtex")).isNull(), "no key").otherwise("ok").alias("status"),
    )
    return out.withColumn("abs_url", page_url(F.col("paper_id"))).withColumn("year", F.substring("published", 1, 4))


def format_record(papers: DataFrame) -> DataFrame:
    """papers as of parse_metadata, and attachments (addresses of files that are there, or null). Adds record: tagged lines for import, with a final empty line.

    Lines of optional fields are left out where these are empty; the others always stand.
    """
    line = lambda tag, value: F.array(F.concat(F.lit(f"%{tag} "), F.coalesce(value, F.lit(""))))
    many = lambda tag, values: F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.concat(F.lit(f"%{tag} "), v))
    optional = lambda tag, value: F.when(F.coalesce(value, F.lit("")) != "", F.array(F.concat(F.lit(f"%{tag} "), value))).otherwise(F.array().cast("array<string>"))
    c = F.col
    rows = F.concat(
        F.array(F.lit("%0 Electronic Article")), optional("F", c("citation_key")), many("A", c("authors")), line("T", c("title")), line("D", c("year")),
        line("8", F.substring("published", 1, 10)), F.array(F.lit("%J arXiv")), line("U", c("abs_url")), F.array(F.concat(F.lit("%M arXiv:"), c("paper_id"))),
        line("X", c("abstract")), optional("R", c("doi")), optional("O", c("journal_ref")), optional("9", c("primary_category")), optional("Z", c("comment")),
        many("K", c("categories")), many(">", c("attachments")),
    )
    clean = F.transform(rows, lambda x: F.regexp_replace(x, "[\r\n]", " "))
    return papers.withColumn("record", F.concat(F.array_join(clean, "\n"), F.lit("\n\n")))


def write_records(records: DataFrame, at: str) -> None:
    """One text file part per task: each record with the byte order mark that importers want, its last line end added by the writer."""
    records.select(F.concat(F.lit("﻿"), F.regexp_replace("record", "\n$", "")).alias("value")).write.text(at)

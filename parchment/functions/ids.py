"""Paper identifiers: parsing, addresses, folder names. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NEW = r"(\d{4}\.\d{4,5}(?:v\d+)?)"
_OLD = r"(?i)([a-z-]+(?:\.[A-Z]{2})?/\d{7}(?:v\d+)?)"


def _candidate(value: Column) -> tuple[Column, Column, Column]:
    """Whether value is a URL, its host, and the part that may hold the identifier."""
    value = F.trim(value)
    is_url = F.rlike(value, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]"))
    host = F.lower(F.regexp_extract(value, r"^[^:]+://([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract(value, r"^[^:]+://[^/?#]*/*([^?#]*)", 1), "/+$", "")
    path = F.regexp_replace(path, r"^(abs|pdf|html|format)(/|$)", "")
    rest = F.when(is_url, path).otherwise(value)
    rest = F.regexp_replace(F.regexp_replace(rest, r"\.pdf$", ""), r"\.html$", "")
    return is_url, host, F.regexp_replace(rest, "^/+|/+$", "")


def paper_id(value: Column, lenient: bool = True) -> Column:
    """The identifier that a raw text or an address names; null if there is none, or the address is of another host.

    lenient: an identifier may be part of a longer text, as `12345.67890` holds `2345.67890`; else it must be all of it.
    """
    is_url, host, rest = _candidate(value)
    anchored = lambda p: p if lenient else p.replace("(?i)", "(?i)^", 1) + "$" if "(?i)" in p else "^" + p + "$"
    new, old = F.regexp_extract(rest, anchored(_NEW), 1), F.regexp_extract(rest, anchored(_OLD), 1)
    found = F.coalesce(F.nullif(new, F.lit("")), F.nullif(old, F.lit("")))
    return F.when(~is_url | host.isin("arxiv.org", "www.arxiv.org"), found)


def paper_id_error(value: Column) -> Column:
    """Why a value names no paper; null if it does."""
    is_url, host, _ = _candidate(value)
    return (
        F.when(F.coalesce(F.trim(value), F.lit("")) == "", "empty link")
        .when(is_url & ~host.isin("arxiv.org", "www.arxiv.org"), "other host")
        .when(paper_id(value).isNull(), "no identifier")
    )


def version(identifier: Column) -> Column:
    return F.nullif(F.regexp_extract(identifier, r"v(\d+)$", 1), F.lit("")).cast("int")


def source_url(identifier: Column) -> Column:
    return F.concat(F.lit("https://arxiv.org/e-print/"), identifier)


def pdf_url(identifier: Column) -> Column:
    return F.concat(F.lit("https://arxiv.org/pdf/"), identifier)


def page_url(identifier: Column) -> Column:
    return F.concat(F.lit("https://arxiv.org/abs/"), identifier)


def folder_name(identifier: Column) -> Column:
    return F.replace(identifier, F.lit("/"), F.lit("_"))

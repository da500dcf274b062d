"""Term lists in Markdown, histories, and the configuration file."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import PREFERRED_TRANSLATIONS, PRESERVED_TERMS
from ..operators.distinct import first_of_key


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """pos, line of one text file, read whole so that positions are those in the file."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\r\n|[\r\n]")).alias("pos", "line"))


def preferred_translations(lines: DataFrame) -> DataFrame:
    """lines: pos, line of a Markdown table. pos, english, chinese: the first row of each English term, without head and rule."""
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\|+|\|+$", ""), r"\|"), lambda x: F.trim(x))
    rows = lines.filter(F.startswith(F.trim("line"), F.lit("|"))).select("pos", cells.alias("cells")).filter("size(cells) >= 2")
    pairs = rows.select("pos", F.get("cells", F.lit(0)).alias("english"), F.get("cells", F.lit(1)).alias("chinese"))
    dashes = F.rlike("english", F.lit("^-+$")) & F.rlike("chinese", F.lit("^-+$"))
    pairs = pairs.filter((F.col("english") != "") & (F.col("chinese") != "") & (F.lower("english") != "english term") & ~dashes)
    return first_of_key(pairs, F.lower("english"), [F.col("pos")]).orderBy("pos")


def preserved_terms(lines: DataFrame) -> DataFrame:
    """lines: pos, line of a Markdown list. pos, term: a line's first code span, else the whole; the first of each term."""
    body = F.trim(F.substring(F.trim("line"), 3, 1 << 20))
    span = F.trim(F.regexp_extract(body, "`([^`]+)`", 1))
    rows = lines.filter(F.startswith(F.trim("line"), F.lit("- "))).select("pos", F.when(F.rlike(body, F.lit("`[^`]+`")), span).otherwise(body).alias("term"))
    return first_of_key(rows.filter("term <> ''"), F.lower("term"), [F.col("pos")]).orderBy("pos")


def terms_or_default(terms: DataFrame | None = None, pairs: DataFrame | None = None) -> tuple[tuple[str, ...], tuple[tuple[str, str], ...]]:
    """Both lists for use in expressions; the built-in ones where there is none or it is empty. Term lists are dictionaries of a few pages."""
    own = tuple(r["term"] for r in terms.orderBy("pos").collect()) if terms is not None else ()
    own_pairs = tuple((r["english"], r["chinese"]) for r in pairs.orderBy("pos").collect()) if pairs is not None else ()
    return own or PRESERVED_TERMS, own_pairs or PREFERRED_TRANSLATIONS


@dataclass(frozen=True)
class Config:
    """Settings of the remote model."""

    api_key: str
    model: str
    appendix_model: str
    base_url: str
    use_proxy: bool = True


_KEYS = ("api_key", "model", "appendix_model", "base_url")


def parse_config(text: str, prefix: str = "deepseek_") -> Config:
    """JSON with comments and trailing commas. ValueError says what is wrong with it."""
    string = r'"(?:[^"\\]|\\.)*"'
    text = text.removeprefix("﻿")
    text = re.sub(rf"({string})|//[^\n]*|/\*.*?\*/", lambda m: m[1] or " " * 0 + "\n" * m[0].count("\n"), text, flags=re.S)
    text = re.sub(rf"({string})|,(?=\s*[\]}}])", lambda m: m[1] or "", text, flags=re.S)
    values = json.loads(text)
    if not isinstance(values, dict):
        raise ValueError("the configuration must be one object")
    found = {}
    for key in _KEYS:
        value = values.get(prefix + key)
        if not isinstance(value, str) or not value.strip() and key != "api_key":
            raise ValueError(f"{prefix}{key} must be a text")
        found[key] = value.strip()
    proxy = values.get("use_proxy", True)
    if not isinstance(proxy, bool):
        raise ValueError("use_proxy must be true or false")
    return Config(**found, use_proxy=proxy)


def read_config(spark: SparkSession, path: str) -> Config:
    return parse_config(spark.read.text(path, wholetext=True).first()["value"])

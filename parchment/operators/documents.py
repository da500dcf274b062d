"""Choosing among a paper's files, and among papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DOCUMENT_SUFFIXES, MAIN_NAMES
from ..functions.scan import clean_udf, protect_udf
from ..functions.text import is_macro_file, normalized_lines, worth_translating


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def main_score(path: Column, text: Column) -> Column:
    """Lower is likelier: a class, a document, the paper's own folder, a usual name, few folders."""
    name = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    points = lambda yes, n: F.when(yes, -n).otherwise(0)
    return (
        points(F.contains(text, F.lit(r"\documentclass")), 100) + points(F.contains(text, F.lit(r"\begin{document}")), 50)
        + points(~F.contains(path, F.lit("/")), 20) + points(name.isin(*MAIN_NAMES), 10) + F.size(F.split(path, "/"))
    )


def main_paths(files: DataFrame) -> DataFrame:
    """files: paper_id, path, text. paper_id, path, score of the likeliest main document of each paper, ties by path. No text crosses the shuffle."""
    docs = files.filter(suffix(F.col("path")).isin(*DOCUMENT_SUFFIXES))
    scored = docs.select("paper_id", F.struct(main_score(F.col("path"), F.col("text")).cast("int").alias("score"), "path").alias("_k"))
    return scored.groupBy("paper_id").agg(F.min("_k").alias("_k")).select("paper_id", "_k.path", "_k.score")


def main_files(files: DataFrame) -> DataFrame:
    """The rows of main_paths with all columns of files; adds score."""
    return files.join(main_paths(files), ["paper_id", "path"]).dropDuplicates(["paper_id", "path"]).select(*files.columns, "score")


def clean_files(files: DataFrame) -> DataFrame:
    """files: paper_id, path, text. Adds to documents: text without comments and accents and with placeholders, blocks, skip_reason.

    skip_reason: `prose` if there is too little of it, `macros` for files of definitions, else null.
    """
    docs = files.filter(suffix(F.col("path")).isin(*DOCUMENT_SUFFIXES))
    cleaned = docs.withColumn("text", clean_udf(normalized_lines(F.col("text")))).withColumn("_p", protect_udf(F.col("text")))
    told = cleaned.withColumn("text", F.col("_p.text")).withColumn("blocks", F.col("_p.blocks"))
    reason = F.when(~worth_translating(F.col("text")), "prose").when(is_macro_file(stem(F.col("path")), F.col("text")), "macros")
    return told.withColumn("skip_reason", reason).drop("_p")


def without_completed(papers: DataFrame, state: DataFrame, compile_pdf: bool = True) -> DataFrame:
    """papers that are not done. state: paper_id, has_pdf, has_record, has_translated_pdf, has_translated_tex, has_source_tex.

    Done: the PDF and the record are there, and the translated PDF; without compilation translated TeX will do; a paper without TeX needs neither.
    """
    done = F.col("has_pdf") & F.col("has_record") & (F.col("has_translated_pdf") | (F.lit(not compile_pdf) & F.col("has_translated_tex")) | ~F.col("has_source_tex"))
    return papers.join(state.filter(done), "paper_id", "left_anti")


def resumable(state: DataFrame) -> DataFrame:
    """Papers whose later stages alone can run again."""
    return state.filter(F.col("has_source_tex") & F.col("has_translated_tex"))

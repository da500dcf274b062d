"""From texts to chunks with offsets, contexts and routes, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CHUNK_CHARS, CONTEXT_CHARS
from ..functions.scan import chunks_udf, restore_udf
from ..functions.text import is_appendix_path, running, spaced_commands
from .distinct import ordered_concat


def pack(parts: Column, limit: int) -> Column:
    """Neighbouring parts joined greedily into chunks of at most limit characters; a longer part is a chunk of its own."""
    state = F.aggregate(
        parts,
        F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held")),
        lambda s, x: F.when(s["held"] == "", F.struct(s["done"].alias("done"), x.alias("held")))
        .when(F.length(s["held"]) + F.length(x) <= limit, F.struct(s["done"].alias("done"), F.concat(s["held"], x).alias("held")))
        .otherwise(F.struct(F.concat(s["done"], F.array(s["held"])).alias("done"), x.alias("held"))),
    )
    return F.when(state["held"] == "", state["done"]).otherwise(F.concat(state["done"], F.array(state["held"])))


def paragraphs(text: Column, separator: str = r"\n") -> Column:
    """Parts of a text, each with the separator that follows it, as matched by a pattern without groups."""
    return F.filter(F.regexp_extract_all(text, F.lit(f"(?s)(.*?(?:{separator}|\\z))"), F.lit(1)), lambda x: x != "")


def offsets(parts: Column, gap: int = 0) -> Column:
    """Where each part begins in the text that they make up, with gap characters between them."""
    ends = running(F.transform(parts, lambda x: F.length(x).cast("long") + gap), lambda a, b: a + b)
    return F.slice(F.concat(F.array(F.lit(0).cast("long")), ends), F.lit(1), F.size(parts))


def chunk_rows(files: DataFrame, keys: list[str], chunks: Column) -> DataFrame:
    """One row per chunk: keys, idx, chunk, offset in the text that the chunks make up, length. A row's own array tells the offsets: no shuffle."""
    parts = files.select(*keys, chunks.alias("_chunks")).withColumn("_at", offsets(F.col("_chunks")))
    rows = parts.select(*keys, F.posexplode(F.arrays_zip("_chunks", "_at")).alias("idx", "_c"))
    return rows.select(*keys, "idx", F.col("_c._chunks").alias("chunk"), F.col("_c._at").alias("offset"), F.length("_c._chunks").cast("long").alias("length"))


def with_context(text: Column, offset: Column, length: Column, size: int = CONTEXT_CHARS) -> tuple[Column, Column]:
    """The characters of text before and after a chunk, whatever chunks they lie in."""
    start = F.greatest(offset - size, F.lit(0))
    return F.substring(text, (start + 1).cast("int"), (offset - start).cast("int")), F.substring(text, (offset + length + 1).cast("int"), F.lit(size))


def route_at(begins: Column, offset: Column, length: Column, appendix_file: Column) -> Column:
    r"""`appendix` for chunks of appendix files, and for those that reach beyond the first \appendix, which begins at a character counted from 1, or 0."""
    return F.when(appendix_file | ((begins > 0) & (offset + length > begins - 1)), "appendix").otherwise("main")


def route(text: Column, offset: Column, length: Column, appendix_file: Column) -> Column:
    return route_at(F.instr(text, r"\appendix"), offset, length, appendix_file)


def included_paths(files: DataFrame) -> DataFrame:
    r"""paper_id, path of the files that appendices include: by name from the including file's folder or the paper's, with .tex where a suffix is missing.

    One level, as an equi-join of the candidates of each \input or \include with the paths there are.
    """
    tail = F.when(F.instr("text", r"\appendix") > 0, F.expr(r"substring(text, instr(text, '\\appendix'))")).otherwise("")
    names = F.regexp_extract_all(tail, F.lit(r"\\(?:input|include)\s*\{([^{}]+)\}"), F.lit(1))
    base = F.regexp_replace("path", "[^/]*$", "")
    found = files.select("paper_id", base.alias("base"), F.explode(names).alias("name")).withColumn("name", F.trim("name"))
    with_suffix = F.when(F.rlike("name", F.lit(r"\.[^./]+$")), F.col("name")).otherwise(F.concat("name", F.lit(".tex")))
    candidates = F.array_distinct(F.array(F.concat("base", "name"), F.col("name"), F.concat("base", with_suffix), with_suffix))
    rows = found.select("paper_id", F.explode(candidates).alias("path")).withColumn("path", _resolved(F.col("path"))).distinct()
    return files.select("paper_id", "path").join(rows, ["paper_id", "path"], "left_semi")


def _resolved(path: Column) -> Column:
    """A path without . and inner .. parts."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != ".") & (p != ""))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when((p == "..") & (F.size(a) > 0), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    return F.array_join(kept, "/")


def work_items(files: DataFrame, limit: int = CHUNK_CHARS, context: int = CONTEXT_CHARS) -> DataFrame:
    """files: paper_id, path, text (protected). Returns a row per chunk: paper_id, path, idx, offset, length, chunk, ctx_before, ctx_after, route.

    Offsets, contexts and routes are found in the file's own row, so that a chunk's row carries no more than these.
    """
    appendix = included_paths(files).withColumn("_included", F.lit(True))
    told = files.join(appendix, ["paper_id", "path"], "left").withColumn("_appendix", F.coalesce("_included", F.lit(False)) | is_appendix_path(F.split("path", "/")))
    parts = told.withColumn("_chunks", chunks_udf(F.col("text"), F.lit(limit))).withColumn("_at", offsets(F.col("_chunks"))).withColumn("_begins", F.instr("text", r"\appendix"))
    text, at = F.col("text"), lambda i: F.get("_at", i)

    def item(chunk: Column, i: Column) -> Column:
        length = F.length(chunk).cast("long")
        before, after = with_context(text, at(i), length, context)
        way = route_at(F.col("_begins"), at(i), length, F.col("_appendix"))
        return F.struct(i.alias("idx"), at(i).alias("offset"), length.alias("length"), chunk.alias("chunk"), before.alias("ctx_before"), after.alias("ctx_after"), way.alias("route"))

    return parts.select("paper_id", "path", F.explode(F.transform("_chunks", item)).alias("_item")).select("paper_id", "path", "_item.*")


def reassemble(results: DataFrame, files: DataFrame) -> DataFrame:
    """results: paper_id, path, idx, output. files: paper_id, path, blocks. Returns paper_id, path, text: outputs in order, kept stretches put back."""
    whole = ordered_concat(results, ["paper_id", "path"], "idx", "output")
    back = whole.join(files.select("paper_id", "path", "blocks"), ["paper_id", "path"])
    return back.select("paper_id", "path", spaced_commands(restore_udf(F.col("text"), F.col("blocks"))).alias("text"))

"""A guide for each paper, from its sources and metadata, as one text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DOCUMENT_SUFFIXES, OUTLINE, PREFERRED_TRANSLATIONS, PRESERVED_TERMS
from ..functions.scan import first_title_udf, macro_definitions_udf, math_commands_udf, outline_udf, strip_comments_udf
from ..functions.text import package_names
from ..operators.distinct import first_of_key, sorted_distinct
from ..sources.tree import of_suffix


def code(value: Column) -> Column:
    return F.concat(F.lit("`"), F.replace(value, F.lit("`"), F.lit("\\`")), F.lit("`"))


def code_list(values: Column, none: str = "None detected.") -> Column:
    return F.when(F.size(values) == 0, none).otherwise(F.array_join(F.transform(values, code), ", "))


def bullets(values: Column, none: str) -> Column:
    return F.when(F.size(values) == 0, none).otherwise(F.array_join(F.transform(values, lambda v: F.concat(F.lit("- "), v)), "\n"))


def preferred_prompt(pairs=PREFERRED_TRANSLATIONS) -> str:
    return "; ".join(f"`{a}` -> `{b}`" for a, b in pairs)


def preserved_prompt(terms=PRESERVED_TERMS) -> str:
    return ", ".join(f"`{t}`" for t in terms)


def sources(files: DataFrame) -> DataFrame:
    """files: paper_id, path, text. The same without comments, with the order of paths by parts."""
    return files.withColumn("text", strip_comments_udf(F.col("text"))).withColumn("parts", F.split("path", "/"))


def outlines(clean: DataFrame) -> DataFrame:
    """paper_id, pos, level, heading in the order of files and places."""
    rows = clean.filter(of_suffix(F.col("path"), DOCUMENT_SUFFIXES) & F.rlike("text", F.lit("\\\\(?:" + "|".join(OUTLINE) + r")\*?\s*\{")))
    found = rows.select("paper_id", "parts", F.posexplode(outline_udf(F.col("text"))).alias("at", "section"))
    w = Window.partitionBy("paper_id").orderBy("parts", "at")
    return found.select("paper_id", F.row_number().over(w).alias("pos"), "section.level", "section.heading")


def macros(clean: DataFrame) -> DataFrame:
    r"""paper_id, pos, name, definition: what papers define, each definition once, in order.

    Those of style files count only where a formula of some document uses them: an equi-join on (paper_id, name).
    """
    is_doc = of_suffix(F.col("path"), DOCUMENT_SUFFIXES)
    used = clean.filter(is_doc).select("paper_id", F.explode(math_commands_udf(F.col("text"))).alias("name")).distinct()
    defines = F.rlike("text", F.lit(r"\\(?:newcommand|renewcommand|providecommand|DeclareRobustCommand|DeclareMathOperator|[gex]?def|let)"))
    found = clean.filter(defines).select("paper_id", "parts", is_doc.alias("is_doc"), F.posexplode(macro_definitions_udf(F.col("text"))).alias("at", "m")).select("paper_id", "parts", "at", "is_doc", "m.name", "m.definition")
    kept = found.filter("is_doc").unionByName(found.filter("not is_doc").join(used, ["paper_id", "name"], "left_semi"))
    first = first_of_key(kept, F.col("definition"), [F.col("parts"), F.col("at")], ["paper_id"])
    w = Window.partitionBy("paper_id").orderBy("parts", "at")
    return first.select("paper_id", F.row_number().over(w).alias("pos"), "name", "definition")


def inventory(clean: DataFrame) -> DataFrame:
    """paper_id; distinct sorted packages, classes, environments, labels; files in order; title, the first in that order."""
    docs = clean.filter(of_suffix(F.col("path"), DOCUMENT_SUFFIXES))
    every = lambda p: F.filter(F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(1)), lambda x: F.trim(x)), lambda x: x != "")
    gathered = lambda c: sorted_distinct(F.flatten(F.collect_list(c)))
    titled = docs.withColumn("_title", F.when(F.rlike("text", F.lit(r"\\(?:icml|paper|acl)?title")), first_title_udf(F.col("text"))))
    return titled.groupBy("paper_id").agg(
        gathered(F.flatten(F.transform(every(r"\\usepackage(?:\[[^\]]*\])?\{([^}]+)\}"), package_names))).alias("packages"),
        gathered(every(r"\\documentclass(?:\[[^\]]*\])?\{([^}]+)\}")).alias("classes"),
        gathered(every(r"\\begin\{([^}]+)\}")).alias("environments"),
        gathered(every(r"\\label\{([^}]+)\}")).alias("labels"),
        F.transform(F.array_sort(F.collect_list(F.struct("parts", "path"))), lambda s: s["path"]).alias("files"),
        F.min_by("_title", F.when(F.col("_title").isNotNull(), F.col("parts"))).alias("source_title"),
    )


_CAUTIONS = (
    "- Keep every command, environment name, label, citation key, path, address and formula as it is.",
    "- Translate visible prose in headings, captions, statements, cells and items; leave the structure around it.",
    "- The title command and the PDF's title stay in English.",
    "- Bibliographies, code, package options, graphics paths and included files are not translated.",
)
_MORE = (
    (("table", "table*", "tabular", "tabularx"), "- There are tables: keep `&`, `\\\\`, rows, column specifications, `\\multicolumn` and `\\multirow`."),
    (("figure", "figure*", "subfigure"), "- There are figures: translate captions only."),
    (("algorithm", "algorithmic", "lstlisting", "minted", "verbatim"), "- There are algorithms or code: keep identifiers, keywords, indentation and lines."),
)


def metadata_sections(m: DataFrame) -> DataFrame:
    """Adds metadata: the sections on fields and topic; parts without data are left out."""
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    categories = F.array_distinct(F.filter(F.concat(F.array("primary_category"), F.coalesce("categories", F.array().cast("array<string>"))), lambda x: F.coalesce(x, F.lit("")) != ""))
    field = F.when(F.size(categories) > 0, F.concat_ws("\n", F.lit("## Field And Subfield"), F.when(some("primary_category"), F.concat(F.lit("- arXiv primary category: "), code(F.col("primary_category")))), F.concat(F.lit("- arXiv categories: "), F.array_join(F.transform(categories, code), ", "))))
    topic = F.when(some("title") | some("abstract"), F.concat_ws("\n", F.lit("## Topic Context From arXiv"), F.when(some("title"), F.concat(F.lit("- Title: "), code(F.col("title")))), F.when(some("abstract"), F.concat(F.lit("- Abstract: "), "abstract"))))
    sections = F.concat_ws("\n\n", field, topic)
    return m.withColumn("metadata", F.when(sections == "", "").otherwise(F.concat(sections, F.lit("\n\n"))))


def guides(files: DataFrame, metadata: DataFrame | None = None, terms=PRESERVED_TERMS, pairs=PREFERRED_TRANSLATIONS) -> DataFrame:
    """files: paper_id, path, text. metadata: as of parse_metadata. Returns paper_id, guide for each paper with a document."""
    clean = sources(files)
    listed = lambda rows, item: rows.groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", item.alias("x")))), lambda s: s["x"]).alias("items"))
    sections = listed(outlines(clean), F.concat(code(F.col("level")), F.lit(": "), code(F.col("heading")))).withColumnRenamed("items", "sections")
    commands = listed(macros(clean), code(F.col("definition"))).withColumnRenamed("items", "commands")
    rows = inventory(clean).join(sections, "paper_id", "left").join(commands, "paper_id", "left")
    if metadata is not None:
        rows = rows.join(metadata_sections(metadata).select("paper_id", "title", "metadata"), "paper_id", "left")
    else:
        rows = rows.withColumn("title", F.lit(None).cast("string")).withColumn("metadata", F.lit(""))
    none = F.array().cast("array<string>")
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("source_title"), F.lit(""))
    cautions = [F.lit(x) for x in _CAUTIONS] + [F.when(F.arrays_overlap("environments", F.array(*map(F.lit, names))), text) for names, text in _MORE]
    cautions.append(F.when(F.size("labels") > 0, F.concat(F.lit("- There are cross-references ("), F.size("labels").cast("string"), F.lit(" labels): never translate identifiers."))))
    term_rows = "\n".join(f"| {a} | {b} |" for a, b in pairs)
    glossary = "\n".join([*(f"| {a} | {b} | fixed, the same throughout |" for a, b in pairs), "| any other term | by its context | English where in doubt |"])
    parts = [
        F.lit("# Paper Translation Guide\n\nMade from the paper's sources and metadata; it states nothing that these do not.\n\n"),
        F.coalesce("metadata", F.lit("")),
        F.lit("## Structure\n"), bullets(F.coalesce("sections", none), "- No explicit section commands were detected."),
        F.lit(f"\n\n## Glossary\n| English term | Chinese translation | Notes |\n| --- | --- | --- |\n{glossary}\n"),
        F.lit("\n## Proper Nouns And Keep-English Items\n"),
        F.when(title == "", "").otherwise(F.concat(F.lit("- Original title: "), code(title), F.lit("\n"))),
        F.lit("- Document class(es): "), code_list(F.col("classes")), F.lit("\n- Packages detected: "), code_list(F.col("packages")),
        F.lit("\n- Environment names detected: "), code_list(F.col("environments")),
        F.lit("\n- Source files:\n"), bullets(F.transform("files", lambda f: F.concat(F.lit("`"), f, F.lit("`"))), "- No documents were detected."),
        F.lit("\n\n## Style Rules\n- Concise, formal Simplified Chinese; the same words for the same terms throughout.\n- Notation and claims stay as they are.\n\n## LaTeX Cautions\n"),
        F.concat_ws("\n", *cautions),
        F.when(F.size(F.coalesce("commands", none)) == 0, "").otherwise(F.concat(F.lit("\n\n## Predefined LaTeX Commands\nKeep every use of these with its arguments; a command without arguments right before Chinese text gets an empty group (`{}`).\n"), bullets(F.col("commands"), ""))),
        F.lit(f"\n\n## Preferred Fixed Translations\n| English term | Preferred Chinese translation |\n| --- | --- |\n{term_rows}\n"),
        F.lit("\n## Forced Keep-English Terms\n" + "\n".join(f"- `{t}`" for t in terms) + "\n"),
    ]
    return rows.select("paper_id", F.concat(*parts).alias("guide"))

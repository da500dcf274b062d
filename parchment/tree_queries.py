r"""Queries of what a paper's files tell about each other, and of terms in prose, with DuckDB SQL that computes the same from the texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Template, table
from .constants import PRESERVED_TERMS
from .functions import text as text_
from .operators import terms
from .plans import guide
from .rule_queries import Cases
from .rules import compat, document

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


class Files:
    """The template that a document takes by doc_id % 10: the first for 0, the last for 9, the others in turn."""

    def __init__(self, *patterns: str):
        templates = [Template(p) for p in patterns]
        self.of = [templates[0], *(templates[1 + k % (len(templates) - 2)] for k in range(8)), templates[-1]]

    @property
    def column(self) -> Column:
        out = self.of[9].column
        for k, t in enumerate(self.of[:9]):
            out = F.when(F.col("doc_id") % 10 == k, t.column).otherwise(out)
        return out

    @property
    def sql(self) -> str:
        return "case doc_id % 10 " + " ".join(f"when {k} then {t.sql}" for k, t in enumerate(self.of)) + " end"


def _files(spark: SparkSession, sf_dir: str, text: Column) -> DataFrame:
    """Ten documents a paper: nine .tex files and a style file."""
    n = F.col("doc_id")
    path = F.concat(F.lit("f"), F.lpad(n.cast("string"), 12, "0"), F.when(n % 10 == 9, ".sty").otherwise(".tex"))
    return table(spark, sf_dir, "documents").select(F.floor(n / 10).cast("string").alias("paper_id"), path.alias("path"), text.alias("text"))


_FILES = "select (doc_id // 10)::varchar paper_id, 'f' || lpad(doc_id::varchar, 12, '0') || case when doc_id % 10 = 9 then '.sty' else '.tex' end path, doc_id, lang, source"

# names that begin alike, defined in one file and used in the others; the switch \large everywhere
_USES = ("\\newcommand{\\own}{<<source>>}\n\\def\\ownmore{y}\nText <<lang>> 7 %", "A \\own汉 \\ownmore汉 \\owner汉 \\large字 <<lang>> 7 % \\ownmore\\汉", "\\own x \\emph汉 <<source>>", "% style\n\\own汉 7 % <<lang>>")
_USED = Files(*_USES)


@query(rf"""
with f as ({_FILES}, {_USED.sql} t from documents),
d as (select distinct paper_id from f where doc_id % 10 = 0),
m as (select f.*, case when d.paper_id is null then regexp_replace(t, '\\(large)([^\x00-\x7F])', '\\\1{{}}\2', 'g') else regexp_replace(t, '\\(ownmore|own|large)\\?([^\x00-\x7F])', '\\\1{{}}\2', 'g') end x from f left join d using (paper_id)),
p as (select *, case when doc_id % 10 = 9 then x else replace(x, '7 %', '7\%') end y from m)
select paper_id, path, t <> y changed, md5(y) text_md5 from p""")
def trees_compatible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers of ten files through the chain of rewrites: names that one file defines are ended in all, the longest first."""
    return compat.make_compatible(_files(spark, sf_dir, _USED.column)).select("paper_id", "path", "changed", F.md5("text").alias("text_md5"))


_DEFINES = (
    "\\newcommand{\\a<<lang>>}{x}\n$\\b<<lang>> + 1$", "\\newcommand{\\a<<lang>>}{x}\n\\newcommand{\\d<<lang>>}{<<source>>} no formula", "\\[ \\b<<lang>> \\]", "\\newcommand{\\ben}{q}\n\\newcommand{\\bde}{q}\n\\newcommand{\\unused}{r}",
)
_DEFINED = Files(*_DEFINES)


@query(rf"""
with f as ({_FILES}, {_DEFINED.sql} t from documents),
m as (select paper_id, path, generate_subscripts(d, 1) k, unnest(d) definition from (select paper_id, path, regexp_extract_all(t, '\\newcommand\{{\\[a-z]+\}}\{{[^{{}}]*\}}') d from f)),
u as (select distinct paper_id, unnest(regexp_extract_all(t, '\\b[a-z]+')) as name from f where doc_id % 10 in (0, 2, 4, 6, 8)),
j as (select * from m where ends_with(path, '.tex') union all select m.* from m join u on m.paper_id = u.paper_id and contains(definition, '{{' || name || '}}') where ends_with(path, '.sty')),
o as (select * from j qualify row_number() over (partition by paper_id, definition order by path, k) = 1)
select paper_id, row_number() over (partition by paper_id order by path, k)::int pos, definition from o""")
def paper_macros(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the ten files of a paper define: each definition once, those of the style file only where a formula uses them."""
    return guide.macros(guide.sources(_files(spark, sf_dir, _DEFINED.column))).select("paper_id", "pos", "definition")


@query("""
with m as (select doc_id::varchar paper_id, case when doc_id % 3 = 0 then '' else 'On ' || source end title, case when doc_id % 4 = 0 then null else 'In ' || lang || ' ' || coalesce(text, '') end abstract,
  case when doc_id % 5 = 0 then null else 'cs.' || lang end p, case when doc_id % 7 = 0 then [] when doc_id % 5 = 0 then [source] else [source, 'cs.' || lang] end c from documents),
f as (select *, list_filter(list_prepend(p, list_filter(c, lambda x: x is distinct from p)), lambda x: x is not null) k from m),
s as (select *, case when len(k) > 0 then '## Field And Subfield' || case when p is null then '' else chr(10) || '- arXiv primary category: `' || p || '`' end || chr(10) || '- arXiv categories: ' || array_to_string(list_transform(k, lambda x: '`' || x || '`'), ', ') end field,
  case when title <> '' or abstract is not null then '## Topic Context From arXiv' || case when title = '' then '' else chr(10) || '- Title: `' || title || '`' end || case when abstract is null then '' else chr(10) || '- Abstract: ' || abstract end end topic from f)
select paper_id, case when field is null and topic is null then '' else concat_ws(chr(10) || chr(10), field, topic) || chr(10) || chr(10) end metadata from s""")
def metadata_guided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The guide's sections on fields and topic, for records that lack one part or another."""
    n, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    primary = F.when(n % 5 != 0, F.concat(F.lit("cs."), "lang"))
    rows = table(spark, sf_dir, "documents").select(
        n.cast("string").alias("paper_id"), F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("On "), "source")).alias("title"),
        F.when(n % 4 != 0, F.concat(F.lit("In "), "lang", F.lit(" "), text)).alias("abstract"), primary.alias("primary_category"),
        F.when(n % 7 == 0, F.array().cast("array<string>")).when(n % 5 == 0, F.array("source")).otherwise(F.array("source", primary)).alias("categories"),
    )
    return guide.metadata_sections(rows).select("paper_id", "metadata")


_BLOCK = "'\n% parchment: Chinese text\n\\PassOptionsToPackage{no-math}{fontspec}\n\\usepackage{iftex}\n\\iftutex\\usepackage[fontset=fandol]{ctex}\\else\\usepackage[UTF8]{ctex}\\fi\n'"
_SPACING = "'% parchment: line spacing of Chinese text\n\\makeatletter\n\\let\\ACM@origbaselinestretch\\baselinestretch\n\\makeatother\n'"
_MAINS = Cases(
    "\\documentclass[a4paper]{article}\n\\begin{document}<<lang>>", "\\documentclass{article}\n\\usepackage{ctex}\n<<lang>>", "\\documentclass{article}\n\\usepackage[x]{xeCJK}\n<<source>>", "no class <<lang>>",
    "\\documentclass[a]{acmart}\n\\begin{document}<<source>>", "\\documentclass{acmart}\n\\usepackage[UTF8]{ctex}\n\\begin{document}<<lang>>",
)


@query(rf"""
with m as (select doc_id, doc_id % 6 k, {_MAINS.sql} t from documents)
select doc_id, md5(case k when 0 then replace(t, '{{article}}', '{{article}}' || {_BLOCK}) when 1 then '{compat.NO_MATH}' || chr(10) || replace(t, '\usepackage{{ctex}}', '\usepackage[fontset=fandol]{{ctex}}') when 2 then '{compat.NO_MATH}' || chr(10) || t
  when 4 then replace(replace(t, '{{acmart}}', '{{acmart}}' || {_BLOCK}), '\begin{{document}}', {_SPACING} || '\begin{{document}}') when 5 then '{compat.NO_MATH}' || chr(10) || replace(t, '\begin{{document}}', {_SPACING} || '\begin{{document}}') else t end) text_md5 from m""")
def chinese_supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main files that load a package for Chinese in one way or another, or none."""
    mains = table(spark, sf_dir, "documents").select("doc_id", _MAINS.column.alias("text"))
    return document.chinese_support(mains).select("doc_id", F.md5("text").alias("text_md5"))


_PROSE = Template("<<text>> the red teaming of agents, agent by agent and token by token: prompt injection, few-shot RAG; zero-shot KV cache-AI safety. <<lang>>")
_TERMS = "|".join(t.replace("-", r"\-") for t in PRESERVED_TERMS)
_STRIP = rf"regexp_replace({{}}, '(?i)(^|[^A-Za-z])(?:{_TERMS})([^A-Za-z]|$)', '\1 \2', 'g')"


@query(f"""
with p as (select doc_id, {_PROSE.sql} t from documents)
select doc_id, md5({_STRIP.format(_STRIP.format("t"))}) text_md5, length({_STRIP.format(_STRIP.format("t"))})::bigint n_chars from p""")
def terms_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prose without the terms that stay in English, where they stand alone."""
    rows = table(spark, sf_dir, "documents").select("doc_id", text_.without_terms(_PROSE.column, PRESERVED_TERMS).alias("t"))
    return rows.select("doc_id", F.md5("t").alias("text_md5"), F.length("t").cast("long").alias("n_chars"))


@query(SQL["terms_stripped"])
def terms_looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, by a look-up of each word's n-grams among the terms."""
    rows = table(spark, sf_dir, "documents").select("doc_id", _PROSE.column.alias("t"))
    return terms.without_terms(rows, list(PRESERVED_TERMS), "t").select("doc_id", F.md5("t").alias("text_md5"), F.length("t").cast("long").alias("n_chars"))

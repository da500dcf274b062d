r"""The library's queries over the driver's tables, and DuckDB SQL for the same rows.

The tables hold no TeX, so most queries first make a source of each document from its columns, by one template from
which both the Spark column and the SQL expression are derived. Every query runs over its whole table and whole texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import ids, scan, text
from .operators import chunking, distinct, intervals
from .operators import documents as docs_
from .operators import validate as gate
from .plans import guide as guides_
from .plans import translate as plan
from .rules import compat
from .sources import archives, metadata

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Template:
    """A text with columns in double angle brackets, as a Spark column and as SQL."""

    def __init__(self, pattern: str):
        self.parts = pattern.replace(">>", "<<").split("<<")

    @property
    def column(self) -> Column:
        return F.concat(*(F.coalesce(F.col(p).cast("string"), F.lit("")) if k % 2 else F.lit(p) for k, p in enumerate(self.parts)))

    @property
    def sql(self) -> str:
        quote = lambda p: "'" + p.replace("'", "''") + "'"
        return "(" + " || ".join(f"coalesce(cast({p} as varchar), '')" if k % 2 else quote(p) for k, p in enumerate(self.parts)) + ")"


TEX = Template(
    r"""\documentclass[a4paper]{article}
\usepackage[utf8]{inputenc, <<source>>}
\usepackage{graphicx,<<lang>>} % loaded for <<lang>>
% a line of its own 100\% sure
\newcommand{\own<<lang>>}[1]{#1}
\newcommand\zero<<lang>>{x}
\def\plain<<lang>>{y}
\if<<lang>>
\usepackage{graphicx}
\fi
\begin{document}
\section{On <<source>> in <<lang>>}\label{sec:<<doc_id>>}
``A'' \'e caf\"{e} <<text>>
\subsection*{Numbers  <<n_chars>>}
Some 50% or 7 % of 12px and 3.5 px \& more \cite{b\_<<doc_id>>}.
\begin{tabular}{ll}a & b\\c & d \end{tabular}
\begin{align}x_{<<doc_id>>}\end{align}
\input{parts/<<source>>} \emph{end} \textbf{<<lang>>}
\end{document}
"""
)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text", TEX.column.alias("tex"))


_S = f"(select doc_id, source, lang, n_chars, {TEX.sql} tex from documents)"
_VISIBLE = r"regexp_replace({}, '(?m)((?:^|[^\\])(?:\\\\)*)%[^\n]*', '\1', 'g')"


@query("""
with p as (select doc_id, coalesce(text, '') text from documents),
s as (select doc_id, text, list_filter(regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+'), lambda x: x <> '') parts from p),
f as (select doc_id, text, case when len(parts) = 0 then {'c': []::varchar[], 'cur': ''} else list_reduce(list_transform(parts, lambda x: {'c': []::varchar[], 'cur': x}),
  lambda a, x: case when length(a.cur) + length(x.cur) <= 2048 then {'c': a.c, 'cur': a.cur || x.cur} else {'c': list_append(a.c, a.cur), 'cur': x.cur} end) end r from s),
k as (select doc_id, text, case when r.cur = '' then r.c else list_append(r.c, r.cur) end chunks from f)
select doc_id, len(chunks)::bigint n_chunks, length(text)::bigint total_chars, coalesce(list_max(list_transform(chunks, lambda x: length(x))), 0)::bigint longest from k""")
def chunk_plan(spark, sf_dir):
    """Lines packed into chunks of at most 2,048 characters."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("chunks", chunking.pack(chunking.paragraphs(F.col("text")), chunking.CHUNK_CHARS))
    longest = F.coalesce(F.array_max(F.transform("chunks", lambda c: F.length(c))), F.lit(0))
    return rows.select("doc_id", F.size("chunks").cast("long").alias("n_chunks"), F.length("text").cast("long").alias("total_chars"), longest.cast("long").alias("longest"))


@query("select doc_id, length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g'))::bigint n_letters, length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) >= 20 worth from documents")
def worth_translating(spark, sf_dir):
    body = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", text.ascii_letters(body).cast("long").alias("n_letters"), text.worth_translating(body).alias("worth"))


_RAW = r"""case doc_id % 7 when 0 then 'https://arxiv.org/pdf/24' || lpad((doc_id % 12 + 1)::varchar, 2, '0') || '.' || lpad((doc_id % 100000)::varchar, 5, '0') || 'v' || (doc_id % 9 + 1) || '.pdf'
  when 1 then 'hep-th/' || lpad((doc_id % 10000000)::varchar, 7, '0') when 2 then ' https://www.arxiv.org/abs/math.GT/' || lpad((doc_id % 10000000)::varchar, 7, '0') || '/ '
  when 3 then 'https://example.org/' || (2400 + doc_id % 100) || '.00001' when 4 then '1' || (2400 + doc_id % 100) || '.' || lpad((doc_id % 100000)::varchar, 5, '0')
  when 5 then '' else 'no paper ' || source end"""


def raw_ids(spark, sf_dir):
    n, pad = F.col("doc_id"), lambda c, k: F.lpad(c.cast("string"), k, "0")
    new = F.concat(F.lit("https://arxiv.org/pdf/24"), pad(n % 12 + 1, 2), F.lit("."), pad(n % 100000, 5), F.lit("v"), (n % 9 + 1).cast("string"), F.lit(".pdf"))
    raw = (
        F.when(n % 7 == 0, new).when(n % 7 == 1, F.concat(F.lit("hep-th/"), pad(n % 10000000, 7)))
        .when(n % 7 == 2, F.concat(F.lit(" https://www.arxiv.org/abs/math.GT/"), pad(n % 10000000, 7), F.lit("/ ")))
        .when(n % 7 == 3, F.concat(F.lit("https://example.org/"), (2400 + n % 100).cast("string"), F.lit(".00001")))
        .when(n % 7 == 4, F.concat(F.lit("1"), (2400 + n % 100).cast("string"), F.lit("."), pad(n % 100000, 5)))
        .when(n % 7 == 5, "").otherwise(F.concat(F.lit("no paper "), "source"))
    )
    return table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"))


@query(rf"""
with r as (select doc_id, {_RAW} raw from documents),
i as (select doc_id, raw, case doc_id % 7 when 3 then null when 5 then null when 6 then null
  when 0 then regexp_extract(raw, '[0-9]{{4}}\.[0-9]{{5}}v[0-9]+') when 4 then substr(raw, 2) else regexp_extract(trim(raw, ' /'), '[a-zA-Z.-]+/[0-9]{{7}}') end paper_id from r)
select doc_id, raw, paper_id, nullif(regexp_extract(paper_id, 'v([0-9]+)$', 1), '')::int as version, 'https://arxiv.org/e-print/' || paper_id source_url, 'https://arxiv.org/pdf/' || paper_id pdf_url,
  replace(paper_id, '/', '_') folder, case doc_id % 7 when 3 then 'other host' when 5 then 'empty link' when 6 then 'no identifier' end error from i""")
def paper_ids(spark, sf_dir):
    rows = raw_ids(spark, sf_dir).withColumn("paper_id", ids.paper_id(F.col("raw")))
    p = F.col("paper_id")
    return rows.select("doc_id", "raw", "paper_id", ids.version(p).alias("version"), ids.source_url(p).alias("source_url"), ids.pdf_url(p).alias("pdf_url"), ids.folder_name(p).alias("folder"), ids.paper_id_error(F.col("raw")).alias("error"))


@query("""
with c as (select doc_id, text, k - 1 idx, substr(text, ((k - 1) * 700 + 1)::bigint, 700) chunk, ((k - 1) * 700)::bigint as offset_ from documents, unnest(range(1, (length(text) + 699) // 700 + 1)) u(k))
select doc_id, idx::int idx, offset_ as "offset", length(chunk)::bigint length, md5(chunk) chunk_md5,
  md5(substr(text, greatest(offset_ - 250, 0) + 1, offset_ - greatest(offset_ - 250, 0))) before_md5, md5(substr(text, offset_ + length(chunk) + 1, 250)) after_md5 from c""")
def chunk_context(spark, sf_dir):
    """Chunks of 700 characters with the 250 before and after them."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") + 699) / 700).cast("int") - 1), lambda k: F.substring(F.col("text"), k * 700 + 1, F.lit(700)))
    chunks = chunking.chunk_rows(rows.filter("length(text) > 0"), ["doc_id", "text"], pieces)
    before, after = chunking.with_context(F.col("text"), F.col("offset"), F.col("length"))
    return chunks.select("doc_id", "idx", "offset", "length", F.md5("chunk").alias("chunk_md5"), F.md5(before).alias("before_md5"), F.md5(after).alias("after_md5"))


@query("select conv_id, md5(string_agg(coalesce(text, ''), '' order by turn)) text_md5, sum(length(coalesce(text, '')))::bigint n_chars from conversations group by conv_id")
def reassemble(spark, sf_dir):
    whole = distinct.ordered_concat(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text")
    return whole.select("conv_id", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


_PATH = "case doc_id % 4 when 0 then 'main.tex' when 1 then 'parts/' || source || doc_id || '.tex' when 2 then 'd' || doc_id || '.ltx' else 'style' || doc_id || '.sty' end"


def tree(spark, sf_dir):
    """Documents as files of as many papers as there are tens of them."""
    n = F.col("doc_id")
    path = F.when(n % 4 == 0, "main.tex").when(n % 4 == 1, F.concat(F.lit("parts/"), "source", n.cast("string"), F.lit(".tex"))).when(n % 4 == 2, F.concat(F.lit("d"), n.cast("string"), F.lit(".ltx"))).otherwise(F.concat(F.lit("style"), n.cast("string"), F.lit(".sty")))
    body = F.when(n % 3 == 0, F.col("tex")).otherwise(F.coalesce("text", F.lit("")))
    return sources(spark, sf_dir).withColumn("path", path).withColumn("text", body).select(F.floor(n / 10).cast("string").alias("paper_id"), "path", "text", "doc_id", "source")


_TREE = f"(select (doc_id // 10)::varchar paper_id, {_PATH} path, case when doc_id % 3 = 0 then tex else coalesce(t, '') end text, doc_id from (select *, {TEX.sql} tex, text t from documents))"


@query(rf"""
with f as (select *, -100 * contains(text, '\documentclass')::int - 50 * contains(text, '\begin{{document}}')::int - 20 * (not contains(path, '/'))::int - 10 * (path = 'main.tex')::int + len(string_split(path, '/'))::int score
  from {_TREE} where not ends_with(path, '.sty'))
select paper_id, path, score from f qualify row_number() over (partition by paper_id order by score, path) = 1""")
def main_files(spark, sf_dir):
    return docs_.main_paths(tree(spark, sf_dir))


@query("""
with l as (select conv_id * 1000 + turn pos, trim(case when turn % 2 = 0 then 'https://arxiv.org/abs/24' || lpad((conv_id % 12 + 1)::varchar, 2, '0') || '.00' || lpad((conv_id % 60)::varchar, 3, '0') else replace(coalesce(text, ''), chr(10), ' ') end, ' ') line from conversations),
k as (select *, coalesce(nullif(regexp_extract(line, '[0-9]{4}\\.[0-9]{5}'), ''), 'x' || line) k from l where line <> '')
select pos, line from (select *, row_number() over (partition by k order by pos desc) n from k) where n = 1 order by pos desc limit 200""")
def history(spark, sf_dir):
    c = F.col("conv_id")
    url = F.concat(F.lit("https://arxiv.org/abs/24"), F.lpad((c % 12 + 1).cast("string"), 2, "0"), F.lit(".00"), F.lpad((c % 60).cast("string"), 3, "0"))
    line = F.when(F.col("turn") % 2 == 0, url).otherwise(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")))
    lines = table(spark, sf_dir, "conversations").select((c * 1000 + F.col("turn")).alias("pos"), line.alias("line"))
    return distinct.history(lines)


_MESSAGE = Template("warning: <<lang>> text kept on <<source>> model=x")


@query(f"select lang || ' text kept' kind, count(*) n from (select *, {_MESSAGE.sql} m from documents) group by lang")
def warning_summary(spark, sf_dir):
    return gate.warning_summary(table(spark, sf_dir, "documents").select(_MESSAGE.column.alias("message"))).select("kind", "n")


@query(f"""
with m as (select doc_id // 10 p, doc_id, lang || ' text kept' kind, {_MESSAGE.sql} m from documents),
k as (select p, string_agg('- ' || kind || ': ' || n, chr(10) order by kind) s, sum(n) t from (select p, kind, count(*) n from m group by p, kind) group by p),
d as (select p, string_agg('[' || n || '] ' || m, chr(10) order by n) d from (select *, row_number() over (partition by p order by doc_id) n from m) group by p)
select p::varchar paper_id, 'Translation warnings' || chr(10) || '====================' || chr(10) || chr(10) || 'Total: ' || t || chr(10) || chr(10) || 'Summary:' || chr(10) || s || chr(10) || chr(10) || 'Details:' || chr(10) || d || chr(10) report from k join d using (p)""")
def warning_report(spark, sf_dir):
    return gate.warning_report(table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 10).cast("string").alias("paper_id"), F.col("doc_id").alias("pos"), _MESSAGE.column.alias("message")))


@query("""
with s as (select source, doc_id * 37 % 5000 a, doc_id * 37 % 5000 + n_chars % 90 b from documents),
o as (select *, max(b) over (partition by source order by a, b rows between unbounded preceding and 1 preceding) m from s),
i as (select *, sum(case when m is null or a > m then 1 else 0 end) over (partition by source order by a, b rows unbounded preceding) g from o)
select source, min(a) as "start", max(b) as "end" from i group by source, g""")
def span_merge(spark, sf_dir):
    start = F.col("doc_id") * 37 % 5000
    return intervals.merge_spans(table(spark, sf_dir, "documents").select("source", start.alias("start"), (start + F.col("n_chars") % 90).alias("end")), ["source"])


@query(rf"""
select lang, regexp_replace(c, '^\\', '') command, count(*) n from (select lang, unnest(regexp_extract_all(replace({_VISIBLE.format("tex")}, '\\', '  '), '\\[A-Za-z@]+')) c from {_S}) group by all""")
def command_counts(spark, sf_dir):
    return distinct.counts(sources(spark, sf_dir), ["lang"], text.commands(F.col("tex")), "command")


@query(rf"""
with c as (select lang, regexp_replace(c, '^\\', '') command, doc_id from (select lang, doc_id, unnest(regexp_extract_all(replace({_VISIBLE.format("tex")}, '\\', '  '), '\\[A-Za-z@]+')) c from {_S})),
a as (select lang, command, count(*) n from c group by all), b as (select lang, command, count(*) n from c where not (command = 'emph' or doc_id % 5 = 0 and command = 'input') group by all)
select a.lang, a.command, a.n - coalesce(b.n, 0) n from a left join b using (lang, command) where a.n > coalesce(b.n, 0)""")
def command_difference(spark, sf_dir):
    """What copies without \\emph and, for some, without \\input lack."""
    rows = sources(spark, sf_dir)
    edited = F.replace(F.col("tex"), F.lit(r"\emph"), F.lit(""))
    edited = F.when(F.col("doc_id") % 5 == 0, F.replace(edited, F.lit(r"\input"), F.lit(""))).otherwise(edited)
    return distinct.count_difference(distinct.counts(rows, ["lang"], text.commands(F.col("tex")), "command"), distinct.counts(rows, ["lang"], text.commands(edited), "command"), ["lang", "command"])


@query(rf"""
with b as (select doc_id, list_transform(regexp_extract_all({_VISIBLE.format("tex")}, '\\(begin|end)\{{[^{{}}\n]+\}}'), lambda x: regexp_replace(x, '^.(begin|end).(.*).$', '\1 \2')) b from {_S})
select doc_id, array_to_string(b, ',') bounds, len(b)::bigint n from b""")
def environment_bounds(spark, sf_dir):
    return sources(spark, sf_dir).withColumn("b", text.environment_bounds(F.col("tex"))).select("doc_id", F.array_join("b", ",").alias("bounds"), F.size("b").cast("long").alias("n"))


@query(rf"select doc_id, len(regexp_extract_all(replace(replace({_VISIBLE.format('tex')}, '\\', '  '), '\&', '  '), '&'))::bigint n_tabs from {_S}")
def alignment_tabs(spark, sf_dir):
    return sources(spark, sf_dir).select("doc_id", text.unescaped_count(F.col("tex"), "&").cast("long").alias("n_tabs"))


@query(rf"""select doc_id, md5(replace(replace(replace(replace(replace(replace(replace(tex, '\`\`', '"'), '\`', '’'), '\''\''', '"'), '\''', '’'), '``', '"'), '''''', '"'), '`', '’')) text_md5 from {_S}""")
def plain_quotes(spark, sf_dir):
    return sources(spark, sf_dir).select("doc_id", F.md5(text.plain_quotes(F.col("tex"))).alias("text_md5"))


@query(rf"select doc_id, md5(regexp_replace(tex, '([0-9])[ \t]*%', '\1\\%', 'g')) text_md5 from {_S}")
def percent_escaped(spark, sf_dir):
    return sources(spark, sf_dir).select("doc_id", F.md5(text.percent_escaped(F.col("tex"))).alias("text_md5"))


@query(rf"select doc_id, md5(regexp_replace(tex, '(-?[0-9]+(?:\.[0-9]+)?)\s*px\b', '\1pt', 'g')) text_md5 from {_S}")
def px_as_pt(spark, sf_dir):
    return sources(spark, sf_dir).select("doc_id", F.md5(text.px_as_pt(F.col("tex"))).alias("text_md5"))


@query(rf"""
with m as (select doc_id, regexp_replace(tex, '(?m)((?:^|[^\\])(?:\\\\)*)%[^\n]*', '\1' || chr(1), 'g') m from {_S})
select doc_id, md5(regexp_replace(m, '[ \t]*' || chr(1), '', 'g')) text_md5 from m""")
def comments_stripped(spark, sf_dir):
    return sources(spark, sf_dir).select("doc_id", F.md5(text.without_comments(F.col("tex"))).alias("text_md5"))


@query()
def sources_cleaned(spark, sf_dir):
    """Comments, accents and kept stretches, by the scanners."""
    clean = docs_.clean_files(tree(spark, sf_dir).select("paper_id", "path", "text", "doc_id"))
    return clean.select("doc_id", "skip_reason", F.length("text").cast("long").alias("n_chars"), F.size("blocks").cast("long").alias("n_blocks"), (scan.restore_udf(F.col("text"), F.col("blocks")) == scan.clean_udf(F.col("text"))).alias("plain"))


@query(rf"select doc_id, md5(regexp_replace(replace(replace(tex, '\''e', 'e'), '\\\"{{e}}', 'e'), 'x^', 'x^')) text_md5 from {_S}".replace('\\\\\\"', '\\"'))
def accents_dropped(spark, sf_dir):
    return sources(spark, sf_dir).select("doc_id", F.md5(text.accents_dropped(F.col("tex"))).alias("text_md5"))


@query(rf"""
with c as (select doc_id, generate_subscripts(x, 1) i, unnest(x) c from (select doc_id, string_split(regexp_replace(regexp_replace({_VISIBLE.format("tex")}, '(?s)\\.', '', 'g'), '[^{{}}]', '', 'g'), '') x from {_S})),
r as (select doc_id, sum(case c when '{{' then 1 when '}}' then -1 else 0 end) over (partition by doc_id order by i) d, row_number() over (partition by doc_id order by i desc) l from c)
select doc_id, min(d) >= 0 and min(case when l = 1 then d end) = 0 balanced from r group by doc_id""")
def braces_balanced(spark, sf_dir):
    return sources(spark, sf_dir).select("doc_id", text.braces_balanced(F.col("tex")).alias("balanced"))


@query(f"select doc_id, 'zero' || lang || ',' || 'plain' || lang macros from {_S}")
def zero_argument_macros(spark, sf_dir):
    return sources(spark, sf_dir).select("doc_id", F.array_join(text.zero_argument_macros(F.col("tex")), ",").alias("macros"))


@query(f"select doc_id, 3::int n_definitions, doc_id % 5 = 0 is_macro_file from {_S}")
def macro_files(spark, sf_dir):
    """Every fifth file is named after its macros."""
    stem = F.when(F.col("doc_id") % 5 == 0, "Macros").otherwise(F.col("source"))
    return sources(spark, sf_dir).select("doc_id", text.definitions(F.col("tex")).alias("n_definitions"), text.is_macro_file(stem, F.col("tex")).alias("is_macro_file"))


@query(rf"""
with l as (select doc_id, lang, generate_subscripts(x, 1) - 1 line_no, unnest(x) line from (select doc_id, lang, string_split(tex, chr(10)) x from {_S})),
m as (select doc_id, line_no, line, sum(length(line) + 1) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding) o, line = '\if' || lang opens, line = '\fi' closes from l)
select doc_id, line_no::int line_no, coalesce(o, 0)::bigint as "offset", (sum(opens::int - closes::int) over (partition by doc_id order by line_no) - opens::int)::int depth from m""")
def conditional_depth(spark, sf_dir):
    lines = intervals.text_lines(sources(spark, sf_dir), ["doc_id"], "tex")
    return lines.select("doc_id", "line_no", "offset", "depth")


@query(rf"""
with l as (select doc_id, generate_subscripts(x, 1) - 1 line_no, unnest(x) line from (select doc_id, string_split(tex, chr(10)) x from {_S}))
select doc_id, line_no::int line_no, md5(first_value(case when trim(line, ' ') <> '' then line end ignore nulls) over (partition by doc_id order by line_no rows between 1 following and unbounded following)) next_md5 from l""")
def next_nonblank(spark, sf_dir):
    lines = F.split("tex", "\n", -1)
    told = sources(spark, sf_dir).select("doc_id", F.posexplode(intervals.next_nonblank(lines)).alias("line_no", "next_line"))
    return told.select("doc_id", "line_no", F.md5("next_line").alias("next_md5"))


@query(f"select doc_id::varchar paper_id, p::bigint pos, level, trim(regexp_replace(h, '\\s+', ' ', 'g')) heading from (select doc_id, unnest([1, 2]) p, unnest(['section', 'subsection']) as level, unnest(['On ' || source || ' in ' || lang, 'Numbers  ' || n_chars]) h from {_S})")
def outline(spark, sf_dir):
    files = sources(spark, sf_dir).select(F.col("doc_id").cast("string").alias("paper_id"), F.lit("main.tex").alias("path"), F.col("tex").alias("text"))
    return guides_.outlines(guides_.sources(files)).withColumn("pos", F.col("pos").cast("long"))


@query(rf"""
with p as (select source, trim(unnest(string_split(g, ',')), ' ') package, o from (select source, regexp_extract(l, '\{{([^}}]+)\}}', 1) g, nullif(regexp_extract(l, '\[([^\]]*)\]', 1), '') o
  from (select source, unnest(regexp_extract_all(tex, '(?m)^[ \t]*\\usepackage(?:\[[^\]]*\])?\{{[^}}]+\}}')) l from {_S})))
select source, package, count(*) n, coalesce(string_agg(distinct o, ',' order by o), '') options from p group by source, package""")
def package_loads(spark, sf_dir):
    """How often packages are loaded, and with which options."""
    lines = F.regexp_extract_all("tex", F.lit(r"(?m)^[ \t]*(\\usepackage(?:\[[^\]]*\])?\{[^}]+\})"), F.lit(1))
    loads = sources(spark, sf_dir).select("source", F.explode(lines).alias("line"))
    named = loads.select("source", F.explode(text.package_names(F.regexp_extract("line", r"\{([^}]+)\}", 1))).alias("package"), F.nullif(F.regexp_extract("line", r"\[([^\]]*)\]", 1), F.lit("")).alias("o"))
    return named.groupBy("source", "package").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("o")), ",").alias("options"))


@query("""
with f as (select (doc_id // 10)::varchar p, doc_id, 'main' || doc_id || '.tex' m from documents)
select p paper_id, 'parts/x' || doc_id || '.tex' path from f where doc_id % 3 = 0 union all select p, 'y' || doc_id || '.tex' from f where doc_id % 3 = 1""")
def included_paths(spark, sf_dir):
    """Each document a main file with an appendix that includes one file of two that are there, by one of two forms."""
    n, paper = F.col("doc_id").cast("string"), F.floor(F.col("doc_id") / 10).cast("string").alias("paper_id")
    rows = table(spark, sf_dir, "documents").select("doc_id")
    body = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\\input{y"), n, F.lit("}\\appendix \\include{./parts/x"), n, F.lit("}"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("\\appendix\\input { parts/../y"), n, F.lit(".tex }"))).otherwise(F.concat(F.lit("\\input{y"), n, F.lit("}")))
    file = lambda head, t: rows.select(paper, F.concat(F.lit(head), n, F.lit(".tex")).alias("path"), t.alias("text"))
    return chunking.included_paths(file("main", body).unionByName(file("parts/x", F.lit("x"))).unionByName(file("y", F.lit("y"))))


@query("""
with d as (select doc_id, source, lang, text from documents), c as (select distinct sha256(source || '|' || text) k from d where lang = 'en')
select lang, count(*) filter (k is not null) n_hits, count(*) filter (k is null) n_misses, count(distinct case when k is null then sha256(source || '|' || text) end) n_calls from d left join c on k = sha256(source || '|' || text) group by lang""")
def cache_join(spark, sf_dir):
    """Documents as work items of their source, against a cache that holds the answers to the English ones."""
    items = table(spark, sf_dir, "documents").select("lang", F.sha2(F.concat_ws("|", "source", "text"), 256).alias("key"))
    cache = items.filter("lang = 'en'").select("key", F.lit(True).alias("hit")).distinct()
    rows = items.join(cache, "key", "left")
    return rows.groupBy("lang").agg(F.count("hit").alias("n_hits"), (F.count("*") - F.count("hit")).alias("n_misses"), F.countDistinct(F.when(F.col("hit").isNull(), F.col("key"))).alias("n_calls"))


@query("select doc_id, source, lang from documents where not (doc_id % 2 = 0 and (doc_id % 3 = 0 or doc_id % 5 = 0))")
def without_completed(spark, sf_dir):
    papers = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), "doc_id", "source", "lang")
    n = F.col("doc_id")
    state = papers.select("paper_id", (n % 2 == 0).alias("has_pdf"), F.lit(True).alias("has_record"), (n % 3 == 0).alias("has_translated_pdf"), F.lit(True).alias("has_translated_tex"), (n % 5 != 0).alias("has_source_tex"))
    return docs_.without_completed(papers, state).select("doc_id", "source", "lang")


_ATOM = Template("""<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><title>q</title><entry><id>x</id><title> On
  <<source>> </title><summary>  In <<lang>>  </summary><published>2024-01-02T03:04:05Z</published><updated>2024-02-03T00:00:00Z</updated>
<author><name>A. <<lang>></name></author><author><name>  B  <<source>> </name></author><author><name> </name></author><arxiv:doi>10.1/<<doc_id>></arxiv:doi>
<category term="cs.<<lang>>"/><category term=""/><category term="<<source>>"/><arxiv:primary_category term="cs.<<lang>>"/></entry></feed>""")


def atom(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), _ATOM.column.alias("body"), F.concat(F.lit("@misc{ key"), "doc_id", F.lit(" ,\n title={x}}")).alias("bibtex"))
    return metadata.parse_metadata(rows)


@query("""select doc_id::varchar paper_id, 'On ' || source title, 'A. ' || lang || ';B ' || source authors, 'In ' || lang abstract, '2024-01-02T03:04:05Z' published, 'cs.' || lang || ';' || source categories,
  'cs.' || lang primary_category, '10.1/' || doc_id doi, cast(null as varchar) journal_ref, 'key' || doc_id citation_key, '2024' as year, 'ok' status from documents""")
def metadata_parsed(spark, sf_dir):
    m = atom(spark, sf_dir)
    return m.select("paper_id", "title", F.array_join("authors", ";").alias("authors"), "abstract", "published", F.array_join("categories", ";").alias("categories"), "primary_category", "doi", "journal_ref", "citation_key", "year", "status")


@query("""select doc_id::varchar paper_id, array_to_string(['%0 Electronic Article', '%F key' || doc_id, '%A A. ' || lang, '%A B ' || source, '%T On ' || source, '%D 2024', '%8 2024-01-02', '%J arXiv', '%U https://arxiv.org/abs/' || doc_id,
  '%M arXiv:' || doc_id, '%X In ' || lang, '%R 10.1/' || doc_id, '%9 cs.' || lang, '%K cs.' || lang, '%K ' || source], chr(10)) || chr(10) || chr(10) record from documents""")
def records(spark, sf_dir):
    return metadata.format_record(atom(spark, sf_dir).withColumn("attachments", F.lit(None).cast("array<string>"))).select("paper_id", "record")


_HTTP = "case doc_id % 6 when 0 then 404 when 1 then 500 when 2 then null else 200 end"


@query(rf"""
with r as (select doc_id, {_HTTP} status, case when doc_id % 4 = 0 then 'text/html; charset=utf-8' when doc_id % 4 = 1 then 'application/pdf' end kind,
  case when doc_id % 9 = 0 then '' when doc_id % 9 = 1 then '%PDF-1.5 ' || text when doc_id % 9 = 2 then '<HTML>' || text else text end body from documents)
select doc_id, case when status = 404 then 'unavailable' when status is null or status = 500 then 'failed' when body = '' then 'empty' when starts_with(body, '%PDF') then 'pdf' when kind like 'text/html%' and contains(lower(substr(body, 1, 400)), '<html') then 'html' else 'ok' end source_status,
  case when status is null or status <> 200 then 'unavailable' when body = '' then 'empty' when starts_with(body, '%PDF') or kind = 'application/pdf' then 'ok' else 'other' end pdf_status from r""")
def landed_status(spark, sf_dir):
    n = F.col("doc_id")
    status = F.when(n % 6 == 0, 404).when(n % 6 == 1, 500).when(n % 6 > 2, 200)
    kind = F.when(n % 4 == 0, "text/html; charset=utf-8").when(n % 4 == 1, "application/pdf")
    body = F.when(n % 9 == 0, "").when(n % 9 == 1, F.concat(F.lit("%PDF-1.5 "), "text")).when(n % 9 == 2, F.concat(F.lit("<HTML>"), "text")).otherwise(F.col("text")).cast("binary")
    return table(spark, sf_dir, "documents").select("doc_id", archives.source_status(status, kind, body).alias("source_status"), archives.pdf_status(status, kind, body).alias("pdf_status"))


@query(f"select doc_id::varchar paper_id, case when doc_id % 3 = 0 then 'main.tex' end path, case when doc_id % 3 = 0 then octet_length(encode(tex)) end n_bytes, case when doc_id % 3 = 0 then 'ok' when doc_id % 3 = 1 then 'pdf' else 'no tex' end status from {_S}")
def archives_expanded(spark, sf_dir):
    n = F.col("doc_id")
    content = F.when(n % 3 == 0, F.col("tex")).when(n % 3 == 1, F.concat(F.lit("%PDF"), "tex")).otherwise(F.lit("plain words"))
    rows = sources(spark, sf_dir).select(n.cast("string").alias("paper_id"), content.cast("binary").alias("content"))
    return archives.expand(rows).select("paper_id", "path", F.octet_length("content").cast("long").alias("n_bytes"), "status")


@query(rf"""
with a as (select doc_id, regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', 'e', 'g') t from documents),
p as (select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?s)\$\$.*?\$\$|\$.*?\$|\\\[.*?\\\]|\\\(.*?\\\)', ' ', 'g'),
  '\\(?:cite|citep|citet|citealp|ref|eqref|cref|Cref|autoref|label|url|href|includegraphics|input|include|bibliography)\*?(?:\[[^\]]*\])?(?:\{{[^{{}}]*\}}){{1,2}}', ' ', 'g'), '\\[A-Za-z]+\*?(?:\[[^\]]*\])?', ' ', 'g'), '[{{}}~^_\\]+', ' ', 'g') t from a)
select doc_id, regexp_matches(t, '\b[A-Za-z][A-Za-z''-]{{2,}}(?:[ \t\r\n,;:()-]+[A-Za-z][A-Za-z''-]{{2,}}){{11}}\b')
  or (len(regexp_extract_all(t, '\b[A-Za-z][A-Za-z''-]{{2,}}\b')) >= 16 and length(trim(t, ' ')) >= 120) is_english from p""")
def english_prose(spark, sf_dir):
    """Which documents hold a stretch of prose in ASCII letters; other letters are written as e, so that both engines agree on what a word is."""
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\x7F]", "e")
    return table(spark, sf_dir, "documents").select("doc_id", (text.english_prose(plain, ()) != "").alias("is_english"))


@query("""
with p as (select source, unnest(string_split(lang || ',' || upper(lang) || ',' || source, ',')) x from documents)
select source, array_to_string(list(x order by lower(x), x), ',') names from (select distinct source, x from p) group by source""")
def names_sorted(spark, sf_dir):
    """Distinct names in order without regard to case."""
    named = table(spark, sf_dir, "documents").select("source", F.explode(F.array("lang", F.upper("lang"), "source")).alias("x"))
    rows = named.dropna(subset=["x"]).distinct().groupBy("source").agg(F.collect_list("x").alias("x"))
    return rows.select("source", F.array_join(distinct.sorted_distinct(F.col("x")), ",").alias("names"))


@query(f"""
select doc_id, case doc_id % 6 when 1 then 'braces' when 2 then 'environments,alignment' when 3 then 'commands' when 4 then 'echo' else '' end violations, doc_id % 6 = 5 style_changed from {_S}""")
def outputs_validated(spark, sf_dir):
    r"""Copies of sources with a fault each: a brace, a table's end and cells, an \input, a block's name, or only a lost \emph."""
    n, t = F.col("doc_id"), F.replace(F.replace(F.col("tex"), F.lit("``A''"), F.lit("A")), F.lit(r"\'e"), F.lit("e"))
    rows = sources(spark, sf_dir).select("doc_id", t.alias("source")).withColumn("source", F.replace("source", F.lit(r"\""), F.lit("")))
    s = F.col("source")
    out = (
        F.when(n % 6 == 1, F.concat(s, F.lit("{"))).when(n % 6 == 2, F.replace(s, F.lit(r"a & b\\c & d \end{tabular}"), F.lit(r"a b\\c & d \end{tabbing}")))
        .when(n % 6 == 3, F.replace(s, F.lit(r"\input"), F.lit(""))).when(n % 6 == 4, F.concat(s, F.lit("</TEXT_AFTER>"))).when(n % 6 == 5, F.replace(s, F.lit(r"\emph"), F.lit(""))).otherwise(s)
    )
    told = gate.validated(rows.withColumn("output", out))
    named = F.array_join(F.transform("violations", lambda v: F.when(v == "echoed block name", "echo").otherwise(v)), ",")
    return told.select("doc_id", named.alias("violations"), "style_changed")


@query()
def work_items(spark, sf_dir):
    files = sources(spark, sf_dir).select(F.col("doc_id").cast("string").alias("paper_id"), F.lit("main.tex").alias("path"), F.replace("tex", F.lit("\n"), F.lit("\n\n")).alias("text"))
    items = chunking.work_items(files)
    return items.select("paper_id", "idx", "offset", "length", "route", F.md5("chunk").alias("chunk_md5"), F.md5("ctx_before").alias("before_md5"), F.md5("ctx_after").alias("after_md5"))


@query()
def guides(spark, sf_dir):
    files = tree(spark, sf_dir).select("paper_id", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("/"), "path").alias("path"), "text")
    return guides_.guides(files).select("paper_id", F.length("guide").cast("long").alias("n_chars"), "guide")


@query()
def compatibility(spark, sf_dir):
    """The whole chain of rewrites over all sources."""
    files = sources(spark, sf_dir).select(F.floor(F.col("doc_id") / 10).cast("string").alias("paper_id"), F.concat("source", "doc_id", F.lit(".tex")).alias("path"), F.col("tex").alias("text"))
    return compat.make_compatible(files).select("paper_id", "path", "changed", F.md5("text").alias("text_md5"))


@query()
def translation(spark, sf_dir):
    """Whole papers through cleaning, chunks, the cache, the dictionary translator, the gate and reassembly."""
    files = sources(spark, sf_dir).select(F.col("doc_id").cast("string").alias("paper_id"), F.lit("main.tex").alias("path"), F.replace("tex", F.lit("\n"), F.lit("\n\n")).alias("text"))
    done, _ = plan.translate_papers(files, None, plan.DictionaryTranslator((("the", "此"),)), wait=False)
    return done.select("paper_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))

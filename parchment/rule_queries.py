r"""Queries for single rewrite rules and scanners, and DuckDB SQL that computes the same rewrite from the text.

The tables hold no TeX, so each query writes one of several small sources around a document's columns: some give the rule
a cause, some nearly do, some have what it would have made already. The SQL rewrites that text with its own patterns.
"""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Template, table
from .functions import scan
from .functions import text as text_
from .operators import boundaries, chunking, intervals
from .operators.answers import Answers
from .plans import guide, translate
from .rules import compat, document
from .sources import archives
from .storage import forget, new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


class Cases:
    """Templates, of which a document takes the one of its doc_id modulo their number."""

    def __init__(self, *patterns: str):
        self.templates = [Template(p) for p in patterns]

    @property
    def column(self) -> Column:
        n, out = len(self.templates), self.templates[-1].column
        for k, t in reversed(list(enumerate(self.templates[:-1]))):
            out = F.when(F.col("doc_id") % n == k, t.column).otherwise(out)
        return out

    @property
    def sql(self) -> str:
        return f"case doc_id % {len(self.templates)} " + " ".join(f"when {k} then {t.sql}" for k, t in enumerate(self.templates)) + " end"


def rule(name: str, cases: Cases, apply: Callable[[Column], Column], sql: str) -> None:
    """Registers a query of the rewritten text; sql is an expression over tex."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "documents").select("doc_id", cases.column.alias("tex"))
        return rows.select("doc_id", F.md5(apply(F.col("tex"))).alias("text_md5"), F.length("tex").cast("long").alias("n_before"))

    run.__name__, run.__doc__ = name, f"The rewrite {name} over a source for each document."
    QUERIES[name] = run
    SQL[name] = f"select doc_id, md5({sql}) text_md5, length(tex)::bigint n_before from (select doc_id, {cases.sql} tex from documents)"


_TAIL = r"([ \t]*(?:%[^\n]*)?)"

rule(
    "option_lists_closed_up",
    Cases("\\usepackage[\n  a=<<lang>>,\n\n \t\n  b\n]{<<source>>}\n\n<<text>>", "\\usepackage[a,\n\nb]{<<source>>}\n<<text>>", " \\usepackage [ \n a\n]\n{x}\n\n<<text>>"),
    compat.close_up_option_lists,
    r"regexp_replace(tex, '(\\usepackage\[\n[^\]\n]*)\n(?:[ \t]*\n)+', '\1' || chr(10))",
)
rule(
    "graphics_drivers_dropped",
    Cases(
        "\\usepackage[dvips,draft]{graphicx}\n<<text>>", "\\usepackage[pdftex]{graphicx}\n<<text>>", "\\usepackage[draft]{graphicx}\n<<text>>",
        "\\PassOptionsToPackage{xetex}{graphicx}\n\\RequirePackage[dvips]{graphicx}<<text>>", "\\PassOptionsToPackage{xetex,final}{graphics}\n<<text>>", "\\usepackage[dvips]{<<source>>}\n<<text>>",
    ),
    compat.drop_graphics_drivers,
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(tex, '(?m)^(\\(?:usepackage|RequirePackage))\[(?:dvips|pdftex)\]\{graphicx\}', '\1{graphicx}'), '(?m)^(\\usepackage\[)dvips,([^\]]*\]\{graphicx\})', '\1\2'),"
    r" '(?m)^\\PassOptionsToPackage\{xetex\}\{graphicx\}\n', ''), '(\\PassOptionsToPackage\{)xetex,', '\1')",
)
_BOX = f"{compat.HIGHLIGHT}{compat._HIGHLIGHT_BOX}"
rule(
    "highlights_boxed",
    Cases("\\usepackage{soul}\n\\hl{汉字 <<lang>>} <<text>>", "\\usepackage{soul}\n\\soulhl{汉 <<lang>>}", "\\usepackage{soul}\n\\hl{<<lang>>}", "\\hl{汉}<<text>>", f"\\usepackage{{soul}}\n{compat.HIGHLIGHT}\n\\hl{{汉 <<lang>>}}"),
    compat.box_highlights,
    rf"case when contains(tex, '\usepackage{{soul}}') and regexp_matches(tex, '[\x{{3400}}-\x{{9fff}}]') and not contains(tex, {literal(compat.HIGHLIGHT)}) then replace(tex, '\usepackage{{soul}}' || chr(10), '\usepackage{{soul}}' || chr(10) || replace({literal(_BOX)}, 'COMMAND', regexp_extract(tex, '\\((?:soul)?hl)\{{', 1)) || chr(10)) else tex end",
)
rule(
    "packages_loaded_once",
    Cases(
        "\\documentclass{article}\n\\usepackage[a=<<lang>>]{<<source>>}\n\\usepackage{other}\n\\usepackage[b]{<<source>>}\n\\begin{document}<<text>>",
        "\\documentclass{article}\n\\usepackage[a]{x}\n\\usepackage[b]{y}\n\\begin{document}<<text>>",
        "\\documentclass{article}\n\\usepackage[a]{x}\n\\ifx\n\\usepackage[b]{x}\n\\fi\n\\begin{document}<<text>>",
    ),
    compat.load_packages_once,
    r"case when doc_id % 3 = 0 then '\PassOptionsToPackage{' || array_to_string(regexp_extract_all(tex, '(?m)^\\usepackage\[([^\]]*)\]', 1), ',') || '}{' || regexp_extract(tex, '(?m)^\\usepackage\[[^\]]*\]\{([^}]*)\}', 1) || '}' || chr(10) || regexp_replace(tex, '(\\usepackage\{other\}\n)\\usepackage\[[^\n]*\n', '\1') else tex end",
)
rule(
    "unaligned_as_equations",
    Cases("\\begin{align}x_{<<doc_id>>}\\end{align} <<text>> \\begin{align*}a &= b\\end{align*}", "\\begin{align*}\ny \\& <<lang>>\n\\end{align*}\\begin{align}p\\\\&q\\end{align}", "\\begin{aligned}x\\end{aligned}"),
    compat.unaligned_as_equation,
    r"replace(regexp_replace(replace(replace(tex, '\\', chr(1)), '\&', chr(2)), '\\begin\{align(\*?)\}([^&]*?)\\end\{align\*?\}', '\\begin{equation\1}\2\\end{equation\1}', 'g').replace(chr(2), '\&'), chr(1), '\\')",
)
rule(
    "formulas_closed_up",
    Cases("\\begin{equation}\nx\n\n \t\ny_{<<doc_id>>}\n\\end{equation}\n\n<<text>>", "\\begin{gather*}a\n\nb\\end{gather*}\n\n", "\\begin{center}\n\n<<text>>\\end{center}"),
    compat.close_up_formulas,
    r"regexp_replace(tex, '(\\begin\{(?:equation|gather\*)\}[^\\]*?\n)(?:[ \t]*\n)+', '\1')",
)
rule(
    "preamble_commands_closed",
    Cases("\\title{On <<source>>  \n\n\\author{<<lang>>}\n<<text>>", "\\date{\\emph{<<lang>>\n\\maketitle\n<<text>>", "\\title{On <<source>>\nand more}\n\\author{x}", "\\title{Closed}\n\\author{x}\n<<text>>"),
    compat.close_preamble_commands,
    r"regexp_replace(regexp_replace(tex, '\A(\\title\{[^{}\n]*?)[ \t]*(\n\s*\\author)', '\1}\2'), '\A(\\date\{\\emph\{[^{}\n]*?)[ \t]*(\n\\maketitle)', '\1}}\2')",
)
rule(
    "macro_names_ended",
    Cases("\\newcommand{\\own}{x}\n\\own汉 \\large字 \\textbf汉 \\own{}字 <<text>>", "\\def\\mine{<<lang>>}\n\\mine\\汉 \\mine a\n\\newcommand{\\two}[2]{#1}\n\\two汉", "\\newcommand{\\own}{x \\own汉}\n<<text>>"),
    lambda t: compat.end_macro_names(t, F.array().cast("array<string>")),
    r"case when doc_id % 3 = 2 then tex else regexp_replace(tex, '\\(own|large|mine)\\?([^\x00-\x7F])', '\\\1{}\2', 'g') end",
)
rule(
    "natbib_made_numeric",
    Cases("  \\usepackage{natbib} % <<lang>>\n\\bibliographystyle{plain}<<text>>", "\\usepackage{natbib}\n\\bibliographystyle{plainnat}<<text>>", "\\usepackage[round]{natbib}\n\\bibliographystyle{IEEEtran}"),
    compat.numeric_natbib,
    rf"case when regexp_matches(tex, '\\bibliographystyle\{{(plain|unsrt|abbrv|ieeetr|IEEEtran)\}}') then regexp_replace(tex, '(?m)^([ \t]*)\\usepackage\{{natbib\}}{_TAIL}$', '\1\\usepackage[numbers]{{natbib}}\2') else tex end",
)
rule(
    "fonts_of_ctex_set",
    Cases("\\usepackage{ctex} % <<lang>>\n<<text>>", "\\usepackage[UTF8]{ctex}\n<<text>>", "x \\usepackage{ctex}\n  \\usepackage{ctex}\n"),
    compat.fandol_fonts,
    rf"regexp_replace(tex, '(?m)^([ \t]*)\\usepackage\{{ctex\}}{_TAIL}$', '\1\\usepackage[fontset=fandol]{{ctex}}\2', 'g')",
)
rule(
    "math_fonts_kept",
    Cases("% head\n\\documentclass[a4paper]{article}\n\\usepackage{ctex}<<text>>", "\\usepackage{xeCJK}<<text>>", "\\documentclass{article}\\usepackage{unicode-math,ctex}", "\\documentclass{article}\\usepackage[x,no-math]{fontspec}\\usepackage{ctex}", "\\documentclass{article}<<lang>>"),
    compat.keep_math_fonts,
    rf"case when regexp_matches(tex, 'ctex|xeCJK') and not regexp_matches(tex, 'unicode-math|no-math') then case when contains(tex, '\documentclass') then replace(tex, '\documentclass', '{compat.NO_MATH}' || chr(10) || '\documentclass') else '{compat.NO_MATH}' || chr(10) || tex end else tex end",
)
_WRAP = r"'\1\\ifPDFTeX' || chr(10) || '\1\2' || chr(10) || '\1\\fi'"
rule(
    "pdfoutput_guarded",
    Cases("  \\pdfoutput = 1 \n<<text>>", "\\ifPDFTeX\\pdfoutput=1\\fi\n<<text>>", "x \\pdfoutput=1\n<<text>>", "\\pdfoutput=<<n_chars>>"),
    compat.guard_pdfoutput,
    r"regexp_replace(tex, '(?m)^([ \t]*)\\pdfoutput\s*=\s*([0-9]+)[ \t]*$', '\1\\ifPDFTeX' || chr(10) || '\1\\pdfoutput=\2' || chr(10) || '\1\\fi', 'g')",
)
rule(
    "pdfminorversion_guarded",
    Cases(" \\pdfminorversion = 7 % <<lang>>\n<<text>>", "\\ifPDFTeX\n\\pdfminorversion=5\n\\fi\n<<text>>", "\\pdfminorversion=4 x\n<<text>>"),
    compat.guard_pdfminorversion,
    rf"case when doc_id % 3 = 1 then tex else regexp_replace(tex, '(?m)^([ \t]*)(\\pdfminorversion\s*=\s*[0-9]+[ \t]*(?:%[^\n]*)?)$', '\1\\ifPDFTeX' || chr(10) || '\1\2' || chr(10) || '\1\\fi') end",
)
rule(
    "unicode_declarations_guarded",
    Cases("\\DeclareUnicodeCharacter{00E9}{<<lang>>}\n\t\\DeclareUnicodeCharacter{00E8}{x}\n<<text>>", "\\ifPDFTeX\n\\DeclareUnicodeCharacter{00E9}{x}\n\\fi\n", "x \\DeclareUnicodeCharacter{1}{2}\n<<text>>"),
    compat.guard_unicode_declarations,
    rf"case when doc_id % 3 = 1 then tex else regexp_replace(tex, '(?m)^([ \t]*)(\\DeclareUnicodeCharacter\b[^\n]*)$', {_WRAP}, 'g') end",
)
rule(
    "legacy_encodings_guarded",
    Cases("\\usepackage[utf8]{inputenc} % <<lang>>\n\\RequirePackage{fontenc}\n<<text>>", "  \\AtEndOfClass{\\RequirePackage[T1]{fontenc}}\n", "\\ifPDFTeX\n\\usepackage{inputenc}\n\\fi\n<<text>>", "\\usepackage{xinputenc}"),
    compat.guard_legacy_encodings,
    rf"case when doc_id % 4 = 2 then tex else regexp_replace(tex, '(?m)^([ \t]*)((?:\\AtEndOfClass\{{)?\\(?:usepackage|RequirePackage)(?:\[[^\]\n]*\])?\{{(?:inputenc|fontenc)\}}[^\n]*)$', {_WRAP}, 'g') end",
)
rule(
    "microtype_guarded",
    Cases("\\usepackage[final]{microtype}\n\\DisableLigatures{<<lang>>}\n<<text>>", " \\usepackage{microtype} % x\n<<text>>", "\\DisableLigatures{}\n<<text>>", f"\\ifPDFTeX\n\\usepackage{{microtype}}\n\\fi\n{compat.NO_LIGATURES}\n\\DisableLigatures{{}}"),
    compat.guard_microtype,
    rf"case when doc_id % 4 = 3 then tex when contains(tex, '{{microtype}}') then replace(regexp_replace(tex, '(?m)^([ \t]*)(\\usepackage(?:\[[^\]\n]*\])?\{{microtype\}}[^\n]*)$', {_WRAP}), '\DisableLigatures', {literal(compat.NO_LIGATURES)} || chr(10) || '\DisableLigatures') else tex end",
)
_CJK = "\n".join(compat._CJK_SHIM)
rule(
    "cjk_environments_kept",
    Cases("\\documentclass{a}\n\\usepackage{CJKutf8} % <<lang>>\n\\begin{CJK}{UTF8}{gbsn}<<text>>\\end{CJK}", "\\documentclass[x]{a}\n\\begin{CJK}{UTF8}{gbsn}<<text>>\\end{CJK}", "\\documentclass{a}<<text>>", "\\documentclass{a}\\newenvironment{CJK}{}{}\\begin{CJK}"),
    compat.keep_cjk_environments,
    rf"case doc_id % 4 when 0 then regexp_replace(tex, '(?m)^\\usepackage\{{CJKutf8\}}{_TAIL}$', chr(1) || '\1').replace(chr(1), {literal(_CJK)}) when 1 then regexp_replace(tex, '(\\documentclass(?:\[[^\]]*\])?\{{[^}}]+\}})', '\1' || chr(10) || chr(1)).replace(chr(1), {literal(_CJK)} || chr(10)) else tex end",
)
_MINTED = "\n".join(compat._MINTED)
rule(
    "minted_without_shell",
    Cases("\\usepackage[x]{minted} % <<lang>>\n\\begin{minted}{py}\n<<lang>>\n\\end{minted}<<text>>", "\\usepackage{minted}\n\\begin{minted}{py}\\end{minted}\\mintinline{py}{x}", "\\usepackage{minted}\n<<text>>"),
    compat.plain_minted,
    rf"case when contains(tex, '\begin{{minted}}') and not contains(tex, '\mintinline') then regexp_replace(tex, '(?m)^\\usepackage(?:\[[^\]]*\])?\{{minted\}}{_TAIL}$', chr(1) || '\1').replace(chr(1), {literal(_MINTED)}) else tex end",
)
rule(
    "double_strokes",
    Cases("\\usepackage{bbm} % <<lang>>\n$\\mathbbm{1}$<<text>>\\mathbbm 2", "$\\mathbbm{1}$ <<text>>", "\\usepackage[x]{bbm}\n\\mathbbmss"),
    compat.double_stroke,
    rf"case when regexp_matches(tex, '\\usepackage(\[x\])?\{{bbm\}}') then replace(regexp_replace(tex, '(?m)^\\usepackage(?:\[[^\]]*\])?\{{bbm\}}{_TAIL}$', '\\usepackage{{dsfont}}\1'), '\mathbbm', '\mathds') else tex end",
)
rule(
    "iftex_loaded_first",
    Cases("<<lang>>\\ifPDFTeX x\\fi\n\\usepackage{iftex}<<text>>", "\\usepackage{iftex}\\ifPDFTeX\\fi<<text>>", "\\RequirePackage{iftex}<<text>>\\ifPDFTeX\\fi", "<<text>>"),
    compat.load_iftex_first,
    r"case when strpos(tex, '\ifPDFTeX') > 0 and not regexp_matches(substr(tex, 1, strpos(tex, '\ifPDFTeX') - 1), '\\(usepackage|RequirePackage)\{iftex\}') then substr(tex, 1, strpos(tex, '\ifPDFTeX') - 1) || '\RequirePackage{iftex}' || chr(10) || substr(tex, strpos(tex, '\ifPDFTeX')) else tex end",
)
rule(
    "dates_fixed",
    Cases("\\date{\\today{} <<lang>>}\n\\begin{document}<<text>>", "<<text>>\\begin{document}x\\begin{document}", "\\date [x] {y}\\date{z}\\begin{document}", "no document"),
    document.fix_date_udf,
    r"case when contains(tex, '\date') then regexp_replace(tex, '\\date\b(?:\s*\[[^\]]*\])?\s*\{(?:[^{}]|\{[^{}]*\})*\}', '\\date{不可用}', 'g') else regexp_replace(tex, '(\\begin\{document\})', '\\date{不可用}' || chr(10) || '\1') end",
)
rule(
    "citations_merged",
    Cases("a \\citep{k<<doc_id>>}, \\citet[p. 1]{b, c} and d <<text>>", "\\cite{a} 和 \\cite{ <<lang>> }.", "\\cite{a} but \\cite{b} <<text>>", "\\citet*{a}\\citep{b}"),
    document.merge_citations_udf,
    r"regexp_replace(tex, '\\cite[pt]?\*?(?:\[[^\]]*\])?\{\s*([^{}]*?)\s*\}\s*(?:[,;]\s*)?(?:and|和)?\s*\\cite[pt]?\*?(?:\[[^\]]*\])?\{\s*([^{}]*?)\s*\}', '\\cite{\1,\2}', 'g')",
)
rule(
    "citations_superscript",
    Cases("\\begin{document}<<text>>\\begin{document}", "\\\\begin{document}<<text>>", f"{document.SUPERSCRIPT}\n\\begin{{document}}<<lang>>"),
    document.superscript_citations,
    rf"case when doc_id % 3 = 0 then {literal(document._SUPERSCRIPT)} || tex else tex end",
)
rule(
    "styles_made_numeric",
    Cases(document.NUMERIC[0][0] + "<<text>>", "\\citestyle{authoryear}\n<<lang>>\\citestyle{authoryear}", "\\citestyle{nature}<<text>>"),
    document.numeric_styles,
    r"replace(replace(tex, '\setcitestyle{authoryear,round,citesep={;},aysep={,},yysep={;}}', '\setcitestyle{numbers,sort&compress}'), '\citestyle{authoryear}', '\citestyle{numeric}')",
)
rule(
    "captions_closed_up",
    Cases("\\caption{one {<<lang>>} \n \n\n two}\n\n<<text>>", "\\caption[s\n\nt]{one\n\ntwo}", "\\begin{verbatim}\\caption{a\n\nb}\\end{verbatim}<<text>>", "\\captionof{x}{a\n\nb}"),
    document.close_up_captions_udf,
    r"regexp_replace(tex, '\A(\\caption(?:\[[^\]]*\])?\{(?:[^{}]|\{[^{}]*\})*?)(?:[ \t]*\n){2,}[ \t]*', '\1 ')",
)
rule(
    "line_spacing_accepted",
    Cases("\\documentclass[sigconf]{acmart}\n\\usepackage{CTEX}\n\\begin{document}<<text>>", "\\documentclass{acmart}\n\\begin{document}<<lang>>", "\\documentclass{article}\\usepackage{ctex}\\begin{document}"),
    document.accept_line_spacing,
    rf"case when regexp_matches(tex, '\\documentclass(\[[^\]]*\])?\{{acmart\}}') and contains(lower(tex), 'ctex') then regexp_replace(tex, '(\\begin\{{document\}})', chr(1) || '\1').replace(chr(1), {literal(document.BASELINE)} || chr(10) || '\makeatletter' || chr(10) || '\let\ACM@origbaselinestretch\baselinestretch' || chr(10) || '\makeatother' || chr(10)) else tex end",
)

_CODED = Cases(
    "a % <<lang>>\nb 5\\% % c\n\\begin{verbatim}\n50% kept \\'e\n\\end{verbatim}\nd \\'e \\\"{o} % e\n  % only\n<<lang>>", "\\begin{lstlisting}\n% code \\~n <<doc_id>>\n\\end{lstlisting} % gone\nx \\c{c} \\`a",
    "<<lang>>\\\\% gone\n\\usepackage[a, % b\n\n c]{x}\n\nend \\^{ i } \\H o",
)
_PLAIN_COMMENTS = r"regexp_replace(regexp_replace({}, '(?m)((?:^|[^\\])(?:\\\\)*)%[^\n]*', '\1' || chr(1), 'g'), '[ \t]*' || chr(1), '', 'g')"
_PLAIN_ACCENTS = r"""regexp_replace(regexp_replace({}, '\\(?:["''`^~=.]|[cH])\{{([A-Za-z])\}}', '\1', 'g'), '\\(?:["''`^~=.]\s*|[cH]\s+)([A-Za-z])', '\1', 'g')"""
_AROUND = "(\\\\begin\\{(?:verbatim|lstlisting)\\}.*?\\\\end\\{(?:verbatim|lstlisting)\\}[^\\n]*)"


def _outside(expression: str) -> str:
    """expression over what stands before and behind the lines of the one code environment, or over the whole text."""
    part = lambda k: expression.format(f"regexp_extract(tex, '(?s)\\A(.*?){_AROUND}(.*)\\z', {k})")
    return f"case when regexp_matches(tex, '(?s){_AROUND}') then {part(1)} || regexp_extract(tex, '(?s){_AROUND}', 1) || {part(3)} else {expression.format('tex')} end"


rule("comments_outside_code", _CODED, scan.strip_comments_udf, "replace(" + _outside(_PLAIN_COMMENTS) + r", '[a,' || chr(10) || chr(10), '[a,' || chr(10))")
rule("accents_outside_code", _CODED, scan.drop_accents_udf, _outside(_PLAIN_ACCENTS))


def register(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], SQL[name] = run, sql


_KEPT = Cases("x \\fbox{a{<<lang>>}} y \\gls{k<<doc_id>>} <<text>>", "\\parbox[t]{1}{b}\\Gls{<<lang>>} z", "<<text>> \\fboxes{a} \\term {t}", "\\begin{verbatim}\\fbox{<<lang>>}\\end{verbatim}\\colorbox{red}{b}!")


def kept_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders for boxes, glossary keys and code, what they stand for, and the way back."""
    rows = table(spark, sf_dir, "documents").select("doc_id", _KEPT.column.alias("tex")).withColumn("p", scan.protect_udf(F.col("tex")))
    back = scan.restore_udf(F.col("p.text"), F.col("p.blocks"))
    return rows.select("doc_id", F.md5("p.text").alias("text_md5"), F.array_join("p.blocks", "|").alias("blocks"), F.md5(back).alias("back_md5"))


_PLACE = scan.PLACEHOLDER
register(
    "kept_stretches",
    kept_stretches,
    rf"""
with t as (select doc_id, {_KEPT.sql} tex from documents),
b as (select doc_id, tex, regexp_extract_all(tex, '(?s)\\begin\{{verbatim\}}.*?\\end\{{verbatim\}}(?:\\colorbox\{{[^{{}}]*\}}\{{[^{{}}]*\}})?|\\fbox\{{(?:[^{{}}]|\{{[^{{}}]*\}})*\}}|\\parbox\[t\]\{{[^{{}}]*\}}\{{[^{{}}]*\}}\\Gls\{{[^{{}}]*\}}|\\(?:gls|term) ?\{{[^{{}}]*\}}') b from t)
select doc_id, md5(case len(b) when 1 then replace(tex, b[1], '{_PLACE}{{0}}') when 2 then replace(replace(tex, b[1], '{_PLACE}{{0}}'), b[2], '{_PLACE}{{1}}') else tex end) text_md5, array_to_string(b, '|') blocks, md5(tex) back_md5 from b""",
)

_PACKED = Cases("{<<lang>>\n\n<<text>>}\n\n<<text>>\n \n<<source>>\n\n<<text>>", "<<text>>\n\n<<text>>\n\n{<<text>>\n\n}\n\nend", "<<lang>>\n\n<<text>>")


def _plain(column: str) -> Column:
    return F.translate(column, "\\%$[]{}", "")


def safe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs packed into chunks that end outside all groups. Texts lose their own marks first, so that only the template's braces count."""
    rows = table(spark, sf_dir, "documents").withColumn("text", _plain("text")).select("doc_id", _PACKED.column.alias("tex"))
    chunks = rows.withColumn("c", scan.chunks_udf(F.col("tex"), F.lit(700)))
    return chunks.select("doc_id", F.size("c").cast("long").alias("n_chunks"), F.array_join(F.transform("c", lambda x: F.length(x).cast("string")), ",").alias("lengths"), F.md5(F.array_join("c", "")).alias("text_md5"))


#: SQL that packs the column tex into the list c of chunks of about 700 characters, ends of chunks outside all braces.
_PACK = r"""
p as (select *, string_split_regex(tex, '\n\s*\n') a, regexp_extract_all(tex, '\n\s*\n') s from t),
q as (select *, flatten(list_transform(range(1, len(a) + 1), lambda i: case when i <= len(s) then [a[i], s[i]] else [a[i]] end)) parts from p),
r as (select *, list_reduce(list_transform(parts, lambda x: {'c': []::varchar[], 'cur': x, 'b': length(x) - length(replace(x, '{', '')) - length(x) + length(replace(x, '}', ''))}), lambda f, x:
  case when f.cur <> '' and length(f.cur) + length(x.cur) > 700 and f.b = 0 then {'c': list_append(f.c, f.cur), 'cur': x.cur, 'b': x.b}
    when f.cur <> '' and length(f.cur) + length(x.cur) >= 700 and f.b + x.b = 0 then {'c': list_append(f.c, f.cur || x.cur), 'cur': '', 'b': 0::bigint}
    else {'c': f.c, 'cur': f.cur || x.cur, 'b': f.b + x.b} end) r from q),
k as (select *, case when length(tex) <= 700 then [tex] when r.cur = '' then r.c else list_append(r.c, r.cur) end c from r)"""
register(
    "safe_chunks",
    safe_chunks,
    rf"""
with t as (select doc_id, {_PACKED.sql} tex from (select * replace (translate(text, '\%$[]{{}}', '') as text) from documents)),{_PACK}
select doc_id, len(c)::bigint n_chunks, array_to_string(list_transform(c, lambda x: length(x)::varchar), ',') lengths, md5(array_to_string(c, '')) text_md5 from k""",
)


def safe_chunks_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same chunks by summaries of paragraphs, combined in blocks of three."""
    rows = table(spark, sf_dir, "documents").withColumn("text", _plain("text")).select("doc_id", _PACKED.column.alias("tex"))
    found = boundaries.safe_chunks(rows, ["doc_id"], 700, "tex", block=3)
    lengths = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "offset", "length"))).alias("c"))
    cut = rows.join(lengths, "doc_id").withColumn("x", F.transform("c", lambda c: F.substring(F.col("tex"), (c["offset"] + 1).cast("int"), c["length"].cast("int"))))
    return cut.select("doc_id", F.size("c").cast("long").alias("n_chunks"), F.array_join(F.transform("c", lambda c: c["length"].cast("string")), ",").alias("lengths"), F.md5(F.array_join("x", "")).alias("text_md5"))


register("safe_chunks_scanned", safe_chunks_scanned, SQL["safe_chunks"])


def expression(name: str, cases: Cases, apply: Callable[[Column], Column], sql: str, column: str) -> None:
    """Registers a query of one value for each document; sql is an expression over tex."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "documents").select("doc_id", cases.column.alias("tex")).select("doc_id", apply(F.col("tex")).alias(column))

    run.__name__, run.__doc__ = name, f"{column} of a source for each document."
    register(name, run, f'select doc_id, {sql} "{column}" from (select doc_id, {cases.sql} tex from documents)')


expression(
    "formula_commands",
    Cases("$\\alpha_{<<lang>>}$ \\no \\[\\beta\\] \\(\\delta\\)", "$$\\zeta<<n_chars>>$$ \\$\\no\\$ $x$", "\\begin{center}\\no\\end{center}\\begin{cases}\\eta_<<doc_id>>\\end{cases}"),
    lambda t: F.array_join(scan.math_commands_udf(t), ","),
    r"array_to_string(regexp_extract_all(array_to_string(regexp_extract_all(replace(tex, '\$', ''), '\$\$[^$]*\$\$|\$[^$]*\$|\\\[.*?\\\]|\\\(.*?\\\)|\\begin\{cases\}.*?\\end\{cases\}'), ' '), '\\([A-Za-z@]+)', 1), ',')",
    "commands",
)
expression(
    "definitions_listed",
    Cases("\\newcommand{\\own<<lang>>}[1]{#1  {x}}\n\\def\\mine#1{y}\\let\\b\\a\n", "\\renewcommand*\\two{<<lang>>\n z}\\newcommand{\\a@b}{x}", "\\DeclareMathOperator{\\op}{<<source>>} \\newcommands{\\x}{y}"),
    lambda t: F.array_join(F.transform(scan.macro_definitions_udf(t), lambda m: F.concat(m["name"], F.lit("="), m["definition"])), "|"),
    r"case doc_id % 3 when 0 then array_to_string([regexp_extract(tex, '\{\\(own[A-Za-z]*)\}', 1) || '=' || regexp_replace(regexp_extract(tex, '\A[^\n]*'), '\s+', ' ', 'g'), 'mine=' || regexp_extract(tex, '\\def[^}]*\}'), 'b=' || regexp_extract(tex, '\\let[^\n]*')], '|')"
    r" when 1 then 'two=' || regexp_replace(regexp_extract(tex, '(?s)\\renew[^}]*\}'), '\s+', ' ', 'g') else 'op=' || regexp_replace(regexp_extract(tex, '\\Declare\S*\}\{[^}]*\}'), '\s+', ' ', 'g') end",
    "definitions",
)
expression(
    "titles_found",
    Cases("\\title[s]{On {<<source>>}\n  x} \\papertitle{no}", "\\icmltitle{<<lang>>  <<doc_id>>}", "\\subtitle{<<source>>}"),
    lambda t: F.coalesce(scan.first_title_udf(t), F.lit("none")),
    r"coalesce(nullif(trim(regexp_replace(regexp_extract(tex, '\\(?:title|icmltitle|papertitle|acltitle)(?:\[[^\]]*\])?\s*\{((?:[^{}]|\{[^{}]*\})*)\}', 1), '\s+', ' ', 'g'), ' '), ''), 'none')",
    "title",
)
expression(
    "boundaries_safe",
    Cases("{<<lang>>}$x$\\begin{a}\\end{a}", "{<<lang>>", "$<<n_chars>> \\$", "\\begin{a}{}\\begin{b}\\end{b}", "\\[ <<doc_id>> \\] [a] \\{", "} {"),
    scan.is_boundary_udf,
    r"length(replace(tex, '\{', '')) - length(replace(replace(tex, '\{', ''), '{', '')) = length(tex) - length(replace(tex, '}', '')) and not starts_with(tex, '}') and len(regexp_extract_all(tex, '\\begin')) = len(regexp_extract_all(tex, '\\end')) and len(regexp_extract_all(replace(tex, '\$', ''), '\$')) % 2 = 0",
    "safe",
)
rule(
    "identifiers_mended",
    Cases("\\cite{a\\_b\\_<<lang>>} \\emph{x\\_y} \\label{f\\_1}<<text>>", "\\ref*{a\\_<<doc_id>>} \\_", "\\citep[p\\_1]{a\\_b}<<lang>>"),
    lambda t: text_.identifiers_unescaped(t),
    r"replace(replace(replace(tex, 'a\_', 'a_'), 'b\_', 'b_'), 'f\_1}', 'f_1}').replace('p\_1', case when doc_id % 3 = 2 then 'p_1' else 'p\_1' end)",
)
rule(
    "commands_spaced",
    Cases("\\own汉字 \\own{}汉 \\\\own字 <<text>>", "\\textbf<<lang>>字 \\a汉\\b字"),
    lambda t: text_.spaced_commands(t),
    r"regexp_replace(replace(tex, '\\', chr(1)), '\\([A-Za-z@]+)([\x{3400}-\x{9fff}])', '\\\1 \2', 'g').replace(chr(1), '\\')",
)
expression(
    "protocol_checked",
    Cases("\n ```<<lang>>", "<<text>></TEXT_AFTER >", "\\begin{GUIDE_OF_PAPER}<<lang>>", "a ` <<lang>>", "<<lang>> fine", "\\'e"),
    lambda t: F.coalesce(text_.protocol_violation(t), F.lit("none")),
    r"case when regexp_matches(tex, '\A\s*```') then 'markdown fence' when regexp_matches(tex, '</?(TEXT_TO_TRANSLATE|TEXT_BEFORE|TEXT_AFTER|GUIDE_OF_PAPER)\s*>|\\(begin|end)\{(TEXT_TO_TRANSLATE|TEXT_BEFORE|TEXT_AFTER|GUIDE_OF_PAPER)\}') then 'echoed block name' when contains(tex, '`') or contains(tex, '\''') then 'TeX quotation mark' else 'none' end",
    "violation",
)
expression(
    "appendix_paths",
    Cases("Appendix<<lang>>/x.tex", "parts/<<source>>.tex", "a/my-APPENDICES.tex", "append/<<lang>>.tex"),
    lambda t: text_.is_appendix_path(F.split(t, "/")),
    r"regexp_matches(lower(tex), 'appendix|appendices')",
    "is_appendix",
)


def positions_in_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the length of a text lies in a span of its language's: of lengths 100 k to 100 k + 30 for some k."""
    spans = F.array(*(F.struct(F.lit(100 * k).alias("start"), F.lit(100 * k + 30).alias("end")) for k in range(20)))
    return table(spark, sf_dir, "documents").select("doc_id", intervals.in_spans(F.col("n_chars"), spans).alias("inside"))


register("positions_in_spans", positions_in_spans, "select doc_id, n_chars < 2000 and n_chars % 100 < 30 inside from documents")


def _archives() -> list[tuple[bytes, str, list[tuple[str, int]]]]:
    """One archive of each kind, its status and its members' names and sizes; the sizes are those of the texts below."""
    main, part = b"\\documentclass{article}\\begin{document}x\\end{document}", b"a part"

    def tar(mode: str, *names: str) -> bytes:
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode=mode) as archive:
            for name in names:
                data = main if name.endswith(".tex") else part
                info = tarfile.TarInfo(name)
                info.size = len(data)
                archive.addfile(info, io.BytesIO(data))
        return out.getvalue()

    zipped = io.BytesIO()
    with zipfile.ZipFile(zipped, "w") as archive:
        archive.writestr("src/paper.tex", main)
        archive.writestr("src/fig.eps", part)
    packed = gzip.compress(main, mtime=0)
    return [
        (tar("w:gz", "paper.tex", "figs/a.eps"), "ok", [("paper.tex", len(main)), ("figs/a.eps", len(part))]), (tar("w", "./main.tex"), "ok", [("main.tex", len(main))]),
        (zipped.getvalue(), "ok", [("src/paper.tex", len(main)), ("src/fig.eps", len(part))]), (packed, "ok", [("main.tex", len(main))]), (packed[:-12], "damaged", []),
        (tar("w:bz2", "../out.tex"), "unsafe", []), (tar("w", "only.eps"), "no tex", []), (b"", "no tex", []),
    ]


def archive_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document an archive of one of the kinds there are, damaged and unsafe ones among them."""
    kinds = _archives()
    content = F.lit(None).cast("binary")
    for k, (data, _, _) in enumerate(kinds):
        content = F.when(F.col("doc_id") % len(kinds) == k, F.lit(data)).otherwise(content)
    rows = archives.expand(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), content.alias("content")))
    return rows.select("paper_id", "path", F.octet_length("content").cast("long").alias("n_bytes"), "status")


_MEMBERS = ", ".join(
    f"({k}, {literal(name) if name else 'null'}, {size}, {literal(status)})" for k, (_, status, of) in enumerate(_archives()) for name, size in of or [(None, "null::bigint")]
)
register("archive_kinds", archive_kinds, f"select doc_id::varchar paper_id, path, n_bytes::bigint n_bytes, status from documents join (values {_MEMBERS}) v(k, path, n_bytes, status) on k = doc_id % {len(_archives())}")


def _prose(column: str) -> Column:
    """Letters, blanks and full stops only, so that cleaning changes nothing."""
    return F.regexp_replace(column, r"[^A-Za-z .\n]", "")


def translation_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English papers through the whole translation, then all of them with the same cache: texts, and how many cached answers were asked for twice."""
    papers = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), "lang", F.lit("main.tex").alias("path"), _prose("text").alias("text")).dropna()
    cache, translator = new_path(spark, "answers"), translate.DictionaryTranslator((("the", "此"),))
    first = new_path(spark, "papers")
    translate.translate_papers(papers.filter("lang = 'en'").select("paper_id", "path", "text"), None, translator, cache, wait=False, scratch=first)
    forget(spark, first)
    known = Answers(spark, cache).all().select("key")
    done, _ = translate.translate_papers(papers.select("paper_id", "path", "text"), None, translator, cache, wait=False)
    again = Answers(spark, cache).puts().groupBy("key").agg(F.count("*").alias("n")).join(known, "key").agg(F.sum("n") - F.count("*")).first()[0]  # one number
    return done.select("paper_id", F.md5("text").alias("text_md5"), F.lit(again).cast("long").alias("n_asked_again"))


register(
    "translation_resumed",
    translation_resumed,
    r"""
with p as (select doc_id::varchar paper_id, regexp_replace(text, '[^A-Za-z .\n]', '', 'g') t from documents where text is not null and lang is not null)
select paper_id, md5(case when length(regexp_replace(t, '[^A-Za-z]', '', 'g')) < 20 then t else regexp_replace(t, '\b[Tt][Hh][Ee]\b', '此', 'g') end) text_md5, 0::bigint n_asked_again from p""",
)


def titles_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible and PDF titles of an original carried over to its translation, and a date that stands still."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", _TRANSLATED.column.alias("tex"), _ORIGINAL.column.alias("original"))
    done = document.fix_date_udf(document.carry_titles_udf(F.col("tex"), F.col("original"), F.col("source"), F.col("doc_id").cast("string")))
    return rows.select("doc_id", F.md5(done).alias("text_md5"), document.pdf_title_udf(done).alias("pdf_title"))


_TRANSLATED = Cases("\\title{译 <<lang>>}\n\\begin{document}\\maketitle\n<<text>>", "\\usepackage{hyperref} % x\n\\begin{document}<<text>>", "\\hypersetup{pdftitle = {Old {<<lang>>}}}\n\\begin{document}\n<<text>>")
_ORIGINAL = Cases("\\title{On {<<source>>}}", "\\title{}\\hypersetup{pdftitle={Given <<doc_id>>}}", "\\title[s]{In <<lang>>}")
register(
    "titles_carried",
    titles_carried,
    rf"""
with t as (select doc_id, {_TRANSLATED.sql} tex, {_ORIGINAL.sql} original, source from documents),
a as (select *, regexp_replace(regexp_replace(coalesce(nullif(regexp_extract(original, 'pdftitle=\{{[^{{}}]*\}}'), ''), 'pdftitle={{' || regexp_replace(source, '([&%#_{{}}])', '\\\1', 'g') || '}}'), '\}}$', ''), '$', ' [arXiv:' || doc_id || ']}}') a,
  coalesce(nullif(regexp_extract(original, '\\title(?:\[s\])?\{{(?:[^{{}}]|\{{[^{{}}]*\}})+\}}'), ''), '') c from t),
b as (select *, case doc_id % 3 when 0 then replace(tex, '\begin{{document}}', '\usepackage{{hyperref}}' || chr(10) || '\hypersetup{{' || a || '}}' || chr(10) || '\begin{{document}}')
  when 1 then replace(tex, '% x' || chr(10), '% x' || chr(10) || '\hypersetup{{' || a || '}}' || chr(10) || chr(10)) else replace(tex, regexp_extract(tex, 'pdftitle = \{{(?:[^{{}}]|\{{[^{{}}]*\}})*\}}'), a) end p from a),
d as (select *, case when contains(p, '\maketitle') then '\maketitle' else '\begin{{document}}' end mark from b),
e as (select *, replace(replace(p, mark || chr(10), mark), mark, mark || chr(10) || '{document.PDF_TITLE}' || chr(10) || '\hypersetup{{' || a || '}}' || chr(10)) q from d),
f as (select *, case when doc_id % 3 = 0 then regexp_replace(q, '\\title\{{[^{{}}]*\}}', chr(1)).replace(chr(1), c) when c <> '' then replace(q, '\begin{{document}}', c || chr(10) || '\begin{{document}}') else q end r from e)
select doc_id, md5(replace(r, '\begin{{document}}', '\date{{不可用}}' || chr(10) || '\begin{{document}}')) text_md5, a pdf_title from f""",
)


_FILES = Cases("<<text>>\n\n{<<text>>\n\n<<source>>}\n\n\\appendix\n\n<<text>>", "<<lang>>\n\n<<text>>\n\n<<text>>", "\\appendix\n\n<<lang>>")


def prose_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work items of files of prose: chunks that end outside groups, with offsets, contexts of 40 characters, and routes. Texts lose their own marks first."""
    rows = table(spark, sf_dir, "documents").withColumn("text", _plain("text"))
    files = rows.select(F.col("doc_id").cast("string").alias("paper_id"), F.when(F.col("doc_id") % 5 == 0, "appendix/a.tex").otherwise("main.tex").alias("path"), _FILES.column.alias("text"))
    items = chunking.work_items(files, 700, 40)
    return items.select("paper_id", F.col("idx").cast("long").alias("idx"), "offset", "length", "route", F.md5("chunk").alias("chunk_md5"), F.md5("ctx_before").alias("before_md5"), F.md5("ctx_after").alias("after_md5"))


register(
    "prose_items",
    prose_items,
    rf"""
with t as (select doc_id, {_FILES.sql} tex from (select * replace (translate(text, '\%$[]{{}}', '') as text) from documents)),{_PACK},
i as (select doc_id, tex, unnest(range(1, len(c) + 1)) n, c from k),
o as (select doc_id, tex, n, c[n] chunk, coalesce(list_sum(list_transform(c[1:n - 1], lambda x: length(x))), 0)::bigint o, strpos(tex, '\appendix') app from i)
select doc_id::varchar paper_id, n - 1 idx, o as "offset", length(chunk)::bigint length, case when doc_id % 5 = 0 or app > 0 and o + length(chunk) > app - 1 then 'appendix' else 'main' end route,
  md5(chunk) chunk_md5, md5(substr(tex, greatest(o - 40, 0) + 1, o - greatest(o - 40, 0))) before_md5, md5(substr(tex, o + length(chunk) + 1, 40)) after_md5 from o""",
)

_GUIDED = Cases(
    "\\documentclass{article}\n\\usepackage{b,a}\n\\newcommand{\\own<<lang>>}{x}\n\\title{On <<source>>}\n\\begin{document}\n\\section{In <<lang>>}\\label{s}\n\\begin{table}x\\end{table}\n\\subsection*{Of `<<n_chars>>`}\n\\end{document}",
    "words <<lang>> % \\section{no}\n",
)


def guide_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guides of papers of one file, from sources with a title, sections, a table and a macro, or with nothing."""
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), F.lit("main.tex").alias("path"), _GUIDED.column.alias("text"))
    return guide.guides(files).select("paper_id", "guide")


def _guide_sql() -> str:
    some = lambda then, other: f"case when doc_id % 2 = 0 then {then} else {literal(other)} end"
    found = lambda p: f"regexp_extract(tex, '{p}', 1)"
    pairs, terms = guide.PREFERRED_TRANSLATIONS, guide.PRESERVED_TERMS
    parts = [
        literal("# Paper Translation Guide\n\nMade from the paper's sources and metadata; it states nothing that these do not.\n\n## Structure\n"),
        some("'- `section`: `' || " + found(r"\\section\{([^}]*)\}") + " || '`' || chr(10) || '- `subsection`: `' || replace(" + found(r"\\subsection\*\{([^}]*)\}") + ", '`', '\\`') || '`'", "- No explicit section commands were detected."),
        literal("\n\n## Glossary\n| English term | Chinese translation | Notes |\n| --- | --- | --- |\n" + "".join(f"| {a} | {b} | fixed, the same throughout |\n" for a, b in pairs) + "| any other term | by its context | English where in doubt |\n"),
        literal("\n## Proper Nouns And Keep-English Items\n"),
        some("'- Original title: `' || " + found(r"\\title\{([^}]*)\}") + " || '`' || chr(10)", ""),
        some("'- Document class(es): `' || " + found(r"\\documentclass\{([^}]*)\}") + " || '`' || chr(10) || '- Packages detected: `' || array_to_string(list_sort(string_split(" + found(r"\\usepackage\{([^}]*)\}") + r", ',')), '`, `') || '`' || chr(10) || '- Environment names detected: `' || array_to_string(list_sort(regexp_extract_all(tex, '\\begin\{([^}]*)\}', 1)), '`, `') || '`'",
             "- Document class(es): None detected.\n- Packages detected: None detected.\n- Environment names detected: None detected."),
        literal("\n- Source files:\n- `main.tex`\n\n## Style Rules\n- Concise, formal Simplified Chinese; the same words for the same terms throughout.\n- Notation and claims stay as they are.\n\n## LaTeX Cautions\n" + "\n".join(guide._CAUTIONS)),
        some(literal("\n" + guide._MORE[0][1]) + r" || chr(10) || '- There are cross-references (' || len(regexp_extract_all(tex, '\\label')) || ' labels): never translate identifiers.' || " + literal("\n\n## Predefined LaTeX Commands\nKeep every use of these with its arguments; a command without arguments right before Chinese text gets an empty group (`{}`).\n- `") + " || " + found(r"(\\newcommand[^\n]*)") + " || '`'", ""),
        literal("\n\n## Preferred Fixed Translations\n| English term | Preferred Chinese translation |\n| --- | --- |\n" + "".join(f"| {a} | {b} |\n" for a, b in pairs) + "\n## Forced Keep-English Terms\n" + "".join(f"- `{t}`\n" for t in terms)),
    ]
    return f"select doc_id::varchar paper_id, {' || '.join(parts)} guide from (select doc_id, {_GUIDED.sql} tex from documents)"


register("guide_texts", guide_texts, _guide_sql())

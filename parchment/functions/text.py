r"""Column functions over TeX text, of built-in expressions only.

Java's regular expressions recurse on alternations under a star, so patterns here use possessive quantifiers, bounded
repeats or lazy dots, and hold for lines of any length. `(?d)` makes only \n end a line.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import BOXES, CJK, DEFINERS, IDENTIFIER_COMMANDS, MACRO_STEMS, PRESERVED_TERMS, REQUEST_BLOCKS, TEXT_STYLE, VERBATIM

ESCAPE_PAIRS = r"(?<!\\)(?:\\\\)*+"


def normalized_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def collapsed(text: Column) -> Column:
    """White space of any kind as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def running(values: Column, combine: Callable[[Column, Column], Column], block: int = 256) -> Column:
    """Of an array: what combine (associative) makes of the first values up to each one. In blocks, so that the work grows little faster than the array."""
    last = lambda xs: F.element_at(xs, -1)
    scan = lambda xs: F.aggregate(F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))), F.slice(xs, 1, 1), lambda out, x: F.concat(out, F.array(combine(last(out), x))))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int")), lambda k: scan(F.slice(values, k * block + 1, block)))
    carried = lambda bs, carry: F.flatten(F.transform(bs, lambda xs, k: F.when(k == 0, xs).otherwise(F.transform(xs, lambda x: combine(F.get(carry, k - 1), x)))))
    # arrays of one bind what is used more than once
    whole = F.get(F.transform(F.array(blocks), lambda bs: F.get(F.transform(F.array(scan(F.transform(bs, last))), lambda carry: carried(bs, carry)), F.lit(0))), F.lit(0))
    return F.when(F.size(values) > block, whole).when(F.size(values) > 0, scan(values)).otherwise(values)


def ascii_letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^A-Za-z]", ""))


def worth_translating(text: Column, least: int = 20) -> Column:
    return ascii_letters(text) >= least


def definitions(text: Column) -> Column:
    """How many macro-defining commands there are."""
    return F.regexp_count(text, F.lit(r"\\(?:" + "|".join(DEFINERS) + r")\b"))


def is_macro_file(stem: Column, text: Column) -> Column:
    n = definitions(text)
    return F.when(n == 0, False).when(F.lower(stem).isin(*MACRO_STEMS), True).otherwise(~F.contains(text, F.lit(r"\begin{document}")) & (n >= 8))


def is_appendix_path(parts: Column) -> Column:
    """Of a path relative to its paper, so that a job's own folder name does not count."""
    return F.exists(parts, lambda p: F.rlike(F.lower(p), F.lit("appendix|appendices")))


def has_unescaped(text: Column, character: str) -> Column:
    return F.rlike(text, F.lit(ESCAPE_PAIRS + "[" + character + "]"))


def visible(text: Column) -> Column:
    """Every line without its comment; line ends stay."""
    return F.regexp_replace(text, r"(?d)(?=[\\%])(?<!\\)((?:\\\\)*+)%[^\n]*", "$1")


def without_comments(text: Column) -> Column:
    """For texts without code environments: comments and the blanks before them go; a comment-only line becomes empty."""
    marked = F.regexp_replace(text, r"(?d)(?<!\\)((?:\\\\)*+)%[^\n]*", "$1\x00")
    return F.regexp_replace(marked, "[ \t]*\x00", "")


def unescaped_count(text: Column, character: str, seen: Column | None = None) -> Column:
    """Comments left out; seen: what visible() gives for text, where the caller has it."""
    return F.regexp_count(visible(text) if seen is None else seen, F.lit(rf"(?=[\\{character}])(?<!\\)(?:\\\\)*+{character}"))


def commands(text: Column, seen: Column | None = None) -> Column:
    """Names of all commands in order, comments left out."""
    return F.regexp_extract_all(visible(text) if seen is None else seen, F.lit(r"\\(?<!\\\\)([A-Za-z@]+)"), F.lit(1))


def environment_bounds(text: Column, seen: Column | None = None) -> Column:
    """`begin name` and `end name` in order, comments left out."""
    found = F.regexp_extract_all(visible(text) if seen is None else seen, F.lit(r"\\(?:begin|end)\{[^{}\n]+\}"), F.lit(0))
    return F.transform(found, lambda x: F.regexp_replace(x, r"^\\(begin|end)\{(.*)\}$", "$1 $2"))


def package_names(packages: Column) -> Column:
    """Names in a comma-separated list."""
    return F.filter(F.transform(F.split(packages, ","), lambda x: F.trim(x)), lambda x: x != "")


def zero_argument_macros(text: Column) -> Column:
    r"""Names that text defines without arguments, by \newcommand and the like or by \def."""
    definer = r"\\(?:newcommand|renewcommand|providecommand|DeclareRobustCommand)\*?\s*"
    none = r"\s*(?!\s*\[\s*[0-9]*[1-9][0-9]*\s*\])"
    braced = F.regexp_extract_all(text, F.lit(definer + r"\{\s*\\([A-Za-z@]++)\s*\}" + none), F.lit(1))
    bare = F.regexp_extract_all(text, F.lit(definer + r"\\([A-Za-z@]++)" + none), F.lit(1))
    plain = F.regexp_extract_all(text, F.lit(r"\\(?:def|gdef|edef|xdef)\s*\\([A-Za-z@]++)[^{}\r\n#]*+\{"), F.lit(1))
    return F.array_distinct(F.concat(braced, bare, plain))


def missing_braces(line: Column) -> Column:
    """Braces that a line leaves open; a closing brace without an opening one does not count."""
    inner = F.regexp_replace(F.regexp_replace(line, r"(?s)\\.", ""), r"[^{}]+", "")
    return F.aggregate(F.filter(F.split(inner, ""), lambda c: c != ""), F.lit(0), lambda d, c: F.when(c == "{", d + 1).otherwise(F.greatest(d - 1, F.lit(0))))


def braces_balanced(text: Column) -> Column:
    """Whether grouping braces match; escaped ones and comments do not count."""
    inner = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?=[\\%])(?<!\\)((?:\\\\)*+)%[^\r\n]*", "$1"), r"(?s)\\.", ""), r"[^{}]+", "")
    # pairs go, the inner ones first; what is left after some rounds is walked
    for _ in range(6):
        inner = F.replace(inner, F.lit("{}"), F.lit(""))
    steps = lambda rest: F.aggregate(
        F.filter(F.split(rest, ""), lambda c: c != ""),
        F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")),
        lambda s, c: F.struct((s["d"] + F.when(c == "{", 1).otherwise(-1)).alias("d"), F.least(s["low"], s["d"] + F.when(c == "{", 1).otherwise(-1)).alias("low")),
        lambda s: (s["d"] == 0) & (s["low"] == 0),
    )
    # an array of one binds what is left, so that it is computed once
    return F.get(F.transform(F.array(inner), lambda rest: F.when(rest == "", True).otherwise(steps(rest))), F.lit(0))


def plain_quotes(text: Column) -> Column:
    """TeX quotation marks as ordinary ones; the order of the replacements matters."""
    for old, new in ((r"\`\`", '"'), (r"\`", "’"), (r"\'\'", '"'), (r"\'", "’"), ("``", '"'), ("''", '"'), ("`", "’")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def spaced_commands(text: Column) -> Column:
    """A space between a command and a Chinese character right behind it."""
    return F.regexp_replace(text, rf"\\(?<!\\\\)([A-Za-z@]++)(?=[{CJK}])", r"\\$1 ")


def identifiers_unescaped(text: Column) -> Column:
    r"""`\_` in identifiers as `_`: the parts around identifier commands are taken apart, mended and joined again."""
    command = r"\\(?:" + "|".join(IDENTIFIER_COMMANDS) + r")\*?(?:\[[^\[\]{}]*\])*\{[^{}]*\}"
    # an array of one binds the text, and the parts are zipped: a lambda would find all commands anew for each part
    parts = lambda t: F.zip_with(F.split(t, command, -1), F.regexp_extract_all(t, F.lit(f"({command})"), F.lit(1)), lambda x, y: F.concat(x, F.coalesce(F.replace(y, F.lit(r"\_"), F.lit("_")), F.lit(""))))
    return F.get(F.transform(F.array(text), lambda t: F.when(F.contains(t, F.lit(r"\_")), F.array_join(parts(t), "")).otherwise(t)), F.lit(0))


def protocol_violation(output: Column) -> Column:
    """What shows that an answer is more than the text asked for; null if nothing does."""
    names = "|".join(REQUEST_BLOCKS)
    named = reduce(Column.__or__, [F.contains(output, F.lit(x)) for x in REQUEST_BLOCKS])
    return (
        F.when(F.startswith(F.regexp_replace(output, r"^(?U)\s+", ""), F.lit("```")), "markdown fence")
        .when(named & F.rlike(output, F.lit(rf"</?(?:{names})\s*>|\\(?:begin|end)\{{(?:{names})\}}")), "echoed block name")
        .when(F.contains(output, F.lit("`")) | F.contains(output, F.lit(r"\'")), "TeX quotation mark")
    )


def structural(names: Column) -> Column:
    """Commands that a translation must keep."""
    return F.filter(names, lambda c: ~c.isin(*TEXT_STYLE))


def multiset_difference(a: Column, b: Column) -> Column:
    """Elements of a that b has fewer of, as often as they are missing, in order of first occurrence."""
    times = lambda of, x: F.size(F.filter(of, lambda y: y == x))
    return F.flatten(F.transform(F.array_distinct(a), lambda x: F.array_repeat(x, F.greatest(times(a, x) - times(b, x), F.lit(0)))))


def without_terms(text: Column, terms: tuple[str, ...] = PRESERVED_TERMS) -> Column:
    """Each term, where it stands alone, as a space; of two that begin at one place the earlier in the list."""
    if not terms:
        return text
    return F.regexp_replace(text, r"(?i)(?<![A-Za-z])(?:" + "|".join(rf"\Q{t}\E" for t in terms) + r")(?![A-Za-z])", " ")


def prose(text: Column, terms: tuple[str, ...] = PRESERVED_TERMS) -> Column:
    """What is left of a text without code, kept terms, mathematics, references, commands and marks."""
    code = "|".join(x.replace("*", r"\*") for x in VERBATIM[:7])
    text = F.regexp_replace(text, rf"(?s)\\begin\{{({code})\}}.*?\\end\{{\1\}}", " ")
    text = without_terms(text, terms)
    text = F.regexp_replace(text, r"(?s)\$\$.*?\$\$|\$.*?\$|\\\[.*?\\\]|\\\(.*?\\\)", " ")
    kept = "cite|citep|citet|citealp|ref|eqref|cref|Cref|autoref|label|url|href|includegraphics|input|include|bibliography"
    text = F.regexp_replace(text, rf"\\(?:{kept})\*?(?:\[[^\]]*\])?(?:\{{[^{{}}]*\}}){{1,2}}", " ")
    text = F.regexp_replace(text, r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?", " ")
    return F.regexp_replace(text, r"[{}~^_\\]+", " ")


_EN = r"[A-Za-z][A-Za-z'-]{2,}"


def english_words(rest: Column) -> Column:
    """Of what prose() leaves: a run of twelve English words or more, or else the words of a long mostly English segment; empty if none."""
    run = F.regexp_extract(rest, rf"(\b{_EN}(?:[ \t\r\n,;:()\-]+{_EN}){{11}}(?:[ \t\r\n,;:()\-]++{_EN}){{0,24}}\b)", 1)
    words = lambda s: F.regexp_extract_all(s, F.lit(rf"\b({_EN})\b"), F.lit(1))
    heavy = F.filter(F.split(rest, f"[{CJK}]+"), lambda s: (F.length(F.trim(s)) >= 120) & (F.size(words(s)) >= 16))
    return F.coalesce(F.nullif(run, F.lit("")), F.array_join(F.slice(words(F.get(heavy, F.lit(0))), 1, 24), " "), F.lit(""))


def english_prose(text: Column, terms: tuple[str, ...] = PRESERVED_TERMS) -> Column:
    return english_words(prose(text, terms))


def percent_escaped(text: Column) -> Column:
    """Percent signs behind numbers escaped, but for lines that set pdfTeX's own parameters."""
    fixed = lambda part: F.regexp_replace(part, r"([0-9])(?<!\\[0-9])[ \t\x0B\f\r]*%", r"$1\\%")
    # line by line only where there may be such a line
    lines = F.transform(F.split(text, "\n", -1), lambda line: F.when(F.rlike(line, F.lit(r"^\s*\\(?:pdfoutput|pdfminorversion)\b")), line).otherwise(fixed(line)))
    own = F.contains(text, F.lit(r"\pdfoutput")) | F.contains(text, F.lit(r"\pdfminorversion"))
    return F.when(own, F.array_join(lines, "\n")).otherwise(fixed(text))


def px_as_pt(text: Column) -> Column:
    # of a number its last digit tells, so that a long one is not tried from each of its digits
    return F.regexp_replace(text, r"([0-9])\s*px\b", "$1pt")


def accents_dropped(text: Column) -> Column:
    """For texts without code environments: a text accent and its letter become the letter. A line break before a letter is no accent."""
    symbols, words = r"[\"'`\^~=\.]", "[bcdHkrtuv]"
    return F.regexp_replace(text, rf"(?<!\\)\\(?:{symbols}\s*(?:\{{([A-Za-z])\}}|([A-Za-z]))|{words}(?:\s*\{{([A-Za-z])\}}|\s+([A-Za-z])))", "$1$2$3$4")


def code_environments(text: Column) -> Column:
    """Whole code environments, none nested."""
    names = "|".join(x.replace("*", r"\*") for x in VERBATIM)
    return F.regexp_extract_all(text, F.lit(rf"(?s)(\\begin\{{({names})\}}.*?\\end\{{\2\}})"), F.lit(1))


def box_commands(text: Column) -> Column:
    r"""How often each box command is called, as `name:count` in order of name."""
    return F.array_join(F.filter(F.array(*(F.concat(F.lit(f"{n}:"), F.regexp_count(text, F.lit(rf"\\{n}(?![A-Za-z])")).cast("string")) for n in sorted(BOXES))), lambda x: ~x.endswith(":0")), ",")


def mended(text: Column, pattern: str, change, shift: int = 0) -> Column:
    r"""Every match of pattern changed by a column function; what stands between the matches stays.

    A pattern with groups of its own numbers them from 2, as for a pattern in parentheses, and gives their number as shift.
    """
    # zipped, as a lambda would find all matches anew for each part
    found = F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), change)
    return F.array_join(F.zip_with(F.split(text, f"({pattern})" if shift else pattern, -1), found, lambda x, y: F.concat(x, F.coalesce(y, F.lit("")))), "")


def first_replaced(text: Column, pattern: str, replacement: str) -> Column:
    r"""The first match of pattern (no groups in it, or numbered from 3) replaced; $2 is the match."""
    return F.regexp_replace(text, rf"(?s)\A(.*?)({pattern})", "$1" + replacement)


def quoted(text: str) -> str:
    r"""text as a replacement that stands for itself."""
    return text.replace("\\", "\\\\").replace("$", "\\$")

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parchment.functions import ids, scan, text

CASES = [
    (ids.paper_id, "https://arxiv.org/pdf/2401.00001v2.pdf", "2401.00001v2"),
    (ids.paper_id, "hep-th/9901001", "hep-th/9901001"),
    (ids.paper_id, "https://arxiv.org/abs/hep-th/9901001", "hep-th/9901001"),
    (ids.paper_id, "12345.67890", "2345.67890"),
    (lambda c: ids.paper_id(c, lenient=False), "12345.67890", None),
    (lambda c: ids.paper_id(c, lenient=False), " 2345.67890 ", "2345.67890"),
    (ids.paper_id, "https://example.org/2401.00001", None),
    (ids.paper_id_error, "https://example.org/2401.00001", "other host"),
    (ids.paper_id_error, "  ", "empty link"),
    (ids.version, "2401.00001v12", 12),
    (ids.folder_name, "hep-th/9901001", "hep-th_9901001"),
    (text.worth_translating, "a" * 19 + "é", False),
    (text.worth_translating, "A" * 20, True),
    (lambda c: text.has_unescaped(c, "&"), "a\\\\& b", True),
    (lambda c: text.has_unescaped(c, "&"), "a\\& b", False),
    (lambda c: text.unescaped_count(c, "&"), "a & b \\& c % &\n&", 2),
    (text.visible, "5\\% x % c\nb \\\\% d", "5\\% x \nb \\\\"),
    (text.without_comments, "a  % c\nb", "a\nb"),
    (text.without_comments, "% only\nb", "\nb"),
    (text.plain_quotes, "``a'' \\'e", '"a" ’e'),
    (text.identifiers_unescaped, "\\ref{sec\\_a} \\emph{x\\_y} \\cite[p.~1]{a\\_b,c}", "\\ref{sec_a} \\emph{x\\_y} \\cite[p.~1]{a_b,c}"),
    (text.spaced_commands, "\\alpha中 \\\\alpha中", "\\alpha 中 \\\\alpha中"),
    (text.braces_balanced, "{a}", True),
    (text.braces_balanced, "{a", False),
    (text.braces_balanced, "\\{a", True),
    (text.braces_balanced, "a}{", False),
    (text.braces_balanced, "% {", True),
    (text.missing_braces, "\\title{a {b} \\{", 1),
    (text.protocol_violation, " ```latex", "markdown fence"),
    (text.protocol_violation, "\\begin{TEXT_AFTER}", "echoed block name"),
    (text.protocol_violation, "a ` b", "TeX quotation mark"),
    (text.protocol_violation, "fine", None),
    (text.collapsed, "  a \n　b\t", "a b"),
    (text.accents_dropped, "na\\\"ive caf\\'{e} \\c{c}a \\v s a\\\\=b", "naive cafe ca s a\\\\=b"),
    (lambda c: text.without_terms(c), "A Token, tokens, prompt injection; x-agentic", "A  , tokens,   injection; x- "),
    (lambda c: F.array_join(text.zero_argument_macros(c), ","), "\\newcommand{\\a}{x} \\newcommand\\b[0]{y} \\newcommand{\\c}[2]{z} \\def\\d{q} \\def\\e#1{r}", "a,b,d"),
    (lambda c: F.array_join(text.environment_bounds(c), ","), "\\begin{a} % \\end{a}\n\\end{b*}", "begin a,end b*"),
    (lambda c: F.array_join(text.code_environments(c), "|"), "\\begin{verbatim}\na\\end{verbatim}\\begin{x}\\end{x}", "\\begin{verbatim}\na\\end{verbatim}"),
    (lambda c: text.is_macro_file(F.lit("x"), c), "\\def\\a{} " * 8, True),
    (lambda c: text.is_macro_file(F.lit("x"), c), "\\def\\a{} " * 7, False),
    (lambda c: text.is_macro_file(F.lit("Macros"), c), "\\def\\a{}", True),
    (lambda c: text.is_appendix_path(F.split(c, "/")), "a/Appendix-1.tex", True),
    (text.box_commands, "\\fbox{a} \\parbox{b}{c} \\fboxsep", "fbox:1,parbox:1"),
]


def test_cases(spark):
    row = spark.range(1).select(*(f(F.lit(x)).alias(f"c{k}") for k, (f, x, _) in enumerate(CASES))).first()
    assert [(k, CASES[k][1], row[k], want) for k, (_, _, want) in enumerate(CASES) if row[k] != want] == []


@pytest.mark.parametrize(("n", "found"), [(11, False), (12, True)])
def test_run_of_english_words(spark, n, found):
    one = " ".join(["word"] * n)
    row = spark.range(1).select((text.english_prose(F.lit("中 " + one + " 中")) != "").alias("x")).first()
    assert row.x == found


def test_patterns_hold_for_long_texts(spark):
    long = "word\\emph{a} % c " * 30000 + "\n" + "x" * 200000 + " and " * 50000
    row = spark.createDataFrame([(long,)], "t string").select(
        F.length(text.visible(F.col("t"))), F.size(text.commands(F.col("t"))), text.braces_balanced(F.col("t")), F.length(text.english_prose(F.col("t"))), F.length(text.identifiers_unescaped(F.col("t"))), F.length(text.accents_dropped(F.col("t")))
    ).first()
    assert row[2] is True and row[3] > 0


def test_multisets(spark):
    row = spark.range(1).select(text.multiset_difference(F.lit(["a", "b", "a", "c", "a"]), F.lit(["a", "c", "d"]))).first()
    assert row[0] == ["a", "a", "b"]


def test_comments_and_code():
    code = "\\begin{verbatim}\n% keep\n\\end{verbatim}\n"
    assert scan.strip_comments(code) == code
    assert scan.strip_comments("\\includegraphics[\n% c\nwidth=1]{f}") == "\\includegraphics[\nwidth=1]{f}"
    assert scan.strip_comments("a[%\n%\n]") == "a[\n\n]"
    assert scan.drop_accents("\\begin{minted}\\'e\n\\'e\n\\end{minted}\n\\'e") == "\\begin{minted}e\n\\'e\n\\end{minted}\ne"


def test_protection():
    got = scan.protect("x \\fbox{a{b}} y \\gls{k} \\parbox[t]{1}{\\{}z")
    assert got == {"text": "x \\ParchmentKept{0} y \\ParchmentKept{1} \\ParchmentKept{2}z", "blocks": ["\\fbox{a{b}}", "\\gls{k}", "\\parbox[t]{1}{\\{}"]}
    assert scan.restore("\\ParchmentKept{7}", ["a", "b"]) == "\\ParchmentKept{7}"
    assert scan.protect("\\fbox{a} \\fbox{b")["blocks"] == ["\\fbox{a}"] and scan.protect("\\fbox{a}\\gls{b}")["blocks"] == ["\\fbox{a}\\gls{b}"]


@pytest.mark.parametrize(("sample", "safe"), [("a{b}", True), ("a{b", False), ("\\begin{x}", False), ("$a", False), ("\\(a\\)", True), ("\\\\{a}", True), ("(0,1]", False), ("\\begin{document}", True), ("\\begin{a}\\end{b}", False), ("\\[a", False), ("$$a$$ \\$", True), ("\\\\[2pt] x", True)])
def test_boundaries(sample, safe):
    assert scan.is_boundary(sample) == safe


def test_chunks():
    assert scan.chunks("aaaa\n\nbbbb\n\ncccc", 10) == ["aaaa\n\nbbbb", "\n\ncccc"]
    assert scan.chunks("a{aa\n\nbb}b\n\ncccc", 6) == ["a{aa\n\nbb}b", "\n\ncccc"]
    assert scan.chunks("short", 10) == ["short"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab{}[]$\\%\n \r()é中", max_size=120), st.integers(1, 40))
def test_properties(sample, limit):
    assert "".join(scan.chunks(sample, limit)) == sample
    once = scan.strip_comments(sample)
    assert scan.strip_comments(once) == once
    kept = scan.protect(sample)
    assert scan.restore(kept["text"], kept["blocks"]) == sample


def test_scanners_on_long_texts():
    rng = random.Random(1)
    sample = "".join(rng.choice(["\\begin{align}", "\\end{align}", "{", "}", "$", "\\fbox{x}", "word ", "%\n", "\n\n", "\\[", "\\section{A}"]) for _ in range(30000))
    assert "".join(scan.chunks(sample, 2048)) == sample
    scan.protect(sample), scan.math_contexts(sample), scan.macro_definitions(sample), scan.outline(sample)


def test_contexts_and_definitions():
    found = scan.math_contexts("a $x$ b $$y$$ \\(z\\) \\[w\\] \\$5 $u\\$v$ \\begin{align*}q\\end{align*}")
    assert found == ["$x$", "$$y$$", "\\(z\\)", "\\[w\\]", "$u\\$v$", "\\begin{align*}q\\end{align*}"]
    assert [d["name"] for d in scan.macro_definitions("\\newcommand{\\a}[1]{x{#1}} \\def\\b#1{y} \\let\\c=\\d\n\\newcommand\\e{z}\\def\\x@y{}")] == ["a", "b", "c", "e"]
    assert scan.outline("\\section{A {b}} \\subsection*{ C\n d} \\section{}") == [{"level": "section", "heading": "A {b}"}, {"level": "subsection", "heading": "C d"}]
    assert scan.first_title("\\title[s]{A {b}}") == "A {b}" and scan.first_title("x") is None
    assert scan.top_level_split("a,{b,c},d\\,e,") == ["a", "{b,c}", "d\\,e", ""]

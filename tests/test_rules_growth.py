"""Rules and the gate's mends on texts of many matches: their time grows as the text does, not with the square of the matches."""

import time

import pytest
from pyspark.sql import functions as F

from parchment.functions import text as t
from parchment.rules import compat as c

N = 12_000
CASES = [
    (c.unaligned_as_equation, "\\begin{align}x\\end{align}\n", "\\begin{equation}x\\end{equation}\n"),
    (lambda x: c.end_macro_names(x, F.array(F.lit("own"))), "\\own中\n", "\\own{}中\n"),
    (t.identifiers_unescaped, "a\\_b \\cite{a\\_b}\n", "a\\_b \\cite{a_b}\n"),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_time_grows_as_the_text(spark, k):
    rule, before, after = CASES[k]
    rows = spark.createDataFrame([(before,)], "text string").select(F.repeat("text", N).alias("text"))
    began = time.monotonic()
    assert rows.select(rule(F.col("text"))).first()[0] == after * N
    assert time.monotonic() - began < 15
    assert spark.createDataFrame([(None,)], "text string").select(rule(F.col("text"))).first()[0] is None


LOADS = [
    # the load inside the options of another is none, and a condition that a comment follows counts
    ("\\usepackage[a,\n\\usepackage{x}\n]{y}\n\\usepackage{x}\n", "\\usepackage[a,\n\\usepackage{x}\n]{y}\n\\usepackage{x}\n"),
    ("\\ifx\\a\\b\n\\usepackage{x}\n \\fi % end\n\\usepackage[o]{x}\n\\usepackage{x,z}\n", "\\ifx\\a\\b\n\\PassOptionsToPackage{o}{x}\n\\usepackage{x}\n \\fi % end\n\\usepackage[o]{x}\n\\usepackage{z}\n"),
    ("\\usepackage{x}\n\\begin{document}\n\\usepackage{x}\n", "\\usepackage{x}\n\\begin{document}\n\\usepackage{x}\n"),
    ("\\fifth\n\\usepackage{x}\n\\fi\n\\usepackage{x}\n", "\\fifth\n\\usepackage{x}\n\\fi\n"),
]


@pytest.mark.parametrize("before,after", LOADS)
def test_package_loads_by_lines(before, after):
    assert c.merge_package_loads(before) == after

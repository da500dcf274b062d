import random

from hypothesis import given, settings
from hypothesis import strategies as st

from parchment.functions import scan
from parchment.operators import boundaries as k

PIECES = ["{", "}", "[", "]", "$", "$$", r"\(", r"\)", r"\[", r"\]", r"\begin{a}", r"\end{a}", r"\begin{b}", r"\end{b}", r"\begin{document}", r"\\", r"\\[2pt]", r"\{", r"\$", "% {\n", "x", " ", "\n"]


def texts(n):
    return st.lists(st.sampled_from(PIECES), max_size=n).map("".join)


@settings(deadline=None, max_examples=400)
@given(st.lists(texts(8), max_size=6))
def test_combined_summaries_are_the_walk(parts):
    state, combined = scan.Boundary(), k.Stretch()
    for p in parts:
        state.feed(p)
        combined = combined.then(k.stretch(p))
        assert combined.safe == state.safe


@settings(deadline=None, max_examples=200)
@given(texts(6), texts(6), texts(6))
def test_combining_is_associative(a, b, c):
    a, b, c = map(k.stretch, (a, b, c))
    assert a.then(b).then(c) == a.then(b.then(c)) and k.Stretch().then(a) == a == a.then(k.Stretch())


def test_chunks_are_those_of_the_walk(spark):
    """With blocks of any size, and with a text of thousands of paragraphs in as many rows as it has blocks."""
    rng = random.Random(8)
    closed = ["x" * 30, "{y}", "$z$", r"\begin{a} w \end{a}", "[v]", r"\( u \)", "% {\n t"]
    rows = [("", 0)] + [("\n\n".join("".join(rng.choices(closed, k=rng.randrange(5))) + rng.choice(["", "", "", "{", "}", "$", r"\begin{a}", r"\end{a}"]) for _ in range(rng.randrange(30))), i) for i in range(60)]
    rows.append(("\n\n".join(rng.choice(closed) + rng.choice(["", "", " {", " }"]) for _ in range(4000)), 999))
    df = spark.createDataFrame(rows, "text string, k int").repartition(3)
    want = {}
    for text, i in rows:
        at = 0
        for n, c in enumerate(scan.chunks(text, 80)):
            want[i, n] = (at, len(c))
            at += len(c)
    for block in (1, 7, 512):
        got = {(r["k"], r["idx"]): (r["offset"], r["length"]) for r in k.safe_chunks(df, ["k"], 80, block=block).collect()}
        assert got == want

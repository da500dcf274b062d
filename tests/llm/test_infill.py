import hashlib
import random
import re

from pyspark.sql import functions as F

from parchment.llm import infill as k

TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def plain_version(doc, text):
    """As the contract reads, on one text."""
    text = text or ""
    units = TOKEN.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return n, out[0], len(p), len(m), out[1]


EDGES = ["", " ", "\n\t ", "a", " a", "a ", "  a  b  ", "<P>", "a <S> b", "a<M", "M>", "<", "<P", ">", "日本 語 ", "é　x y", "a\0b c", "😀 😀😀  x", "<<P> x", "<p> <s>", "a<\n", "\x1c a\x85b"]


def test_against_plain_version(spark):
    rng = random.Random(1)
    texts = [*EDGES, *("".join(rng.choice("ab <PSM>\n語é") for _ in range(rng.randrange(60))) for _ in range(1500))]
    # marks must not be seen across two texts, so neighbours that make one up are in
    rows = [(i - 40, t) for i, t in enumerate(texts)] + [(5, "x<"), (5, "P> y"), (5, "P> y"), (None, "some words here to cut"), (7, None), (None, None)]
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, form string").coalesce(2)
    out = k.fill_in_middle(df).withColumn("back", k.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(repr, ((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in out))) == sorted(repr((d, *plain_version(d, t))) for d, t in rows)
    assert sorted((repr(r["doc_id"]), r["back"]) for r in out) == sorted((repr(d), t or "") for d, t in rows)
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}


def test_long_text_and_empty_table(spark):
    docs = [d for d in range(40) if plain_version(d, "x")[1] != "plain"][:2]
    text = "wörd  and\n" * 400_000
    out = k.fill_in_middle(spark.createDataFrame([(d, text) for d in docs], "doc_id long, text string")).collect()
    assert all((r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_version(r["doc_id"], text) for r in out) and len(out) == 2
    assert k.infill_digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_other_rates(spark):
    df = spark.createDataFrame([(d, "one two three four") for d in range(200)], "doc_id long, text string")
    assert {r["form"] for r in k.fill_in_middle(df, rate=100, spm_rate=0).collect()} == {"psm"}
    assert {r["form"] for r in k.fill_in_middle(df, rate=0).collect()} == {"plain"}
    first, again = (sorted(k.fill_in_middle(df, seed=s, rate=100).collect()) for s in (1, 2))
    assert first != again

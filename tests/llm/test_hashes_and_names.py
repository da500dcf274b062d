"""Words that a weak hash takes for one another, long texts full of hits, and columns whose names operators use themselves."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from parchment.llm import components, decontaminate, quality, repeats, shared, similar, simhash
from parchment.llm.bloom import bloom_filter, with_maybe


def thue_morse(n, flip=False):
    """A word of n letters; it and its mirror image agree in no place, and polynomial hashes modulo 2**64 take them for one another from some 1,000 letters on."""
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


def test_long_words_are_told_apart(spark):
    for n in (33, 64, 1024, 2048):
        raw = np.frombuffer((thue_morse(n) + " " + thue_morse(n, True)).encode(), np.uint8)
        h = shared.word_hashes(raw, np.array([0, n + 1]), np.array([n, 2 * n + 1]))
        assert h[0] != h[1]
    one, two = thue_morse(2048), thue_morse(2048, True)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, f"{one} x y {two} x y"), (2, f"{one} x y {one} x y")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_repeat_words"] for r in quality.quality(docs, labels).collect()} == {1: 0, 2: 6}
    items = spark.createDataFrame([(5, f"{one} a b c d e f g h i")], "item_id long, text string")
    texts = spark.createDataFrame([(1, f"{two} a b c d e f g h i"), (2, f"z {one} a b c d e f g h i")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_hit"] for r in decontaminate.decontamination_report(texts, items).collect()} == {1: 0, 2: 10}
    assert [r["doc_id"] for r in decontaminate.without_contaminated(texts, items).collect()] == [1]


#: Strings of 32 and of 100 bytes that a polynomial hash modulo 2**64 that was used here once took for one another, found by a birthday search.
TWINS = ("mbtvcgrcrgsouszrdydborsxcfdipmpb", "yjltogvsxprhgvtradrtmixswumaagng")


def test_words_of_one_polynomial_hash_are_told_apart(spark):
    one, two = TWINS
    raw = np.frombuffer(f"{one} {two}".encode(), np.uint8)
    starts, ends = np.array([0, 33]), np.array([32, 65])
    sums = shared.rolling(raw)
    assert len(set(shared.hashes(sums, starts, ends).tolist())) == 1, "no twins any more: find others, or drop these"
    number, h = shared.word_numbers(raw, starts, ends)
    assert len(set(number.tolist())) == len(set(h.tolist())) == 2
    docs = spark.createDataFrame([(1, f"a b {one} c d e a b {two}"), (2, f"a b {one} c d e a b {one}")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_repeat_words"] for r in quality.quality(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()} == {1: 0, 2: 6}
    items = spark.createDataFrame([(5, one)], "item_id long, text string")
    texts = spark.createDataFrame([(1, f"x {two} y"), (2, f"x {one} y")], "doc_id long, text string")
    assert {r["doc_id"]: r["contaminated"] for r in decontaminate.decontamination_report(texts, items).collect()} == {1: False, 2: True}
    sets = list(similar.shingle_sets(pa.array([f"p q {one} r s", f"p q {two} r s"])))
    assert not set(sets[0].tolist()) & set(sets[1].tolist())


def test_repeats_of_one_polynomial_hash_are_told_apart(spark):
    """Texts that begin alike and differ in 32 bytes that have one polynomial hash: nothing is repeated but what is."""
    one, two = (("q" * 20 + "zyxwvuts" * 6)[:68] + w for w in TWINS)
    assert one != two and len(one) == 100
    for docs in ([(1, one), (2, two)], [(1, one), (2, two), (3, one)], [(1, f"{two}{one}"), (2, f"ab{one}"), (3, f"cd{two}")]):
        rows = spark.createDataFrame(docs, "doc_id long, text string")
        want, seen = {}, set()
        for i, t in docs:
            gone = set()
            for a in range(len(t) - 99):
                gone |= set(range(a, a + 100)) if t[a : a + 100] in seen else set()
                seen.add(t[a : a + 100])
            want[i] = len(gone)
        for group in (1 << 12, 1):
            assert {r["doc_id"]: r["n_removed"] for r in repeats.repeats_report(rows, 2, group).collect()} == want


def test_word_numbers_are_exact():
    rng = np.random.default_rng(3)
    words = [bytes(rng.choice([97, 98, 0, 200], rng.integers(1, 12)).astype(np.uint8)) for _ in range(5000)] + [b"", b"a" * 7, b"a" * 8, b"a" * 7 + b"\0", b"\0", b"\0\0"]
    raw = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    number, h = shared.word_numbers(raw, np.concatenate([[0], ends[:-1] + 1]), ends)
    assert len(set(zip(words, number.tolist(), strict=True))) == len(set(words)) == len(set(number.tolist())) == len(set(h.tolist()))
    assert (shared.word_hashes(raw, np.concatenate([[0], ends[:-1] + 1]), ends) == h).all()


def test_decontamination_of_a_text_full_of_hits():
    """The places of many spans in one long text are found in one walk over it."""
    item = " ".join(f"w{i}" for i in range(10))
    block = decontaminate.make_block([(3, [w.encode() for w in item.split()])])
    text = f"{item} é , zz " * 140_000
    began = time.time()
    n_words, found, items = decontaminate._shard(pa.array([text, None, item]), block, decontaminate.Vocabulary(block.words))
    assert time.time() - began < 60 and len(text) > 5_000_000
    assert len(found[0]) == 140_000 and items == [[3], [], [3]] and n_words.tolist() == [1_680_000, 0, 10]
    for span in (found[0][0], found[0][31_234], found[0][-1]):
        assert text[span["start"] : span["end"]] == item
    assert found[2] == [{"first": 0, "last": 9, "start": 0, "end": len(item)}]


@pytest.fixture(scope="module")
def clashing(spark):
    """Columns named as operators name their own, with a copy, a near copy and repeated rows."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    near = base[:]
    near[50] = "other"
    texts = [" ".join(base), " ".join(base), " ".join(near), "all alone " * 3, None, ""]
    rows = [(i, t, i, "k", "r", "t", "m", "b", 1.5) for i, t in enumerate(texts)] + [(0, texts[0], 0, "k", "r", "t", "m", "b", 1.5)]
    return spark.createDataFrame(rows, "doc_id long, text string, tag long, key string, root string, none string, maybe string, block string, keep double")


def test_first_of_classes_with_clashing_names(clashing):
    for first in (similar.first_of_similar, simhash.first_of_group):
        out = first(clashing)
        rows = {r["doc_id"]: r for r in out.collect()}
        assert out.columns == clashing.columns and out.dtypes == clashing.dtypes and out.count() == len(rows)
        assert {0, 3, 4} <= set(rows) and 1 not in rows and 5 not in rows and rows[0]["tag"] == 0 and rows[3]["keep"] == 1.5
    assert 2 not in {r["doc_id"] for r in similar.first_of_similar(clashing).collect()}


def test_filters_with_clashing_names(spark, clashing):
    items = spark.createDataFrame([(1, "all alone all alone")], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.without_contaminated(clashing, items).collect()} == {0, 1, 2, 4, 5}
    spans = clashing.selectExpr("*", "'s' spans", "'o' of")
    cut = {r["doc_id"]: (r["text"], r["spans"], r["of"], r["tag"]) for r in decontaminate.with_spans_cut(spans, items).collect()}
    assert cut[3][0].strip() == "" and cut[3][1:] == ("s", "o", 3) and cut[4][0] is None
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.kept_documents(clashing, labels).columns == clashing.columns


def test_filter_with_clashing_names(spark):
    rows = spark.createDataFrame([(1, "a", 7), (2, "b", 8)], "block long, w0 string, _block long")
    from pyspark.sql import functions as F

    blooms, n = bloom_filter(spark.createDataFrame([("a",)], "key string"), 1)
    got = {r["w0"]: (r["block"], r["_block"], r["hit"]) for r in with_maybe(rows, F.col("w0"), blooms, n, "hit").collect()}
    assert got["a"] == (1, 7, True) and got["b"][:2] == (2, 8)


def test_sketches_bound_what_sets_share():
    rng = np.random.default_rng(3)
    for n, m, both in ((1, 1, 1), (5, 900, 3), (1000, 1000, 0), (700, 90, 60), (4000, 4100, 3900)):
        x = np.unique(rng.integers(0, 1 << 63, n + m, dtype=np.uint64) * np.uint64(2))
        a, b = np.sort(x[:n]), np.sort(np.concatenate([x[:both], x[n : n + m - both]]))
        na, nb, most = similar._most_shared(similar._sketch(a), similar._sketch(b))
        assert {na, nb} == {len(a), len(b)} and most >= len(np.intersect1d(a, b))
    # sets that share little are ruled out
    low, high = (similar._sketch(np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2))) for _ in range(2))
    assert not similar._open(low, high) and similar._open(low, low) and similar._open(b"", high)


def test_components_of_nulls(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (None, 4), (7, 7)], "a long, b long")
    assert {(r["node"], r["root"]) for r in components.components(edges).collect()} == {(1, 1), (2, 1), (3, 1)}

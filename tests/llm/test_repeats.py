import hashlib
import random

from parchment.llm.repeats import IndexFamily, _keyed, repeats_report, without_repeats


def brute(docs):
    """docs in order of doc_id; the removed bytes of each."""
    seen, out = set(), []
    for _, text in docs:
        raw = (text or "").encode()
        gone, own = bytearray(len(raw)), []
        for i in range(len(raw) - 99):
            s = raw[i : i + 100]
            if s in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(s)
        out.append((raw, gone))
    return out


def digest(raw, gone):
    kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
    n_spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
    return len(raw), sum(gone), n_spans, hashlib.sha256(kept).hexdigest()


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passages = [text(rng.randint(10, 60)) for _ in range(5)]
    docs = []
    for i in range(n):
        kind = rng.randint(0, 7)
        t = text(rng.randint(1, 80))
        if kind == 0 and docs:
            t = rng.choice(docs)[1]
        elif kind == 1 and docs:
            old = rng.choice(docs)[1] or ""
            cut = rng.randint(0, len(old))
            t = old[:cut] + "X" + old[cut:]
        elif kind in (2, 3, 4):
            t = t + rng.choice(passages) + text(5) + rng.choice(passages)
        elif kind == 5:
            t = rng.choice(["", None, "a" * 350, "ab" * 120, "x" * 99, "y" * 100, "y" * 101])
        docs.append((i, t))
    return docs


def test_against_brute_force(spark):
    for seed, batches, group in ((1, 1, 1 << 14), (2, 2, 3), (3, 5, 1 << 14)):
        docs = corpus(seed)
        expected = {i: digest(*x) for (i, _), x in zip(docs, brute(docs), strict=True)}
        shuffled = docs[:]
        random.Random(9).shuffle(shuffled)
        rows = repeats_report(spark.createDataFrame(shuffled, "doc_id long, text string").repartition(4), batches, group).collect()
        assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows} == expected
        assert len(rows) == len(docs)


def test_levels_grow_geometrically(spark):
    docs = corpus(4, 50)
    family = IndexFamily(spark)
    held = []
    for k in range(5):
        family.add(_keyed(spark.createDataFrame(docs[k * 10 : k * 10 + 10], "doc_id long, text string")))
        held.append(sorted(family.levels))
    assert held == [[0], [1], [0, 1], [2], [0, 2]]


def test_odd_rows(spark):
    long = "".join(chr(97 + (i * i) % 26) for i in range(300))
    rows = [(None, long, 1), (1, long, 2), (1, long, 3), (2, None, 4), (3, "", 5)]
    out = without_repeats(spark.createDataFrame(rows, "doc_id long, text string, spans int"), 2).collect()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append((r["n_bytes"], sum(s["stop"] - s["start"] for s in r["spans"])))
    within = by[None][0][1]
    assert by[1] == [(300, 300), (300, 300)] and by[2] == [(0, 0)] and by[3] == [(0, 0)] and within < 300
    assert without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_long_text_in_parts(spark, monkeypatch):
    import parchment.llm.repeats as m

    monkeypatch.setattr(m, "_PIECE", 1000)
    docs = [(0, corpus(5)[3][1] or "z"), (1, " ".join((t or "") for _, t in corpus(6, 40)))]
    raw = docs[1][1].encode()
    import numpy as np

    ids = []
    for i, a, at in m._pieces(np.array([0, len(raw)])):
        row, start, n, g, r = m._runs(np.frombuffer(raw, np.uint8)[a : a + at[-1]], at, b"key")
        ids += [x for s, k in zip((start + a).tolist(), n.tolist(), strict=True) for x in range(s, s + k)]
    assert ids == list(range(len(raw) - 99)) or sorted(ids) == list(range(len(raw) - 99))


def test_many_rows_without_id_and_a_common_line(spark):
    """Rows without id are ordered by their texts' hashes; a line that all documents share, in differing surroundings, is kept once."""
    rng = random.Random(21)
    line = "".join(rng.choice("abcdefgh ") for _ in range(120))
    docs = [(i, f"{rng.random()} {line} {rng.random()}") for i in range(400)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    want = {i: digest(*x) for (i, _), x in zip(docs, brute(docs), strict=True)}
    for group in (1 << 14, 50):
        assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats_report(rows, 2, group).collect()} == want
    texts = [f"{line[:60]} {k % 19_000}" + line[:40] for k in range(20_000)]
    none = spark.createDataFrame([(None, t) for t in texts] + [(-(1 << 63), texts[0])], "doc_id long, text string").repartition(6)
    out = repeats_report(none).collect()
    assert len(out) == 20_001 and all(r["n_bytes"] >= 100 for r in out)
    # the row of the least id comes after those without one
    assert [r["n_removed"] for r in out if r["doc_id"] is not None] == [len(texts[0])]


def test_frequent_anchors_are_dealt_out(spark, monkeypatch):
    import parchment.llm.repeats as m

    monkeypatch.setattr(m, "SAMPLE", 1)
    monkeypatch.setattr(m, "OFTEN", 3)
    docs = corpus(8, 80)
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert m.frequent_anchors(_keyed(rows)).count() > 0
    want = {i: digest(*x) for (i, _), x in zip(docs, brute(docs), strict=True)}
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats_report(rows, 3).collect()} == want


def test_replaced_levels_are_deleted(spark):
    import os

    family = IndexFamily(spark)
    docs = _keyed(spark.createDataFrame(corpus(9, 20), "doc_id long, text string"))
    family.add(docs.filter("doc_id < 10"))
    old = family.levels[0].removeprefix("file://")
    assert os.path.isdir(old)
    family.add(docs.filter("doc_id >= 10"))
    assert not os.path.exists(old) and list(family.levels) == [1]

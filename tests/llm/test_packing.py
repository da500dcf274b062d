import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from parchment.llm import packing as k

PATH = public_tokenizers.path("byte_bpe_50k.json")


def first_fit_by_scan(lengths, size):
    bins = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        for b in bins:
            if sum(lengths[j] for j in b) + lengths[i] <= size:
                b.append(i)
                break
        else:
            bins.append([i])
    return bins


@settings(deadline=None)
@given(st.lists(st.integers(1, 31), max_size=80))
def test_tree_finds_the_first_bin(lengths):
    assert k.first_fit_decreasing(lengths, 32) == first_fit_by_scan(lengths, 32)


@settings(deadline=None)
@given(st.lists(st.integers(1, 63), min_size=1, max_size=60), st.integers(0, 8))
def test_sequences_hold_each_id_once_and_need_little_padding(lengths, slack):
    seen = {i: [] for i in range(len(lengths))}
    for pieces in k.sequences(lengths, 64, slack):
        n = sum(x for _, _, x in pieces)
        assert n == k.padded(n, 64) or 64 - slack <= n <= 64
        for item, since, x in pieces:
            assert x > 0
            seen[item] += range(since, since + x)
    assert all(sorted(v) == list(range(lengths[i])) for i, v in seen.items())


def test_packing_against_the_library(spark):
    tokenizer, rng = Tokenizer.from_file(PATH), random.Random(3)
    words = ["alpha", "Beta,", "γάμμα", "12", "\n", "<|endoftext|>", "x" * 30, "日本"]
    texts = [None, "", "a", "word " * 9000, "word " * 2047, "word " * 2046] + [" ".join(rng.choices(words, k=rng.randrange(700))) for _ in range(400)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "no id", 1), (9, "same id", 1), (9, "same id", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, offset int").repartition(4)
    packing = k.pack(df, PATH, group=100)
    whole = packing.read(spark).collect()
    assert len({r["sequence_id"] for r in whole}) == len(whole)
    assert len([r for r in whole if r["length"] == 2048]) > 20
    got = []
    for r in whole:
        ids = np.frombuffer(r["ids"], f"<u{r['width']}")
        assert len(ids) == r["length"] <= 2048 and r["padded"] == (r["length"] if r["length"] & (r["length"] - 1) == 0 else 2048)
        at = 0
        for p in r["pieces"]:
            assert p["offset"] == at
            at += p["length"]
            got.append((p["doc_id"], p["doc_tokens"], p["start"], ids[p["offset"] : at].tolist()))
        assert at == r["length"]
    assert sum(r["padded"] - r["length"] for r in whole) < 0.01 * sum(r["length"] for r in whole)
    # documents put together again: pieces of one document in order, those of rows that share an id are told apart by nothing but their ids
    want = {}
    for doc, t, _ in rows:
        want.setdefault(doc, []).append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])
    for doc, lists in want.items():
        mine = sorted([g for g in got if g[0] == doc], key=lambda g: g[2])
        if len(lists) == 1:
            assert [x for g in mine for x in g[3]] == lists[0] and all(g[1] == len(lists[0]) for g in mine)
            assert [g[2] for g in mine] == np.cumsum([0, *(len(g[3]) for g in mine[:-1])]).tolist()
        else:
            assert sum(len(g[3]) for g in mine) == sum(map(len, lists))
    report = k.piece_digests(packing.read(spark)).collect()
    assert sorted((repr(r["doc_id"]), r["start"], r["length"], r["ids_crc32"]) for r in report) == sorted((repr(d), s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, _, s, x in got)


def test_empty_table(spark):
    assert k.packing_report(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = k.packing_report(docs, PATH).toPandas()
    tokenizer = Tokenizer.from_file(PATH)
    for r in docs.collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        mine = out[out["doc_id"] == r["doc_id"]].sort_values("start")
        assert mine["doc_tokens"].eq(len(ids)).all() and mine["length"].sum() == len(ids)
        for p in mine.itertuples():
            assert zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32
    filled = out.groupby("sequence_id")["length"].sum()
    assert filled.max() <= 2048

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from parchment.llm import tokens as k
from parchment.llm.rans import Table, decode, encode, normalized

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["The cat. The dog.\nA bird", "", None, "a  b\n c\t d", " x", "z'll 12 ' s　y", "日本 語", "<|endoftext|> x", " \n \n a", "a b\nc d.\ne\n\nf g,\n h", "n\0 \0m", "word " * 3000, "a ª º É×÷é!"]


def test_report_against_the_library(spark):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    rows = [(i * 3 - 5, t, 0) for i, t in enumerate(TEXTS)] + [(None, "first", 0), (1, "again", 0), (1, "again", 0)]
    out = k.token_report(spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(5), PATH).collect()
    out = sorted(out, key=lambda r: r["start"])
    assert [r["doc_id"] for r in out] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    start = 0
    for r in out:
        assert r["start"] == start
        start += r["n_tokens"]
    for i, t in enumerate(TEXTS):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        mine = [r for r in out if r["doc_id"] == i * 3 - 5 and r["n_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids.tobytes())]
        assert mine, t


def test_files_hold_small_blocks_and_verify(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * (i % 50)) for i in range(300)], "doc_id long, text string")
    files = k.write_ids(docs, PATH, block=500)
    blocks = spark.read.parquet(files.blocks)
    assert blocks.count() > 20
    whole = {r["doc_id"]: list(r["ids"]) for r in k.read_ids(spark, files).collect()}
    tokenizer = Tokenizer.from_file(PATH)
    assert whole == {i: [*tokenizer.encode(f"text {i} " * (i % 50), add_special_tokens=False).ids, 0] for i in range(300)}
    bad = k.new_path(spark, "bad")
    blocks.withColumn("crc", blocks["crc"] + 1).write.parquet(bad)
    with pytest.raises(Exception, match="damaged"):
        k.read_ids(spark, k.FileSet(bad, files.table, files.parts)).collect()


def test_empty(spark):
    assert k.token_report(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


@pytest.mark.parametrize("n", [0, 1, 7, 1024, 5000, 200_000])
def test_coder(n):
    symbols = np.random.default_rng(n).zipf(1.3, n) % 5000
    table = Table(normalized(np.bincount(symbols, minlength=5000)))
    coded = encode(symbols, table, lanes=256, every=16)
    assert (decode(coded, table) == symbols).all()
    for step, _, _ in coded.checkpoints:
        assert (decode(coded, table, step, step + 16) == symbols[step * 256 : (step + 16) * 256]).all()
    assert len(coded.checkpoints) == max(0, (-(-n // 256) - 1) // 16)


def test_frequencies():
    for counts in ([5], [0, 0], [1] * 50000 + [10**9], list(range(1000))):
        f = normalized(np.array(counts))
        assert f.sum() == 1 << 20 and ((f > 0) == (np.array(counts) > 0)).all() or not sum(counts)

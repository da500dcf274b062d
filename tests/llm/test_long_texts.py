"""One text of some megabytes, longer than what the operators handle at a time, beside short ones."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from parchment.llm import decontaminate, licenses, pieces, quality, repeats, secrets, simhash, tokens

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def text():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    return " ".join(rng.choice(words) for _ in range(500_000))


@pytest.fixture(scope="module")
def docs(spark, text):
    assert len(text) > 3_000_000
    return spark.createDataFrame([(1, "short one"), (2, text + " under the mit license password = abcdefgh1234"), (3, "é " + text[1000:2000]), (4, None)], SCHEMA).repartition(1)


def test_quality(spark, docs, text):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rows = {r["doc_id"]: r for r in quality.quality(docs, labels).collect()}
    assert rows[2]["n_words"] == 500_007 and rows[2]["word_chars"] == len((text + "under the mit license password = abcdefgh1234").replace(" ", "")) and rows[2]["n_repeat_words"] < 5000


def test_simhash(docs, text):
    rows = {r["doc_id"]: r["fingerprint"] for r in simhash.near_components(docs).collect()}
    assert len(set(rows.values())) == 4 and rows[4] == "0" * 16


def test_decontamination(spark, docs, text):
    items = spark.createDataFrame([(7, " ".join(text.split()[400_000:400_025]).upper()), (8, " ".join(text.split()[170:190]))], "item_id long, text string")
    rows = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in decontaminate.decontamination_report(docs, items).collect()}
    assert rows[1] == rows[4] == (0, 0) and rows[2][0] >= 45 and rows[2][1] == 2 and rows[3][1] == 1


def test_scans(docs):
    found = {r["doc_id"]: r for r in licenses.license_scan(docs).collect()}
    assert found[2]["base_labels"] == "mit" and found[2]["first_word"] == 500_000
    assert {r["doc_id"]: r["n_assign"] for r in secrets.secret_digest(docs).collect()} == {1: 0, 2: 1, 3: 0, 4: 0}


def test_repeats(docs, text):
    rows = {r["doc_id"]: r for r in repeats.repeats_report(docs).collect()}
    assert rows[2]["n_removed"] == 0 and rows[3]["n_removed"] == 1000 and rows[3]["kept_sha256"] == hashlib.sha256("é ".encode()).hexdigest()


def test_ids(docs, text):
    whole = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.token_report(docs, path).collect()} == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in whole.items()}
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    assert {r["doc_id"]: (list(r["ids"]), r["round_trip"]) for r in pieces.pieces_report(docs, path).collect()} == {i: (library.encode(t), True) for i, t in whole.items()}

import public_tokenizers
import pytest
import sentencepiece

from parchment.llm import pieces as p

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "The cat sat on the mat. The cat sat on the mat. The cat sat on the mat.", "", None, "a  b\n\n c ", "     deep   spaces\n\tand\ttabs ", "日本語 テキスト ▁▁ literal",
    "é😀 naïve café\nÉtude", "x" * 300, " ".join(f"word{i % 7}" for i in range(5000)), " lead", "trail  ", "\n", "\r\n", "\x00\x01",
]
ROWS = [(i, t, "clash") for i, t in enumerate(TEXTS * 2)]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def expected(library, text):
    """The library reads the mark for a space as a space; in a text it is a character like any other, so its bytes stand for it."""
    return None if "▁" in (text or "") else library.encode(text or "")


@pytest.mark.parametrize("max_words", [0, 1 << 17])
def test_equals_the_library(spark, library, max_words, monkeypatch):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, n_pieces string")
    rows = p.pieces_report(docs, PATH, max_words).collect()
    assert len(rows) == len(ROWS) and all(r["round_trip"] for r in rows)
    for r in rows:
        want = expected(library, TEXTS[r["doc_id"] % len(TEXTS)])
        assert want is None or list(r["ids"]) == want
        assert r["n_pieces"] == len(r["ids"])


def test_tail_that_forgets(library):
    tail = p.Tail(p.load_model(PATH), limit=5)
    for text in ("a b c d", "d e f g h", "a b c d e f g h i j", "j k", "z"):
        got = tail.encode([p.keys_of(text.encode()), p.keys_of(b"d j")], {b"b": b"\0\0\0\0"})
        assert [x.count(b"") - 1 for x in got] == [4 * len(library.encode(text)), 8] and len(tail.known) <= max(5, len(text.split()) + 2)


def test_lattice_alone(spark, library):
    words = [" the", " unbelievable", "\nNew", "    x", " 語", " q😀", " aaaaaaaaaaaaaaaaaaaaaaaa"]
    model = p.load_model(PATH)
    got = {r["word"]: list(r["ids"]) for r in p.lattice(spark.createDataFrame([(w,) for w in words], "word string"), p.piece_table(spark, model), model).collect()}
    assert got == {w: p.merge_pieces(w, model) for w in words}
    assert p.Folder(model).fold(words) == [__import__("numpy").array(got[w], "<u4").tobytes() for w in words]


def brute(word, model):
    """The best sum of scores over all segmentations."""
    if not word:
        return 0.0
    options = [model.scores[word[:k]][1] + brute(word[k:], model) for k in range(1, len(word) + 1) if word[:k] in model.scores]
    if word[0] not in model.scores:
        options.append(model.unknown + brute(word[1:], model))
    return max(options)


def test_viterbi(spark):
    model = p.load_model(PATH, merges=False)
    words = [" the", " sixteen", "\nNewer", " 語x", " aaaaaaa"]
    got = {r["word"]: list(r["ids"]) for r in p.lattice(spark.createDataFrame([(w,) for w in words], "word string"), p.piece_table(spark, model), model).collect()}
    scores = {i: s for i, s in model.scores.values()}
    for w in words:
        assert got[w] == p.best_pieces(w, model)
        unknown = sum(c not in model.scores for c in w)
        assert sum(scores.get(i, 0) for i in got[w]) + unknown * model.unknown == brute(w, model)


def test_decoding_as_the_library_does(spark, library):
    ids = [library.encode(t) for t in TEXTS if t]
    rows = p.decode(spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "n int, ids array<int>"), PATH).collect()
    assert {r["n"]: r["decoded"] for r in rows} == {i: library.decode(x) for i, x in enumerate(ids)}


def test_empty(spark):
    assert p.pieces_report(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []

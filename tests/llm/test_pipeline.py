"""The pipeline on a small table against brute-force versions of its stages, which use nothing of the library."""

import random
import re

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def windows(text):
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    return {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(11)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeio" for c in ("", "n", "st", "rd")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, prose(30)) for i in range(5)]
    docs, labels = [], []
    for i in range(160):
        text = prose(rng.randint(80, 200))
        kind = i % 8
        if kind == 1:
            text = " ".join(w + rng.choice(["$$$", "###", "!!!"]) for w in text.split())
        elif kind == 2 and i > 10:
            text = docs[i - 2][1]
        elif kind == 3 and i > 10:
            words_ = docs[i - 3][1].split()
            words_[len(words_) // 2] = "changed"
            text = "  ".join(words_)
        elif kind == 4:
            text += " " + items[i % 5][1].upper() + " " + prose(5)
        elif kind == 5:
            text += f" password = s3cr3t{i:06d} and é " + prose(4)
        elif kind == 6:
            text = prose(20)
        docs.append((i, text, "en", f"src{i % 3}", len(text)))
        if i % 2 or i % 8 == 0:
            labels.append((i, 0 if kind == 1 else 1, 0))
    docs += [(900, None, None, None, None), (901, "", "en", "s", 0)]
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages_and_run(spark, sf_dir):
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    docs = {r["doc_id"]: r["text"] for r in table("documents").collect()}
    # junk marks and short texts go, so do texts without words; all other kinds are clean prose
    kept = {i: t for i, t in docs.items() if i < 900 and i % 8 not in (1, 6)}
    assert {r["doc_id"] for r in corpus_pipeline.quality_rules(spark, table("documents"), sf_dir).collect()} == set(kept)

    sets = {i: shingles(t) for i, t in kept.items()}
    group = {i: i for i in kept}
    for a in sorted(kept):
        for b in kept:
            if a < b and group[a] != group[b] and jaccard(sets[a], sets[b]) >= 0.8:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {k: new if g == old else g for k, g in group.items()}
    single = {i: kept[i] for i in set(group.values())}
    assert len(single) < len(kept) - 10

    leaks = set().union(*(windows(r["text"]) for r in table("benchmark").collect()))
    clean = {i: t for i, t in single.items() if not windows(t) & leaks}
    assert {i for i in single if i % 8 == 4} == set(single) - set(clean)

    want = {i: re.sub(r"password = s3cr3t\d{6}", "[SECRET]", t) for i, t in clean.items()}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"]: r["text"] for r in rows} == want and len(rows) == len(want)
    assert all(list(r["ids"]) == library.encode(r["text"]) and r["n_pieces"] == len(r["ids"]) and r["n_chars"] == len(r["text"]) for r in rows)
    assert any("[SECRET]" in t for t in want.values())


def test_stages_keep_columns_and_stand_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), sf_dir).collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf_dir).collect() == []

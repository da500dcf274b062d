import random

import pytest

import corpus_pipeline
from parchment.llm import similar


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    passage = [rng.choice(words) for _ in range(40)]
    docs = []
    for k in range(30):
        base = [rng.choice(words) for _ in range(rng.randint(3, 250))] + passage * (k % 2)
        for _ in range(25 if k == 7 else rng.randint(1, 4)):
            copy = base[:]
            for _ in range(rng.randint(0, 7)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            docs.append(" ".join(copy))
    docs += ["", None, "one", "ONE", "two words", "words two", "a b c d e"] + [docs[3]] * 10
    rng.shuffle(docs)
    return list(enumerate(docs))


def firsts(docs):
    sets = {i: shingles(t) for i, t in docs}
    group = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and group[a] != group[b] and jaccard(sets[a], sets[b]) >= 0.8:
                    old, new = max(group[a], group[b]), min(group[a], group[b])
                    group = {k: new if g == old else g for k, g in group.items()}
                    changed = True
    return sorted(set(group.values()))


@pytest.mark.parametrize("first", [1, 64])
def test_firsts_against_brute_force(spark, first):
    docs = corpus(first)
    want = firsts(docs)
    rows = similar.first_of_similar(spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, key string").repartition(4), first).collect()
    assert sorted(r["doc_id"] for r in rows) == want and len(want) < len(docs) - 20
    assert {r["doc_id"]: r["text"] for r in rows} == {i: dict(docs)[i] for i in want} and set(rows[0].asDict()) == {"doc_id", "text", "key"}


def test_stage_drops_copies_with_words_changed(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(900)}" for _ in range(200)]
    few, many = base[:], base[:]
    for k in (30, 90, 150):
        few[k] = "changed"
    for k in range(5, 200, 20):
        many[k] = "changed"
    docs = [(1, " ".join(base)), (2, " ".join(few)), (3, " ".join(many))]
    assert jaccard(shingles(docs[0][1]), shingles(docs[1][1])) >= 0.8 > jaccard(shingles(docs[0][1]), shingles(docs[2][1]))
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string"), "").collect()
    assert sorted(r["doc_id"] for r in out) == [1, 3]

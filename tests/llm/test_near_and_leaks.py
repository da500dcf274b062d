import random
import re

import xxhash

from parchment.llm import decontaminate as d
from parchment.llm import simhash as s
from parchment.llm.components import components


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(keys, linked):
    parent = {k: k for k in keys}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in linked:
        parent[root(a)] = root(b)
    return {k: root(k) for k in keys}


def near_corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(80, 400))]
        for _ in range(rng.randint(1, 5)):
            copy = base[:]
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            docs.append(" ".join(copy))
    docs += ["", None, "one", "ONE", "two words", "É à b c"] + [docs[3]] * 30
    rng.shuffle(docs)
    return list(enumerate(docs))


def check(spark, docs, shard):
    fps = {i: plain_fingerprint(t) for i, t in docs}
    values = sorted(set(fps.values()))
    roots = classes(values, [(a, b) for k, a in enumerate(values) for b in values[k + 1 :] if (a ^ b).bit_count() <= 2])
    least = {}
    for i, f in fps.items():
        least[roots[f]] = min(i, least.get(roots[f], i))
    rows = s.near_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), shard).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{f:016x}", least[roots[f]]) for i, f in fps.items()}
    assert len(rows) == len(docs)
    return least


def test_components_against_brute_force(spark):
    docs = near_corpus(1)
    least = check(spark, docs, 512)
    kept = s.first_of_group(spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, fp string")).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(least.values()) and set(kept[0].asDict()) == {"doc_id", "text", "fp"}


def test_full_shards_are_split(spark):
    check(spark, near_corpus(2), 2)


def test_dense_shard(spark):
    """Fingerprints all within few bits of each other share every block, so splitting goes to the last level."""
    rng = random.Random(5)
    values = {0}
    while len(values) < 300:
        values.add(rng.choice(sorted(values)) ^ (1 << rng.randrange(20)) ^ (1 << rng.randrange(20)))
    links = s.near_links(spark.createDataFrame([(s._signed(v),) for v in values], "fp long"), 4).collect()
    mine = classes(values, [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in links])
    own = classes(values, [(a, b) for a in values for b in values if (a ^ b).bit_count() <= 2])
    group = lambda c: sorted(sorted(k for k in c if c[k] == r) for r in set(c.values()))
    assert group(mine) == group(own)


def test_components_of_a_chain(spark):
    chain = list(range(200))
    random.Random(1).shuffle(chain)
    rows = components(spark.createDataFrame([*zip(chain, chain[1:], strict=False), (500, 500), (None, 3)], "a long, b long")).collect()
    assert {(r["node"], r["root"]) for r in rows} == {(k, 0) for k in range(200)}


def test_near_odd_rows(spark):
    rows = s.near_components(spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c"), (None, "zz")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in rows) == [(-1, -1), (-1, 4), (4, 4), (4, 4)]
    kept = s.first_of_group(spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c"), (None, None)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in kept) == [(-1, ""), (4, "a b c")]
    assert s.near_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def plain_report(docs, items):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    windows = {}
    for item, t in items:
        w = words(t)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(item)
    out = []
    for i, t in docs:
        w = words(t)
        hit, found = set(), set()
        for size in {len(x) for x in windows}:
            for a in range(len(w) - size + 1):
                of = windows.get(tuple(w[a : a + size]))
                if of:
                    hit.update(range(a, a + size))
                    found |= of
        out.append((i, len(w), len(hit), len(found - {None}), bool(hit)))
    return out


def leak_corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"v{i}é" if i % 5 == 0 else f"v{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.choice([2, 5, 9, 10, 11, 30]))) for k in range(12)] + [(3, text(12)), (None, "only here two"), (50, ""), (51, None), (52, "...")]
    docs = []
    for i in range(80):
        parts = [text(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            leak = (rng.choice(items)[1] or "").split()
            cut = rng.randint(0, len(leak))
            parts += [" ".join(leak[:cut]) if rng.random() < 0.4 else " - ".join(leak).upper(), text(rng.randint(0, 4))]
        docs.append((i, "\n".join(parts)))
    return docs + [(80, None), (81, ""), (82, "only here Two"), (82, "only here Two")], items


def test_decontamination_against_brute_force(spark):
    for seed, block in ((1, 1 << 20), (2, 40)):
        docs, items = leak_corpus(seed)
        rows = d.decontamination_report(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), block_words=block).collect()
        got = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in rows)
        assert got == sorted(plain_report(docs, items))


def test_cutting_and_dropping(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "é x A b, c d e f g h i j k. y", 0), (2, "clean é text", 0), (3, None, 0)], "doc_id long, text string, spans int")
    assert {r["doc_id"]: r["text"] for r in d.with_spans_cut(docs, items).collect()} == {1: "é x . y", 2: "clean é text", 3: None}
    assert sorted(r["doc_id"] for r in d.without_contaminated(docs, items).collect()) == [2, 3]
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.without_contaminated(docs, none).count() == 3 and d.decontamination_report(docs.limit(0), items).collect() == []

import hashlib
import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra import numpy as hnp

from parchment.llm import vectors as k

SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def by_definition(rows, parts=8, entries=16, rounds=6):
    """The contract in plain Python integers; rows: vec_id, embedding, label."""
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * size : (p + 1) * size]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(c) for c in zip(*groups[e], strict=True)] if e in groups else c for e, c in enumerate(books[p])]
    out, total = [], {}
    for i, v, label in kept:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
        total[label] = total.get(label, 0) + out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted((repr(i), code, error, total[label], digest) for i, code, error, label in out)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(3)
    return sorted((repr(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in k.vector_codes(df).collect())


@settings(deadline=None)
@given(hnp.arrays(np.int64, st.tuples(st.integers(1, 40), st.integers(1, 5)), elements=st.integers(-3, 3)), st.integers(1, 16), st.integers(0, 99))
def test_nearest_against_all_distances(x, n, seed):
    book = np.random.default_rng(seed).integers(-3, 4, (n, x.shape[1]))
    all_ = ((x[:, None] - book) ** 2).sum(2)
    best, distance = k.nearest(x, book)
    assert best.tolist() == all_.argmin(1).tolist() and distance.tolist() == all_.min(1).tolist()


def test_against_plain_integers(spark):
    rng = random.Random(5)
    rows = [(i * 7 % 301, [rng.choice([rng.gauss(0, 0.3), round(rng.gauss(0, 1)) / 4]) for _ in range(16)], rng.choice([None, 1, 2, -3])) for i in range(300)]
    rows += [(500, None, 1), (0, [1.0] * 15 + [math.nan], 1), (-1, [math.inf] * 16, 2), (-2, [None] + [0.0] * 15, None)]  # dropped
    rows += [(1000 + i, [0.5] * 16, None) for i in range(80)] + [(3, [0.25] * 16, 1), (3, [0.25] * 16, 1), (None, [0.1] * 16, 9)]  # copies, ties, no id
    assert run(spark, rows) == by_definition(rows)


def test_few_rows_large_components_and_no_rows(spark):
    rows = [(i, [float(i % 3)] * 8, None) for i in range(5)]
    assert run(spark, rows) == by_definition(rows)
    rows = [(i, [float((-1) ** i * 30_000 + i)] * 64, i % 2) for i in range(40)]
    assert run(spark, rows) == by_definition(rows)
    # another length, a length that 8 does not divide, and components without an exact distance are dropped
    assert run(spark, [*rows, (-5, [1.0] * 8, 1), (-6, [1.0] * 12, 1), (-7, [], 1), (-8, [1e30] * 64, 1)]) == by_definition(rows)
    assert run(spark, []) == [] == run(spark, [(1, None, 2), (2, [math.nan] * 8, 2)])


def test_labels_beyond_the_broadcast(spark, monkeypatch):
    rows = [(i, [float(i % 7), float(i % 5)] * 8, i % 4 or None) for i in range(60)]
    want = by_definition(rows)
    monkeypatch.setattr(k, "MAX_LABELS", 2)
    assert run(spark, rows) == want

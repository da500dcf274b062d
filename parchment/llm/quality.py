"""Quality rules: word counts per text, and a calibrated logistic regression on hashed word and character n-grams.

The model is linear in the mean weight of a text's hashed n-grams (word 1- and 2-grams, character 3- and 4-grams),
so that scoring is one gather and one running sum per family. It is trained on a bounded sample of labelled rows
(MAX_ROWS, chosen by the hash of their id), its margins are turned into probabilities by Platt's method on a fifth
of that sample that the weights never saw, and a text is kept when its probability reaches KEEP_AT.

Null and empty texts have no words and fail the base rules. Repeated rows are judged alike, one output row each.
Extra columns are not read. Labels with a null are left out, of contradicting labels of one document the lowest
counts; with labels of one class only, or none, the model keeps all. An empty table gives an empty result. Very long
texts are judged whole, one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import PLAIN, chunks, freeing, mixed, slices, spans, text_columns, utf8, word_numbers

#: Labelled rows that the classifier is fitted on, at most.
MAX_ROWS = 1500
#: Weights of each n-gram family.
DIMS = 1 << 16
WORDS, CHARS = (1, 2), (3, 4)
#: A text is kept when its calibrated probability of being good is at least this.
KEEP_AT = 0.5
#: Base rules: fewest words; largest share, in hundredths, of words in repeated windows of three.
MIN_WORDS, MAX_REPEATED = 50, 50
_SYMBOLS = np.array([chr(b) in "#*$%&|<>" for b in range(256)])
_WHITE = b" \t\n\v\f\r"


def _grams(raw: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, word: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each family: the weight numbers of its n-grams in order, and each row's first and last + 1."""
    first = np.searchsorted(starts, offsets)
    for n in WORDS:
        h = word
        for k in range(1, n):
            h = mixed(h[:-1] * np.uint64(3) + word[k:]) if len(h) > 1 else h[:0]
        yield (h >> np.uint64(48)).astype(np.int64), first[:-1], np.maximum(first[:-1], first[1:] - (n - 1))
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets]
    for n in CHARS:
        h = np.zeros(max(0, len(points) - n + 1), np.uint32)
        for k in range(n):
            h = (h + points[k : k + len(h)]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        yield (h >> np.uint32(16)).astype(np.int64), at[:-1], np.maximum(at[:-1], at[1:] - (n - 1))


@dataclass
class Model:
    """Weights by family, intercept, and the two calibration numbers of Platt's method."""

    weights: np.ndarray
    intercept: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, families) -> np.ndarray:
        total: np.ndarray | float = self.intercept
        for w, (grams, a, b) in zip(self.weights, families, strict=True):
            sums = np.concatenate([[0.0], np.cumsum(w[grams], dtype=np.float64)])
            total = total + (sums[np.minimum(b, len(grams))] - sums[np.minimum(a, len(grams))]) / np.maximum(1, b - a)
        return total

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -30, 30)))


def _views(column: pa.Array):
    """For each chunk of a text column: its bytes, offsets, word spans, word numbers (equal for equal words only) and word hashes."""
    raw, offsets = utf8(column)
    for i, j in chunks(offsets):
        part, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends = spans(part, at, PLAIN)
        yield part, at, starts, ends, *word_numbers(part, starts, ends)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's distinct n-grams with their shares of its family."""
    for batch in batches:
        ids, label, texts = text_columns(batch, "doc_id", "label", "text")
        grams, shares = [], []
        for part, at, starts, ends, _, word in _views(texts):
            families = list(_grams(part, at, starts, ends, word))
            for k in range(len(at) - 1):
                found = [np.unique(g[a[k] : b[k]], return_counts=True) for g, a, b in families]
                grams.append(np.concatenate([x + f * DIMS for f, (x, _) in enumerate(found)]).astype(np.int32))
                shares.append(np.concatenate([c / max(1, c.sum()) for _, c in found]).astype(np.float32))
        yield pa.RecordBatch.from_arrays([ids, label, pa.array(grams, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))], ["doc_id", "label", "grams", "shares"])


def _fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, steps: int = 60, rate: float = 1.0) -> Model:
    """Logistic regression by full Adagrad steps with a little weight decay; every fifth row calibrates."""
    model = Model(np.zeros((len(WORDS) + len(CHARS), DIMS), np.float32))
    if len(set(y.tolist())) < 2:
        return Model(model.weights, intercept=30.0)
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held[:] = False
    use = np.flatnonzero(~held)
    flat, share = np.concatenate([rows[i][0] for i in use]), np.concatenate([rows[i][1] for i in use])
    row = np.repeat(np.arange(len(use), dtype=np.int32), [len(rows[i][0]) for i in use])
    target, size = y[use].astype(np.float64), model.weights.size
    w, seen, b, seen_b = np.zeros(size), np.full(size, 1e-12), 0.0, 1e-12
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, share * w[flat], len(use)) + b, -30, 30)))
        g = np.bincount(flat, share * ((p - target) / len(use))[row], size) + 1e-7 * w
        seen += g * g
        w -= rate * g / np.sqrt(seen)
        g_b = float(np.mean(p - target))
        seen_b += g_b * g_b
        b -= rate * g_b / seen_b**0.5
    model = Model(w.reshape(model.weights.shape).astype(np.float32), b)
    if held.any():
        m = np.array([float((w[rows[i][0]] * rows[i][1]).sum()) + b for i in np.flatnonzero(held)])
        model.slope, model.shift = _platt(m, y[held])
    return model


def _platt(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the sigmoid that fits the labels best, with Platt's smoothed targets, by Newton steps."""
    good, bad = int(y.sum()), int(len(y) - y.sum())
    t = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    x, at = np.stack([m, np.ones_like(m)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (p - t))
        at = at - step * min(1.0, 1.0 / max(1e-9, np.abs(step).max()))
    return (float(at[0]), float(at[1])) if at[0] > 0 else (1.0, 0.0)


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of _features, in their order: one row with the model."""
    rows, labels = [], []
    for batch in batches:
        label, grams, shares = text_columns(batch, "label", "grams", "shares")
        labels += label.to_pylist()
        # copies of their own, so that the batches' buffers go
        rows += [(np.array(g.values, np.int32), np.array(s.values, np.float32)) for g, s in zip(grams, shares, strict=True)]
    model = _fit(rows, np.array([x > 0 for x in labels], np.int64))
    values = (model.weights.tobytes(), model.intercept, model.slope, model.shift)
    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in values], names=["weights", "intercept", "slope", "shift"])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fits the classifier on at most max_rows labelled documents, the first by the hash of their id.

    docs: doc_id, text. labels: doc_id, quality (above 0: good). One task gets the n-gram shares of these rows, of which
    a text has at most one for each weight; only the model, of a fixed size, reaches the driver.
    """
    picked = labels.select("doc_id", F.col("quality").cast("int").alias("label")).dropna().groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("label").alias("label"), F.min("text").alias("text"))
    shares = sample.select("doc_id", "label", "text").mapInArrow(freeing(_features), "doc_id long, label int, grams array<int>, shares array<float>")
    ordered = shares.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    row = ordered.mapInArrow(_fitted, "weights binary, intercept double, slope double, shift double").first()
    if row is None:  # no labelled rows, and so no task
        return _fit([], np.zeros(0, np.int64))
    return Model(np.frombuffer(row["weights"], np.float32).reshape(len(WORDS) + len(CHARS), DIMS), row["intercept"], row["slope"], row["shift"])


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[edges])


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers from 0 that are equal for equal pairs only, of numbers below 2**31."""
    return np.unique(a << 31 | b, return_inverse=True)[1]


def _repeated(word: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each row: its words in windows of three that its row has twice or more. word: equal for equal words only."""
    n = len(word)
    covered = np.zeros(n, bool)
    if n >= 3:
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        key = _pairs(_pairs(_pairs(word[:-2], word[1:-1]), word[2:]), row[:-2])
        at = np.flatnonzero(row[:-2] == row[2:])
        order = at[np.argsort(key[at], kind="stable")]
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        for k in range(3):
            covered[order[twice] + k] = True
    return _sums(covered, first)


def _repeated_lines(text: bytes) -> int:
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line.strip(_WHITE):
            n += line in seen
            seen.add(line)
    return n


def _judged(texts: pa.Array, model: Model, keep_at: float) -> list[np.ndarray]:
    """The columns of SCHEMA but doc_id for some texts, of which there is one at least."""
    parts = []
    for raw, at, starts, ends, number, word in _views(texts):
        first = np.searchsorted(starts, at)
        n_words, repeated = np.diff(first), _repeated(number, first)
        whole = raw.tobytes()
        failed = (n_words < MIN_WORDS) | (100 * repeated > MAX_REPEATED * n_words)
        p = model.probability(model.margins(_grams(raw, at, starts, ends, word)))
        lines = np.array([_repeated_lines(whole[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], np.int64)
        parts.append((n_words, _sums(PLAIN[raw] & ((raw & 0xC0) != 0x80), at), _sums(_SYMBOLS[raw], at), lines, repeated, failed, ~failed & (p >= keep_at), p))
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def score(docs: DataFrame, model: Model, keep_at: float = KEEP_AT) -> DataFrame:
    """One row of counts and verdicts for each row of docs (doc_id, text); SCHEMA has the columns."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, texts = text_columns(batch, "doc_id", "text")
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, _judged(texts, model, keep_at))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(freeing(scored), SCHEMA)


def kept_documents(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, keep_at: float = KEEP_AT) -> DataFrame:
    """Trains on labels; docs, with all their columns, without the rows that are not kept."""
    model = train(docs, labels, max_rows)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(_judged(text_columns(batch, "text")[0], model, keep_at)[6]))

    return docs.mapInArrow(freeing(kept), docs.schema)


def quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, keep_at: float = KEEP_AT) -> DataFrame:
    """Trains on labels, then judges every row of docs."""
    return score(docs, train(docs, labels, max_rows), keep_at)

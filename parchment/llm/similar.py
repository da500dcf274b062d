"""SimHash near-dedup down to a similarity: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Pairs are proposed in two ways and decided by the sets themselves. The fingerprints of the sets go through the BK-trees
of simhash.py, which find the closest copies. Sets of 0.8 may differ in any number of the fingerprint's bits, so prefixes
of the sets propose the rest: of a set of n shingles in one fixed order, the first n - ceil(0.8 n) + 1 make up its prefix;
two sets that similar have a shared shingle in both prefixes, and at the first one what still follows must be long enough.
Every similar pair is so found, up to equal 64-bit hashes of different shingles. The order puts common shingles last, so
that a passage of very many documents is hardly in a prefix; a sample tells which are common, and which order it gives
changes the costs only, not what is found.

In a bucket, each set is paired with the next NEAR ones. A bucket of more sets goes on in rounds: sets outside its largest
component so far are paired with all others, FIRST of them in the first round and more in each further one, until no two of
different components are left. A group of near copies so takes a number of pairs in proportion to its size.

Most pairs share a passage only. Sketches of the sets, the numbers of their shingles in bins of hashes, bound from above what
two sets share: rounds send on only pairs that a sketch of RANGES bins leaves open, and whole sets decide only those that one
of about as many bins as shingles leaves open too.

Null and empty texts have no words and an empty set; equal sets count as similar. A text of fewer words is one shingle.
Repeated rows are one document, of which one row stays. A null doc_id stays only where its class has no other. Extra
columns pass through, whatever their names. A very long text is hashed whole, and its set is one value.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import bloom_filter, with_maybe
from .components import components, first_of_classes, merged
from .shared import LOWER, PLAIN, chunks, freeing, mixed, spans, stored, text_columns, utf8, word_hashes
from .simhash import near_links

#: Words of a shingle.
WORDS = 5
#: Sets after it in a bucket that each set is paired with.
NEAR = 4
#: Sets of a bucket that the first round pairs with all others; four times as many in each further one.
FIRST = 8
#: One in EVERY documents tells common shingles: those in COMMON of them or more, of which at most MAX_COMMON are ranked.
EVERY, COMMON, MAX_COMMON = 8, 3, 1 << 16
#: Bins of the small sketch that goes along in the rounds, 8 to a long.
RANGES = 128
_SMALL = [f"s{k}" for k in range(RANGES // 8)]
#: Bits of the table that marks common shingles, of which a shingle takes the one that its top bits number: 8 MB.
BITS = 26
#: Bytes of text that are hashed at a time; a longer text is a chunk of its own.
CHUNK = 1 << 18
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_BUCKETS = "a long, b long, shingle long, key long, n int, place int"


def _similar(na, nb, shared):
    """Whether shared of na and nb elements make a Jaccard similarity of 0.8 or more."""
    return 9 * shared >= 4 * (na + nb)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """For each text, its distinct shingles as hashes in ascending order."""
    raw, offsets = utf8(column)
    for i, j in chunks(offsets, CHUNK):
        part, at = LOWER[raw[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
        starts, ends = spans(part, at, PLAIN)
        words = word_hashes(part, starts, ends)
        first = np.searchsorted(starts, at)
        n = max(0, len(words) - WORDS + 1)
        joined = np.zeros(n, np.uint64)
        for k in range(WORDS):
            joined = mixed(joined * _FACTOR + words[k : k + n])
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= WORDS:
                yield np.unique(joined[a : b - WORDS + 1])
            else:
                short = np.full(1, b - a, np.uint64)
                for k in range(a, b):
                    short = mixed(short * _FACTOR + words[k : k + 1])
                yield short[: b > a]


def _key(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), 42) - (1 << 63) if len(shingles) else 0


def _fingerprint(shingles: np.ndarray) -> int:
    """As simhash.fingerprint, of the distinct shingles; signed."""
    counts = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(shingles), bitorder="little").view(np.int64)[0])


def _sketch(shingles: np.ndarray) -> bytes:
    """How many shingles lie in each of 2**k equal ranges of hashes, 2**k being their number or more; no bytes where a range has more than a byte holds."""
    k = max(1, (len(shingles) - 1).bit_length())
    counts = np.bincount((shingles >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def _small(shingles: np.ndarray) -> np.ndarray:
    """As _sketch with RANGES bins, as longs; a bin of 255 may hold more."""
    k = RANGES.bit_length() - 1
    return np.minimum(np.bincount((shingles >> np.uint64(64 - k)).astype(np.int64), minlength=RANGES), 255).astype(np.uint8).view(np.int64)


def _most_shared(x: bytes, y: bytes) -> tuple[int, int, int]:
    """Of two sketches: the sizes of their sets, and how many shingles these can share at most."""
    p, q = sorted((np.frombuffer(s, np.uint8).astype(np.int64) for s in (x, y)), key=len)
    return int(p.sum()), int(q.sum()), int(np.minimum(p, q.reshape(len(p), -1).sum(1)).sum())


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for k in range(0, whole.num_rows, 500):
            ids, tag, texts = text_columns(whole.slice(k, 500), "doc_id", "tag", "text")
            rows = [(_key(x), _fingerprint(x), _sketch(x), _small(x)) for x in shingle_sets(texts)]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))]
            small = [pa.array(c) for c in np.stack([r[3] for r in rows], 1)]
            yield pa.RecordBatch.from_arrays([ids, tag, *columns, *small], names=["doc_id", "tag", "key", "fp", "sketch", *_SMALL])


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """Key and set of the texts; copies in one task only once, so that very many of them do not meet later."""
    seen: set[int] = set()
    for batch in batches:
        for x in shingle_sets(batch.column(0)):
            key = _key(x)
            if len(x) and key not in seen:
                seen.add(key)
                yield key, x


def _some(batches: Iterator[pa.RecordBatch], n: int = 100) -> Iterator[list[tuple[int, np.ndarray]]]:
    """What _once gives, n at a time."""
    rows = _once(batches)
    while some := list(itertools.islice(rows, n)):
        yield some


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for some in _some(batches):
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x for _, x in some]).view(np.int64))], names=["shingle"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for some in _some(batches):
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.int64()), pa.array([x.tobytes() for _, x in some], pa.binary())], names=["key", "shingles"])


def _marks(shingles: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether each shingle's bit is set: so for all common ones, and a few others."""
    at = shingles >> np.uint64(64 - BITS)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _prefixes(held):
    """held: the most common shingles in ascending order, the rank of each, and the bits of all common ones. Any order will do that is the same everywhere."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, rank, bits = held.value
        for some in _some(batches):
            found = []
            for _, x in some:
                late = np.where(_marks(x, bits), 1, 0)
                if len(common):
                    at = np.minimum(np.searchsorted(common, x), len(common) - 1)
                    late = np.where(common[at] == x, 2 + rank[at], late)
                found.append(x[np.argsort(late, kind="stable")][: len(x) - (4 * len(x) + 4) // 5 + 1])
            sizes = [len(p) for p in found]
            columns = [
                np.concatenate(found).view(np.int64), np.repeat(np.array([k for k, _ in some], np.int64), sizes),
                np.repeat(np.array([len(x) for _, x in some], np.int32), sizes), np.concatenate([np.arange(n, dtype=np.int32) for n in sizes]),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["shingle", "key", "n", "place"])

    return mapped


def _whole(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows in order of shingle, the first name, as an array of columns, and where its buckets start; a bucket that a batch cuts off waits for its rest."""
    held: list[np.ndarray] = []
    for batch in batches:
        rows = np.stack([x.to_numpy().astype(np.int64) for x in text_columns(batch, *names)])
        if not rows.shape[1]:
            continue
        if held and held[-1][0, -1] == rows[0, -1]:  # nothing but the bucket that waits already
            held.append(rows)
            continue
        whole = np.concatenate([*held, rows], 1)
        cut = int(np.searchsorted(whole[0], whole[0, -1]))
        if cut:
            yield whole[:, :cut], np.flatnonzero(np.append(True, np.diff(whole[0, :cut]) != 0))
        held = [whole[:, cut:].copy()]
    if held:
        whole = np.concatenate(held, 1)
        yield whole, np.flatnonzero(np.append(True, np.diff(whole[0]) != 0))


def _batch(a=None, b=None, left=None) -> pa.RecordBatch:
    """Pairs a and b, or rows of buckets that go on."""
    none, size = pa.nulls, len(a) if a is not None else left.shape[1]
    kinds = [pa.int64()] * 4 + [pa.int32()] * 2
    columns = [a, b, None, None, None, None] if a is not None else [None, None, *left]
    return pa.RecordBatch.from_arrays([none(size, t) if c is None else pa.array(c).cast(t) for c, t in zip(columns, kinds, strict=True)], names=["a", "b", "shingle", "key", "n", "place"])


def _may(na, nb, i, j):
    """Whether two sets whose first shared shingle is at places i and j can be similar."""
    return _similar(na, nb, np.minimum(na - i, nb - j))


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (shingle, key): pairs of each with the next NEAR, and the rows of larger buckets."""
    for rows, _ in _whole(batches, "shingle", "key", "n", "place"):
        rows = rows[:, np.append(True, (np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0))]  # copies of several tasks
        shingle, key, n, place = rows
        for d in range(1, NEAR + 1):
            i = np.flatnonzero(shingle[d:] == shingle[:-d]) if d < len(shingle) else np.zeros(0, np.int64)
            i = i[_may(n[i], n[i + d], place[i], place[i + d])]
            if len(i):
                yield _batch(key[i], key[i + d])
        _, at, size = np.unique(shingle, return_inverse=True, return_counts=True)
        large = rows[:, size[at] > NEAR + 1]
        if large.shape[1]:
            yield _batch(left=large)


def _rounds(reps: int):
    """Rows in order of (shingle, key) with the root and small sketch of each: pairs of sets outside the largest component that may be similar, and what goes on."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in _whole(batches, "shingle", "key", "n", "place", "root", *_SMALL):
            for i, j in zip(starts.tolist(), [*starts[1:].tolist(), rows.shape[1]], strict=True):
                bucket = rows[:, i:j]
                _, key, n, place, root = bucket[:5]
                small = np.ascontiguousarray(bucket[5:].T).view(np.uint8)
                full = (small == 255).any(1)
                names, count = np.unique(root, return_counts=True)
                outside = np.flatnonzero(root != names[np.argmax(count)])
                left = np.ones(j - i, bool)
                for r in outside[:reps].tolist():
                    left[r] = False
                    to = np.flatnonzero(left & (root != root[r]) & _may(n, n[r], place, place[r]))
                    to = to[full[r] | full[to] | _similar(n[to], n[r], np.minimum(small[to], small[r]).sum(1, dtype=np.int64))]
                    if len(to):
                        yield _batch(np.minimum(key[to], key[r]), np.maximum(key[to], key[r]))
                if len(outside) > reps:
                    yield _batch(left=bucket[:4, left])

    return mapped


def _decided(batches: Iterator[pa.RecordBatch], similar) -> Iterator[pa.RecordBatch]:
    """The pairs a and b for whose values x and y similar holds."""
    for batch in batches:
        a, b, x, y = text_columns(batch, "a", "b", "x", "y")
        hit = [similar(p.as_buffer().to_pybytes(), q.as_buffer().to_pybytes()) for p, q in zip(x, y, strict=True)]
        yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(hit, pa.bool_()))


def _open(x: bytes, y: bytes) -> bool:
    return not (x and y) or bool(_similar(*_most_shared(x, y)))


def _verified(x: bytes, y: bytes) -> bool:
    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    return bool(_similar(len(p), len(q), len(p) + len(q) - len(np.unique(np.concatenate([p, q])))))


def _filtered(pairs: DataFrame, values: DataFrame, similar) -> DataFrame:
    """Of pairs, those for whose values (key, value) similar holds."""
    side = lambda end, name: values.select(F.col("key").alias(end), F.col("value").alias(name))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").mapInArrow(freeing(lambda batches: _decided(batches, similar)), "a long, b long")


def _among(keys: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """rows whose column key a Bloom filter of keys (key) lets pass: all that are among keys, and few others."""
    blooms, n_blocks = bloom_filter(keys, keys.count())
    return with_maybe(rows, F.col(key), stored(blooms, "blooms"), n_blocks, "maybe_").filter("maybe_").drop("maybe_")


def _verify(pairs: DataFrame, rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Of the pairs a and b, those that are similar. rows: tag, key, sketch of docs (tag, text)."""
    ends = lambda pairs, name: stored(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), name)
    pairs = stored(pairs.distinct(), "pairs")
    needed = ends(pairs, "needed")
    sketches = _among(needed, rows, "key").select("key", F.col("sketch").alias("value")).groupBy("key").agg(F.first("value").alias("value"))
    left = stored(_filtered(pairs, sketches, _open), "open")
    needed = ends(left, "needed")
    tags = stored(_among(needed, rows, "key").select("key", "tag").groupBy("key").agg(F.min("tag").alias("key_")).select(F.col("key_").alias("key")).distinct(), "tags")
    sets = _among(tags, docs, "tag").select("text").mapInArrow(freeing(_sets), "key long, shingles binary").join(needed, "key", "left_semi")
    sets = stored(sets.groupBy("key").agg(F.first("shingles").alias("value")), "sets")
    return stored(_filtered(left, sets, _verified), "links")


def _close(rows: DataFrame) -> DataFrame:
    """Pairs of keys whose fingerprints are equal or linked by the BK-trees: each key with the least of its own fingerprint, and those with each other."""
    keys = rows.select("key", "fp").distinct().filter("key <> 0")
    least = stored(keys.groupBy("fp").agg(F.min("key").alias("least")), "fingerprints")
    links = near_links(least.select("fp"))
    ends = links.join(least.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(least.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    pairs = keys.join(least, "fp").select(F.col("key").alias("x"), F.col("least").alias("y")).unionByName(ends.select("x", "y"))
    return pairs.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def similar_roots(docs: DataFrame, rows: DataFrame, first: int = FIRST) -> DataFrame:
    """docs: tag, text; rows: tag, key, fp, sketch of each. Returns key and root, the least key that pairs of similar sets lead to, of sets that have such a pair."""
    spark, texts = docs.sparkSession, docs.select("text")
    counted = texts.filter(F.pmod(F.xxhash64("text"), F.lit(EVERY)) == 0).mapInArrow(freeing(_shingles), "shingle long").groupBy("shingle").agg(F.count("*").alias("n"))
    counted = stored(counted.filter(F.col("n") >= COMMON), "common")
    ranked = counted.orderBy(F.desc("n"), "shingle").limit(MAX_COMMON).toArrow()  # MAX_COMMON rows at most
    shingle = ranked["shingle"].to_numpy().view(np.uint64)
    order = np.argsort(shingle)
    bit = F.shiftrightunsigned("shingle", 64 - BITS)
    words = counted.groupBy(F.shiftrightunsigned(bit, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63).cast("int"))).alias("bits")).toArrow()  # a row for each word of the table at most
    bits = np.zeros(1 << (BITS - 6), np.uint64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    held = spark.sparkContext.broadcast((shingle[order], len(order) - order, bits))
    prefixes = texts.mapInArrow(freeing(_prefixes(held)), "shingle long, key long, n int, place int")
    found = stored(prefixes.repartition("shingle").sortWithinPartitions("shingle", "key").mapInArrow(freeing(_near), _BUCKETS), "near")
    met = found.filter("a is not null").select("a", "b")
    links = _verify(met.unionByName(_close(rows)), rows, docs)
    roots = stored(components(links).withColumnRenamed("node", "key"), "roots")
    while True:
        wide = found.filter("shingle is not null").select("shingle", "key", "n", "place")
        if wide.isEmpty():
            return roots
        wide = stored(wide.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")), "wide")
        mixed_ = wide.groupBy("shingle").agg(F.min("root").alias("p"), F.max("root").alias("q")).filter("p <> q").select("shingle")
        wide = wide.join(mixed_, "shingle", "left_semi")
        keys = stored(wide.select("key").distinct(), "needed")
        small = _among(keys, rows, "key").groupBy("key").agg(*(F.first(c).alias(c) for c in _SMALL))
        found = stored(wide.join(small, "key").repartition("shingle").sortWithinPartitions("shingle", "key").mapInArrow(freeing(_rounds(first)), _BUCKETS), "wide")
        if not found.isEmpty():
            roots = merged(roots, _verify(found.filter("a is not null").select("a", "b"), rows, docs))
        first *= 4


def first_of_similar(docs: DataFrame, first: int = FIRST) -> DataFrame:
    """docs (doc_id, text, and any other columns) without all but one document of each component of similar ones: the one of the least doc_id, of equal ids that of the least text hash."""
    tagged = docs.select("doc_id", F.xxhash64("text").alias("tag"), "text")
    rows = stored(tagged.mapInArrow(freeing(_keys), "doc_id long, tag long, key long, fp long, sketch binary, " + ", ".join(f"{c} long" for c in _SMALL)), "keys")
    return first_of_classes(docs, rows.select("doc_id", "tag", "key"), similar_roots(tagged.select("tag", "text"), rows, first))

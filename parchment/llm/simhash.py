"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked through BK-trees.

Two fingerprints that differ in at most two of four 16-bit blocks' bits agree in two whole blocks. Each distinct
fingerprint therefore goes to six shards, one for each pair of blocks, and every link lies inside some shard. A shard
of more than SHARD members is split: of its free bits, cut into three parts, two linked members agree in one part at
least. After three splits no more than ten bits are free, so no shard has over 1,024 distinct members.

A shard's tree keys the children of a node by their Hamming distance to it; a search with radius r at distance d from
a node follows only the edges d - r to d + r. Trees reach the tasks that search them by the shuffle, not through the
driver, as together they hold every fingerprint.

Null and empty texts have no words: their fingerprint is zero, and they are linked like others. Repeated rows have
equal fingerprints and so one component; a null doc_id is never a component's least id, unless all its ids are null.
Extra columns are not read. An empty table gives an empty result. A very long text is hashed whole, in stretches of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components, first_of_classes
from .shared import stored, text_columns

#: Fingerprints with at most this many differing bits are linked; the shards below rely on two.
RADIUS = 2
#: Words of a shingle.
WORDS = 3
#: Members of a shard that are searched as one tree.
SHARD = 512
_BLOCK = 1 << 16


def fingerprint(text: bytes) -> int:
    """Of lower-cased (A-Z) text; signed, as Spark holds it."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - WORDS + 1)
    of = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for i in range(0, n, _BLOCK):
        j = min(n, i + _BLOCK)
        last = ends[i + WORDS - 1 : j + WORDS - 1] if len(words) >= WORDS else ends[-1:]
        h = np.array([of(joined[a:b], 42) for a, b in zip(starts[i:j].tolist(), last.tolist(), strict=True)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, fp (a long), and tag, a hash that tells rows of one doc_id apart by their text."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, tag = text_columns(batch, "doc_id", "text", "tag")
            fp = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts.cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([ids, pa.array(fp, pa.int64()), tag], names=["doc_id", "fp", "tag"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("tag")).mapInArrow(mapped, "doc_id long, fp long, tag long")


class BKTree:
    """Values as nodes; the children of a node are keyed by their Hamming distance to it."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def search(self, value: int, radius: int) -> list[int]:
        """Positions of the values within radius."""
        found, todo = [], [0] if self.values else []
        while todo:
            i = todo.pop()
            d = (self.values[i] ^ value).bit_count()
            if d <= radius:
                found.append(i)
            edges = self.children[i]
            if len(edges) > 2 * radius + 1:
                todo += [edges[k] for k in range(d - radius, d + radius + 1) if k in edges]
            else:
                todo += [j for k, j in edges.items() if abs(k - d) <= radius]
        return found

    def insert(self, value: int) -> int:
        new = len(self.values)
        self.values.append(value)
        self.children.append({})
        i = 0
        while i != new:
            i = self.children[i].setdefault((self.values[i] ^ value).bit_count(), new)
        return new


def tree_links(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links among values (distinct, unsigned) that connect all within radius of each other: a forest, not all pairs."""
    tree, parent, links = BKTree(), [], []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for v in values:
        near = tree.search(v, radius)
        new = tree.insert(v)
        parent.append(new)
        for i in near:
            a, b = root(i), root(new)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((v, tree.values[i]))
    return links


def _parts(mask: int, n: int) -> list[int]:
    """The bits that mask lacks, in n runs of about equal length."""
    free = [1 << b for b in range(64) if not mask >> b & 1]
    return [sum(free[len(free) * k // n : len(free) * (k + 1) // n]) for k in range(n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_QUARTERS = _parts(0, 4)
#: Masks of the shards by level; the masks of a level's shards lead to three of the next.
LEVELS = [[a | b for i, a in enumerate(_QUARTERS) for b in _QUARTERS[i + 1 :]]]
for _ in range(3):
    LEVELS.append([m | p for m in LEVELS[-1] for p in _parts(m, 3)])


def _split(level: int) -> Column:
    """The masks of the next level for the column mask."""
    array = lambda masks: F.array(*(F.lit(_signed(m)).cast("long") for m in masks))
    entries = [x for m in dict.fromkeys(LEVELS[level]) for x in (F.lit(_signed(m)).cast("long"), array(m | p for p in _parts(m, 3)))]
    return F.element_at(F.create_map(*entries), F.col("mask"))


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (mask, shard): links of each shard. A shard that a batch cuts off waits for its rest."""
    rest = np.zeros((3, 0), np.int64)

    def linked(rows: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)) + 1
        fps = rows[2].view(np.uint64).tolist()
        edges = [e for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fps)], strict=True) for e in tree_links(fps[a:b])]
        both = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    for batch in batches:
        rows = np.concatenate([rest, np.stack([x.to_numpy() for x in text_columns(batch, "mask", "shard", "fp")])], 1)
        if rows.shape[1]:
            whole = int(np.argmax((rows[0] == rows[0, -1]) & (rows[1] == rows[1, -1])))
            rest = rows[:, whole:]
            if whole:
                yield linked(rows[:, :whole])
    if rest.shape[1]:
        yield linked(rest)


def near_links(nodes: DataFrame, shard_size: int = SHARD) -> DataFrame:
    """nodes: distinct fp. Returns a and b, links that connect what is connected by pairs within RADIUS."""
    rows = nodes.select("fp", F.explode(F.array(*(F.lit(_signed(m)).cast("long") for m in LEVELS[0]))).alias("mask"))
    edges = None
    for level in range(len(LEVELS)):
        rows = rows.withColumn("shard", F.col("fp").bitwiseAND(F.col("mask")))
        full = rows.groupBy("mask", "shard").agg(F.count("*").alias("n")).filter("n > 1")
        rows = stored(rows.join(full, ["mask", "shard"]), "shards")
        last = level == len(LEVELS) - 1
        small = rows if last else rows.filter(F.col("n") <= shard_size)
        new = small.select("mask", "shard", "fp").repartition("mask", "shard").sortWithinPartitions("mask", "shard", "fp").mapInArrow(_links, "a long, b long")
        edges = new if edges is None else edges.unionByName(new)
        large = rows.filter(F.col("n") > shard_size)
        if last or large.isEmpty():
            return edges
        rows = large.select("fp", F.explode(_split(level)).alias("mask")).distinct()  # two masks may lead to one


def _classes(fps: DataFrame, shard_size: int = SHARD) -> DataFrame:
    """fps: doc_id, fp. Returns fp, root (an fp of its component) and component_id."""
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = stored(components(near_links(nodes.select("fp"), shard_size)), "roots").withColumnRenamed("node", "fp")
    joined = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = joined.join(roots.select("fp"), "fp", "left_semi").groupBy("root").agg(F.min("least").alias("component"))
    # written down, so that a join with it deals both sides anew and can split the rows of a fingerprint that very many copies share
    return stored(joined.join(least, "root", "left").select("fp", "root", F.coalesce("component", "least").alias("component_id")), "classes")


def near_components(docs: DataFrame, shard_size: int = SHARD) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits), component_id (the least doc_id reachable)."""
    fps = stored(fingerprints(docs), "fingerprints")
    return fps.join(_classes(fps, shard_size), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def first_of_group(docs: DataFrame, shard_size: int = SHARD) -> DataFrame:
    """docs without all but one document of each component: the one of the least doc_id, of equal ids that of the least text hash."""
    rows = stored(fingerprints(docs), "fingerprints").withColumnRenamed("fp", "key")
    roots = stored(components(near_links(rows.select(F.col("key").alias("fp")).distinct(), shard_size)), "roots")
    return first_of_classes(docs, rows, roots.withColumnRenamed("node", "key"))

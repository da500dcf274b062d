"""Benchmark decontamination: an FM-index of each shard's text, searched backwards for the windows of benchmark items.

A shard is some documents of an Arrow batch, of SHARD bytes or one. Its text is the sequence of its words as numbers: a word that no window
has is the separator 0, as is the end of a document, and stretches between separators that are shorter than the
shortest window are left out, since no window can occur in them. Windows are found by backward search through ranks
of a wavelet matrix, their places by sampled suffix positions; overlapping and touching places merge into removal spans.

The benchmark goes to the tasks in blocks of at most BLOCK_WORDS words (an item of more words is a block of its own),
one pass over the documents each; with several blocks the passes' spans are merged per document. Words are compared by
their bytes.

Null and empty texts have no words and no hits. Items without words are left out; an item without id taints documents
but is not counted among their items; rows of one item_id are one item. Repeated documents each give a row; rows that
share doc_id and text are judged alike. Extra columns pass through filters and are not read. An empty benchmark leaves all
documents clean. A very long text is searched whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fmindex import FMIndex
from .shared import ALNUM, LONG, LOWER, SHORT, chunks, cut_spans, free_names, freeing, merged_spans, packed_words, spans, stored, text_columns, utf8

#: Words of a window.
WINDOW = 10
#: Words of the benchmark that one pass searches for.
BLOCK_WORDS = 1 << 18
#: Bytes of text in a shard; a longer text is one of its own.
SHARD = 1 << 21
SPANS = "array<struct<first:int,last:int,start:int,end:int>>"
SCHEMA = f"doc_id long, tag long, n_words long, spans {SPANS}, items array<long>"
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass
class Block:
    """Windows of some items: the words by their numbers from 1, windows as rows of those numbers, their lengths, and their items."""

    words: list[bytes]
    windows: np.ndarray
    lengths: np.ndarray
    items: list[list[int]]


def item_words(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode().lower())


def make_block(items: list[tuple[int | None, list[bytes]]], window: int = WINDOW) -> Block:
    vocabulary = sorted({w for _, words in items for w in words})
    number = {w: k + 1 for k, w in enumerate(vocabulary)}
    of: dict[tuple[int, ...], set] = {}
    for item, words in items:
        ids = [number[w] for w in words]
        for i in range(max(1, len(ids) - window + 1)):
            of.setdefault(tuple(ids[i : i + window]), set()).add(item)
    rows = np.zeros((len(of), window), np.int64)
    for k, ids in enumerate(of):
        rows[k, : len(ids)] = ids
    return Block(vocabulary, rows, np.array([len(x) for x in of], np.int64), [sorted(x - {None}) for x in of.values()])


def blocks(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[Block]:
    """benchmark: item_id, text. The driver holds one block at a time."""
    held, n = [], 0
    for item, text in benchmark.select("item_id", "text").toLocalIterator():
        words = item_words(text)
        if held and n + len(words) > block_words:
            yield make_block(held, window)
            held, n = [], 0
        if words:
            held.append((item, words))
            n += len(words)
    if held:
        yield make_block(held, window)


class Vocabulary:
    """The words of a block, to look up those of texts: short ones as sorted 64-bit numbers that are their bytes, long ones by a dictionary."""

    def __init__(self, words: list[bytes]):
        raw = np.frombuffer(b" ".join(words), np.uint8)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        packed, _ = packed_words(raw, np.concatenate([[0], ends[:-1] + 1]), ends)
        short = np.array([len(w) <= SHORT for w in words])
        self.number = np.flatnonzero(short) + 1
        order = np.argsort(packed[short])
        self.packed, self.number = packed[short][order], self.number[order]
        self.long = {w: k + 1 for k, w in enumerate(words) if len(w) > SHORT}
        # which of the numbers' 16 bits behind a mixing step occur: most words of a text are told apart by these
        self.seen = np.zeros(1 << 16, bool)
        self.seen[self._top(self.packed)] = True

    @staticmethod
    def _top(packed: np.ndarray) -> np.ndarray:
        return (packed * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.int64)

    def numbers(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each word of raw, 0 for those that are not in the vocabulary."""
        packed, long = packed_words(raw, starts, ends)
        out = np.zeros(len(packed), np.int64)
        is_long = packed >= LONG
        if long:
            out[is_long] = np.array([self.long.get(w, 0) for w in long])[(packed[is_long] ^ LONG).astype(np.int64)]
        if len(self.packed):
            maybe = np.flatnonzero(~is_long & self.seen[self._top(packed)])
            at = np.minimum(np.searchsorted(self.packed, packed[maybe]), len(self.packed) - 1)
            out[maybe] = np.where(self.packed[at] == packed[maybe], self.number[at], 0)
        return out


def _places(numbers: np.ndarray, row: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """First word and window of every occurrence, given a shard's words and the document of each."""
    inside = numbers > 0
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | ~inside[:-1]
    starts = np.flatnonzero(inside & fresh)
    stop = np.flatnonzero(np.concatenate([fresh | ~inside, [True]]))
    ends = stop[np.searchsorted(stop, starts, "right")]
    long = ends - starts >= block.lengths.min()
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return starts, starts
    size = ends - starts
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    source = np.repeat(starts - begin[:-1], size + 1) + np.arange(begin[-1])
    text = np.where(np.arange(begin[-1]) == np.repeat(begin[1:] - 1, size + 1), 0, numbers[np.minimum(source, len(numbers) - 1)])
    index = FMIndex(text, len(block.words) + 1)
    low, high = index.search(block.windows, block.lengths)
    n = high - low
    window = np.repeat(np.arange(len(n)), n)
    rows = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    return source[index.locate(rows)], window


def _shard(texts: pa.Array, block: Block, vocabulary: Vocabulary):
    """n_words, spans and items of each text."""
    raw, offsets = utf8(texts)
    numbers, row, begin, end = [], [], [], []
    for i, j in chunks(offsets):
        part, at = LOWER[raw[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
        a, b = spans(part, at, ALNUM)
        numbers.append(vocabulary.numbers(part, a, b).astype(np.int32))
        row.append((np.searchsorted(at, a, "right") - 1 + i).astype(np.int32))
        begin.append(a + offsets[i])
        end.append(b + offsets[i])
    numbers, row, begin, end = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (numbers, row, begin, end))
    first, window = _places(numbers, row, block)
    edge = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + block.lengths[window], -1)
    hit = np.cumsum(edge[:-1]) > 0
    fresh = np.ones(len(hit), bool)
    fresh[1:] = ~hit[:-1] | (row[1:] != row[:-1])
    firsts = np.flatnonzero(hit & fresh)
    stop = np.flatnonzero(np.concatenate([fresh | ~hit, [True]]))
    lasts = stop[np.searchsorted(stop, firsts, "right")] - 1
    word0 = np.searchsorted(row, np.arange(len(texts)))
    found: list[list[dict]] = [[] for _ in range(len(texts))]
    hits = row[firsts]
    for r in np.unique(hits).tolist():
        of = slice(*np.searchsorted(hits, (r, r + 1)).tolist())
        a, b, at = firsts[of], lasts[of], offsets[r]
        before = np.cumsum(np.concatenate([[0], (raw[at : offsets[r + 1]] & 0xC0) != 0x80]), dtype=np.int32)  # code points before each byte of this text
        bounds = (a - word0[r], b - word0[r], before[begin[a] - at], before[end[b] - at])
        found[r] = [dict(zip(("first", "last", "start", "end"), x, strict=True)) for x in zip(*(x.tolist() for x in bounds), strict=True)]
    items: list[set] = [set() for _ in range(len(texts))]
    pairs = np.unique(np.stack([row[first].astype(np.int64), window]), axis=1) if len(first) else np.zeros((2, 0), np.int64)
    for r, w in zip(*pairs.tolist(), strict=True):
        items[r].update(block.items[w])
    return np.bincount(row, minlength=len(texts)), found, [sorted(x) for x in items]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches' rows, as many at a time as have SHARD bytes of text, or one."""
    for batch in batches:
        _, offsets = utf8(text_columns(batch, "text")[0])
        for i, j in chunks(offsets, SHARD):
            yield batch.slice(i, j - i)


def _search(docs: DataFrame, block: Block) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(block)
    span = pa.list_(pa.struct([(x, pa.int32()) for x in ("first", "last", "start", "end")]))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held.value
        vocabulary = Vocabulary(block.words)
        for batch in _slices(batches):
            ids, tag, texts = text_columns(batch, "doc_id", "tag", "text")
            n_words, found, items = _shard(texts, block, vocabulary)
            yield pa.RecordBatch.from_arrays([ids, tag, pa.array(n_words, pa.int64()), pa.array(found, span), pa.array(items, pa.list_(pa.int64()))], names=["doc_id", "tag", "n_words", "spans", "items"])

    return docs.select("doc_id", F.xxhash64("text").alias("tag"), "text").mapInArrow(freeing(searched), SCHEMA)


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs: doc_id, text. Returns SCHEMA, a row for each of docs: spans are runs of hit words (first, last; code points start, end)."""
    parts = []
    for block in blocks(benchmark, window, block_words):
        parts.append(_search(docs, block))
        if len(parts) > 1:
            parts[-1] = stored(parts[-1], "hits")
    if not parts:
        return _search(docs, Block([b"a"], np.ones((1, window), np.int64), np.array([1 << 30]), [[]]))
    if len(parts) == 1:
        return parts[0]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    # rows that share doc_id and text meet; as many come back
    whole = every.groupBy("doc_id", "tag", "n_words").agg(
        (F.count("*") / len(parts)).cast("int").alias("copies"), merged_spans(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")
    )
    return whole.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select("doc_id", "tag", "n_words", "spans", "items")


def n_hit(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)


def decontamination_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row for each of docs with counts, items and the verdict."""
    found = contaminated_spans(docs, benchmark, window, block_words)
    items = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id", "n_words", n_hit(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without those that hold a window of an item. Rows are judged where they stand, by one block after the other."""
    schema = docs.schema
    for block in blocks(benchmark, window, block_words):
        docs = docs.mapInArrow(freeing(_clean(docs.sparkSession.sparkContext.broadcast(block))), schema)
    return docs


def _clean(held):
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held.value
        vocabulary = Vocabulary(block.words)
        for batch in _slices(batches):
            _, found, _ = _shard(text_columns(batch, "text")[0], block, vocabulary)
            yield batch.filter(pa.array([not x for x in found], pa.bool_()))

    return kept


def with_spans_cut(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the removal spans cut from their texts, for those who would rather keep the rest of a document."""
    of, tag, spans = free_names(docs, "of", "tag", "spans")
    found = contaminated_spans(docs, benchmark, window).filter(F.size("spans") > 0).select(F.col("doc_id").alias(of), F.col("tag").alias(tag), F.col("spans").alias(spans)).dropDuplicates([of, tag])
    joined = docs.join(found, docs["doc_id"].eqNullSafe(found[of]) & (F.xxhash64(docs["text"]) == found[tag]), "left")
    return joined.withColumn("text", F.when(F.size(spans) > 0, cut_spans(F.col("text"), F.col(spans))).otherwise(F.col("text"))).select(*docs.columns)

"""Dedup of repeated bytes by a logarithmic index family: bytes of every LENGTH-byte string that also starts earlier are removed.

A text's LENGTH-byte windows are dealt to anchors: of the GRAM-byte strings in a window the one with the least hash, the
leftmost of equals. Equal windows have their anchor at the same place in them, so an index of the suffixes at anchors
(about one in 35 bytes) finds every repeat. A run is the stretch of windows of one anchor; its row holds g, the hash of
the anchor's string, and r, a BLAKE2b digest of all bytes of the run under a key that is drawn anew for each family, so that
no text can be written to have the r of another one. g only brings runs together; what is removed hangs on r, and where runs
that share g only are compared, on their bytes.

Batches come in ascending doc_id. The runs of a batch, sorted by (g, r, place), stand for its suffix array: suffixes at
anchors, in order of hashes instead of bytes. It is merge-scanned with the arrays of all existing levels in one sorted
pass: a run with an equal run before it is a repeat as a whole; runs that share g only are compared window by window.
Level k holds 2**k batches: the pass writes the new array and those of the full lower levels as one array of the next
level, so each run is rewritten a logarithmic number of times, and the levels that it replaces are deleted.

Within a task, an Arrow batch's repeats are found before the shuffle, so copies of one text send one set of runs per
batch. Anchors that a sample shows to be very frequent are dealt out by r too, and all their runs are compared. Groups of
more than GROUP runs that share g are compared through rows of window hashes, not in one task.

Null and empty texts have no bytes; texts shorter than LENGTH lose none; texts of any length are indexed whole, in parts.
Rows that share a doc_id are ordered by a 63-bit hash of their text; rows that are wholly equal stand at the same place,
and neither is earlier. A null doc_id comes first. Extra columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bloom import MAX_BLOCKS, bloom_filter, with_maybe
from .shared import chunks, forget, hashes, new_path, rolling, stored, text_columns, utf8
from .shared import mixed as spread

#: Bytes of a string that counts as repeated, and of the strings that anchors are chosen from.
LENGTH, GRAM = 100, 32
#: Runs that share an anchor string and are compared in one task.
GROUP = 1 << 12
#: One in SAMPLE documents tells the frequent anchors: HOT of them at most, with OFTEN runs or more; their runs are dealt out to SALTS times as many tasks.
SAMPLE, OFTEN, HOT, SALTS = 64, 32, 1024, 64
_REACH = LENGTH - GRAM + 1
_PIECE = 1 << 22
_SIGN = -(1 << 63)
#: place: first byte and number of windows; stop: only in rows of bytes that an earlier run of the same Arrow batch has.
ROW = "g long, r long, doc long, tie long, place long, stop long"
SPANS = "doc long, tie long, start long, stop long"


def start_of(place: Column) -> Column:
    return F.shiftright(place, 7)


def windows_of(place: Column) -> Column:
    return place.bitwiseAND(127)


def _digests(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: bytes) -> np.ndarray:
    data, digest = raw.tobytes(), functools.partial(hashlib.blake2b, digest_size=8, key=key)
    return np.frombuffer(b"".join([digest(data[a:b]).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]), np.uint64)


def _runs(raw: np.ndarray, at: np.ndarray, key: bytes) -> tuple[np.ndarray, ...]:
    """Row, first byte, number of windows, g and r of each run in the texts raw[at[i]:at[i + 1]]."""
    m = len(raw) - LENGTH + 1
    if m <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    sums = rolling(raw)
    at_gram = np.arange(len(raw) - GRAM + 1)
    h = hashes(sums, at_gram, at_gram + GRAM)
    keyed = (h >> np.uint64(24) << np.uint64(24)) | at_gram.astype(np.uint64)
    padded = np.concatenate([keyed, np.full(-len(keyed) % _REACH, np.uint64(2**64 - 1))]).reshape(-1, _REACH)
    head = np.minimum.accumulate(padded, 1).ravel()
    tail = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    anchor = (np.minimum(tail[:m], head[_REACH - 1 : _REACH - 1 + m]) & np.uint64(0xFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))[:m]
    whole = np.arange(LENGTH, LENGTH + m) <= at[row + 1]
    fresh = np.ones(m, bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    start = np.flatnonzero(fresh & whole)
    stop = np.flatnonzero(np.concatenate([fresh | ~whole, [True]]))
    end = stop[np.searchsorted(stop, start, "right")]
    return row[start], start, end - start, h[anchor[start]], _digests(raw, start, end + LENGTH - 1, key)


def _pieces(offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """First row, first byte and edges of stretches of whole texts, or of overlapping parts of a text longer than _PIECE."""
    for i, j in chunks(offsets):
        a, b = int(offsets[i]), int(offsets[j])
        if b - a <= _PIECE:
            yield i, a, offsets[i : j + 1] - a
        else:
            for k in range(a, b - LENGTH + 1, _PIECE):
                yield i, k, np.array([0, min(b, k + _PIECE + LENGTH - 1) - k])


def _scan(batches: Iterator[pa.RecordBatch], key: bytes) -> Iterator[pa.RecordBatch]:
    """Rows of ROW for each Arrow batch: the first run of each (g, r), and with stop set, the bytes of its later ones."""
    names = [x.split()[0] for x in ROW.split(", ")]
    for batch in batches:
        docs, ties, texts = text_columns(batch, "doc", "tie", "text")
        doc, tie = docs.to_numpy(zero_copy_only=False), ties.to_numpy(zero_copy_only=False)
        raw, offsets = utf8(texts)
        parts = []
        for i, a, at in _pieces(offsets):
            row, start, n, g, r = _runs(raw[a : a + at[-1]], at, key)
            parts.append((row + i, start + a - offsets[row + i], n, g, r))
        if not parts:
            continue
        row, start, n, g, r = (np.concatenate(x) for x in zip(*parts, strict=True))
        rank = np.zeros(len(doc), np.int64)
        by_doc = np.lexsort((tie, doc))
        rank[by_doc[1:]] = np.cumsum((np.diff(doc[by_doc]) != 0) | (np.diff(tie[by_doc]) != 0))
        order = np.lexsort((start, rank[row], r, g))
        row, start, n, g, r = (x[order] for x in (row, start, n, g, r))
        again = np.zeros(len(g), bool)
        again[1:] = (g[1:] == g[:-1]) & (r[1:] == r[:-1])
        first_of = np.maximum.accumulate(np.where(again, 0, np.arange(len(g))))
        twin = again & (rank[row] == rank[row[first_of]]) & (start == start[first_of])  # the same place in an equal row
        later = again & ~twin
        once = ~again
        columns = (g[once].view(np.int64), r[once].view(np.int64), doc[row[once]], tie[row[once]], start[once] << 7 | n[once])
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.nulls(int(once.sum()), pa.int64())], names=names)
        if later.any():
            row, start, stop = row[later], start[later], start[later] + n[later] + LENGTH - 1
            by_place = np.lexsort((start, row))
            row, start, stop = row[by_place], start[by_place], stop[by_place]
            fresh = np.ones(len(row), bool)
            fresh[1:] = (row[1:] != row[:-1]) | (start[1:] > stop[:-1])
            head, last = np.flatnonzero(fresh), np.concatenate([np.flatnonzero(fresh)[1:] - 1, [len(row) - 1]])
            own = spread(doc[row[head]].astype(np.uint64) + (start[head].astype(np.uint64) << np.uint64(32))).view(np.int64)  # deals them out evenly
            columns = (own, np.zeros(len(head), np.int64), doc[row[head]], tie[row[head]], start[head] << 7, stop[last])
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=names)


def _keyed(docs: DataFrame, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """doc_id, doc (the doc_id, or the least long), tie (where the doc_id may stand in several rows, a hash of the text, below zero without doc_id; else 0) and text."""
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(_SIGN)).alias("doc"), "text")
    several = stored(rows.groupBy("doc").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc").alias("key")), "several")
    blooms, n_blocks = bloom_filter(several, several.count(), max_blocks)
    half = F.shiftrightunsigned(F.xxhash64("text"), 1)
    tie = F.when(F.col("doc_id").isNull(), half.bitwiseOR(F.lit(_SIGN))).when(F.col("several"), half).otherwise(F.lit(0).cast("long"))
    return with_maybe(rows, F.col("doc"), stored(blooms, "blooms"), n_blocks, "several").select("doc_id", "doc", tie.alias("tie"), "text")


def _scanned(keyed: DataFrame, key: bytes) -> DataFrame:
    return keyed.select("doc", "tie", "text").mapInArrow(lambda batches: _scan(batches, key), ROW)


def frequent_anchors(keyed: DataFrame) -> DataFrame:
    """g of anchors that very many runs share, by a sample of documents. At most HOT; they decide how rows are dealt out, not what is found."""
    runs = _scanned(keyed.filter(F.pmod(F.xxhash64("doc", "text"), F.lit(SAMPLE)) == 0), bytes(16))
    return stored(runs.filter("stop is null").groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") >= OFTEN).orderBy(F.desc("n"), "g").limit(HOT).select("g"), "frequent")


class IndexFamily:
    """The levels of the index; add() takes batches of ascending doc_ids and keeps what it finds in them. frequent: g of anchors whose runs are dealt out further."""

    def __init__(self, spark: SparkSession, frequent: DataFrame | None = None):
        self.spark, self.frequent, self.key = spark, frequent, os.urandom(16)
        self.levels: dict[int, str] = {}
        self.found: dict[str, DataFrame] = {}

    def _level(self, k: int) -> DataFrame:
        """The first run of each (g, r) in the batches of level k."""
        return self._table(self.levels[k]).filter("age < 2 and not again and stop is null").select("g", "r", "doc", "tie", "place", "stop")

    def _table(self, at: str) -> DataFrame:
        return self.spark.read.schema(f"{ROW}, age byte, again boolean, mixed boolean").parquet(at)

    def add(self, docs: DataFrame) -> None:
        """docs: doc, tie, text, with no doc below those of earlier batches."""
        into = 0
        while into in self.levels:
            into += 1
        age = lambda rows, n: rows.withColumn("age", F.lit(n).cast("byte"))
        rows = age(_scanned(docs, self.key), 0)
        for k in self.levels:
            rows = rows.unionByName(age(self._level(k), 1 if k < into else 2))
        salt = F.lit(-1)
        if self.frequent is not None:
            rows = rows.join(F.broadcast(self.frequent.withColumn("hot", F.lit(True))), "g", "left")
            salt = F.when(F.col("hot"), F.pmod("r", F.lit(SALTS))).otherwise(-1)
        ordered = Window.partitionBy("g", "salt").orderBy("r", "doc", "tie", "place")
        before = F.lag(F.struct("r", "doc", "tie", "place")).over(ordered)
        scanned = rows.withColumn("salt", salt.cast("int")).withColumn("before", before)
        same = F.coalesce(F.col("before.r") == F.col("r"), F.lit(False))
        twin = same & (F.col("before.doc") == F.col("doc")) & (F.col("before.tie") == F.col("tie")) & (F.col("before.place") == F.col("place"))
        # a run behind another of its g, and every first run of a frequent one, tells that this g has several kinds of runs
        mixed = F.col("stop").isNull() & ~same & (F.col("before.r").isNotNull() | (F.col("salt") >= 0))
        kept = scanned.filter(~twin).select("g", "r", "doc", "tie", "place", "stop", "age", same.alias("again"), mixed.alias("mixed")).filter("age < 2 or mixed")
        at = new_path(self.spark, f"level{into}")
        kept.write.option("compression", "zstd").parquet(at)
        for k in [k for k in self.levels if k < into]:
            # what a replaced level has found stays, its array goes
            old = self.levels.pop(k)
            self.found[old] = stored(self.found[old], "found")
            forget(self.spark, old)
        self.levels[into] = at
        self.found[at] = self._table(at).filter("mixed or age = 0 and (again or stop is not null)").select("g", "doc", "tie", "place", "stop", "mixed")

    def repeats(self) -> DataFrame:
        """SPANS of runs that are repeats as a whole."""
        start = start_of(F.col("place"))
        spans = [f.filter("not mixed").select("doc", "tie", start.alias("start"), F.coalesce("stop", start + windows_of(F.col("place")) + LENGTH - 1).alias("stop")) for f in self.found.values()]
        return functools.reduce(DataFrame.unionByName, spans)

    def mixed(self) -> DataFrame:
        """g, doc, tie, place of the first of each kind of run, of those that share g but not r."""
        keys = stored(functools.reduce(DataFrame.unionByName, [f.filter("mixed").select("g") for f in self.found.values()]).distinct(), "mixed")
        blooms, n_blocks = bloom_filter(keys.withColumnRenamed("g", "key"), keys.count())
        firsts = functools.reduce(DataFrame.unionByName, [self._level(k).select("g", "doc", "tie", "place") for k in self.levels])
        return with_maybe(firsts, F.col("g"), stored(blooms, "blooms"), n_blocks, "maybe").filter("maybe").drop("maybe").join(keys, "g", "left_semi")


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the runs that are to be compared."""
    for batch in batches:
        docs, ties, texts, runs = text_columns(batch, "doc", "tie", "text", "runs")
        raw, offsets = utf8(texts)
        out: list[list] = [[], [], [], [], [], []]
        for i, (doc, tie, of) in enumerate(zip(docs.to_pylist(), ties.to_pylist(), runs.to_pylist(), strict=True)):
            text = raw[offsets[i] : offsets[i + 1]]
            for run in of:
                start, n = run["place"] >> 7, run["place"] & 127
                for x, v in zip(out, (run["g"], doc, tie, run["place"], run["hot"], text[start : start + n + LENGTH - 1].tobytes()), strict=True):
                    x.append(v)
        kinds = (*[pa.int64()] * 4, pa.bool_(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["g", "doc", "tie", "place", "hot", "bytes"])


def _windows(contexts: pa.Array, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of the runs; of each window of each run: the run, the window's number in it, and its first byte."""
    at = np.concatenate([[0], np.cumsum((place & 127) + LENGTH - 1)])
    raw = np.frombuffer(b"".join(contexts.to_pylist()), np.uint8)
    n = place & 127
    run = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    return raw, run, step, at[run] + step


def _same(raw: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the LENGTH bytes at a and at b are equal, pair by pair."""
    windows, out = np.lib.stride_tricks.sliding_window_view(raw, LENGTH), np.zeros(len(a), bool)
    for k in range(0, len(a), 1 << 14):
        out[k : k + (1 << 14)] = (windows[a[k : k + (1 << 14)]] == windows[b[k : k + (1 << 14)]]).all(1)
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (g, doc, tie, place): windows that an earlier run of their g also has."""

    def compared(table: pa.Table) -> pa.RecordBatch:
        g, doc, tie, place = (table[x].to_numpy() for x in ("g", "doc", "tie", "place"))
        raw, run, step, at = _windows(table["bytes"], place)
        h = hashes(rolling(raw), at, at + LENGTH)
        order = np.lexsort((step, run, h, g[run]))
        again = np.zeros(len(order), bool)
        again[1:] = (h[order[1:]] == h[order[:-1]]) & (g[run[order[1:]]] == g[run[order[:-1]]])
        later = np.flatnonzero(again)
        differ = later[~_same(raw, at[order[later]], at[order[later - 1]])]
        head = np.flatnonzero(~again)
        for first in np.unique(head[np.searchsorted(head, differ, "right") - 1]).tolist():
            # different bytes of one hash, a rare case: told apart one by one
            seen = set()
            for k in range(first, int(head[np.searchsorted(head, first, "right")]) if first < head[-1] else len(order)):
                window = raw[at[order[k]] : at[order[k]] + LENGTH].tobytes()
                again[k] = window in seen
                seen.add(window)
        run, step = run[order[again]], step[order[again]]
        start = (place[run] >> 7) + step
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[run], tie[run], start, start + LENGTH)], names=["doc", "tie", "start", "stop"])

    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        g = rest["g"].to_numpy()
        if len(g) and g[0] != g[-1]:
            whole = int(np.argmax(g == g[-1]))
            yield compared(rest.slice(0, whole))
            rest = rest.slice(whole)
    if rest is not None and len(rest):
        yield compared(rest)


def _explode(batches: Iterator[pa.RecordBatch], key: bytes) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        g, doc, tie, place = (batch.column(x).to_numpy() for x in ("g", "doc", "tie", "place"))
        raw, run, step, at = _windows(batch.column("bytes"), place)
        columns = (g[run], _digests(raw, at, at + LENGTH, key).view(np.int64), doc[run], tie[run], (place[run] >> 7) + step)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["g", "h", "doc", "tie", "start"])


def _near(docs: DataFrame, keys: DataFrame, name: str, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """docs with a boolean column: whether their doc may be among keys (doc)."""
    blooms, n_blocks = bloom_filter(keys.select(F.col("doc").alias("key")).distinct(), keys.count(), max_blocks)
    return with_maybe(docs, F.col("doc"), stored(blooms, "bloom"), n_blocks, name)


def _part_repeats(docs: DataFrame, mixed: DataFrame, group: int = GROUP) -> DataFrame:
    """SPANS of windows in mixed runs that also stand in an earlier run of the same g."""
    mixed = stored(mixed, "mixed")
    hot = mixed.groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") > group).select("g", F.lit(True).alias("hot"))
    runs = mixed.join(hot, "g", "left").select("g", "doc", "tie", "place", F.coalesce("hot", F.lit(False)).alias("hot"))
    runs = stored(runs.groupBy("doc", "tie").agg(F.collect_list(F.struct("g", "place", "hot")).alias("runs")), "runs")
    texts = _near(docs, runs, "near").filter("near").select("doc", "tie", "text").dropDuplicates(["doc", "tie"])
    found = stored(texts.join(runs, ["doc", "tie"]).select("doc", "tie", "text", "runs").mapInArrow(_contexts, "g long, doc long, tie long, place long, hot boolean, bytes binary"), "contexts")
    cold = found.filter("not hot").drop("hot").repartition("g").sortWithinPartitions("g", "doc", "tie", "place").mapInArrow(_compare, SPANS)
    key = os.urandom(16)
    windows = found.filter("hot").drop("hot").mapInArrow(lambda batches: _explode(batches, key), "g long, h long, doc long, tie long, start long")
    first = windows.groupBy("g", "h").agg(F.min(F.struct("doc", "tie", "start")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    late = windows.join(first, ["g", "h"]).filter(F.struct("doc", "tie", "start") > F.col("first"))
    return cold.unionByName(late.select("doc", "tie", "start", (F.col("start") + LENGTH).alias("stop")))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    for batch in batches:
        ids, texts, spans = text_columns(batch, "doc_id", "text", "spans")
        raw, offsets = utf8(texts)
        sizes, merged, kept = [], [], []
        for i, of in enumerate(spans):
            text = raw[offsets[i] : offsets[i + 1]]
            at = of.values.flatten() if of.is_valid else None
            start, stop = (np.sort(x.to_numpy()) for x in at) if at else (np.zeros(0, np.int64),) * 2
            # sorted apart, the starts and stops of all spans bound the same union of bytes
            fresh = np.ones(len(start), bool)
            fresh[1:] = start[1:] > stop[:-1]
            a, b = start[fresh], stop[np.concatenate([fresh[1:], [True]])] if len(start) else stop
            keep = np.ones(len(text), bool)
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                keep[x:y] = False
            sizes.append(len(text))
            merged.append([{"start": x, "stop": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)])
            kept.append(text[keep].tobytes())
        yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(merged, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])


def without_repeats(docs: DataFrame, n_batches: int = 2, group: int = GROUP, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n_bytes, spans (maximal removed runs: start, stop in bytes) and kept (the other bytes), a row for each of docs."""
    keyed = _keyed(docs, max_blocks)
    shares = [k / n_batches for k in range(1, n_batches)]
    cuts = sorted({x for x in (keyed.agg(F.percentile_approx("doc", shares)).first()[0] or [])}) if shares else []
    family = IndexFamily(docs.sparkSession, frequent_anchors(keyed))
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        batch = keyed if low is None else keyed.filter(F.col("doc") > low)
        family.add(batch if high is None else batch.filter(F.col("doc") <= high))
    removed = family.repeats().unionByName(_part_repeats(keyed, family.mixed(), group))
    spans = stored(removed.groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "spans")
    # documents that surely lose nothing need not meet the spans
    near = _near(keyed, spans, "near", max_blocks)
    whole = near.filter("not near").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)").alias("spans"), F.coalesce("text", F.lit("")).cast("binary").alias("kept"))
    return whole.unionByName(near.filter("near").join(spans, ["doc", "tie"], "left").select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary"))


def repeats_report(docs: DataFrame, n_batches: int = 2, group: int = GROUP) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return without_repeats(docs, n_batches, group).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

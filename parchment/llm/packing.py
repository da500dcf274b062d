"""Packing of token ids into sequences of at most SIZE, first-fit decreasing in randomised groups of documents.

A document is its ids and an end id. Every SIZE of them from the front make a full sequence where the document is read; only the
rest, of less than SIZE ids, is packed with others. Rests are dealt out into groups of about GROUP at random, by the number that
each got when it was written, so that copies, one source or one length do not meet in a group. A group is one task's work: its
rests, longest first, each go into the first bin that has room, which a tournament tree of the bins' room finds in one walk
from its root. Bins that stay emptier than SLACK are taken apart again; their ids follow each other in sequences of SIZE,
and what is left over of a group in sequences of powers of two. So a sequence is either within SLACK of SIZE, or a power
of two, which needs no padding.

A Packing is two Parquet folders of sequences, `full` and `mixed`: sequence_id, length, padded (what it takes when padded), width
of an id in bytes, ids, and its pieces. sequence_id is even in `full` and odd in `mixed`.

Null and empty texts have the end id only. A null doc_id is an id like others; rows that share a doc_id are packed each on its
own. Extra columns are not read. An empty table gives no sequences. Texts of any length are encoded whole.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path, text_columns
from .tokens import encoder

SIZE = 2048
#: Rests of documents in a group, about.
GROUP = 2048
#: Ids that a bin may lack, to be padded rather than taken apart.
SLACK = 16
PIECES = "array<struct<doc_id:long,start:long,length:long,offset:long,doc_tokens:long>>"
SEQUENCES = f"sequence_id long, length long, padded long, width int, ids binary, pieces {PIECES}"
_PIECES = pa.list_(pa.struct([(x, pa.int64()) for x in ("doc_id", "start", "length", "offset", "doc_tokens")]))
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), _PIECES]
_NAMES = [x.split()[0] for x in SEQUENCES.split(", ")]


@dataclass
class Packing:
    """Where the sequences are, by folder; read() gives them as one table."""

    full: str
    mixed: str

    def read(self, spark: SparkSession) -> DataFrame:
        full = spark.read.schema(SEQUENCES + ", rest boolean").parquet(self.full).filter("not rest").drop("rest")
        return full.unionByName(spark.read.schema(SEQUENCES).parquet(self.mixed))


class Bins:
    """Bins of equal size in order of their opening, and a tournament tree of their room: each node has the larger of its two children's."""

    def __init__(self, size: int, most: int):
        self.leaves = 1 << max(0, most - 1).bit_length()
        self.room = [size] * (2 * self.leaves)

    def first_fit(self, length: int) -> int:
        """The first bin with room for length, which then has so much less. There is always a bin that nothing is in yet."""
        at, room = 1, self.room
        while at < self.leaves:
            at *= 2
            if room[at] < length:
                at += 1
        out = at - self.leaves
        room[at] -= length
        while at > 1:
            at //= 2
            most = max(room[2 * at], room[2 * at + 1])
            if room[at] == most:
                break
            room[at] = most
        return out


def first_fit_decreasing(lengths: list[int], size: int = SIZE) -> list[list[int]]:
    """The items of each bin, by their numbers; equal lengths in the order they stand in."""
    bins, out = Bins(size, len(lengths)), []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        at = bins.first_fit(lengths[k])
        if at == len(out):
            out.append([])
        out[at].append(k)
    return out


def powers(n: int) -> list[int]:
    """The powers of two that add up to n, largest first."""
    return [1 << k for k in reversed(range(n.bit_length())) if n >> k & 1]


def sequences(lengths: list[int], size: int = SIZE, slack: int = SLACK) -> list[list[tuple[int, int, int]]]:
    """Of each sequence: item, first id and number of ids of its pieces."""
    out, loose = [], []
    for found in first_fit_decreasing(lengths, size):
        if size - sum(lengths[k] for k in found) <= slack:
            out.append([(k, 0, lengths[k]) for k in found])
        else:
            loose += found
    left = sum(lengths[k] for k in loose)
    takes = [size] * (left // size) + powers(left % size)
    at, since = 0, 0
    for take in takes:
        pieces = []
        while take:
            n = min(take, lengths[loose[at]] - since)
            pieces.append((loose[at], since, n))
            take, since = take - n, since + n
            if since == lengths[loose[at]]:
                at, since = at + 1, 0
        out.append(pieces)
    return out


def padded(length: int, size: int = SIZE) -> int:
    return length if length & (length - 1) == 0 else size


def _cut(path: str, end: int, size: int, special: bool):
    """Full sequences of each document, and its rest as a row that is packed later."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyspark

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        code = encoder(path, special)
        width, last = code.kind.itemsize, np.array([end], code.kind).tobytes()
        number = pyspark.TaskContext.get().partitionId() << 33
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                docs, texts = text_columns(batch.slice(k, 500), "doc_id", "text")
                rows = []
                for doc, text in zip(docs.to_pylist(), texts.cast(pa.binary()), strict=True):
                    ids = code.encode([text.as_buffer().to_pybytes() if text.is_valid else b""])[0] + last
                    n = len(ids) // width
                    for start in range(0, n, size):
                        length = min(size, n - start)
                        piece = {"doc_id": doc, "start": start, "length": length, "offset": 0, "doc_tokens": n}
                        rows.append((2 * number, length, padded(length, size), width, ids[width * start : width * (start + length)], [piece], length < size))
                        number += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [*_TYPES, pa.bool_()], strict=True)], names=[*_NAMES, "rest"])

    return mapped


def _packed(size: int, slack: int):
    def group(table: pa.Table) -> pa.Table:
        rows = table.select(["pack", "width", "ids", "pieces", "sequence_id"]).sort_by("sequence_id").to_pylist()
        out = []
        for k, found in enumerate(sequences([r["pieces"][0]["length"] for r in rows], size, slack)):
            ids, pieces, offset = [], [], 0
            for item, since, n in found:
                width, piece = rows[item]["width"], rows[item]["pieces"][0]
                ids.append(rows[item]["ids"][width * since : width * (since + n)])
                pieces.append(piece | {"start": piece["start"] + since, "length": n, "offset": offset})
                offset += n
            out.append((2 * (rows[0]["pack"] << 33 | k) + 1, offset, padded(offset, size), rows[0]["width"], b"".join(ids), pieces))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), _TYPES, strict=True)], names=_NAMES)

    return group


def pack(docs: DataFrame, tokenizer: str, end: int = 1, size: int = SIZE, group: int = GROUP, slack: int = SLACK, special: bool = True, at: str | None = None) -> Packing:
    """docs: doc_id, text. tokenizer: path of its file on all machines. special: whether added tokens in texts are matched, as the library does."""
    spark = docs.sparkSession
    at = at or new_path(spark, "packing")
    out = Packing(f"{at}/full", f"{at}/mixed")
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_cut(tokenizer, end, size, special), SEQUENCES + ", rest boolean")
    cut.write.option("compression", "none").parquet(out.full)
    rests = spark.read.schema(SEQUENCES + ", rest boolean").parquet(out.full).filter("rest").drop("rest")
    n_groups = max(1, -(-rests.count() // group))
    dealt = rests.withColumn("pack", F.pmod(F.xxhash64("sequence_id"), F.lit(n_groups)))
    dealt.groupBy("pack").applyInArrow(_packed(size, slack), SEQUENCES).write.option("compression", "none").parquet(out.mixed)
    return out


def piece_digests(sequences: DataFrame) -> DataFrame:
    """A row per piece of the sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                rows = []
                for number, width, ids, pieces in zip(*(x.to_pylist() for x in text_columns(batch.slice(k, 1000), "sequence_id", "width", "ids", "pieces")), strict=True):
                    data = np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes()
                    for p in pieces:
                        crc = zlib.crc32(data[4 * p["offset"] : 4 * (p["offset"] + p["length"])])
                        rows.append((p["doc_id"], p["start"], p["length"], crc, p["doc_tokens"], number, p["offset"]))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return sequences.select("sequence_id", "width", "ids", "pieces").mapInArrow(mapped, schema)


def packing_report(docs: DataFrame, tokenizer: str, end: int = 1) -> DataFrame:
    """Packs docs in the shared folder, reads the sequences back and digests their pieces."""
    return piece_digests(pack(docs, tokenizer, end).read(docs.sparkSession))

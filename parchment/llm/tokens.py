"""Token-id output: ids of a public tokenizer in files of independently decodable rANS blocks.

A text is cut before each space that a printing character follows. The tokenizer's own pattern never matches across
such a place, so the ids of the pieces, one after the other, are the ids of the text; every piece is encoded by the
tokenizers library once per worker, as long as the worker keeps less than MEMO pieces; runs of letters, digits
or marks, which the tokenizer's pattern takes as one match each, go straight to the library's merges. A tokenizer of another kind encodes whole texts. Special tokens' names in texts are
ordinary text, unless the caller says otherwise, as the query does; then texts are first split at the added tokens, as the library does.

A file set is a Parquet folder of blocks in ascending doc_id, plus one table of symbol frequencies that all blocks
share, counted over all documents, and one of the parts' first positions. A block holds whole documents, about BLOCK
ids of them, with its first position in its part, the documents' ids and lengths, lane states, stream words, checkpoints, and a crc32 of its ids, which every reader verifies.

Null and empty texts have no ids of their own, only the end id. Rows that share a doc_id follow each other in order of
their text's hash; a null doc_id comes first. Extra columns are not read. An empty table gives a file set without blocks.
A text of any length is encoded whole; one of more than BLOCK ids is a block of its own.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rans import Coded, Table, decode, encode, normalized
from .shared import new_path, stored, text_columns

#: Ids in a block, about; a document of more ids is a block of its own.
BLOCK = 1 << 18
#: Pieces whose ids a worker keeps.
MEMO = 1 << 20
#: Texts that are encoded at a time, and how many are too few to look for equal pieces among them.
ROWS, FEW = 4000, 64
_CUT = re.compile(rb" (?=[\x21-\x7e\xc3-\xdf\xe4-\xf4])")
_ODD = re.compile(rb" (?![\x21-\x7e\xc3-\xdf\xe4-\xf4])")
#: Pieces of letters (ASCII and Latin-1), digits and ASCII marks but the apostrophe; the tokenizer's pattern takes each run of one kind as a match.
_SIMPLE = re.compile(rb"(?:[!-&(-~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_RUNS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+|[0-9]+|[!-&(-/:-@\[-`{-~]+")
BLOCKS = (
    "part int, first_doc long, start long, n_ids long, doc_ids array<long>, sizes array<int>, states binary, words binary, "
    "marks array<struct<step:int,word:int,states:binary>>, crc long"
)


class Encoder(dict):
    """Ids of texts, by one tokenizer file. As a dict: the ids of a space and a piece, as bytes of kind, learnt when first asked for."""

    def __init__(self, path: str, special: bool = False):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code, self.merges = "H" if self.kind.itemsize == 2 else "I", self.tokenizer.model.tokenize
        about = json.loads(self.tokenizer.to_str())
        added = about["added_tokens"] if special else []
        plain = about["normalizer"] is None and not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added)
        # of tokens that begin at one place the library takes the longest
        self.added = {t["content"].encode(): array(self.code, [t["id"]]).tobytes() for t in sorted(added, key=lambda t: -len(t["content"].encode()))}
        self.cut = re.compile(b"(" + b"|".join(map(re.escape, self.added)) + b")") if self.added else None
        self.bytewise = (plain or not special) and about["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        # the byte-level alphabet: printing characters of Latin-1 stand for themselves, the others for those from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.alphabet = dict(zip(plain, plain, strict=True)) | {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
        self.runs: dict[bytes, bytes] = {}
        self.misses = 0
        self.line = self._plain("\n")

    def _plain(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _match(self, match: bytes) -> bytes:
        """The ids of what the tokenizer's pattern takes as one match, straight from its merges."""
        return array(self.code, [t.id for t in self.merges(match.decode("latin-1").translate(self.alphabet))]).tobytes()

    def __missing__(self, piece: bytes) -> bytes:
        if b"\n" in piece:
            lines = piece.split(b"\n")
            if self.bytewise and all(map(_SIMPLE.fullmatch, lines)):
                # line ends between words are matches of their own, and the words behind them have no space before them
                return self[lines[0]] + b"".join([self.line + self.bare(x) for x in lines[1:]])
        if self.bytewise and piece.isalpha():  # of bytes: ASCII letters
            ids = self._match(b" " + piece)
        elif self.bytewise and _SIMPLE.fullmatch(piece):
            first, *rest = _RUNS.findall(piece)
            ids = self[first] + b"".join(map(self.run, rest)) if rest else self._match(b" " + first)
        else:
            ids = self._plain(" " + piece.decode("utf-8", "replace"))
        if len(self) < MEMO:
            self[piece] = ids
        else:  # the common pieces are in already; only after many more misses do texts seem to have changed
            self.misses += 1
            if self.misses > 8 * MEMO:
                self.clear()
                self.misses = 0
        return ids

    def run(self, run: bytes) -> bytes:
        """The ids of a run that no space precedes."""
        ids = self.runs.get(run)
        if ids is None:
            if len(self.runs) >= MEMO // 8:
                self.runs.clear()
            ids = self.runs[run] = self._match(run)
        return ids

    def bare(self, piece: bytes) -> bytes:
        """The ids of a simple piece that no space precedes."""
        return b"".join(map(self.run, _RUNS.findall(piece)))

    def head(self, piece: bytes) -> bytes:
        return self.bare(piece) if _SIMPLE.fullmatch(piece) else self._plain(piece.decode("utf-8", "replace"))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, as bytes of kind."""
        out, even = [], []
        for k, t in enumerate(texts):
            if not self.bytewise:
                out.append(self._plain(t.decode("utf-8", "replace")))
            elif any(x in t for x in self.added):
                out.append(b"".join([self.added[x] if k % 2 else self._stretch(x) for k, x in enumerate(self.cut.split(t))]))
            elif len(texts) < FEW or _ODD.search(t):
                out.append(self._stretch(t))
            else:
                head, space, rest = t.partition(b" ")
                out.append(self.head(head))
                if space:
                    even.append((k, rest))
        for (k, _), ids in zip(even, self._rests([rest for _, rest in even]), strict=True):
            out[k] += ids
        return out

    def _rests(self, rests: list[bytes]) -> Iterator[bytes]:
        """The ids of texts behind a space, cut at each of their spaces. Arrow cuts, tells equal pieces and puts the ids in place; each distinct piece is asked for once."""
        if not rests:
            return
        pieces = pc.split_pattern(pa.array(rests, pa.binary()), b" ")
        ends = pieces.offsets.to_numpy()
        coded = pieces.values.dictionary_encode()
        _, starts, held = coded.dictionary.buffers()
        held, starts = held.to_pybytes(), np.frombuffer(starts, np.int32).tolist()
        ids = [self[held[a:b]] for a, b in zip(starts[: len(coded.dictionary)], starts[1:], strict=False)]
        at = np.concatenate([[0], np.cumsum(np.array([len(x) for x in ids], np.int64)[coded.indices.to_numpy()])])[ends].tolist()
        data = pa.array(ids, pa.large_binary()).take(coded.indices).buffers()[2]
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield data[a:b].to_pybytes()

    def _stretch(self, t: bytes) -> bytes:
        """The ids of a text, or of what stands between added tokens in it."""
        pieces = _CUT.split(t) if _ODD.search(t) else t.split(b" ")
        return self.head(pieces[0]) + b"".join(map(self.__getitem__, pieces[1:]))


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, special: bool) -> Encoder:
    """The worker's encoder for that file, with what it has learnt from earlier tasks."""
    if (path, special) not in _ENCODERS:
        _ENCODERS[path, special] = Encoder(path, special)
    return _ENCODERS[path, special]


def _ids(path: str, end: int, special: bool):
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        code = encoder(path, special)
        width, last = bytes([code.kind.itemsize]), np.array([end], code.kind).tobytes()
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                docs, tie, texts = text_columns(batch.slice(k, ROWS), "doc_id", "tie", "text")
                ids = code.encode([t.as_buffer().to_pybytes() if t.is_valid else b"" for t in texts.cast(pa.binary())])
                yield pa.RecordBatch.from_arrays([docs, tie, pa.array([width + x + last for x in ids], pa.binary())], names=["doc_id", "tie", "ids"])

    return mapped


def _unpacked(data: bytes) -> np.ndarray:
    """The ids of a row of the scratch table: a byte that tells their width, then the ids."""
    return np.frombuffer(data, f"<u{data[0]}", offset=1)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For a partition: how often each id occurs, and in a row of id -1, its number of ids."""
    import pyspark

    total = np.zeros(1, np.int64)
    for batch in batches:
        # counted some rows at a time: a count per row would fill a table of the vocabulary's size for each
        for k in range(0, batch.num_rows, 1000):
            rows = batch.column(0).slice(k, 1000).to_pylist()
            n = np.bincount(np.concatenate([_unpacked(x) for x in rows]), minlength=len(total))
            n[: len(total)] += total
            total = n
    found = np.flatnonzero(total)
    part = pyspark.TaskContext.get().partitionId()
    yield pa.RecordBatch.from_arrays([pa.array([part] * len(found), pa.int32()), pa.array(found), pa.array(total[found])], names=["part", "id", "n"])


@dataclass
class FileSet:
    """Where a file set is: its blocks, the frequency table they share, and the first position of each part."""

    blocks: str
    table: str
    parts: str


def write_ids(docs: DataFrame, tokenizer: str, end: int = 0, special: bool = False, block: int = BLOCK, at: str | None = None) -> FileSet:
    """docs: doc_id, text. Encodes every text, adds the id end, and writes all in ascending doc_id. tokenizer: path of its file on all machines."""
    spark = docs.sparkSession
    at = at or new_path(spark, "ids")
    files = FileSet(f"{at}/blocks", f"{at}/table", f"{at}/parts")
    rows = stored(docs.select("doc_id", F.xxhash64("text").alias("tie"), "text").mapInArrow(_ids(tokenizer, end, special), "doc_id long, tie long, ids binary"), "ids")
    counted = rows.select("ids").mapInArrow(_counts, "part int, id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # a row per id of the vocabulary at most
    total = np.zeros(max([0, *counted["id"].to_pylist()]) + 1, np.int64)
    total[counted["id"].to_numpy()] = counted["n"].to_numpy()
    freq = normalized(total)
    spark.createDataFrame([(k, int(freq[k])) for k in np.flatnonzero(freq).tolist()], "id int, freq int").coalesce(1).write.parquet(files.table)
    held = spark.sparkContext.broadcast(freq)
    # ids are put in order once; texts stay where they are
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select(F.spark_partition_id().alias("part"), "doc_id", "ids")
    ordered.mapInArrow(_blocks(held, block), BLOCKS).write.option("compression", "none").parquet(files.blocks)
    sizes = spark.read.schema(BLOCKS).parquet(files.blocks).groupBy("part").agg(F.sum("n_ids").alias("n"))
    before, starts = 0, []
    for part, n in sorted(sizes.collect()):  # a row per partition
        starts.append((part, before))
        before += n
    spark.createDataFrame(starts, "part int, start long").coalesce(1).write.parquet(files.parts)
    return files


def _blocks(held, size: int):
    fields = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.list_(pa.struct([("step", pa.int32()), ("word", pa.int32()), ("states", pa.binary())])), pa.int64()]
    names = re.findall(r"(\w+) (?:int|long|array|binary)", BLOCKS)

    def coded(part: int, start: int, docs: list, ids: list[np.ndarray], table: Table) -> pa.RecordBatch:
        symbols = np.concatenate(ids)
        x = encode(symbols, table)
        marks = [{"step": k, "word": w, "states": s.tobytes()} for k, w, s in x.checkpoints]
        row = (part, docs[0], start, len(symbols), docs, [len(i) for i in ids], x.states.tobytes(), x.words.tobytes(), marks, zlib.crc32(symbols.astype("<u4").tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, fields, strict=True)], names=names)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(held.value)
        docs, ids, n, part, at = [], [], 0, None, 0
        for batch in batches:
            for p, doc, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if docs and (p != part or n >= size):
                    yield coded(part, at, docs, ids, table)
                    docs, ids, at, n = [], [], at + n, 0
                if p != part:
                    part, at = p, 0
                docs.append(doc)
                ids.append(_unpacked(data))
                n += len(ids[-1])
        if docs:
            yield coded(part, at, docs, ids, table)

    return mapped


def _table(spark: SparkSession, files: FileSet) -> np.ndarray:
    rows = spark.read.schema("id int, freq int").parquet(files.table).toArrow()
    freq = np.zeros(max([0, *rows["id"].to_pylist()]) + 1, np.int64)
    freq[rows["id"].to_numpy()] = rows["freq"].to_numpy()
    return freq


def _coded(row: dict) -> Coded:
    marks = [(m["step"], m["word"], np.frombuffer(m["states"], np.int64)) for m in row["marks"]]
    return Coded(row["n_ids"], np.frombuffer(row["states"], np.int64), np.frombuffer(row["words"], np.uint32), marks)


def read_ids(spark: SparkSession, files: FileSet, ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, and ids unless they are not wanted; raises where a block's checksum does not hold."""
    starts = {r["part"]: r["start"] for r in spark.read.schema("part int, start long").parquet(files.parts).collect()}
    held = spark.sparkContext.broadcast((_table(spark, files), starts))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq, first = held.value
        table = Table(freq)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                symbols = decode(_coded(row), table)
                data = symbols.astype("<u4").tobytes()
                if zlib.crc32(data) != row["crc"]:
                    raise ValueError(f"block {row['part']}, {row['start']} is damaged")
                sizes = np.array(row["sizes"], np.int64)
                ends = np.cumsum(sizes)
                starts = ends - sizes
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(starts + (first[row["part"]] + row["start"])), pa.array(sizes), pa.array(crc, pa.int64())]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(symbols.view(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

    return spark.read.schema(BLOCKS).parquet(files.blocks).mapInArrow(mapped, schema)


def token_report(docs: DataFrame, tokenizer: str, end: int = 0, special: bool = False) -> DataFrame:
    """Writes the file set in the shared folder and reads it back."""
    return read_ids(docs.sparkSession, write_ids(docs, tokenizer, end, special), ids=False)

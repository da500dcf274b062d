"""SentencePiece encoding and decoding: a relational lattice of words, folded with Spark's `aggregate`.

A space is put before a text; then it is cut before each run of spaces and line ends, which no piece of the model
crosses. Such a word's substrings of up to the longest piece's length are exploded and equi-joined to the piece table
(a fixed vocabulary, broadcast); the edges found, and one for each character that is no piece, are grouped by word and
folded. A character that is no piece becomes its bytes' pieces. Two folds are here:

- Viterbi, for unigram models: by end position, keeping the best sum of scores at each, the longest last piece where equal;
- merges, for byte-pair models: from single characters on, the edge of best score that covers two neighbours is taken,
  the leftmost of equals, until none is left. The public vocabulary is of this kind, its scores are ranks of merges, and
  a sum of ranks is not what the model means: Viterbi's pieces equal the library's for two words in five only.

The lattice runs over the words that are common: those with COMMON or more places in some ROWS rows, at most MAX_WORDS,
the most frequent. Their ids go to all tasks. The rest, the long tail of words, are folded by the same rule where they
stand, since joining each of their places back to its text would shuffle more than the texts themselves; a word of
more than LONG characters is folded there too. Ids do not depend on which way a word went.

Ids of a byte-pair model are those of the library's encoder, but for texts with U+2581: the library takes it for a space, here
it becomes its bytes' pieces, so that decoding gives each text back exactly.

Null and empty texts have no pieces, and decode to an empty text. Repeated rows each give a row; extra columns pass through encode() and decode(),
but encode() cannot take a column ids. A text of any length is encoded whole; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import freeing, mixed, stored, text_columns

#: Places in ROWS neighbouring rows from which a word counts as common; words whose ids go to all tasks, at most.
COMMON, ROWS, MAX_WORDS = 3, 2000, 1 << 17
#: Partitions of the lattice.
LATTICE_PARTS = 48
#: Characters of a word that the lattice takes at most.
LONG = 64
#: Rare words whose ids a worker keeps.
MEMO = 1 << 17
_DOUBLE = re.compile(rb"[ \n][ \n]")
_WORD = re.compile(rb"[ \n]+[^ \n]*")


@dataclass
class Model:
    """Pieces of the vocabulary file: text (with spaces), id and score of the usual ones; the id of byte 0; the text of each id."""

    scores: dict[str, tuple[int, float]]
    byte0: int
    texts: list[bytes]
    unknown: float
    longest: int
    merges: bool = True


def load_model(path: str, merges: bool = True) -> Model:
    """The file must be at path on all machines. merges: whether it is a byte-pair model."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    scores, texts = {}, []
    for i in range(p.vocab_size()):
        text = p.id_to_piece(i).replace("▁", " ")
        usual = not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))
        texts.append(bytes([int(text[3:5], 16)]) if p.is_byte(i) else text.encode() if usual else b"")
        if usual:
            scores[text] = (i, p.get_score(i))
    byte0 = p.piece_to_id("<0x00>")
    assert [p.id_to_piece(byte0 + b) for b in (0, 255)] == ["<0x00>", "<0xFF>"]
    assert not any("\n" in x or " " in x.lstrip(" ") for x in scores), "a piece crosses words"
    return Model(scores, byte0, texts, min(s for _, s in scores.values()) - 10, max(map(len, scores)), merges)


def key_of(word: bytes) -> bytes:
    """A word without its one leading space; behind a zero byte if it has more spaces or line ends than one at its front."""
    tail = word[1:]
    if tail[:1] in (b" ", b"\n"):
        return b"\0" + word
    return tail if word[:1] == b" " else word


def word_of(key: bytes) -> bytes:
    return key[1:] if key[:1] == b"\0" and key[1:2] in (b" ", b"\n") else key if key[:1] == b"\n" else b" " + key


def keys_of(text: bytes) -> list[bytes]:
    """Keys of the words of a text that is not empty."""
    text = b" " + text
    if _DOUBLE.search(text):
        return [key_of(w) for w in _WORD.findall(text)]
    return text.replace(b"\n", b" \n").split(b" ")[1:]


def fold_word(word: str, model: Model) -> list[int]:
    """The rule of the model for one word."""
    return merge_pieces(word, model) if model.merges else best_pieces(word, model)


def merge_pieces(word: str, model: Model) -> list[int]:
    """Merges, best first, from a queue of neighbours."""
    ends, before = {i: i + 1 for i in range(len(word))}, {i + 1: i for i in range(len(word))}
    queue: list[tuple[float, int, int, int]] = []

    def offer(start: int, middle: int) -> None:
        end = ends.get(middle)
        found = end and model.scores.get(word[start:end])
        if found:
            heappush(queue, (-found[1], start, middle, end))

    for i in range(len(word) - 1):
        offer(i, i + 1)
    while queue:
        _, start, middle, end = heappop(queue)
        if ends.get(start) == middle and ends.get(middle) == end:
            ends[start] = end
            del ends[middle], before[middle]
            before[end] = start
            offer(start, end)
            if start:
                offer(before[start], start)
    ids: list[int] = []
    for start in sorted(ends):
        found = model.scores.get(word[start : ends[start]])
        ids += [found[0]] if found else [model.byte0 + b for b in word[start : ends[start]].encode()]
    return ids


def best_pieces(word: str, model: Model) -> list[int]:
    """Viterbi's path."""
    n = len(word)
    score, back = [0.0] + [-np.inf] * n, [(0, 0)] * (n + 1)
    for end in range(1, n + 1):
        for start in range(max(0, end - model.longest), end):
            found = model.scores.get(word[start:end])
            if found is None:
                if start < end - 1:
                    continue
                found = (-1, model.unknown)
            if score[start] + found[1] > score[end]:
                score[end], back[end] = score[start] + found[1], (start, found[0])
    ids: list[int] = []
    while n:
        start, i = back[n]
        ids[:0] = [i] if i >= 0 else [model.byte0 + b for b in word[start:n].encode()]
        n = start
    return ids


class Folder:
    """Merges for many words at once: a row of a matrix for each word, a merge in every row at each step."""

    def __init__(self, model: Model):
        self.model = model
        pieces = list(model.scores)
        ids, scores = (np.array(x) for x in zip(*model.scores.values(), strict=True))
        hashes, lengths = self._prefixes(pieces)
        key = self._key(hashes[np.arange(len(pieces)), lengths], lengths)
        order = np.argsort(key)
        self.keys, self.ids, self.scores = key[order], ids[order].astype(np.int64), scores[order].astype(np.float64)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.powers = np.multiply.accumulate(np.array([1] + [int(_BASE)] * LONG, np.uint64))

    @staticmethod
    def _prefixes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first 0, 1, ... characters of each word, a row for each, and the words' lengths."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        first = np.cumsum(lengths) - lengths
        out = np.zeros((len(words), int(lengths.max(initial=0)) + 1), np.uint64)
        for i in range(out.shape[1] - 1):
            has = np.flatnonzero(i < lengths)
            out[has, i + 1] = out[has, i] * _BASE + points[first[has] + i] + np.uint64(1)
        return out, lengths

    @staticmethod
    def _key(hashes: np.ndarray, length: np.ndarray) -> np.ndarray:
        return mixed(hashes ^ (length.astype(np.uint64) << np.uint64(56)))

    def _find(self, hashes: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The place in the table of the piece from start to end in each of the rows, or -1."""
        key = self._key(hashes[row, end] - hashes[row, start] * self.powers[end - start], end - start)
        out = np.full(len(row), -1, np.int64)
        maybe = np.flatnonzero(self.seen[(key >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, key[maybe]), len(self.keys) - 1)
        out[maybe] = np.where(self.keys[at] == key[maybe], at, -1)
        return out

    def fold(self, words: list[str]) -> list[bytes]:
        """Ids of each word of at most LONG characters, as little-endian unsigned 32-bit integers."""
        hashes, size = self._prefixes(words)
        n, longest = hashes.shape[0], hashes.shape[1] - 1
        ends = np.tile(np.arange(1, longest + 2), (n, 1))
        before = ends - 2
        symbol = np.arange(longest + 1) < size[:, None]
        rank = np.full((n, longest + 1), -np.inf)

        def offer(row: np.ndarray, start: np.ndarray, middle: np.ndarray) -> None:
            """The score of joining the symbols at start and middle."""
            rank[row, start] = -np.inf
            ok = np.flatnonzero(middle < size[row])
            row, start = row[ok], start[ok]
            at = self._find(hashes, row, start, ends[row, middle[ok]])
            rank[row[at >= 0], start[at >= 0]] = self.scores[at[at >= 0]]

        row, start = np.nonzero(symbol)
        offer(row, start, start + 1)
        row = np.arange(n)
        while len(row):
            start = rank[row].argmax(1)
            some = rank[row, start] > -np.inf
            row, start = row[some], start[some]
            middle = ends[row, start]
            end = ends[row, middle]
            ends[row, start], before[row, np.minimum(end, longest)] = end, start
            symbol[row, middle], rank[row, middle] = False, -np.inf
            offer(row, start, end)
            left = start > 0
            offer(row[left], before[row[left], start[left]], start[left])
        row, start = np.nonzero(symbol)
        at = self._find(hashes, row, start, ends[row, start])
        ids = np.where(at >= 0, self.ids[at], 0).astype("<u4")
        cut = (4 * np.searchsorted(row, np.arange(n + 1))).tolist()
        data = ids.tobytes()
        out = [data[a:b] for a, b in zip(cut, cut[1:], strict=False)]
        for i in set(row[at < 0].tolist()):
            out[i] = np.array(merge_pieces(words[i], self.model), "<u4").tobytes()
        return out


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            seen: Counter = Counter()
            for t in batch.column(0).slice(k, ROWS).cast(pa.binary()):
                if t.is_valid and t.as_buffer().size:
                    seen.update(keys_of(t.as_buffer().to_pybytes()))
            kept = [(word_of(x), n) for x, n in seen.items() if n >= COMMON]
            yield pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])


def common_words(docs: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """docs: text. Returns word, n: at most max_words, and the most frequent ones down to some power of two."""
    words = stored(docs.select("text").mapInArrow(freeing(_common), "word string, n long").filter(F.length("word") <= LONG).groupBy("word").agg(F.sum("n").alias("n")), "words")
    level = F.floor(F.log2("n")).cast("int")
    left, least = max_words, 64
    for power, n in sorted(words.groupBy(level.alias("p")).count().collect(), reverse=True):  # 64 rows at most
        if n > left:
            break
        left, least = left - n, power
    return words.filter(level >= least)


def piece_table(spark: SparkSession, model: Model) -> DataFrame:
    return spark.createDataFrame([(t, i, s) for t, (i, s) in model.scores.items()], "piece string, id int, score double")


_PATH = "array<struct<end:int,start:int,id:int>>"


def _viterbi_paths(grouped: DataFrame) -> DataFrame:
    """grouped: word, edges in order of end and start. Returns word, path: the edges (end, start, id) of the best sum of scores."""

    def step(state: Column, e: Column) -> Column:
        total = F.element_at(state, e["start"] + 1)["score"] + e["score"]
        new = F.array(F.struct(total.alias("score"), e["start"].alias("start"), e["id"].alias("id")))
        return (
            F.when(F.size(state) <= e["end"], F.concat(state, new))
            .when(F.element_at(state, -1)["score"] < total, F.concat(F.slice(state, 1, F.size(state) - 1), new))
            .otherwise(state)
        )

    folded = grouped.select("word", F.aggregate("edges", F.expr("cast(array(struct(0D, 0, 0)) as array<struct<score:double,start:int,id:int>>)"), step).alias("state"))
    # from the last position back along the starts
    walk = F.aggregate(
        F.sequence(F.size("state") - 1, F.lit(1), F.lit(-1)),
        F.struct((F.size("state") - 1).alias("at"), F.expr(f"cast(array() as {_PATH})").alias("path")),
        lambda acc, i: F.when(
            acc["at"] == i,
            F.struct(F.element_at("state", i + 1)["start"].alias("at"), F.concat(F.array(F.struct(i.alias("end"), F.element_at("state", i + 1)["start"].alias("start"), F.element_at("state", i + 1)["id"].alias("id"))), acc["path"]).alias("path")),
        ).otherwise(acc),
        lambda acc: acc["path"],
    )
    return folded.select("word", walk.alias("path"))


def _merge_paths(grouped: DataFrame) -> DataFrame:
    """As _viterbi_paths, by merges: the state is the array of the symbols' bounds, of which each merge takes one away."""
    wide = F.filter("edges", lambda e: (e["id"] >= 0) & (e["end"] - e["start"] > 1))
    rows = grouped.select("word", "edges", wide.alias("wide"))

    def step(bounds: Column, _: Column) -> Column:
        covers_two = lambda e: F.array_contains(bounds, e["start"]) & F.array_contains(bounds, e["end"]) & (F.size(F.filter(bounds, lambda b: (b > e["start"]) & (b < e["end"]))) == 1)
        best = F.array_max(F.transform(F.filter("wide", covers_two), lambda e: F.struct(e["score"].alias("score"), (-e["start"]).alias("first"), e["end"].alias("end"))))
        # an array of one binds the best edge, so that it is sought once and not for every bound
        return F.get(F.transform(F.array(best), lambda e: F.filter(bounds, lambda b: F.coalesce((b <= -e["first"]) | (b >= e["end"]), F.lit(True)))), F.lit(0))

    start = F.sequence(F.lit(0), F.length("word"))
    # a merge takes one bound away, so there are fewer of them than characters; once none is left, a step changes nothing
    bounds = F.when(F.size("wide") == 0, start).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.length("word") - 1, F.lit(1))), start, step))
    told = rows.withColumn("bounds", bounds)
    symbol = lambda a, i: F.get(F.filter("edges", lambda e: (e["start"] == a) & (e["end"] == F.get("bounds", i + 1))), F.lit(0))
    path = F.transform(F.slice("bounds", 1, F.size("bounds") - 1), lambda a, i: F.struct(F.get("bounds", i + 1).alias("end"), a.alias("start"), symbol(a, i)["id"].alias("id")))
    return told.select("word", path.alias("path"))


def lattice(words: DataFrame, pieces: DataFrame, model: Model) -> DataFrame:
    """words: distinct word. Returns word, ids."""
    # a number of partitions of its own: the words are few bytes but much work
    spaced = words.select("word").repartition(LATTICE_PARTS, "word")
    start = F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("start")
    reach = F.least(F.lit(model.longest), F.length("word") - F.col("start"))
    cuts = spaced.select("word", start).select("word", "start", F.explode(F.sequence(F.lit(1), reach)).alias("size")).withColumn("piece", F.substring("word", F.col("start") + 1, F.col("size")))
    edges = cuts.join(F.broadcast(pieces), "piece", "left").filter((F.col("size") == 1) | F.col("id").isNotNull())
    edge = F.struct((F.col("start") + F.col("size")).alias("end"), "start", F.coalesce("score", F.lit(model.unknown)).alias("score"), F.coalesce("id", F.lit(-1)).alias("id"))
    # no shuffle here: the rows are still dealt out by word
    grouped = edges.groupBy("word").agg(F.array_sort(F.collect_list(edge)).alias("edges"))

    paths = _merge_paths(grouped) if model.merges else _viterbi_paths(grouped)
    hexed = lambda e: F.hex(F.encode(F.substring(F.col("word"), e["start"] + 1, e["end"] - e["start"]), "UTF-8"))
    as_bytes = lambda e: F.transform(F.sequence(F.lit(1), F.length(hexed(e)), F.lit(2)), lambda k: F.conv(F.substring(hexed(e), k, 2), 16, 10).cast("int") + model.byte0)
    return paths.select("word", F.flatten(F.transform("path", lambda e: F.when(e["id"] >= 0, F.array(e["id"])).otherwise(as_bytes(e)))).alias("ids"))


class Tail:
    """Folds words that are not common, and keeps the ids of at most limit of them."""

    def __init__(self, model: Model, limit: int = MEMO):
        self.model, self.limit, self.known = model, limit, {}
        self.folder = Folder(model) if model.merges else None

    def learn(self, keys: set[bytes]) -> None:
        new = keys.difference(self.known)
        if len(self.known) + len(new) > self.limit:
            self.known = {k: self.known[k] for k in keys.difference(new)}
        words = {k: word_of(k).decode("utf-8", "replace") for k in new}
        short = [k for k, w in words.items() if len(w) <= LONG] if self.folder else []
        for i in range(0, len(short), 8192):
            part = short[i : i + 8192]
            self.known.update(zip(part, self.folder.fold([words[k] for k in part]), strict=True))
        self.known.update((k, np.array(fold_word(words[k], self.model), "<u4").tobytes()) for k in words.keys() - set(short))

    def encode(self, texts: list[list[bytes]], common: dict[bytes, bytes]) -> list[bytes]:
        """The ids of texts given as keys of their words."""
        self.learn({x for of in texts for x in of}.difference(common))
        get, known = common.get, self.known
        return [b"".join([get(x) or known[x] for x in of]) for of in texts]


_MODELS: dict[str, Model] = {}
_TAILS: dict[str, Tail] = {}


def model_of(path: str) -> Model:
    if path not in _MODELS:
        _MODELS[path] = load_model(path)
    return _MODELS[path]


def _dictionary(docs: DataFrame, path: str, max_words: int):
    """The ids of the common words by key, as a broadcast of a bounded size."""
    spark, model = docs.sparkSession, model_of(path)
    table = stored(lattice(common_words(docs, max_words), piece_table(spark, model), model), "lattice").toArrow()
    return spark.sparkContext.broadcast({key_of(w.as_py().encode()): np.array(i.as_py(), "<u4").tobytes() for w, i in zip(table["word"], table["ids"], strict=True)})


def _encoded(batches: Iterator[pa.RecordBatch], path: str, common: dict[bytes, bytes]) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[bytes]]]:
    """Some rows at a time, with their texts and the ids of each text."""
    if path not in _TAILS:
        _TAILS[path] = Tail(model_of(path))
    for whole in batches:
        for k in range(0, whole.num_rows, 500):
            batch = whole.slice(k, 500)
            (texts,) = text_columns(batch, "text")
            raw = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in texts.cast(pa.binary())]
            yield batch, raw, _TAILS[path].encode([keys_of(t) if t else [] for t in raw], common)


def _lists(ids: list[bytes]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]), pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))


def encode(docs: DataFrame, path: str, max_words: int = MAX_WORDS) -> DataFrame:
    """docs: text, and any other columns but ids. Adds ids (array of int). path: the model's file, on all machines."""
    held = _dictionary(docs, path, max_words)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, ids in _encoded(batches, path, held.value):
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(ids)], names=[*batch.schema.names, "ids"])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(freeing(mapped), f"{schema}, ids array<int>")


def decode_ids(ids: list[int], model: Model) -> bytes:
    return b"".join(map(model.texts.__getitem__, ids))[1:]


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded: ids and any other columns. Adds decoded, the text that the ids stand for, and ids_crc32 (of little-endian 32-bit ids)."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            rows = [x.values.to_numpy() if x.is_valid else np.zeros(0, np.int32) for x in ids]
            texts = [decode_ids(x.tolist(), model).decode("utf-8", "replace") for x in rows]
            crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array(crc, pa.int64())], names=[*batch.schema.names, "decoded", "ids_crc32"])

    schema = ", ".join(f"`{c}` {t}" for c, t in encoded.dtypes)
    return encoded.mapInArrow(mapped, f"{schema}, decoded string, ids_crc32 long")


REPORT = "doc_id long, n_pieces long, ids array<int>, ids_crc32 long, round_trip boolean"


def pieces_report(docs: DataFrame, path: str, max_words: int = MAX_WORDS) -> DataFrame:
    """REPORT: the ids of each text, and whether decoding them gives it back. Both ways in one pass, so that no text crosses to Python twice."""
    held = _dictionary(docs, path, max_words)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        for batch, raw, ids in _encoded(batches, path, held.value):
            same = [decode_ids(np.frombuffer(x, "<u4").tolist(), model) == t for x, t in zip(ids, raw, strict=True)]
            columns = [text_columns(batch, "doc_id")[0], pa.array([len(x) // 4 for x in ids], pa.int64()), _lists(ids), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in REPORT.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(mapped, REPORT)

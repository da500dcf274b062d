"""What the operators of this subpackage share: Arrow text columns, word spans, hashes and cuts; scratch tables come from the library."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import forget, new_path, stored  # noqa: F401

#: `[^\x20\x09-\x0D]` and `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` as byte tables; bytes of longer UTF-8 sequences are word bytes in both.
PLAIN = np.array([b not in b" \t\n\v\f\r" for b in range(256)])
ALNUM = np.array([b >= 0x80 or chr(b).isalnum() and not chr(b).isupper() for b in range(256)])
#: A-Z to a-z, all else unchanged.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
#: Bytes of text that numpy handles at a time; a longer text is a chunk of its own.
CHUNK = 1 << 19


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and len + 1 offsets into them; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string()) if len(column) else pa.array([], pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most limit bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def spans(raw: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes for which kind holds; a run ends where its row ends."""
    is_in = kind[raw]
    before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    before[1:], after[:-1] = is_in[:-1], is_in[1:]
    before[offsets[:-1][offsets[:-1] < len(raw)]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    return np.flatnonzero(is_in & ~before), np.flatnonzero(is_in & ~after) + 1


_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(n: int) -> list[np.ndarray]:
    """The first n powers of an odd number modulo 2**64, and of its inverse."""
    if len(_POWERS[0]) < n:
        n = max(n, CHUNK + 1)
        for k, base in enumerate((_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64)))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS


def mixed(h: np.ndarray) -> np.ndarray:
    """h with its bits spread, one to one."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def rolling(raw: np.ndarray) -> np.ndarray:
    """Prefix sums from which hashes() takes the hash of any stretch of bytes."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * _powers(len(raw) + 1)[0][: len(raw)], out=out[1:])
    return out


def hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit numbers of the stretches [start, end); equal bytes have equal numbers wherever they stand, but strings can be built that differ and have one too."""
    return mixed((sums[ends] - sums[starts]) * _powers(len(sums))[1][starts])


#: Bytes of words that stand in a number of 64 bits as they are, below their length in the top byte.
SHORT = 7
#: Added to the number of a long word.
LONG = np.uint64(0xFF << 56)


def packed_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """A number for each word, equal for equal words only: a short one's bytes and length, or the place of a long one in the list of those that differ."""
    size = ends - starts
    wide = np.concatenate([raw, np.zeros(8, np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(wide, 8)[starts].view(np.uint64).ravel() if len(starts) else np.zeros(0, np.uint64)
    masks = np.array([(1 << 8 * k) - 1 for k in range(SHORT + 1)], np.uint64)
    out = (out & masks[np.minimum(size, SHORT)]) | size.astype(np.uint64) << np.uint64(56)
    long, data = np.flatnonzero(size > SHORT), raw.tobytes()
    seen: dict[bytes, int] = {}
    number = [seen.setdefault(data[a:b], len(seen)) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    out[long] = np.array(number, np.uint64) | LONG
    return out, list(seen)


def _hashed(packed: np.ndarray, long: list[bytes]) -> np.ndarray:
    out = mixed(packed)
    if long:
        is_long = packed >= LONG
        out[is_long] = np.array([xxhash.xxh64_intdigest(w, 42) for w in long], np.uint64)[(packed[is_long] ^ LONG).astype(np.int64)]
    return out


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words: one to one up to SHORT bytes, by XXH64 beyond."""
    return _hashed(*packed_words(raw, starts, ends))


def word_numbers(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 that are equal for equal words only, and hashes as of word_hashes."""
    packed, long = packed_words(raw, starts, ends)
    distinct, number = np.unique(packed, return_inverse=True)
    return number, _hashed(distinct, long)[number]


def free_names(df: DataFrame, *names: str) -> list[str]:
    """names, with as many underscores more as it takes for df to have no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """The batches' rows, some at a time, so that what a worker makes of them stays small; no empty batch."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def freeing(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """f for mapInArrow, after which its worker, which waits for other tasks, gives back the memory that Arrow keeps for more batches."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        pa.default_memory_pool().release_unused()

    return mapped


def text_columns(batch: pa.RecordBatch, *names: str) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(x)) for x in names]


def merged_spans(of: Column, touch: int = 1) -> Column:
    """An array of structs first, last, start, end: sorted, with those that overlap or follow each other within touch words made one."""
    join = lambda a, b: F.struct(a["first"].alias("first"), F.greatest(a["last"], b["last"]).alias("last"), a["start"].alias("start"), F.greatest(a["end"], b["end"]).alias("end"))
    empty = F.expr("cast(array() as array<struct<first:int,last:int,start:int,end:int>>)")
    return F.aggregate(
        F.array_sort(of), empty,
        lambda out, s: F.when((F.size(out) > 0) & (F.element_at(out, -1)["last"] + touch >= s["first"]), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(join(F.element_at(out, -1), s)))).otherwise(F.concat(out, F.array(s))),
    )


def cut_spans(text: Column, of: Column, mark: str = "") -> Column:
    """text with the code points of the spans (start, end; sorted, apart from each other) replaced by mark."""
    since = lambda i: F.when(i == 0, 0).otherwise(F.get(of, i - 1)["end"])
    kept = F.transform(of, lambda s, i: F.concat(F.substring(text, since(i) + 1, s["start"] - since(i)), F.lit(mark)))
    return F.concat(F.array_join(kept, ""), F.substring(text, F.coalesce(F.element_at(of, -1)["end"], F.lit(0)) + 1, F.length(text)))

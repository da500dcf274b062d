"""Fill-in-middle: each text cut at two places into prefix, middle and suffix, and put out as text, psm or spm.

The cuts of all rows of a chunk are found together on the Arrow buffer of the text column: a byte table tells white space,
a mask of adjacent bytes tells where a token ends, its running sum less that at the document's start counts the document's
tokens, and one searchsorted over the sum gives every row's cuts. Bytes are then copied, never decoded; a text is in one
piece at a time, so that a worker holds a few bytes for each of its bytes.

A token is white space and the printing characters behind it, or the white space that ends a text. The four draws of a
document come from the SHA-256 of the seed and its id, so that the result does not hang on partitions or order.

Null and empty texts are plain, with no tokens. A text that holds one of the marks is plain, which is what makes the others
readable again: a mark stands in their output once, and can't arise where parts meet, as it begins with `<` and ends with
`>`. A null doc_id draws as an empty id. Repeated rows are treated alike, one output row each. Extra columns are not read.
An empty table gives an empty result. Texts of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import PLAIN, chunks, slices, text_columns, utf8

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FORM, PSM, SPM = "plain", "psm", "spm"
#: Out of 100: texts that are cut at all, and of those, texts that are put out as spm.
RATE, SPM_RATE = 50, 80
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def draws(doc_id: Column, seed: int = 42) -> list[Column]:
    """The first four 32-bit numbers of the SHA-256 of `seed:doc_id`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def token_ends(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A mask of the bytes that end a token: printing ones before white space, and every text's last byte."""
    printing = PLAIN[raw]
    ends = printing.copy()
    ends[:-1] &= ~printing[1:]
    ends[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = True
    return ends


def holds_mark(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which rows hold a mark."""
    at = np.flatnonzero(raw[:-2] == ord("<")) if len(raw) > 2 else np.zeros(0, np.int64)
    letters = [ord(m[1]) for m in (PREFIX, SUFFIX, MIDDLE)]
    at = at[np.isin(raw[at + 1], letters) & (raw[at + 2] == ord(">"))]
    row = np.searchsorted(offsets, at, "right") - 1
    out = np.zeros(len(offsets) - 1, bool)
    out[row[at + 2 < offsets[row + 1]]] = True
    return out


def cuts(raw: np.ndarray, offsets: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's number of tokens, and the bytes behind its prefix and its middle."""
    kind = np.int32 if len(raw) < 1 << 31 else np.int64
    counted = np.cumsum(token_ends(raw, offsets), dtype=kind)
    before = np.concatenate([np.zeros(1, kind), counted])[offsets]
    n = np.diff(before)
    one, two = one % (n + 1), two % (n + 1)
    behind = lambda k: np.where(k == 0, offsets[:-1], np.searchsorted(counted, (before[:-1] + k).astype(kind)) + 1)
    return n, behind(np.minimum(one, two)), behind(np.maximum(one, two))


def _kernel(rate: int, spm_rate: int):
    marks = [np.frombuffer(m.encode(), np.uint8) for m in (PREFIX, SUFFIX, MIDDLE)]

    def chunk(raw: np.ndarray, offsets: np.ndarray, h: list[np.ndarray]):
        n, first, second = cuts(raw, offsets, h[0], h[1])
        plain = (n == 0) | holds_mark(raw, offsets) | (h[2] % 100 >= rate)
        spm = ~plain & (h[3] % 100 < spm_rate)
        points = np.concatenate([np.zeros(1, np.int64), np.cumsum((raw & 0xC0) != 0x80)])
        sizes = np.diff(offsets) + np.where(plain, 0, 9)
        to = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        out = np.empty(to[-1], np.uint8)
        for k, (a, b, c, d) in enumerate(zip(offsets[:-1].tolist(), first.tolist(), second.tolist(), offsets[1:].tolist(), strict=True)):
            at = int(to[k])
            if plain[k]:
                out[at : at + d - a] = raw[a:d]
                continue
            prefix, suffix = (marks[0], raw[a:b]), (marks[1], raw[c:d])
            for part in (*(suffix if spm[k] else prefix), *(prefix if spm[k] else suffix), marks[2], raw[b:c]):
                out[at : at + len(part)] = part
                at += len(part)
        text = pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(to), pa.py_buffer(out)])
        form = np.where(plain, PLAIN_FORM, np.where(spm, SPM, PSM)).astype(object)
        chars = [pa.array(points[b] - points[a], pa.int64(), mask=plain) for a, b in ((offsets[:-1], first), (first, second))]
        return pa.array(n, pa.int64()), pa.array(form, pa.string()), *chars, text

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, texts, *h = text_columns(batch, "doc_id", "text", "h1", "h2", "h3", "h4")
            h = [x.to_numpy(zero_copy_only=False) for x in h]
            raw, offsets = utf8(texts)
            for i, j in chunks(offsets):
                columns = chunk(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], [x[i:j] for x in h])
                text = columns[-1]
                # a string column of 32-bit offsets, as Spark reads it
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), *columns[:-1], text.cast(pa.string())], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return mapped


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars (null where plain) and output of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *draws(F.col("doc_id"), seed))
    return rows.mapInArrow(_kernel(rate, spm_rate), SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from."""
    head, middle = F.split_part(output, F.lit(MIDDLE), F.lit(1)), F.split_part(output, F.lit(MIDDLE), F.lit(2))
    first = lambda mark, other: F.split_part(F.substr(head, F.lit(len(mark) + 1)), F.lit(other), F.lit(1))
    last = lambda mark: F.split_part(head, F.lit(mark), F.lit(2))
    return (
        F.when(form == PSM, F.concat(first(PREFIX, SUFFIX), middle, last(SUFFIX)))
        .when(form == SPM, F.concat(last(PREFIX), middle, first(SUFFIX, PREFIX)))
        .otherwise(output)
    )


def infill_digest(docs: DataFrame) -> DataFrame:
    """The numbers of fill_in_middle, and digests of the outputs and of the texts rebuilt from them."""
    out = fill_in_middle(docs)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))

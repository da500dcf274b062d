"""Product quantisation of vectors in exact integers: 8 codebooks of 16 entries, fitted in rounds over all vectors.

A component x is the integer floor(4096 * x). A vector is cut into 8 equal consecutive parts; each part position's codebook starts as
that part of the 16 kept vectors of smallest vec_id. In each round every task assigns its vectors' parts to the nearest entries and
sums them up by entry; only those sums, at most 8 * 16 rows of a part's components for each task, cross the shuffle, and only the new
entries reach the driver and are broadcast. No random choice and no order of summation has a say in the result.

The nearest entry is found by partial distances. Each vector starts with the entry that is nearest in the most telling dimension, and
that entry's whole distance. The other entries follow in order of their number; their squared differences are added up dimension by
dimension, in descending variance of the codebook, for all vectors of a batch that are still in question, and a vector leaves as soon
as its sum strictly exceeds its best complete distance so far. Ties go to the lower entry, hence "strictly".

Dropped: vectors that are null or hold a null or non-finite component, and those that have no exact result: of another length than
most kept ones (ties: the longest) or of one that 8 does not divide (empty ones with it), or with a component too large for the
squared distances to fit a long (32,768 and more for 64 components). A null vec_id comes behind all others; equal vec_ids stand in
order of their vectors. With fewer than 16 kept vectors the codebooks are as much smaller. Null labels are one label. Repeated rows
are coded alike, one output row each. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_path, text_columns

PARTS, ENTRIES, ROUNDS = 8, 16, 6
SCALE = 4096
#: Vectors that a worker codes at a time.
ROWS = 4096
#: Different labels up to which their sums are broadcast.
MAX_LABELS = 1 << 16


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column of equally long lists without nulls as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), dims)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of the codebook for each row of x, the lower of equals, and the squared distance."""
    mean = book.sum(0, dtype=np.float64) / len(book)
    order = np.argsort(-((book - mean) ** 2).sum(0), kind="stable")
    x, book = np.ascontiguousarray(x[:, order].T), book[:, order]
    best = np.abs(x[0][:, None] - book[:, 0]).argmin(1)
    distance = np.zeros(x.shape[1], np.int64)
    for d in range(len(book[0])):
        distance += (x[d] - book[best, d]) ** 2
    for e in range(len(book)):
        rows = np.flatnonzero(best != e)
        sums = np.zeros(len(rows), np.int64)
        for d in range(len(book[0])):
            sums += (x[d][rows] - book[e, d]) ** 2
            open_ = sums <= distance[rows]
            if not open_.all():
                rows, sums = rows[open_], sums[open_]
                if not len(rows):
                    break
        # those that are left are complete, and at most as far as the best
        rows, sums = (x[(sums < distance[rows]) | (e < best[rows])] for x in (rows, sums))
        best[rows], distance[rows] = e, sums
    return best, distance


def assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all parts, and each vector's error. books: part, entry, component."""
    size = books.shape[2]
    found = [nearest(x[:, p * size : (p + 1) * size], books[p]) for p in range(len(books))]
    return np.stack([c for c, _ in found], 1), np.sum([d for _, d in found], 0)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            yield batch.slice(k, ROWS)


def integers(vectors: DataFrame, parts: int = PARTS) -> tuple[DataFrame, int]:
    """vec_id, label, v (array of integers) of the vectors that are coded, as a stored table, and their number of components."""
    spark = vectors.sparkSession
    real = F.transform("embedding", lambda c: c.cast("double"))
    sound = F.col("embedding").isNotNull() & F.forall("embedding", lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    # how many components: a row per length that occurs
    sizes = vectors.filter(sound).groupBy(F.size("embedding").alias("dims")).count().filter((F.col("dims") > 0) & (F.col("dims") % parts == 0))
    most = sizes.orderBy(F.desc("count"), F.desc("dims")).first()
    dims = most["dims"] if most else parts
    limit = isqrt((1 << 62) // dims) // 2
    fits = (F.size("embedding") == dims) & F.forall("embedding", lambda c: F.abs(c.cast("double")) < limit / SCALE)
    # floor first in double, where the product by a power of two is exact
    whole = F.transform(real, lambda c: F.floor(c * SCALE).cast("int"))
    kept = vectors.filter(sound).filter(fits).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), whole.alias("v"))
    at = new_path(spark, "vectors")
    kept.write.parquet(at)
    return spark.read.schema(kept.schema).parquet(at), dims


def first_books(kept: DataFrame, dims: int, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    rows = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    return np.array([r["v"] for r in rows], np.int64).reshape(len(rows), parts, dims // parts).swapaxes(0, 1)


def _sums(held, dims: int):
    """For a task: of each part and entry, in a row each, how many parts there are (position -1) and their componentwise sums."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = held.value
        parts, entries, size = books.shape
        total = np.zeros((parts, entries, size + 1), np.int64)
        for batch in _batches(batches):
            x = matrix(batch.column(0), dims)
            codes, _ = assign(x, books)
            for p in range(parts):
                total[p, :, 0] += np.bincount(codes[:, p], minlength=entries)
                by, part = np.argsort(codes[:, p], kind="stable"), x[:, p * size : (p + 1) * size]
                used, starts = np.unique(codes[by, p], return_index=True)
                total[p, used, 1:] += np.add.reduceat(part[by], starts, axis=0)
        p, e, k = (a.ravel() for a in np.indices(total.shape))
        use = total[p, e, 0] > 0
        yield pa.RecordBatch.from_arrays([pa.array(a[use], pa.int64()) for a in (p, e, k - 1, total.ravel())], names=["part", "entry", "position", "n"])

    return mapped


def fit(kept: DataFrame, dims: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks after all rounds, as an array of part, entry and component."""
    context = kept.sparkSession.sparkContext
    books = first_books(kept, dims, parts, entries)
    for _ in range(rounds if books.size else 0):
        held = context.broadcast(books)
        rows = kept.select("v").mapInArrow(_sums(held, dims), "part long, entry long, position long, n long")
        new = rows.groupBy("part", "entry", "position").agg(F.sum("n").alias("n")).toArrow()  # as large as the codebooks
        total = np.zeros((*books.shape[:2], books.shape[2] + 1), np.int64)
        total[tuple(new[c].to_numpy() + (c == "position") for c in ("part", "entry", "position"))] = new["n"].to_numpy()
        count = total[:, :, :1]
        books = np.where(count > 0, total[:, :, 1:] // np.maximum(count, 1), books)
        held.unpersist()
    return books


def _codes(held, dims: int):
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = held.value
        for batch in _batches(batches):
            ids, label, v = text_columns(batch, "vec_id", "label", "v")
            codes, error = assign(matrix(v, dims), books)
            text = codes.astype(np.uint8).tobytes().hex()
            width = 2 * codes.shape[1]
            yield pa.RecordBatch.from_arrays([ids, label, pa.array([text[k : k + width] for k in range(0, len(text), width)], pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return mapped


def coded(kept: DataFrame, dims: int, books: np.ndarray) -> DataFrame:
    """vec_id, label, code and error of every vector."""
    label = kept.schema["label"].dataType.simpleString()
    held = kept.sparkSession.sparkContext.broadcast(books)
    return kept.mapInArrow(_codes(held, dims), f"vec_id long, label {label}, code string, error long")


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of vectors (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    kept, dims = integers(vectors)
    books = fit(kept, dims)
    at = new_path(spark, "codes")
    rows = coded(kept, dims, books)
    rows.write.parquet(at)
    rows = spark.read.schema(rows.schema).parquet(at)
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    if sums.limit(MAX_LABELS + 1).count() <= MAX_LABELS:
        sums = F.broadcast(sums)
    out = rows.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))

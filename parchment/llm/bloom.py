"""A blocked Bloom filter of bounded size: a key sets one bit in each of the eight words of one 512-bit block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_names

#: Blocks of 64 bytes in a filter: at most 8 MB, however many keys there are.
MAX_BLOCKS = 1 << 17
#: Filter bits for each key, as long as MAX_BLOCKS allows.
BITS_PER_KEY = 16


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int")


def _bit(key: Column, word: int) -> Column:
    """The bit that a key sets in the given word of its block."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(F.xxhash64(F.lit(17), key), 6 * word).bitwiseAND(63).cast("int"))


def bloom_filter(keys: DataFrame, n_keys: int, max_blocks: int = MAX_BLOCKS) -> tuple[DataFrame, int]:
    """keys: key. Returns the filled blocks (block, w0 ... w7), each word 64 bits, and the number of blocks."""
    n_blocks = 1
    while n_blocks < max_blocks and n_blocks * 512 < n_keys * BITS_PER_KEY:
        n_blocks *= 2
    key = F.col("key")
    return keys.groupBy(_block(key, n_blocks).alias("block")).agg(*(F.bit_or(_bit(key, k)).alias(f"w{k}") for k in range(8))), n_blocks


def with_maybe(rows: DataFrame, key: Column, blooms: DataFrame, n_blocks: int, name: str) -> DataFrame:
    """rows with a boolean column: false where the filter has no such key; a null key is in no filter."""
    block, *words = free_names(rows, "block", *(f"w{k}" for k in range(8)))
    hit = F.lit(True)
    for k, w in enumerate(words):
        hit = hit & (F.col(w).bitwiseAND(_bit(key, k)) != 0)
    of = blooms.select(F.col("block").alias(block), *(F.col(f"w{k}").alias(w) for k, w in enumerate(words)))
    joined = rows.join(F.broadcast(of), _block(key, n_blocks) == F.col(block), "left")
    return joined.withColumn(name, F.coalesce(hit & key.isNotNull(), F.lit(False))).drop(block, *words)

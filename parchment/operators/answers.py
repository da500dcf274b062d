"""A store of answers by key: tables dealt out by the front of the key, of which a manifest tells which count.

A put writes one more table and publishes a manifest with it; where a key is in several tables, the latest counts. Once there are more
than a few, compact() merges them into one and publishes that. What a manifest does not name is never read, so a job that ends between
writing and publishing changes nothing. The keys are hexadecimal digests; their first digits are the bucket, a folder of the table,
and further ones choose the bits of the table's Bloom filter, a row of four words for each block of a bucket. A look-up joins its keys
with the filters' rows first, and then reads only those buckets in which the filter has one of them.
"""

from __future__ import annotations

import functools
import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CACHE
from ..storage import forget, latest, new_path, publish, published, shuffles_gone, written

#: Tables from which a put merges them.
TABLES = 8
#: Keys of a bucket, at most: a table has as many digits of the key for its buckets as that takes.
KEYS_PER_BUCKET = 1 << 16
#: Keys for which a block of the filter has its 256 bits.
KEYS_PER_BLOCK = 16
WORDS = 4


@dataclass(frozen=True)
class Table:
    """A table's name, the blocks of each bucket's filter, the digits of its buckets' names, and its number of keys."""

    name: str
    blocks: int
    digits: int
    n: int


def digits_for(n: int) -> int:
    digits = 1
    while n > KEYS_PER_BUCKET << 4 * digits:
        digits += 1
    return digits


def bucket(key: Column, digits: int) -> Column:
    return F.substring(key, 1, digits)


def _number(key: Column, first: int, digits: int) -> Column:
    return F.conv(F.substring(key, first, digits), 16, 10).cast("long")


def _block(key: Column, blocks: int) -> Column:
    return _number(key, 17, 8) % blocks


def _bit(key: Column, word: int) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (_number(key, 33 + 2 * word, 2) % 64).cast("int"))


class Answers:
    """The store at a folder. Writers must not run at a time: the second one's publishing fails. digits: of the buckets' names, None: by the number of keys."""

    def __init__(self, spark: SparkSession, at: str, digits: int | None = None):
        self.spark, self.at, self.digits = spark, at.rstrip("/"), digits

    def tables(self) -> list[Table]:
        """Those that count, the latest last."""
        n = latest(self.spark, self.at)
        return [Table(**t) for t in json.loads(published(self.spark, self.at, n))] if n else []

    def _publish(self, tables: list[Table]) -> None:
        publish(self.spark, self.at, latest(self.spark, self.at) + 1, json.dumps([asdict(t) for t in tables]))

    def _rows(self, table: Table, buckets: list[str] | None = None) -> DataFrame:
        at = f"{self.at}/tables/{table.name}"
        only = [at] if buckets is None else [f"{at}/bucket={b}" for b in buckets]
        return self.spark.read.schema(f"{CACHE}, bucket string").option("basePath", at).parquet(*only)

    def _filters(self, table: Table) -> DataFrame:
        return self.spark.read.parquet(f"{self.at}/filters/{table.name}")

    def _write(self, rows: DataFrame) -> Table:
        """rows: CACHE, a row for each key. Writes them and their filter, which nothing reads until they are published."""
        name, scratch = uuid.uuid4().hex, new_path(self.spark, "answers")
        rows = written(rows, scratch)
        n = rows.count()
        digits = self.digits or digits_for(n)
        dealt = rows.select("key", "output", "warning", "model", bucket(F.col("key"), digits).alias("bucket"))
        with shuffles_gone(self.spark):
            dealt.repartition("bucket").sortWithinPartitions("bucket", "key").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.at}/tables/{name}")
        forget(self.spark, scratch)
        keys = self.spark.read.schema("key string, bucket string").parquet(f"{self.at}/tables/{name}")
        blocks = max(1, -(-n // (KEYS_PER_BLOCK * 16**digits)))
        key = F.col("key")
        bits = keys.groupBy("bucket", _block(key, blocks).alias("block")).agg(*(F.bit_or(_bit(key, k)).alias(f"w{k}") for k in range(WORDS)))
        bits.write.parquet(f"{self.at}/filters/{name}")
        return Table(name, blocks, digits, n)

    def put(self, rows: DataFrame) -> None:
        """rows: CACHE. Of a key that occurs twice one answer stays. Merges the tables when there are more than TABLES."""
        fresh = self._write(rows.groupBy("key").agg(F.min(F.struct("output", "warning", "model")).alias("least")).select("key", "least.*"))
        if fresh.n:
            self._publish([*self.tables(), fresh])
        if len(self.tables()) > TABLES:
            self.compact()

    def _latest(self, parts: list[tuple[int, DataFrame]]) -> DataFrame:
        """The answers of the highest number that has the key."""
        told = [p.select("key", F.struct(F.lit(k).alias("turn"), "output", "warning", "model").alias("answer")) for k, p in parts]
        every = told[0]
        for p in told[1:]:
            every = every.unionByName(p)
        last = every.groupBy("key").agg(F.max("answer").alias("answer")) if len(told) > 1 else every
        return last.select("key", "answer.output", "answer.warning", "answer.model")

    def all(self) -> DataFrame:
        """CACHE: every key with its latest answer."""
        tables = self.tables()
        return self._latest([(k, self._rows(t)) for k, t in enumerate(tables)]) if tables else self.spark.createDataFrame([], CACHE)

    def puts(self) -> DataFrame:
        """key of every answer of every table that counts: a key as often as it was put since the tables were merged."""
        rows = [self._rows(t).select("key") for t in self.tables()]
        return functools.reduce(DataFrame.unionByName, rows) if rows else self.spark.createDataFrame([], "key string")

    def compact(self) -> None:
        """Makes one table of all; the old ones stay until vacuum()."""
        if len(self.tables()) > 1:
            self._publish([self._write(self.all())])

    def vacuum(self) -> None:
        """Deletes the tables that no longer count, and those that never did. Nothing may read the store meanwhile."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.at}/tables")
        system = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        live = {t.name for t in self.tables()}
        for x in system.listStatus(path) if system.exists(path) else []:
            if (name := x.getPath().getName()) not in live:
                forget(self.spark, f"{self.at}/tables/{name}")
                forget(self.spark, f"{self.at}/filters/{name}")

    def look_up(self, keys: DataFrame, scratch: str | None = None) -> DataFrame:
        """keys: key. CACHE of those that have an answer. scratch: a folder that what is returned is read from, None for a new one."""
        scratch = scratch or new_path(self.spark, "looked-up")
        keys = written(keys.select("key").dropna().distinct(), f"{scratch}/keys")
        parts = []
        for k, table in enumerate(self.tables()):
            key = F.col("key")
            probe = keys.select("key", bucket(key, table.digits).alias("bucket"), _block(key, table.blocks).alias("block"))
            hit = F.lit(True)
            for w in range(WORDS):
                hit = hit & (F.col(f"w{w}").bitwiseAND(_bit(key, w)) != 0)
            maybe = written(probe.join(self._filters(table), ["bucket", "block"]).filter(hit).select("key", "bucket"), f"{scratch}/maybe-{k}")
            buckets = [r["bucket"] for r in maybe.select("bucket").distinct().collect()]  # as many as there are buckets, at most
            if buckets:
                parts.append((k, self._rows(table, buckets).join(maybe.select("key"), "key", "left_semi")))
        forget(self.spark, f"{scratch}/keys")
        return self._latest(parts) if parts else self.spark.createDataFrame([], CACHE)

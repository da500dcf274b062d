"""Source trees by manifest: tasks list the papers' folders, and a snapshot tells which files are to be read again.

A manifest is a table of papers and their folders, dealt out into buckets. The data source `paper_files` has a partition for each
bucket; its task reads its share of the manifest and lists those folders, so the driver knows the buckets only, however many files there are.

A refresh compares the listing with the last snapshot by length and time of change, and reads those files only that are new or changed.
Their texts make up one more generation; the snapshot has the generation of each file, so texts of unchanged files stay where
they are. A generation counts once its number is published: a refresh that ends before leaves nothing that is ever read, and the next one
writes over it. Two refreshes of one store must not run at a time; the second one fails when it publishes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..constants import DOCUMENT_SUFFIXES, STYLE_SUFFIXES
from ..storage import latest, publish, read_or_empty
from . import files
from .tree import decoded

FOLDERS = "paper_id string, folder string"
LISTED = "paper_id string, path string, address string, length long, modified long"
SNAPSHOT = f"{LISTED}, generation long"
TEXTS = "paper_id string, path string, text string"
_LISTED = pa.schema([("paper_id", pa.string()), ("path", pa.string()), ("address", pa.string()), ("length", pa.int64()), ("modified", pa.int64())])
_ROWS = 4096


def _joined(address: str, path: str) -> str:
    """The address of a file, by that of a folder as it was given and the file system's own path of the file."""
    _, base = files.at(address)
    return f"{address.rstrip('/')}/{path[len(base.rstrip('/')) + 1 :]}"


def folders_below(spark: SparkSession, root: str) -> DataFrame:
    """FOLDERS: those right below root, by name. One task lists them; larger trees bring a manifest of their own, or one of each part."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for address in batch.column(0).to_pylist():
                system, path = files.at(address)
                found = [(x.base_name, _joined(address, x.path)) for x in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if x.type == fs.FileType.Directory]
                for k in range(0, len(found), _ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found[k : k + _ROWS], strict=True)], names=["paper_id", "folder"])

    return spark.createDataFrame([(root,)], "root string").mapInArrow(listed, FOLDERS)


def write_manifest(folders: DataFrame, at: str, buckets: int = 64) -> None:
    """folders: FOLDERS. A paper's folders are in one bucket."""
    dealt = folders.select("paper_id", "folder").withColumn("bucket", F.pmod(F.xxhash64("paper_id"), F.lit(buckets)).cast("int"))
    dealt.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(at)


class _Bucket(InputPartition):
    pass


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.manifest = options["path"]
        self.suffixes = tuple(s for s in options.get("suffixes", "").lower().split(",") if s)

    def partitions(self) -> list[InputPartition]:
        system, path = files.at(self.manifest)
        found = [x.path for x in system.get_file_info(fs.FileSelector(path)) if x.type == fs.FileType.Directory and x.base_name.startswith("bucket=")]
        return [_Bucket(p) for p in sorted(found)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system, _ = files.at(self.manifest)
        for part in system.get_file_info(fs.FileSelector(partition.value)):
            if not part.path.endswith(".parquet"):
                continue
            for batch in pq.ParquetFile(system.open_input_file(part.path)).iter_batches(_ROWS, columns=["paper_id", "folder"]):
                for paper, folder in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    yield from self._listed(paper, folder)

    def _listed(self, paper: str, folder: str) -> Iterator[pa.RecordBatch]:
        system, path = files.at(folder)
        rows = [
            (paper, x.path[len(path.rstrip("/")) + 1 :], _joined(folder, x.path), x.size, x.mtime_ns)
            for x in system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
            if x.type == fs.FileType.File and (not self.suffixes or x.base_name.lower().endswith(self.suffixes))
        ]
        for k in range(0, len(rows), _ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + _ROWS], strict=True), _LISTED.types, strict=True)], schema=_LISTED)


class PaperFiles(DataSource):
    """Files below the folders of the manifest at path; suffixes: a comma-separated list, compared without regard to case; none: all files."""

    @classmethod
    def name(cls) -> str:
        return "paper_files"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> DataSourceReader:
        if "path" not in self.options:
            raise ValueError("paper_files needs the path of a manifest")
        return _Reader(dict(self.options))


def listing(spark: SparkSession, manifest: str, suffixes: tuple[str, ...] = (*DOCUMENT_SUFFIXES, *STYLE_SUFFIXES)) -> DataFrame:
    """LISTED of the manifest's folders. A folder that is gone has no files."""
    spark.dataSource.register(PaperFiles)
    return spark.read.format("paper_files").option("suffixes", ",".join(suffixes)).load(manifest)


def with_content(listed: DataFrame) -> DataFrame:
    """listed: address and other columns. Adds content, null where the file is gone since; tasks read the files."""
    schema = ", ".join(f"`{c}` {t}" for c, t in listed.dtypes) + ", content binary"

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a file at a time
                row = batch.slice(k, 1)
                data = files.read(row.column(row.schema.get_field_index("address"))[0].as_py())
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([data], pa.binary())], names=[*row.schema.names, "content"])

    return listed.mapInArrow(mapped, schema)


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """before: SNAPSHOT; now: LISTED. All files of both, with the newer facts, generation (null unless the same) and change: same, added, changed or deleted."""
    old = before.select("paper_id", "path", F.struct("length", "modified", "address", "generation").alias("old"))
    new = now.select("paper_id", "path", F.struct("length", "modified", "address").alias("new"))
    both = old.join(new, ["paper_id", "path"], "full")
    same = (F.col("old.length") == F.col("new.length")) & (F.col("old.modified") == F.col("new.modified"))
    change = F.when(F.col("new").isNull(), "deleted").when(F.col("old").isNull(), "added").when(same, "same").otherwise("changed")
    newer = lambda c: F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}")).alias(c)
    return both.select("paper_id", "path", newer("address"), newer("length"), newer("modified"), F.when(change == "same", F.col("old.generation")).alias("generation"), change.alias("change"))


def snapshot(spark: SparkSession, at: str) -> DataFrame:
    """SNAPSHOT of the latest refresh, empty before the first."""
    n = latest(spark, at)
    return spark.read.schema(SNAPSHOT).parquet(f"{at}/snapshots/{n}") if n else spark.createDataFrame([], SNAPSHOT)


def refresh(spark: SparkSession, manifest: str, at: str, suffixes: tuple[str, ...] = (*DOCUMENT_SUFFIXES, *STYLE_SUFFIXES)) -> int:
    """Brings the store at a folder up to date with the manifest's files. Returns the new generation's number."""
    n = latest(spark, at) + 1
    told = changes(snapshot(spark, at), listing(spark, manifest, suffixes)).filter("change <> 'deleted'")
    told.select("paper_id", "path", "address", "length", "modified", F.coalesce("generation", F.lit(n)).cast("long").alias("generation")).write.mode("overwrite").parquet(f"{at}/snapshots/{n}")
    fresh = spark.read.schema(SNAPSHOT).parquet(f"{at}/snapshots/{n}").filter(F.col("generation") == n)
    texts = with_content(fresh.select("paper_id", "path", "address")).filter("content is not null").select("paper_id", "path", decoded(F.col("content")).alias("text"))
    texts.write.mode("overwrite").parquet(f"{at}/texts/generation={n}")
    publish(spark, at, n)
    return n


def texts(spark: SparkSession, at: str) -> DataFrame:
    """paper_id, path, text and generation of all files of the latest refresh."""
    live = snapshot(spark, at).select("paper_id", "path", "generation")
    return read_or_empty(spark, f"{at}/texts", f"{TEXTS}, generation long").join(live, ["paper_id", "path", "generation"], "left_semi")

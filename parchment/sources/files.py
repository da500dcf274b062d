"""Named files in any file system, read, written, moved and deleted by tasks.

Spark's writers name their own parts. Files that must have a name of their own, as a record or a guide of a paper has, are
written in two steps: each task writes its rows' files into a pending folder of its own and tells which it wrote, in a table that holds
the rows of finished tasks only; when all have finished, a second job moves what the table tells. So a job that fails leaves no
file, a task that ran twice leaves one, and the moves can be done again. Addresses are what pyarrow.fs takes: `file:///...`, `s3://...`,
`hdfs://...`, or a local path.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WRITTEN = "pending string, target string, length long"


_ADDRESS = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?)(/.*)", re.DOTALL)


def at(address: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address, and the path in it. What follows the host is the path as it is, whatever characters it has."""
    if not (m := _ADDRESS.fullmatch(address)):
        return fs.LocalFileSystem(), address
    system, base = fs.FileSystem.from_uri("file:///" if m[1] in ("file:", "file://") else f"{m[1]}/")
    return system, base.rstrip("/") + m[2]


def parent(path: str) -> str:
    return path.rpartition("/")[0]


def write(address: str, content: bytes) -> None:
    system, path = at(address)
    system.create_dir(parent(path))
    with system.open_output_stream(path) as out:
        out.write(content)


def read(address: str) -> bytes | None:
    """All bytes, None where there is no such file (any more)."""
    system, path = at(address)
    try:
        with system.open_input_stream(path) as stream:
            return stream.read()
    except FileNotFoundError:
        return None


def each(rows: DataFrame, names: list[str], f: Callable, schema: str) -> DataFrame:
    """f applied to the named columns of each row, for its effect; its results make up the rows."""
    kinds = pa.schema([(x.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in schema.split(", ")])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 100):
                found = [f(*row) for row in zip(*(batch.column(n).slice(k, 100).to_pylist() for n in names), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds.types, strict=True)], schema=kinds)

    return rows.select(*names).mapInArrow(mapped, schema)


def write_named(rows: DataFrame, root: str, name: str = "name", content: str = "content") -> int:
    """Writes root/<name> for each row, content as UTF-8 if it is a string. All files, or none. Returns how many.

    Names must not occur twice. A name that leads out of root ends the job.
    """
    spark, root = rows.sparkSession, root.rstrip("/")
    run = f"{root}/_pending-{uuid.uuid4().hex}"

    def pending(name: str, content: bytes) -> tuple[str, str, int]:
        if name.startswith("/") or ".." in name.split("/"):
            raise ValueError(f"{name} is outside of the folder")
        own = f"{run}/{uuid.uuid4().hex}"
        write(own, content)
        return own, f"{root}/{name}", len(content)

    def move(own: str, target: str, length: int) -> tuple[str, int]:
        system, path = at(target)
        _, source = at(own)
        system.create_dir(parent(path))
        try:
            system.move(source, path)
        except FileNotFoundError:  # moved by an earlier attempt of this task
            if system.get_file_info(path).type != fs.FileType.File:
                raise
        return target, length

    try:
        named = rows.select(F.col(name).alias("name"), F.coalesce(F.col(content), F.lit("")).cast("binary").alias("content"))
        each(named, ["name", "content"], pending, WRITTEN).write.parquet(f"{run}/written")
        written = spark.read.schema(WRITTEN).parquet(f"{run}/written")
        each(written, ["pending", "target", "length"], move, "target string, length long").write.format("noop").mode("overwrite").save()
        return written.count()
    finally:
        system, path = at(run)
        if system.get_file_info(path).type == fs.FileType.Directory:
            system.delete_dir(path)


def delete(rows: DataFrame, address: Column) -> None:
    """Deletes the files at an address, those that are there."""

    def gone(address: str) -> tuple[str]:
        system, path = at(address)
        if system.get_file_info(path).type == fs.FileType.File:
            system.delete_file(path)
        return (address,)

    each(rows.select(address.alias("address")), ["address"], gone, "address string").write.format("noop").mode("overwrite").save()

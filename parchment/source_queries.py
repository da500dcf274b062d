r"""Queries over files that tasks make from a table and read back: archives of every kind, and trees that change; with DuckDB SQL for the same rows.

The files lie in a new folder of the shared scratch folder, one for each document, written by tasks.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import tarfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import table
from .sources import archives, files, manifest
from .storage import new_path, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_TEX = r"\documentclass{article}"


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def _tar(members: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as archive:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            archive.addfile(info, io.BytesIO(data))
    return out.getvalue()


def _zip(members: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, data in members:
            archive.writestr(name, data)
    return out.getvalue()


_PACK = (None, lambda x: gzip.compress(x, 1, mtime=0), lambda x: bz2.compress(x, 1), lambda x: lzma.compress(x, preset=0))


def archive(kind: int, defect: int, text: str) -> bytes:
    """An archive of a text and a figure: kind 0 to 3 a tar, plain or compressed, 4 a zip, 5 a compressed text; defect 1 lacks its end, 2 has 40 bytes zeroed, 3 has a member outside."""
    main = f"{_TEX}\n{text}".encode()
    members = [("./src/main.TEX", main), ("figs/plot.eps", b"%!PS " + main), ("../out.tex" if defect == 3 else "notes.txt", b"x")]
    if kind == 4:
        data = _zip(members)
    elif kind == 5:
        data = gzip.compress(main, 1, mtime=0)
    else:
        data = _tar(members)
        if kind == 0 and defect == 1:
            return data[: 512 + -(-len(main) // 512) * 512 + 512 + len(main)]  # in the midst of the figure
        if kind == 0 and defect == 2:
            at = 512 + -(-len(main) // 512) * 512
            return data[:at] + bytes(40) + data[at + 40 :]  # the name in the figure's header
        data = _PACK[kind](data) if kind else data
    if defect == 1:
        return data[:-5]
    if defect == 2:
        middle = len(data) // 2 - 20
        return data[:middle] + bytes(40) + data[middle + 40 :]
    return data


def _archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 100):
            rows = [(f"{doc}.bin", archive(doc % 6, doc // 6 % 4, text or "")) for doc, text in zip(*(c.slice(k, 100).to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.binary()), strict=True)], names=["name", "content"])


@query(rf"""
with a as (select doc_id, doc_id % 6 kind, case when doc_id // 6 % 4 in (1, 2) then 'damaged' when doc_id // 6 % 4 = 3 and doc_id % 6 < 5 then 'unsafe' else 'ok' end status,
  '{_TEX}' || chr(10) || coalesce(text, '') t from documents)
select doc_id::varchar || '.bin' paper_id, case when status = 'ok' then case when kind = 5 then 'main.tex' else 'src/main.TEX' end end path,
  case when status = 'ok' then octet_length(encode(t)) end n_bytes, case when status = 'ok' then md5(t) end content_md5, status from a""")
def archives_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole, cut, corrupted and unsafe archives of six kinds in files: the TeX members, streamed by tasks, or why there are none."""
    at = new_path(spark, "archives")
    made = table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(_archives, "name string, content binary")
    files.write_named(made, at)
    landed = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.col("doc_id").cast("string"), F.lit(".bin")).alias("paper_id"))
    found = archives.expand_files(landed.withColumn("address", F.concat(F.lit(f"{at}/"), "paper_id")), archives.TEX)
    return found.select("paper_id", "path", F.octet_length("content").cast("long").alias("n_bytes"), F.md5("content").alias("content_md5"), "status")


_PAPER, _FILE = "doc_id // 10", "case doc_id % 4 when 0 then 'main.tex' when 1 then 'parts/' || doc_id || '.TEX' when 2 then 'a b+' || doc_id || '.sty' else 'fig' || doc_id || '.png' end"


@query(f"""
with f as (select *, doc_id % 7 = 1 changed, doc_id % 7 <> 1 and doc_id % 11 = 2 deleted, coalesce(text, '') t
  from (select doc_id, text, ({_PAPER})::varchar paper_id, {_FILE} path from documents where doc_id % 4 < 3) qualify row_number() over (partition by paper_id, path order by doc_id) = 1)
select paper_id, path, case when changed then 'changed' when deleted then 'deleted' when doc_id % 5 = 3 then 'added' else 'same' end change,
  case when deleted then null when changed or doc_id % 5 = 3 then 2 else 1 end::bigint generation,
  case when not deleted then md5(replace(replace(if(changed, '22 ', '1 ') || t, chr(13) || chr(10), chr(10)), chr(13), chr(10))) end text_md5 from f""")
def tree_refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of a file for each document, read, then changed (files rewritten, deleted and added) and refreshed: what changed, and all texts by the generation that read them."""
    n, at = F.col("doc_id"), new_path(spark, "tree")
    number = n.cast("string")
    path = F.when(n % 4 == 0, "main.tex").when(n % 4 == 1, F.concat(F.lit("parts/"), number, F.lit(".TEX"))).when(n % 4 == 2, F.concat(F.lit("a b+"), number, F.lit(".sty"))).otherwise(F.concat(F.lit("fig"), number, F.lit(".png")))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.floor(n / 10).cast("string"), F.lit("/"), path).alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    # of main files of one paper, one
    # stored, as four jobs read them, each of which would group all texts anew
    docs = stored(docs.groupBy("name").agg(F.min_by(F.struct("doc_id", "text"), "doc_id").alias("of")).select("of.doc_id", "name", "of.text"), "files")
    changed, deleted = n % 7 == 1, (n % 7 != 1) & (n % 11 == 2)
    added = ~changed & ~deleted & (n % 5 == 3)
    root, store = f"{at}/papers", f"{at}/store"
    files.write_named(docs.filter(~added).withColumn("content", F.concat(F.lit("1 "), "text")), root)
    manifest.write_manifest(manifest.folders_below(spark, root), f"{at}/manifest")
    manifest.refresh(spark, f"{at}/manifest", store)
    before = manifest.snapshot(spark, store)
    files.write_named(docs.filter(changed).withColumn("content", F.concat(F.lit("22 "), "text")), root)
    files.write_named(docs.filter(added).withColumn("content", F.concat(F.lit("1 "), "text")), root)
    files.delete(docs.filter(deleted), F.concat(F.lit(f"{root}/"), "name"))
    manifest.write_manifest(manifest.folders_below(spark, root).unionByName(before.select("paper_id", F.concat(F.lit(f"{root}/"), "paper_id").alias("folder"))).distinct(), f"{at}/manifest")
    manifest.refresh(spark, f"{at}/manifest", store)
    told = manifest.changes(before, manifest.snapshot(spark, store)).select("paper_id", "path", "change")
    return told.join(manifest.texts(spark, store), ["paper_id", "path"], "left").select("paper_id", "path", "change", "generation", F.md5("text").alias("text_md5"))

import io
import os
import time

import pytest
from pyspark.sql import functions as F

from parchment.source_queries import archive
from parchment.sources import archives, files, manifest
from parchment.storage import latest, publish

TEXT = "".join(f"line {i * i % 977} of the text\n" for i in range(900))


def told(data):
    return [(p, s) for p, _, s in archives.members(lambda: io.BytesIO(data))]


@pytest.mark.parametrize("kind", range(6))
def test_cut_archives_are_damaged(kind):
    """At whatever byte it ends: an archive of any kind is whole, or of no use."""
    whole = archive(kind, 0, TEXT)
    assert told(whole)[0][1] == "ok" and len(told(whole)) == (1 if kind == 5 else 3)
    end = len(whole)
    if kind == 0:  # behind the end mark a tar has padding, which may be cut
        end = max(k for k, b in enumerate(whole) if b) + 1
        end = -(-end // 512) * 512 + 512
        assert told(whole[:end]) == told(whole)
    for k in [*range(9, 600, 13), *range(600, end, max(1, end // 150)), end - 1, end - 5, end - 9, end - 20]:
        assert told(whole[:k]) in ([(None, "damaged")], [(None, "no tex")]), k
        # only what is too short for any header may be taken for other words
        assert told(whole[:k])[0][1] == "damaged" or k < 512


@pytest.mark.parametrize("kind", range(1, 6))
def test_changed_archives_are_damaged(kind):
    whole = bytearray(archive(kind, 0, TEXT))
    hits = 0
    for k in range(12, len(whole) - 4, max(1, len(whole) // 120)):
        other = bytes(whole[:k]) + bytes([whole[k] ^ 0x55]) + bytes(whole[k + 1 :])
        found = told(other)
        # bits of names, times and the like are not covered by every format; contents are
        same = [d for _, d, _ in archives.members(lambda other=other: io.BytesIO(other))] == [d for _, d, _ in archives.members(lambda: io.BytesIO(bytes(whole)))]
        assert same or found[0][1] in ("damaged", "unsafe", "no tex"), k
        hits += found[0][1] == "damaged"
    assert hits > 60


def test_tar_headers_and_nested_compression():
    import gzip

    plain = archive(0, 0, TEXT)
    assert told(archive(0, 2, TEXT)) == [(None, "damaged")]
    assert told(gzip.compress(archive(1, 0, TEXT))) == told(plain)
    assert told(gzip.compress(gzip.compress(archive(1, 0, TEXT)))) == [(None, "no tex")]
    assert told(b"\0" * 1024) == [(None, "no tex")] and told(b"\\input") == [("main.tex", "ok")]


def test_large_members_and_suffixes(spark):
    data = archive(3, 0, TEXT)
    rows = list(archives.members(lambda: io.BytesIO(data), (".tex",), 100))
    assert rows == [("src/main.TEX", None, "large")]
    df = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(archive(4, 1, TEXT)))], "paper_id string, content binary")
    got = archives.expand(df, (".eps", ".txt"), 100).collect()
    assert sorted((r["paper_id"], r["path"] or "", r["status"]) for r in got) == [("a", "figs/plot.eps", "large"), ("a", "notes.txt", "ok"), ("b", "", "damaged")]


def test_a_large_archive_is_streamed():
    """Reading an archive of some 60 MB in members of 2 MB takes the memory of a few members."""
    import tarfile
    import tracemalloc

    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        for k in range(30):
            info = tarfile.TarInfo(f"{k}.tex")
            info.size = 1 << 21
            tar.addfile(info, io.BytesIO(bytes([65 + k]) * info.size))
    data = out.getvalue()
    tracemalloc.start()
    n = sum(len(d) for _, d, _ in archives.members(lambda: io.BytesIO(data)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 30 << 21 and peak < 12 << 20


def test_missing_archive_files(spark, tmp_path):
    (tmp_path / "x y.bin").write_bytes(archive(2, 0, "t"))
    df = spark.createDataFrame([("p", f"file://{tmp_path}/x y.bin"), ("q", f"{tmp_path}/none.bin")], "paper_id string, address string")
    assert sorted((r["paper_id"], r["path"] or "", r["status"]) for r in archives.expand_files(df, archives.TEX).collect()) == [("p", "src/main.TEX", "ok"), ("q", "", "damaged")]


def test_named_files_are_all_or_none(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    rows = spark.createDataFrame([("a b/1.txt", "é"), ("a b/2%20.txt", None), ("z.txt", "last")], "name string, content string").repartition(3)
    assert files.write_named(rows, root) == 3
    assert (tmp_path / "out/a b/1.txt").read_text() == "é" and (tmp_path / "out/a b/2%20.txt").read_bytes() == b""
    broken = spark.createDataFrame([("new.txt", "x"), ("../up.txt", "y"), ("z.txt", "other")], "name string, content string").repartition(3)
    with pytest.raises(Exception, match="outside"):
        files.write_named(broken, root)
    assert sorted(os.listdir(tmp_path / "out")) == ["a b", "z.txt"] and (tmp_path / "out/z.txt").read_text() == "last"
    assert files.write_named(rows.filter("name = 'z.txt'").withColumn("content", F.lit("again")), root) == 1
    assert (tmp_path / "out/z.txt").read_text() == "again"
    assert files.write_named(rows.limit(0), root) == 0
    files.delete(rows.select(F.concat(F.lit(f"{root}/"), "name").alias("at")), F.col("at"))
    assert [n for _, _, n in os.walk(tmp_path / "out")] == [[], []]


def test_refresh_reads_only_what_changed(spark, tmp_path, monkeypatch):
    root, at, store = tmp_path / "papers", f"file://{tmp_path}/manifest", f"file://{tmp_path}/store"
    for path, data in {"p/a.tex": b"one", "p/sub/b.TEX": b"caf\xe9", "q q/c.sty": b"x", "q q/d.png": b"no"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(data)
    manifest.write_manifest(manifest.folders_below(spark, f"file://{root}"), at, buckets=4)
    assert manifest.snapshot(spark, store).count() == 0 == latest(spark, store)
    assert manifest.refresh(spark, at, store) == 1
    state = lambda: sorted((r["paper_id"], r["path"], r["text"], r["generation"]) for r in manifest.texts(spark, store).collect())
    assert state() == [("p", "a.tex", "one", 1), ("p", "sub/b.TEX", "caf", 1), ("q q", "c.sty", "x", 1)]
    time.sleep(0.02)
    (root / "p/a.tex").write_bytes(b"two")  # of the same length
    (root / "q q/c.sty").unlink()
    (root / "q q/e.ltx").write_bytes(b"new")
    # a refresh that ends before it publishes changes nothing, and the next one does all of it
    monkeypatch.setattr(manifest, "publish", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        manifest.refresh(spark, at, store)
    assert state() == [("p", "a.tex", "one", 1), ("p", "sub/b.TEX", "caf", 1), ("q q", "c.sty", "x", 1)]
    monkeypatch.undo()
    assert manifest.refresh(spark, at, store) == 2
    assert state() == [("p", "a.tex", "two", 2), ("p", "sub/b.TEX", "caf", 1), ("q q", "e.ltx", "new", 2)]
    # the second generation read two files only
    assert spark.read.parquet(f"{store}/texts/generation=2").count() == 2
    # folders that went: nothing of them is listed, which is no error
    (root / "q q/e.ltx").unlink()
    (root / "q q/d.png").unlink()
    (root / "q q").rmdir()
    assert manifest.refresh(spark, at, store) == 3 and len(state()) == 2
    with pytest.raises(Exception, match="exists"):
        publish(spark, store, 3)


def test_the_driver_knows_buckets_only(spark, tmp_path):
    """The source's partitions are as many as the manifest has buckets, whatever the number of folders and files."""
    for k in range(60):
        (tmp_path / f"papers/p{k}").mkdir(parents=True)
        for i in range(5):
            (tmp_path / f"papers/p{k}/{i}.tex").write_text("x")
    manifest.write_manifest(manifest.folders_below(spark, f"{tmp_path}/papers"), f"{tmp_path}/manifest", buckets=8)
    reader = manifest.PaperFiles({"path": f"{tmp_path}/manifest", "suffixes": ".tex"}).reader(None)
    parts = reader.partitions()
    assert len(parts) == 8
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 300
    assert manifest.listing(spark, f"{tmp_path}/manifest").count() == 300

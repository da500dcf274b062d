"""Translation keeps on disk what is still read: not the tables of every round and stage, nor their shuffle files."""

import random
import sys
import time
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import functions as F

from parchment.plans import translate
from parchment.rule_queries import translation_resumed
from parchment.storage import new_path, shared_dir, stored, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])
DATA = "/root/testdata/sf0.001"


def _held(spark):
    return sum(f.stat().st_size for f in Path(shared_dir(spark).removeprefix("file:")).rglob("*") if f.is_file())


def _prose(seed, n=3000):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(n))


class Same:
    model = "same"

    def __call__(self, request, fragment, route):
        if "broken" in fragment:
            return fragment + "{"
        if "``" in fragment and "rejected" not in request:
            return fragment + "}"
        return fragment


def test_rounds_leave_results_only(spark):
    chunks = [_prose(k) + tail for k, tail in enumerate(["", " ``quoted''", " broken"] * 5)]
    items = stored(spark.createDataFrame([(f"k{i}", c, "", "", "", "main") for i, c in enumerate(chunks)], "key string, chunk string, ctx_before string, ctx_after string, guide string, route string"), "given")
    size, before = sum(len(c) for c in chunks), _held(spark)
    done = translate.translate_items(items, Same(), wait=False)
    # at most the results, of which a third failed, and the round that ended last
    assert _held(spark) - before < 1.5 * size
    got = {r["key"]: r for r in done.collect()}
    for i, c in enumerate(chunks):
        r = got[f"k{i}"]
        if i % 3 == 2:
            assert (r["output"], r["status"], r["warning"]) == (None, "failed", "braces")
        else:
            # the answer as mended, not as it came, though it came again in each later round
            assert r["output"] == c.replace("``", '"').replace("''", '"') and r["status"] == "ok" and r["warning"].startswith(translate.ACCEPTED)
    assert len(got) == len(chunks) and set(done.columns) == {"key", "output", "status", "warning"}


def test_papers_keep_all_files_and_little_disk(spark):
    texts = {f"p{k}": _prose(100 + k) + (" broken" if k == 1 else "") for k in range(6)}
    rows = [(p, "main.tex", t) for p, t in texts.items()] + [("p0", "a.sty", "% style"), ("p0", "few.tex", "1 2 3"), ("p0", "none.tex", None), (None, "lost.tex", "of no paper " * 9), ("p1", None, "no path")]
    files = stored(spark.createDataFrame(rows, "paper_id string, path string, text string"), "given")
    size, before = sum(map(len, texts.values())), _held(spark)
    done, messages = translate.translate_papers(files, None, Same(), wait=False)
    assert _held(spark) - before < 1.5 * size
    got = sorted(((r["paper_id"], r["path"], r["text"]) for r in done.collect()), key=str)
    assert len(got) == len(rows)  # one of no paper came twice
    assert {(p, f): t.strip() for p, f, t in got} == {(p, f): (t or "").strip() for p, f, t in rows}
    assert [r["message"] for r in messages.filter("message like 'translation failed%'").collect()] == ["translation failed on main.tex#0: braces"]


def test_a_resumed_run_takes_disk_in_proportion(spark):
    before = _held(spark)
    assert translation_resumed(spark, DATA).agg(F.max("n_asked_again")).first()[0] == 0
    assert _held(spark) - before < 4 * Path(DATA, "documents.parquet").stat().st_size


def test_a_written_table_leaves_no_shuffle_files(spark):
    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.CollectionConverters.SeqHasAsJava(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()).asJava() if f.getName().startswith("shuffle_")}
    before = files()
    written(spark.range(50_000).select((F.col("id") % 20_000).alias("k"), F.md5(F.col("id").cast("string")).alias("x")).groupBy("k").agg(F.max("x").alias("x")), new_path(spark, "grouped"))
    end = time.time() + 10
    while files() - before and time.time() < end:
        time.sleep(0.1)
    assert not files() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"

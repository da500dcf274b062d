import hashlib

import pytest
from pyspark.sql import functions as F

from parchment.operators import answers as k
from parchment.storage import latest

SCHEMA = "key string, output string, warning string, model string"


def rows(spark, numbers, word):
    return spark.createDataFrame([(hashlib.sha256(str(n).encode()).hexdigest(), f"{n} {word}", None, "m") for n in numbers], SCHEMA)


def held(df):
    return sorted(r["output"] for r in df.collect())


@pytest.fixture
def store(spark, tmp_path):
    return k.Answers(spark, f"file://{tmp_path}/answers", digits=1)


def test_the_latest_answer_counts(spark, store):
    keys = rows(spark, range(60), "").select("key")
    assert held(store.look_up(keys)) == [] == held(store.all())
    store.put(rows(spark, range(40), "a").unionByName(rows(spark, range(40), "a")))
    store.put(rows(spark, range(30, 50), "b"))
    want = sorted([f"{n} a" for n in range(30)] + [f"{n} b" for n in range(30, 50)])
    assert held(store.look_up(keys)) == want == held(store.all())
    before = store.tables()
    store.compact()
    assert len(store.tables()) == 1 and store.tables()[0].n == 50 and held(store.look_up(keys.unionByName(keys))) == want
    assert held(store.look_up(rows(spark, range(1000, 1100), "").select("key"))) == []
    store.vacuum()
    assert held(store.look_up(keys)) == want
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        store._rows(before[0]).count()
    store.put(rows(spark, [], "none"))
    assert len(store.tables()) == 1


def test_many_tables_are_merged(spark, store, monkeypatch):
    monkeypatch.setattr(k, "TABLES", 2)
    for n in range(4):
        store.put(rows(spark, range(n, n + 3), str(n)))
    assert len(store.tables()) <= 2 and held(store.all()) == ["0 0", "1 1", "2 2", "3 3", "4 3", "5 3"]


def test_a_crash_before_publishing_changes_nothing(spark, store, monkeypatch):
    store.put(rows(spark, range(10), "a"))
    n, want = latest(spark, store.at), held(store.all())
    monkeypatch.setattr(k.Answers, "_publish", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        store.put(rows(spark, range(20), "b"))
    monkeypatch.undo()
    assert latest(spark, store.at) == n and held(store.all()) == want
    # a second writer that began from the same manifest fails
    k.publish(spark, store.at, n + 1, "[]")
    with pytest.raises(FileExistsError):
        k.publish(spark, store.at, n + 1, "[]")


def test_a_look_up_reads_only_the_buckets_it_needs(spark, tmp_path):
    store = k.Answers(spark, f"file://{tmp_path}/answers", digits=2)
    assert [k.digits_for(n) for n in (0, 1 << 20, (1 << 20) + 1, 1 << 30)] == [1, 1, 2, 4]
    every = rows(spark, range(6000), "a")
    store.put(every)
    buckets = {p.split("bucket=")[1][:2] for p in store.all().inputFiles()}
    assert len(buckets) == 256
    some = every.filter(F.col("key") < "03").select("key")
    found = store.look_up(some)
    assert 0 < found.count() == some.count() < 100
    assert {p.split("bucket=")[1][:2] for p in found.inputFiles() if "bucket=" in p} == {"00", "01", "02"}
    # keys without an answer: the filters keep nearly all buckets closed
    none = store.look_up(rows(spark, range(10_000, 10_400), "").select("key"))
    assert none.count() == 0 and len([p for p in none.inputFiles() if "bucket=" in p]) < 12

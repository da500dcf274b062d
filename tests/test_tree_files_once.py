"""The tree's files are made once: no job that writes them groups the texts again."""

from parchment import source_queries as q


def test_no_writing_job_groups(spark, monkeypatch):
    plans, write = [], q.files.write_named

    def seen(rows, *more):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return write(rows, *more)

    monkeypatch.setattr(q.files, "write_named", seen)
    q.tree_refreshed(spark, "/root/testdata/sf0.001")
    assert len(plans) == 3 and not any("Aggregate" in p for p in plans)

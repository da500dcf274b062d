"""Fetching, compiling and the command line, with stand-ins for what is outside."""

import stat
import sys

from pyspark import cloudpickle

from parchment import cli
from parchment.plans.compile import compile_papers
from parchment.sources.archives import source_status
from parchment.sources.fetch import fetch

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def web(url, timeout, use_proxy):
    if "gone" in url:
        return 404, "text/html", None, "HTTP 404"
    return 200, "application/x", url.encode(), None


def test_fetch(spark):
    papers = spark.createDataFrame([("2401.00001",), ("gone/0000001",), (None,), ("2401.00001",)], "paper_id string")
    got = fetch(papers, "source", getter=web)
    rows = {r["paper_id"]: r for r in got.withColumn("s", source_status(got["status"], got["content_type"], got["content"])).collect()}
    assert bytes(rows["2401.00001"]["content"]) == b"https://arxiv.org/e-print/2401.00001" and rows["2401.00001"]["s"] == "ok"
    assert rows["gone/0000001"]["s"] == "unavailable" and rows[None]["error"] == "no identifier"
    assert b"id_list=2401.00001" in bytes(fetch(papers.limit(1), "metadata", getter=web).first()["content"])


def test_compile(spark, tmp_path):
    engine = tmp_path / "engine"
    engine.write_text('#!/bin/sh\ntest -f fig.txt || exit 3\ncp "$1" "${1%.tex}.pdf"\n')
    engine.chmod(engine.stat().st_mode | stat.S_IEXEC)
    files = spark.createDataFrame([("p", "d/main.tex", bytearray(b"x")), ("p", "d/fig.txt", bytearray(b"")), ("q", "main.tex", bytearray(b"y")), ("r", "../main.tex", bytearray(b"z"))], "paper_id string, path string, content binary")
    mains = spark.createDataFrame([("p", "d/main.tex"), ("q", "main.tex"), ("r", "../main.tex")], "paper_id string, path string")
    got = {r["paper_id"]: r for r in compile_papers(files, mains, ("no such tool",), (str(engine),)).collect()}
    assert got["p"]["status"] == "ok" and bytes(got["p"]["pdf"]) == b"x" and got["q"]["status"] == got["r"]["status"] == "failed" and "exit code 3" in got["q"]["log"]
    assert {r["status"] for r in compile_papers(files, mains, ("no such tool",), ("nor this",)).collect()} == {"no engine"}


def test_command_line(spark, tmp_path):
    root = tmp_path / "in" / "2401.00001"
    root.mkdir(parents=True)
    (root / "main.tex").write_text("\\documentclass{article}\n\\title{T}\n\\begin{document}\nOn representation, in a text that is long enough to count.\n\\end{document}\n")
    out = tmp_path / "out"
    assert cli.main([str(tmp_path / "in"), str(out)]) == 0
    text = spark.read.parquet(str(out / "sources")).first()["text"]
    assert "表示，表征" in text and "{ctex}" in text and "\\title{T}" in text
    assert spark.read.parquet(str(out / "guides")).count() == 1
    (tmp_path / "bad.json").write_text("[]")
    assert cli.main([str(tmp_path / "in"), str(tmp_path / "out2"), "--config", str(tmp_path / "bad.json")]) == 1

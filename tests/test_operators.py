import random

from pyspark.sql import functions as F

from parchment.operators import chunking, distinct, documents, intervals, validate


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_history(spark):
    lines = spark.createDataFrame(list(enumerate(["2401.00001", "x y", " ", "https://arxiv.org/abs/2401.00001"])), "pos long, line string")
    assert [r["line"] for r in distinct.history(lines).orderBy("pos").collect()] == ["x y", "https://arxiv.org/abs/2401.00001"]
    more = distinct.history_appended(lines, spark.createDataFrame([(9, "x y")], "pos long, line string"), 1)
    assert [(r["pos"], r["line"]) for r in more.collect()] == [(9, "x y")]


def test_spans(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 5, 7), ("a", 9, 12), ("a", 1, 2), ("b", 0, 1), ("b", None, 4)], "k string, start int, end int")
    assert rows(intervals.merge_spans(df, ["k"]), "k", "start", "end") == [("a", 0, 7), ("a", 9, 12), ("b", 0, 1)]
    hit = spark.range(3).select(intervals.in_spans(F.col("id"), F.array(F.struct(F.lit(1).alias("start"), F.lit(2).alias("end")))).alias("x"))
    assert [r.x for r in hit.collect()] == [False, True, False]


def test_spans_in_ranges(spark):
    """Whatever the number of ranges, keys and overlaps: as a walk over each key's spans; keys may be null."""
    rng = random.Random(7)
    for parts, reach in ((1, 9), (3, 3), (7, 40), (16, 400)):
        spans = [(rng.choice(["a", "a", "a", None, "b", "c"]), rng.randrange(2), a := rng.randrange(1000), a + rng.randrange(reach)) for _ in range(500)]
        spans += [("one", 0, 0, 5000), ("one", 0, 10, 20), ("one", 0, 4000, 4001)] + [("one", 0, a, a + 1) for a in range(100, 900, 7)]
        want = []
        for key in {s[:2] for s in spans}:
            merged = []
            for _, _, a, b in sorted(s for s in spans if s[:2] == key):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            want += [(str(key[0]), key[1], a, b) for a, b in merged]
        df = spark.createDataFrame(spans, "k string, m int, start int, end int").repartition(5)
        got = intervals.merge_spans(df, ["k", "m"], parts).collect()
        assert sorted((str(r["k"]), r["m"], r["start"], r["end"]) for r in got) == sorted(want)
    assert intervals.merge_spans(df.limit(0), ["k", "m"]).collect() == []


def test_one_keys_spans_are_many_tasks_work(spark):
    """A single key of 200,000 spans lies in as many ranges as there are, none with more than three times its share."""
    df = spark.range(200_000).select(F.lit("k").alias("k"), (F.col("id") * 3).alias("start"), (F.col("id") * 3 + F.when(F.col("id") % 1000 == 0, 9).otherwise(1)).alias("end"))
    merged = intervals.merge_spans(df, ["k"], 8)
    assert merged.count() == 200_000 - 3 * 200
    ranged = df.repartitionByRange(8, "k", "start").groupBy(F.spark_partition_id()).count().collect()
    assert len(ranged) == 8 and max(r["count"] for r in ranged) < 75_000


def test_next_nonblank(spark):
    rng = random.Random(2)
    texts = ["", "a", "\n", "a\n\n b\n \n", *("\n".join(rng.choice(["", " ", "x", " y"]) for _ in range(n)) for n in (5, 300, 700))]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for k, got in df.select("k", intervals.next_nonblank(F.split("t", "\n", -1)).alias("n")).collect():
        lines = texts[k].split("\n")
        assert got == [next((x for x in lines[i + 1 :] if x.strip(" ")), None) for i in range(len(lines))]


def test_appended_histories(spark):
    """Appending to a kept history of some lines gives the history of all; no window is in the plan."""
    rng = random.Random(5)
    lines = [(i, rng.choice([f"2401.{rng.randrange(40):05d}", f"https://arxiv.org/abs/2401.{rng.randrange(40):05d}", f"word {rng.randrange(30)}", " "])) for i in range(600)]
    df = lambda some: spark.createDataFrame(some, "pos long, line string")
    kept = df(lines[:0])
    for k in range(0, 600, 200):
        kept = df([tuple(r) for r in distinct.history_appended(kept, df(lines[k : k + 200]), 20).collect()])
    whole = distinct.history(df(lines), 20)
    assert rows(kept, "pos", "line") == rows(whole, "pos", "line") and kept.count() == 20
    assert "Window" not in whole._jdf.queryExecution().executedPlan().toString()


def test_conditional_depth(spark):
    text = "\\fi\n\\iftrue x\n\\ifx\ny\n\\fi z\n\\fill\n\\fi\nend"
    lines = intervals.text_lines(spark.createDataFrame([(1, text)], "k int, text string"), ["k"])
    got = [r["depth"] for r in lines.orderBy("line_no").collect()]
    assert got == [0, 0, 1, 2, 1, 1, 0, 0]


def test_routes_and_includes(spark):
    n = lambda offset, length: chunking.route(F.lit("x" * 100 + "\\appendix"), F.lit(offset), F.lit(length), F.lit(False))
    assert list(spark.range(1).select(n(0, 100), n(50, 60), n(100, 50)).first()) == ["main", "appendix", "appendix"]
    files = spark.createDataFrame([("p", "a/m.tex", "\\input{x}\\appendix\\include{ ../b/y }\\input{z.tex}"), ("p", "b/y.tex", ""), ("p", "z.tex", ""), ("p", "a/x.tex", ""), ("q", "z.tex", "")], "paper_id string, path string, text string")
    assert rows(chunking.included_paths(files), "paper_id", "path") == [("p", "b/y.tex"), ("p", "z.tex")]


def test_work_items_join_back(spark):
    body = "\n\n".join(f"Paragraph {i} with {{some}} words and \\fbox{{kept {i}}}." for i in range(200))
    files = spark.createDataFrame([("p", "main.tex", body), ("p", "appendix/a.tex", "tail " * 30), ("q", "n.tex", "{" + body), ("q", "short.tex", "x"), ("r", "none.tex", None)], "paper_id string, path string, text string")
    clean = documents.clean_files(files)
    assert rows(clean.filter("skip_reason is not null"), "path", "skip_reason") == [("none.tex", "prose"), ("short.tex", "prose")]
    items = chunking.work_items(clean.filter("skip_reason is null and text is not null"), 500, 50)
    got = items.collect()
    assert {r["route"] for r in got if r["path"].startswith("appendix")} == {"appendix"}
    texts = {r["path"]: r["text"] for r in clean.collect()}
    for r in got:
        t, a, b = texts[r["path"]], r["offset"], r["offset"] + r["length"]
        assert (t[a:b], t[max(0, a - 50) : a], t[b : b + 50]) == (r["chunk"], r["ctx_before"], r["ctx_after"])
    back = chunking.reassemble(items.withColumn("output", F.col("chunk")), clean)
    assert {r["path"]: r["text"] for r in back.collect()} == {"main.tex": body, "n.tex": "{" + body, "appendix/a.tex": "tail " * 30}


def test_main_file(spark):
    files = [("p", "z/main.tex", "\\documentclass{a}"), ("p", "other.tex", "\\documentclass{a}\\begin{document}"), ("p", "b.sty", "\\documentclass\\begin{document}"), ("q", "B.tex", ""), ("q", "A.LTX", "")]
    got = documents.main_files(spark.createDataFrame(files, "paper_id string, path string, text string"))
    assert rows(got, "paper_id", "path") == [("p", "other.tex"), ("q", "A.LTX")]


def test_sorted_distinct(spark):
    row = spark.range(1).select(distinct.sorted_distinct(F.lit(["b", "A", "a", "B", "a"]))).first()
    assert row[0] == ["A", "a", "B", "b"]


GATE = [
    ("{a}", "{a}", []), ("{a}", "{a", ["braces"]), ("{a", "{b", []), ("\\begin{a}\\end{a}", "\\end{a}\\begin{a}", ["environments"]),
    ("\\textbf \\alpha", "\\alpha", []), ("\\textbf \\alpha", "\\textbf", ["commands"]), ("a&b\\&c", "甲&乙\\&丙", []), ("a&b\\&c", "甲 乙\\&丙", ["alignment"]),
    ("", "{", ["braces"]), ("\\ParchmentKept{0}\\ParchmentKept{1}", "\\ParchmentKept{0}\\ParchmentKept{0}", ["placeholders"]), ("x", "```x", ['TeX quotation mark']),
]


def test_gate(spark):
    df = spark.createDataFrame([(k, s, o) for k, (s, o, _) in enumerate(GATE)], "k int, source string, output string")
    got = {r["k"]: r for r in validate.validated(df).collect()}
    for k, (s, _, want) in enumerate(GATE):
        if s != "x":
            assert list(got[k]["violations"]) == want, (k, got[k])
    assert got[4]["style_changed"] and not got[0]["style_changed"] and got[5]["missing"] == ["alpha"]
    assert rows(validate.validated(df).filter("k = 5").select(validate.named(F.col("missing")).alias("m")), "m") == [("\\alpha",)]


def test_source_passes_its_own_gate(spark):
    texts = ["\\section{A} b & c \\cite{x} $y$ % {", "plain 中文", "\\begin{x}{y}\\end{x}"]
    assert all(not r["violations"] for r in validate.validated(spark.createDataFrame([(t, t) for t in texts], "source string, output string")).collect())


def test_english_left(spark):
    english = "These are more than twelve ordinary English words that some answer kept without need"
    df = spark.createDataFrame([(english, "中文 " + english), (english, "中文"), ("中文", english)], "source string, output string")
    assert [bool(r["untranslated"]) for r in validate.validated(df).collect()] == [True, False, False]


def test_warnings(spark):
    m = spark.createDataFrame([("p", 1, "warning: K on host model=m"), ("p", 2, "warning: K on host model=m"), ("p", 3, "warning:  on x"), ("q", 1, "J")], "paper_id string, pos long, message string")
    assert rows(validate.warning_summary(m), "kind", "n") == [("J", 1), ("K", 2), ("warning", 1)] or rows(validate.warning_summary(m), "kind", "n")[:2] == [("J", 1), ("K", 2)]
    report = {r["paper_id"]: r["report"] for r in validate.warning_report(m).collect()}
    assert "Total: 3" in report["p"] and "- K: 2" in report["p"] and "[2] warning: K on host model=m" in report["p"] and "Total: 1" in report["q"]


def test_done_papers(spark):
    papers = spark.createDataFrame([(x,) for x in "abcd"], "paper_id string")
    state = spark.createDataFrame([("a", True, True, True, True, True), ("b", True, True, False, True, True), ("c", True, True, False, False, False)], "paper_id string, has_pdf boolean, has_record boolean, has_translated_pdf boolean, has_translated_tex boolean, has_source_tex boolean")
    assert rows(documents.without_completed(papers, state), "paper_id") == [("b",), ("d",)]
    assert rows(documents.without_completed(papers, state, compile_pdf=False), "paper_id") == [("d",)]
    assert rows(documents.resumable(state), "paper_id") == [("a",), ("b",)]


def test_counts(spark):
    left = distinct.counts(spark.createDataFrame([("a", ["x", "y", "x"])], "k string, v array<string>"), ["k"], F.col("v"))
    right = distinct.counts(spark.createDataFrame([("a", ["x"])], "k string, v array<string>"), ["k"], F.col("v"))
    assert rows(distinct.count_difference(left, right, ["k", "item"]), "item", "n") == [("x", 1), ("y", 1)]

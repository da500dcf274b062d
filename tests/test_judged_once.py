"""An answer that a chunk got before is not judged again; a new one is."""

from pyspark.sql import functions as F

from parchment.plans import translate

ENGLISH = "These results hold for every single case which the authors have studied within their longest paper \\emph{x} & "


def _items(spark, n):
    rows = [(str(k), ENGLISH + str(k), "", "", "", "main") for k in range(n)]
    return spark.createDataFrame(rows, "key string, chunk string, ctx_before string, ctx_after string, guide string, route string")


def _asked(rows):
    """Key 0: English always. 1: English, then a broken answer, then English again, then Chinese. 2: an error between two equal answers. 3: good at once."""
    good = F.concat(F.lit("这些结果 "), F.regexp_extract("chunk", r"(\\emph.*)", 1))
    n, turn = F.col("key").cast("int"), F.col("attempt")
    output = F.when((n == 3) | (n == 1) & (turn == 4), good).when((n == 1) & (turn == 2), F.concat(good, F.lit("{"))).when((n == 2) & (turn == 2), F.lit(None).cast("string")).otherwise(F.col("chunk"))
    failed = output.isNull()
    return rows.select(*rows.columns, output.alias("output"), F.when(failed, "HTTP 500").alias("error"), F.when(failed, 500).alias("http"), failed.alias("retryable"))


def test_only_new_answers_are_judged(spark, monkeypatch):
    seen, judge = [], translate.outcomes

    def counted(answers, *more):
        seen.append(sorted((r["key"], r["output"]) for r in answers.select("key", "output").collect()))
        return judge(answers, *more)

    monkeypatch.setattr(translate, "outcomes", counted)
    out = {r["key"]: r for r in translate.translate_items(_items(spark, 4), None, asked=_asked).collect()}
    assert [[k for k, _ in x] for x in seen] == [["0", "1", "2", "3"], ["1", "2"], ["1", "2"], ["1"], [], []]
    assert {k: r["status"] for k, r in out.items()} == {"0": "ok", "1": "ok", "2": "ok", "3": "ok"}
    left = translate.ACCEPTED + "These results hold for every single case which the authors have studied within their longest paper"
    assert out["0"]["output"] == ENGLISH + "0" and out["0"]["warning"] == left and out["2"]["output"] == ENGLISH + "2" and out["2"]["warning"] == left
    assert out["1"]["output"] == "这些结果 \\emph{x} & 1" and out["1"]["warning"] is None
    assert out["3"]["warning"] is None

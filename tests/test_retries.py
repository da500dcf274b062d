import inspect
from datetime import UTC, datetime
from types import SimpleNamespace

from pyspark.sql import functions as F

from parchment import state_queries
from parchment.plans.translate import translate_items
from parchment.streaming import retries


def answer(**more):
    return SimpleNamespace(**({"bad": False, "error": None, "http": None, "retryable": False, "english": False, "reason": "", "untranslated": "", "style_changed": False, "output": "x"} | more))


def test_attempts():
    known = retries.Attempts()
    limited = answer(bad=True, error="HTTP 429", http=429, retryable=True)
    assert known.after(limited) == ("again", {"seconds": 5}) and known.after(limited) == ("again", {"seconds": 10})
    assert known.after(limited) == ("done", {"status": "failed", "warning": "HTTP 429"})
    assert retries.Attempts().after(answer(bad=True, error="no message")) == ("done", {"status": "failed", "warning": "no message"})
    known = retries.Attempts()
    assert known.after(answer(bad=True, reason="braces")) == ("again", {"seconds": 0}) and known.feedback == "braces"
    assert known.after(answer(bad=True, error="timed out", retryable=True)) == ("again", {"seconds": 4}) and known.feedback == "braces"
    for _ in range(4):
        assert known.after(answer(english=True, untranslated="left")) == ("again", {"seconds": 0})
    assert known.after(answer(english=True, untranslated="left"))[1]["warning"].endswith("left") and known.attempt == 8
    assert retries.pause(429, 9) == 30 and retries.pause(503, 9) == 10 and retries.pause(None, 1) == 2


def test_the_stream_ends_as_the_rounds_do(spark, tmp_path):
    """The same scripted errors and answers, as a stream with a clock that leaps and as rounds: one result. A stream that was stopped goes on where it was."""
    rows = [(str(k), chr(97 + k % 3)) for k in range(20)]
    chunk = F.concat(F.lit("These results hold for every single case which the authors have studied within their longest paper \\emph{"), "x", F.lit("} & "), "key")
    items = spark.createDataFrame(rows, "key string, x string").select("key", chunk.alias("chunk"), *(F.lit("").alias(c) for c in ("ctx_before", "ctx_after", "guide")), F.lit("main").alias("route"))
    rounds = translate_items(items, None, asked=state_queries._scripted)
    want = sorted((r["key"], r["output"] or "", r["status"], r["warning"] or "") for r in rounds.collect())
    clock = retries.LeapingClock()
    stream = retries.TranslationStream(spark, f"file://{tmp_path}/run", asked=state_queries._scripted, clock=clock)
    stream.add(items.filter("key < '5'"))
    first = stream.run()
    assert first.count() == items.filter("key < '5'").count()
    # the clock leapt over all waits: nothing slept
    assert clock.now() >= datetime(2024, 1, 1, 0, 0, 15, tzinfo=UTC)
    again = retries.TranslationStream(spark, f"file://{tmp_path}/run", asked=state_queries._scripted, clock=clock)
    again.add(items.filter("key >= '5'"))
    out = again.run().collect()
    assert sorted((r["key"], r["output"] or "", r["status"], r["warning"] or "") for r in out) == want
    assert {r["waited"] for r in out} == {0, 2, 5, 6, 10, 15}
    assert max(r["attempts"] for r in out) == 5


def test_no_task_sleeps():
    """Only the driver's clock waits."""
    code = inspect.getsource(retries)
    assert code.count("time.sleep") == 2 and "time.sleep" in inspect.getsource(retries.Clock) and "time.sleep" not in inspect.getsource(retries.Retries)


def test_progress(spark):
    """The counts of a run, as it goes: what rounds leave, and what they end."""
    rows = [(str(k), f"These results hold for every single case which the authors have studied within their longest paper \\emph{{x}} & {k}", "", "", "", "main") for k in range(20)]
    items = spark.createDataFrame(rows, "key string, chunk string, ctx_before string, ctx_after string, guide string, route string")
    seen = []
    translate_items(items, None, asked=state_queries._scripted, progress=lambda *told: seen.append(told))
    # scripts of one, two, three and five answers: 4, 4, 10 and 2 of the 20 chunks
    assert seen == [("answered", 4, 20), ("answered", 8, 20), ("answered", 18, 20), ("answered", 18, 20), ("answered", 20, 20)]

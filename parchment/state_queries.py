r"""Queries of what keeps state from one run to the next, and DuckDB SQL for the same rows: retries of a translator, and the store of answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Template, table
from .operators.answers import Answers
from .plans import translate
from .storage import new_path
from .streaming import retries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


_CHUNK = Template(r"These results hold for every single case which the authors have studied within their longest paper, <<source>> \emph{<<lang>>} & <<doc_id>>")
_GOOD, _STYLE = Template(r"这些结果 \emph{<<lang>>} & <<doc_id>>"), Template("这些结果 <<lang>> & <<doc_id>>")
#: What the translator answers to a document's first, second, ... request, by doc_id modulo their number: a status of HTTP, or an answer.
SCRIPTS = (
    ("good",), (429, "good"), (500, 503, "good"), (429, 429, 429), ("broken", "good"), ("english",) * 5, (400,), ("english", 500, "style"), ("broken", 429, "broken"), ("broken", "english", "style"),
)


def _scripted(rows: DataFrame) -> DataFrame:
    """The answers of SCRIPTS. rows: key (a doc_id), attempt, chunk."""
    n, turn = F.col("key").cast("long") % len(SCRIPTS), F.col("attempt")
    said = F.lit(None).cast("string")
    for k, script in enumerate(SCRIPTS):
        for i, answer in enumerate(script):
            said = F.when((n == k) & (turn == i + 1), str(answer)).otherwise(said)
    rows = rows.withColumn("said", said)
    http = F.try_to_number("said", F.lit("999")).cast("int")
    good = F.concat(F.lit("这些结果 "), F.regexp_extract("chunk", r"(\\emph.*)", 1))
    output = (
        F.when(F.col("said") == "good", good).when(F.col("said") == "broken", F.concat(good, F.lit("{")))
        .when(F.col("said") == "style", F.regexp_replace(good, r"\\emph\{(\w*)\}", "$1")).when(F.col("said") == "english", F.col("chunk"))
    )
    return rows.select(*[c for c in rows.columns if c != "said"], output.alias("output"), F.when(http.isNotNull(), F.concat(F.lit("HTTP "), "said")).alias("error"), http.alias("http"), ((http == 429) | (http >= 500)).alias("retryable"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), _CHUNK.column.alias("chunk"), F.lit("").alias("ctx_before"), F.lit("").alias("ctx_after"), F.lit("").alias("guide"), F.lit("main").alias("route"))


_RESULTS = rf"""
with d as (select doc_id, doc_id % {len(SCRIPTS)} k, {_CHUNK.sql} c, {_GOOD.sql} good, {_STYLE.sql} style from documents)
select doc_id::varchar as key, case when k in (3, 6, 8) then 'failed' else 'ok' end status, [1, 2, 3, 3, 2, 5, 1, 3, 3, 3][k + 1]::int attempts, [0, 5, 6, 15, 0, 0, 0, 2, 10, 0][k + 1]::bigint waited,
  case when k = 3 then 'HTTP 429' when k = 6 then 'HTTP 400' when k = 8 then 'braces' when k = 5 then '{translate.ACCEPTED}' || regexp_extract(c, '^[A-Za-z ]+') when k in (7, 9) then '{translate.STYLE}' end warning,
  case when k = 5 then c when k in (7, 9) then style when k not in (3, 6, 8) then good end output from d"""


@query(_RESULTS)
def translation_retried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks through the stream of retries, with scripted errors and answers, and a clock that leaps."""
    stream = retries.TranslationStream(spark, new_path(spark, "retries"), asked=_scripted, clock=retries.LeapingClock())
    stream.add(_items(spark, sf_dir))
    return stream.run().select("key", "status", "attempts", "waited", "warning", "output")


@query("""
with d as (select sha256(coalesce(text, '')) as key, lang, md5(coalesce(text, '')) t, doc_id from documents),
p as (select key, 1 turn, t || ' one' output from d where lang = 'en' union select key, 2, t || ' two' from d where doc_id % 3 = 0 union select key, 3, t || ' three' from d where lang = 'fr')
select key, max_by(output, turn) output from p group by key""")
def answers_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to some texts put three times, two puts merged before the third: each text's latest answer, looked up by the keys of all texts."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(F.sha2(text, 256).alias("key"), F.md5(text).alias("t"), "lang", "doc_id")
    answers = Answers(spark, new_path(spark, "answers"))
    put = lambda rows, word: answers.put(rows.select("key", F.concat("t", F.lit(word)).alias("output"), F.lit(None).cast("string").alias("warning"), F.lit("m").alias("model")))
    put(docs.filter("lang = 'en'"), " one")
    put(docs.filter("doc_id % 3 = 0"), " two")
    answers.compact()
    put(docs.filter("lang = 'fr'"), " three")
    return answers.look_up(docs.select("key")).select("key", "output")

"""Translation of papers: a cache, rounds of requests with checks between them, and finished files.

The translator is any function from a request to a text; it is called on executors, once per distinct key and round.
A round's answers are written down before they are judged, so a lost executor does not repeat what others have answered. Each table of texts
goes as soon as the next one is written, so that the disk which rounds take does not grow with their number.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CHUNK_CHARS, CONTEXT_CHARS, DOCUMENT_SUFFIXES, PREFERRED_TRANSLATIONS, PRESERVED_TERMS
from ..functions.scan import restore_udf
from ..operators.answers import Answers
from ..operators.chunking import reassemble, work_items
from ..operators.documents import clean_files, suffix
from ..operators.validate import named, validated
from ..sources.lists import Config
from ..storage import forget, new_path, observed, written
from .guide import preferred_prompt, preserved_prompt

#: Errors, and answers with English prose left, after which a chunk's attempts end.
MAX_ERRORS, MAX_UNTRANSLATED = 3, 5
#: Part of every key: other wording of requests makes other keys.
WORDING = "1"
SYSTEM = """Translate the English prose of a LaTeX fragment into Simplified Chinese.
Return the fragment alone: no fences, notes or names of the request's blocks.
Keep all commands, environments, arguments, labels, citations, formulas, table structure, code, addresses and placeholders as they are.
Do not complete an environment that the fragment leaves open, and do not output the context.
Use plain quotation marks, no backticks. Put no spaces between Chinese characters."""


#: What is told of accepted answers, and to the translator.
ACCEPTED = "accepted translation after repeated untranslated-English warnings. span: "
STYLE = "accepted translation with changed non-structural LaTeX text commands"
LEFT = "English prose was left: "


#: Told, after each step, what was counted (chunks known, answered or translated), how many, and of how many.
Progress = Callable[[str, int, int], None]


def quiet(what: str, done: int, total: int) -> None:
    pass


class TranslationError(Exception):
    """status: an HTTP status, or None. retryable: whether another attempt may succeed."""

    def __init__(self, message: str, status: int | None = None, retryable: bool = False):
        super().__init__(message)
        self.status, self.retryable = status, retryable


@dataclass(frozen=True)
class DictionaryTranslator:
    """Replaces terms outside commands; the same answer always. For tests, and for runs without a model."""

    terms: tuple[tuple[str, str], ...] = PREFERRED_TRANSLATIONS
    model: str = "dictionary"

    def __call__(self, request: str, fragment: str, route: str) -> str:
        for english, chinese in self.terms:
            fragment = regex.sub(rf"(?<![\\A-Za-z]){regex.escape(english)}(?![A-Za-z])", chinese.replace("\\", r"\\"), fragment, flags=regex.IGNORECASE)
        return fragment


@dataclass(frozen=True)
class RemoteTranslator:
    """A chat-completions address; chunks of appendices go to the second model, if there is one."""

    config: Config
    timeout: int = 120
    temperature: float = 0.2

    @property
    def model(self) -> str:
        return f"{self.config.model}/{self.config.appendix_model}"

    def __call__(self, request: str, fragment: str, route: str) -> str:
        c = self.config
        model = c.appendix_model if route == "appendix" and c.appendix_model else c.model
        body = {"model": model, "messages": [{"role": "system", "content": SYSTEM}, {"role": "user", "content": request}], "temperature": self.temperature}
        headers = {"Authorization": f"Bearer {c.api_key}", "Content-Type": "application/json", "Accept": "application/json"}
        opener = urllib.request.build_opener(*([] if c.use_proxy else [urllib.request.ProxyHandler({})]))
        try:
            with opener.open(urllib.request.Request(c.base_url, json.dumps(body).encode(), headers), timeout=self.timeout) as answer:
                return json.load(answer)["choices"][0]["message"]["content"]
        except urllib.error.HTTPError as e:
            raise TranslationError(f"HTTP {e.code}: {e.read().decode(errors='replace')[:500]}", e.code, e.code == 429 or e.code >= 500) from e
        except (urllib.error.URLError, TimeoutError) as e:
            raise TranslationError(f"request failed: {e}", retryable=True) from e
        except (ValueError, KeyError, IndexError, TypeError) as e:
            raise TranslationError(f"no message in the answer: {e}") from e


def delay(status: Column, errors: Column) -> Column:
    """Seconds to wait after an error that may pass."""
    return F.when(status == 429, F.least(F.lit(30), errors * 5)).otherwise(F.least(F.lit(10), errors * 2))


def cache_key(items: DataFrame, model: str, terms=PRESERVED_TERMS, pairs=PREFERRED_TRANSLATIONS) -> DataFrame:
    """items: chunk, ctx_before, ctx_after, guide, route. Adds key, of all that an answer depends on."""
    return items.withColumn("key", F.sha2(F.to_json(F.struct("chunk", "ctx_before", "ctx_after", F.coalesce("guide", F.lit("")).alias("guide"), "route", F.lit(model).alias("model"), F.lit(preserved_prompt(terms)).alias("terms"), F.lit(preferred_prompt(pairs)).alias("pairs"), F.lit(WORDING + SYSTEM).alias("wording"))), 256))


def request(terms=PRESERVED_TERMS, pairs=PREFERRED_TRANSLATIONS) -> Column:
    """The request for a row with chunk, ctx_before, ctx_after, guide and feedback."""
    block = lambda name, c: F.concat(F.lit(f"<{name}>\n"), F.coalesce(F.col(c), F.lit("")), F.lit(f"\n</{name}>\n\n"))
    return F.concat(
        F.when(F.col("feedback") == "", "").otherwise(F.concat(F.lit("Your last answer was rejected: "), "feedback", F.lit("\nReturn raw LaTeX alone, with every command of <TEXT_TO_TRANSLATE> and no others.\n\n"))),
        F.lit(f"Translate <TEXT_TO_TRANSLATE> into Simplified Chinese; the other blocks are for reference. Fixed translations: {preferred_prompt(pairs)}. Keep in English: {preserved_prompt(terms)}.\n\n"),
        block("GUIDE_OF_PAPER", "guide"), block("TEXT_BEFORE", "ctx_before"), block("TEXT_AFTER", "ctx_after"), block("TEXT_TO_TRANSLATE", "chunk"),
    )


_ANSWERS = "output string, error string, http int, retryable boolean"


def ask(rows: DataFrame, translator: Callable[[str, str, str], str], wait: bool) -> DataFrame:
    names = ["request", "chunk", "route", "pause"]

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers = []
            for text, chunk, route, pause in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True):
                if wait and pause:
                    time.sleep(pause)
                try:
                    answers.append((translator(text, chunk, route), None, None, False))
                except TranslationError as e:
                    answers.append((None, str(e), e.status, e.retryable))
            new = [pa.array(c, t) for c, t in zip(zip(*answers, strict=True), (pa.string(), pa.string(), pa.int32(), pa.bool_()), strict=True)] if answers else [pa.array([], t) for t in (pa.string(), pa.string(), pa.int32(), pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "output", "error", "http", "retryable"])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(asked, f"{schema}, {_ANSWERS}")


def outcomes(answers: DataFrame, terms=PRESERVED_TERMS) -> DataFrame:
    """answers: chunk, output, error, and other columns. Adds what validated() adds, bad (an error, or a broken rule), reason (the rules, for the next request) and english (prose was left)."""
    told = validated(answers.withColumn("output", F.coalesce("output", F.lit(""))), "chunk", "output", terms)
    bad = F.col("error").isNotNull() | (F.size("violations") > 0)
    commands = F.when(F.array_contains("violations", "commands"), F.concat(F.lit(": missing "), named(F.col("missing")), F.lit("; added "), named(F.col("added")))).otherwise("")
    return told.withColumn("bad", bad).withColumn("english", ~bad & (F.col("untranslated") != "")).withColumn("reason", F.concat(F.array_join("violations", ", "), commands))


#: What the gate says of an answer without an error: it hangs on the chunk and the answer alone.
VERDICT = {"output": "string", "bad": "boolean", "english": "boolean", "reason": "string", "untranslated": "string", "style_changed": "boolean"}


#: Of each chunk: what is asked, and what is kept once it is over.
ITEM, RESULT = ("key", "chunk", "ctx_before", "ctx_after", "guide", "route"), ("key", "output", "status", "warning", "source")


def judged_once(answers: DataFrame, terms=PRESERVED_TERMS) -> DataFrame:
    """answers: chunk, output, error, last (the chunk's answer of the round before, or null), verdict (what outcomes() said of it). Adds what outcomes() adds
    and raw, the answer as it came. An answer that is the last one again has its verdict, so only new ones go through the rules."""
    same = F.coalesce(F.col("error").isNull() & (F.col("output") == F.col("last")), F.lit(False))
    kept = [c for c in answers.columns if c not in ("last", "verdict", "output")]
    fresh = outcomes(answers.filter(~same).withColumn("raw", F.col("output")), terms).select(*kept, "raw", *VERDICT)
    return fresh.unionByName(answers.filter(same).select(*kept, F.col("output").alias("raw"), "verdict.*"))


def translate_items(items: DataFrame, translator, terms=PRESERVED_TERMS, pairs=PREFERRED_TRANSLATIONS, parallel: int | None = None, wait: bool = True, asked: Callable[[DataFrame], DataFrame] | None = None, progress: Progress = quiet, scratch: str | None = None) -> DataFrame:
    """items: key (distinct), chunk, ctx_before, ctx_after, guide, route. Returns key, output, status (ok, failed), warning.

    An answer that breaks a rule is an error, and its rule is told in the next request; errors end a chunk after MAX_ERRORS,
    or at once where no other attempt can help. English prose left in the answer is told too, and accepted with a warning
    after MAX_UNTRANSLATED. At most MAX_ERRORS + MAX_UNTRANSLATED - 1 rounds follow. parallel: requests at a time, at most.
    asked: in place of translator, rows with key, attempt, request and chunk to the same with output, error, http and retryable.
    scratch: a folder that what is returned is read from, None for a new one. A round's tables hold a text once: an answer that is the last one
    again, or that the gate left as it was, is not written a second time, and of a chunk that is over only its result stays.
    streaming.retries does the same as a stream, where waits hold no task.
    """
    at = scratch or new_path(items.sparkSession, "rounds")
    rows, seen = observed(items.select(*ITEM), f"{at}/items", total=F.count(F.lit(1)))
    return _rounds(rows, seen["total"], at, translator, terms, pairs, parallel, wait, asked, progress).select("key", "output", "status", "warning")


def _rounds(items: DataFrame, total: int, at: str, translator, terms, pairs, parallel: int | None, wait: bool, asked: Callable[[DataFrame], DataFrame] | None, progress: Progress) -> DataFrame:
    """translate_items() of total rows that stand in the folder at, as items, and go. Returns source, the chunk where it failed, too."""
    spark, n_done, done, held = items.sparkSession, 0, [], f"{at}/items"
    todo = items.select(*ITEM, F.lit("").alias("feedback"), F.lit(0).alias("errors"), F.lit(0).alias("left_english"), F.lit(0).alias("pause"), F.lit(None).cast("string").alias("last"), F.lit(None).cast("struct<" + ",".join(f"{c}:{t}" for c, t in VERDICT.items()) + ">").alias("verdict"))
    for k in range(MAX_ERRORS + MAX_UNTRANSLATED - 1):
        rows = todo.withColumn("request", request(terms, pairs))
        if asked:
            answers = asked(rows.withColumn("attempt", F.lit(k + 1))).drop("request", "attempt")
        else:
            answers = ask(rows.coalesce(parallel) if parallel else rows, translator, wait).drop("request")
        answers = answers.withColumn("again", F.coalesce(F.col("error").isNull() & (F.col("output") == F.col("last")), F.lit(False)))
        answers = written(answers.withColumn("output", F.when(~F.col("again"), F.col("output"))), f"{at}/answers-{k}")
        forget(spark, held)
        answers = answers.withColumn("output", F.when(F.col("again"), F.col("last")).otherwise(F.col("output"))).drop("again")
        answers = answers.withColumn("verdict", F.col("verdict").withField("output", F.coalesce("verdict.output", "last")))
        told = judged_once(answers, terms) if k else outcomes(answers.withColumn("raw", F.col("output")), terms)
        bad, english, reason = F.col("bad"), F.col("english"), F.col("reason")
        told = told.withColumn("errors", F.col("errors") + bad.cast("int")).withColumn("left_english", F.col("left_english") + english.cast("int"))
        over = bad & ((F.col("errors") >= MAX_ERRORS) | (F.col("error").isNotNull() & ~F.col("retryable")))
        status = F.when(over, "failed").when(~bad & (~english | (F.col("left_english") >= MAX_UNTRANSLATED)), "ok")
        warning = F.when(over, F.coalesce("error", reason)).when(english, F.concat(F.lit(ACCEPTED), "untranslated")).when(F.col("style_changed"), STYLE)
        told = (
            told.withColumn("status", status).withColumn("warning", warning)
            .withColumn("feedback", F.when(bad & F.col("error").isNull(), reason).when(english, F.concat(F.lit(LEFT), "untranslated")).otherwise(F.col("feedback")))
            .withColumn("pause", F.when(F.col("error").isNotNull() & F.col("retryable"), delay(F.col("http"), F.col("errors"))).otherwise(0))
        )
        left = F.col("status").isNull()
        verdict = F.struct(F.nullif(F.col("output"), F.col("raw")).alias("output"), *[c for c in VERDICT if c != "output"])
        judged, seen = observed(
            told.select(
                "key", F.when(F.col("status") == "ok", F.col("output")).alias("output"), "status", "warning", F.when(F.col("status") == "failed", F.col("chunk")).alias("source"), "errors", "left_english", "pause",
                *(F.when(left, F.col(c)).alias(c) for c in (*ITEM[1:], "feedback")),
                F.when(left, F.col("raw")).alias("last"), F.when(left, verdict).alias("verdict"),
            ),
            f"{at}/judged-{k}", over=F.count_if(~left), left=F.count_if(left),
        )
        forget(spark, f"{at}/answers-{k}")
        held = f"{at}/judged-{k}"
        n_done += seen["over"]
        progress("answered", n_done, total)
        if not seen["left"]:
            done.append(held)
            break
        if seen["over"]:
            done.append(f"{at}/done-{k}")
            written(judged.filter(~left).select(*RESULT), done[-1])
        todo = judged.filter(left).select(*todo.columns)
    return spark.read.schema(", ".join(f"{c} string" for c in RESULT)).parquet(*done)


def translate_papers(files: DataFrame, guides: DataFrame | None, translator, cache: str | None = None, limit: int = CHUNK_CHARS, context: int = CONTEXT_CHARS, terms=PRESERVED_TERMS, pairs=PREFERRED_TRANSLATIONS, parallel: int | None = None, wait: bool = True, progress: Progress = quiet, scratch: str | None = None) -> tuple[DataFrame, DataFrame]:
    """files: paper_id, path, text. guides: paper_id, guide. cache: a folder of answers, None for one that goes when the results are there.
    scratch: a folder that what is returned is read from, None for a new one.

    Returns all files, translated ones with their new text, cleaned or as they were otherwise; and messages (paper_id,
    pos, message) of chunks that failed, which keep their source text, or were accepted with a warning.
    """
    spark = files.sparkSession
    at = scratch or new_path(spark, "papers")
    clean = written(clean_files(files.select("paper_id", "path", "text")), f"{at}/clean")
    told = work_items(clean.filter("skip_reason is null"), limit, context).drop("offset", "length")
    told = told.join(guides.select("paper_id", "guide"), "paper_id", "left") if guides is not None else told.withColumn("guide", F.lit(""))
    items = written(cache_key(told, translator.model, terms, pairs), f"{at}/keyed")
    # from here on a text that is translated stands in its chunks; those without a paper are of none, so they stay as they are
    stays = F.col("skip_reason").isNotNull() | F.col("paper_id").isNull()
    kept = written(clean.select("paper_id", "path", stays.alias("stays"), F.when(stays, F.col("text")).alias("text"), "blocks"), f"{at}/kept")
    forget(spark, f"{at}/clean")
    answers = Answers(spark, cache or f"{at}/cache")
    known = answers.look_up(items, f"{at}/known").select("key", "output", "warning").filter("output is not null")
    # a cached answer that no longer passes is a miss
    hits = validated(items.select("key", "chunk").dropDuplicates(["key"]).join(known, "key"), "chunk", "output").filter("size(violations) = 0").select("key", "output", F.lit("ok").alias("status"), "warning")
    hits, seen = observed(hits, f"{at}/hits", n=F.count(F.lit(1)))
    forget(spark, f"{at}/known")
    progress("known", seen["n"], seen["n"])
    misses, seen = observed(items.select(*ITEM).join(hits.select("key"), "key", "left_anti").dropDuplicates(["key"]), f"{at}/fresh/items", total=F.count(F.lit(1)))
    places = written(items.select("key", "paper_id", "path", "idx"), f"{at}/places")
    forget(spark, f"{at}/keyed")
    fresh = _rounds(misses, seen["total"], f"{at}/fresh", translator, terms, pairs, parallel, wait, None, progress)
    answers.put(fresh.filter("status = 'ok'").select("key", "output", "warning", F.lit(translator.model).alias("model")))
    if not cache:
        forget(spark, f"{at}/cache")
    every = hits.unionByName(fresh.select("key", F.coalesce("output", "source").alias("output"), "status", "warning"))
    results, seen = observed(places.join(every, "key", "left").select("paper_id", "path", "idx", "output", "status", "warning"), f"{at}/results", ok=F.count_if(F.col("status") == "ok"), n=F.count(F.lit(1)))
    for name in ("places", "hits", "fresh"):
        forget(spark, f"{at}/{name}")
    progress("translated", seen["ok"], seen["n"])
    translated = reassemble(results.filter("paper_id is not null"), kept)
    others = kept.filter("stays").select("paper_id", "path", restore_udf(F.col("text"), F.col("blocks")).alias("text"))
    styles = written(files.filter(~F.coalesce(suffix(F.col("path")).isin(*DOCUMENT_SUFFIXES), F.lit(False))).select("paper_id", "path", "text"), f"{at}/styles")
    place = F.concat(F.lit(" on "), "path", F.lit("#"), F.col("idx").cast("string"))
    kind = F.when(F.col("status") == "ok", F.col("warning")).otherwise(F.concat(F.lit("translation failed"), place, F.lit(": "), F.coalesce("warning", F.lit("no answer"))))
    messages = results.filter("warning is not null or status is null or status <> 'ok'").select("paper_id", F.xxhash64("path", "idx").alias("pos"), kind.alias("message"))
    return translated.unionByName(others).unionByName(styles), messages

r"""Secret scans over an incremental ledger of blobs.

Every version of a text is addressed by its content (SHA-256). The ledger is a folder of two Parquet tables: `blobs`
holds, per blob and version of the rules, the spans found, also when there are none; `versions` holds the path, version
and blob of everything that was ever put in, by run. A run scans only the pairs of blob and rules version that `blobs`
lacks, and findings are joined back to all paths and versions that have the blob, those of earlier runs too. A run that
fails halfway may leave versions whose blobs are unscanned; repeated, it scans just those.

Blobs that one row alone has are scanned where they stand; a Bloom filter of the others tells which texts must cross the
shuffle to be scanned once.

Null and empty texts are one blob without findings. Repeated rows, and rows that share a text, get the same findings.
Extra columns are not read by scans and pass through redact(), whatever their names. Texts of any length are scanned
whole; an empty table adds nothing. Offsets are code points, the end is exclusive.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import read_or_empty
from .bloom import bloom_filter, with_maybe
from .shared import cut_spans, free_names, freeing, merged_spans, new_path, slices, stored, text_columns

#: Fixed values, the base rules: kind, words of which a text has one in lower case, pattern, least length of its last group.
_ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = (
    ("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"), re.compile(_ASSIGN, re.ASCII | re.IGNORECASE), 8),
    ("access", ("akia",), re.compile(r"(AKIA[A-Z0-9]+)"), 16),
    ("hex", (), re.compile(r"([0-9a-f]{32,})"), 32),
    # beyond the base rules
    ("pem", ("private key-----",), re.compile(r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)"), 0),
    # of three runs between dots the first, of which an end that starts at `eyJ` behind no word character makes up the match
    ("jwt", ("eyj",), re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]++)(?=\.[A-Za-z0-9_-]{8,}+\.([A-Za-z0-9_-]++))"), 11),
    ("github", ("ghp_", "gho_", "ghs_"), re.compile(r"(\bgh[pos]_[A-Za-z0-9]{36,})", re.ASCII), 0),
)
BASE = ("assign", "access", "hex")
SPANS = "array<struct<start:int,kind:string,end:int>>"
LEDGER = f"blob string, rules string, spans {SPANS}"
VERSIONS = "path long, version long, blob string, run string"


#: Texts that a worker scans at a time.
ROWS = 256


def rules_version(rules=RULES) -> str:
    """A digest of the rules; other rules make every blob unseen again."""
    return hashlib.sha256(repr([(k, w, p.pattern, p.flags, n) for k, w, p, n in rules]).encode()).hexdigest()[:16]


_EYJ = re.compile(r"(?<![A-Za-z0-9_])eyJ")


def _places(kind: str, pattern: re.Pattern, least: int, text: str) -> Iterator[tuple[int, int]]:
    """First and last + 1 of a rule's findings. Each rule takes time in proportion to the text, whatever is in it."""
    if kind != "jwt":
        for m in pattern.finditer(text):
            if len(m[m.lastindex]) >= least:
                yield m.span()
        return
    behind = 0
    for m in pattern.finditer(text):
        if m.start() >= behind and (begin := _EYJ.search(text, m.start(), m.end())) and m.end() - begin.start() >= least:
            behind = m.end(2)
            yield begin.start(), behind


def find_secrets(text: str, rules=RULES) -> list[tuple[int, str, int]]:
    """(start, kind, end) of every finding, by start, then in the rules' order."""
    low, found = text.lower(), []
    for k, (kind, words, pattern, least) in enumerate(rules):
        if not words or any(w in low for w in words):
            found += [(a, k, b, kind) for a, b in _places(kind, pattern, least, text)]
    return [(a, kind, b) for a, _, b, kind in sorted(found)]


def _scan(rules):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))
    version = rules_version(rules)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            blobs, texts = text_columns(batch, "blob", "text")
            spans = [[{"start": a, "kind": k, "end": b} for a, k, b in find_secrets(t.as_py() or "", rules)] for t in texts]
            yield pa.RecordBatch.from_arrays([blobs, pa.array([version] * len(spans), pa.string()), pa.array(spans, kind)], names=["blob", "rules", "spans"])

    return scanned


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def read_ledger(spark: SparkSession, at: str) -> DataFrame:
    """Blobs and their findings, none where there is no ledger yet."""
    return read_or_empty(spark, f"{at}/blobs", LEDGER)


def read_versions(spark: SparkSession, at: str) -> DataFrame:
    return read_or_empty(spark, f"{at}/versions", VERSIONS)


def _among(rows: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """rows (blob, ...) with a boolean column: false where no blob of keys is theirs."""
    blooms, n_blocks = bloom_filter(keys.select(F.col("blob").alias("key")), keys.count())
    return with_maybe(rows, F.col("blob"), stored(blooms, "blooms"), n_blocks, name)


def scan(history: DataFrame, at: str, rules=RULES) -> str:
    """Puts versions of texts into the ledger at a folder and scans what it has not seen. history: path, version (longs), text. Returns the run's name."""
    spark, rules_now, run = history.sparkSession, rules_version(rules), uuid.uuid4().hex
    history.select("path", "version", blob_of(F.col("text")).alias("blob"), F.lit(run).alias("run")).write.mode("append").parquet(f"{at}/versions")
    known = read_ledger(spark, at).filter(F.col("rules") == rules_now).select("blob")
    now = read_versions(spark, at).filter(F.col("run") == run).groupBy("blob").agg(F.count("*").alias("n"))
    unseen = stored(now.join(known, "blob", "left_anti"), "unseen")
    alone = unseen.filter("n = 1").select("blob")
    texts = history.select(blob_of(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = _among(texts, stored(now.select("blob").join(alone, "blob", "left_anti"), "shared"), "shared")
    here = dealt.filter("not shared").select("blob", "text")
    wanted = _among(dealt.filter("shared").select("blob", "text"), unseen, "wanted").filter("wanted").select("blob", "text")
    once = wanted.join(unseen, "blob", "left_semi").dropDuplicates(["blob"])
    here.unionByName(once).mapInArrow(freeing(_scan(rules)), LEDGER).write.mode("append").parquet(f"{at}/blobs")
    return run


def findings(spark: SparkSession, at: str, rules=RULES) -> DataFrame:
    """blob and spans of every blob with findings. A blob that two runs scanned at once counts once."""
    return read_ledger(spark, at).filter((F.col("rules") == rules_version(rules)) & (F.size("spans") > 0)).select("blob", "spans").dropDuplicates(["blob"])


def path_findings(spark: SparkSession, at: str, rules=RULES) -> DataFrame:
    """path, version, blob, run, spans (none: an empty array) of every version that the ledger holds."""
    joined = read_versions(spark, at).join(findings(spark, at, rules), "blob", "left")
    return joined.select("path", "version", "blob", "run", F.coalesce("spans", F.from_json(F.lit("[]"), SPANS)).alias("spans"))


def secret_spans(docs: DataFrame, ledger: str | None = None, rules=RULES, n_batches: int = 1) -> DataFrame:
    """docs: doc_id (the path), text, and perhaps version. Returns doc_id, blob and spans, by start and rule, one row per row of docs.

    ledger: the ledger's folder; None: a new one in the shared folder. The rows go in as n_batches runs, in order of doc_id.
    """
    spark = docs.sparkSession
    at = ledger or new_path(spark, "ledger")
    version = F.col("version").cast("long") if "version" in docs.columns else F.lit(0).cast("long")
    history = docs.select(F.col("doc_id").alias("path"), version.alias("version"), "text")
    cuts = sorted(set(history.agg(F.percentile_approx("path", [k / n_batches for k in range(1, n_batches)])).first()[0] or [])) if n_batches > 1 else []
    runs = []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        # rows without an id are in the first run
        batch = history if low is None else history.filter(F.col("path") > low)
        runs.append(scan(batch if high is None else batch.filter((F.col("path") <= high) | (F.col("path").isNull() if low is None else F.lit(False))), at, rules))
    return path_findings(spark, at, rules).filter(F.col("run").isin(runs)).select(F.col("path").alias("doc_id"), "blob", "spans")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digest(docs: DataFrame, ledger: str | None = None, rules=RULES, n_batches: int = 1) -> DataFrame:
    found = secret_spans(docs, ledger, rules, n_batches)
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *(n(k) for k in BASE), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, ledger: str | None = None, rules=RULES, mark: str = "[SECRET]") -> DataFrame:
    """docs with every finding in text replaced by mark, overlapping ones by one mark, and n_chars set anew where it is a column.

    docs needs doc_id and text; rows are matched by the text's digest, so a doc_id may repeat. Only texts that a Bloom
    filter of the blobs with findings lets through cross the shuffle.
    """
    spark = docs.sparkSession
    at = ledger or new_path(spark, "ledger")
    scan(docs.select(F.col("doc_id").alias("path"), F.lit(0).cast("long").alias("version"), "text"), at, rules)
    blob, maybe, spans, merged = free_names(docs, "blob", "maybe", "spans", "merged")
    found = stored(findings(spark, at, rules), "findings")
    blooms, n_blocks = bloom_filter(found.select(F.col("blob").alias("key")), found.count())
    dealt = with_maybe(docs.withColumn(blob, blob_of(F.col("text"))), F.col(blob), stored(blooms, "blooms"), n_blocks, maybe)
    bounds = F.transform(spans, lambda s: F.struct(s["start"].alias("first"), (s["end"] - 1).alias("last"), s["start"].alias("start"), s["end"].alias("end")))
    joined = dealt.filter(maybe).join(found.select(F.col("blob").alias(blob), F.col("spans").alias(spans)), blob, "left").withColumn(merged, merged_spans(bounds, touch=0))
    out = joined.withColumn("text", F.when(F.size(merged) > 0, cut_spans(F.col("text"), F.col(merged), mark)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(merged) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return dealt.filter(~F.col(maybe)).select(*docs.columns).unionByName(out.select(*docs.columns))

"""The queries of this subpackage: each numbered operator with production parameters over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import chat_digest
from .decontaminate import decontamination_report
from .infill import infill_digest
from .licenses import license_scan
from .packing import packing_report
from .pieces import pieces_report
from .quality import quality
from .repeats import repeats_report
from .secrets import secret_digest
from .simhash import near_components
from .tokens import token_report
from .urls import judge_urls
from .vectors import ENTRIES, PARTS, ROUNDS, SCALE, vector_codes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))


#: The conversation that is added to the table; its texts hold control strings of the template.
SAMPLE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_digest(rows.unionByName(spark.sql("select * from values " + ", ".join(f"({c}L, {t}L, '{r}', '{x}')" for c, t, r, x in SAMPLE) + " as t(conv_id, turn, role, text)")))


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), special=True)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(table(spark, sf_dir, "documents"), n_batches=2)


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_report(table(spark, sf_dir, "documents"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces_report(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


#: Pages with this in their HTML are junk; their canonical urls make up the list of op10.
JUNK = "###"


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages, pages.filter(F.contains("html", F.lit(JUNK))).select("url")).drop("maybe_listed")


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill_digest(table(spark, sf_dir, "documents"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (op1_quality, op2_simhash, op3_chat, op4_tokens, op5_decontamination, op6_licenses, op7_secrets, op8_repeats, op9_pieces, op10_urls, op11_infill, op12_packing, op13_vectors)
}

_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ESCAPE = r"regexp_replace(coalesce({}, ''), '([<\[])(\\*)(/?s>|/?ROLE\]|TURN\]|/?INST\])', '\1\\\2\3', 'g')"
_HOST = f"""case when url is null or strpos(url, '://') = 0 then '' else {_ASCII_LOWER.format("regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*')")} end"""
_PATH = "case when url is null or strpos(url, '://') = 0 then '' else regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) end"
_QUERY = r"regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*\?([^#]*)', 1)"

_WORDS = f"list_filter(regexp_split_to_array({_ASCII_LOWER.format("coalesce(text, '')")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"

_EITHER = lambda w: "".join(f"[{x.upper()}{x}]" if x.isalpha() else x for x in w)
#: Kind, pattern, group, least length.
_SECRETS = (
    ("assign", "(" + "|".join(map(_EITHER, ("password", "passwd", "secret", "token"))) + "|" + _EITHER("api") + "_?" + _EITHER("key") + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", "(AKIA[A-Z0-9]+)", 1, 16), ("hex", "([0-9a-f]+)", 1, 32), ("pem", "(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 1, 0),
    ("jwt", r"(\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+)", 1, 0), ("github", r"(\bgh[pos]_[A-Za-z0-9]{36,})", 1, 0),
)
_SECRET_MATCHES = " union all ".join(
    f"select n, {k} o, '{kind}' kind, {least} least, regexp_extract_all(t, '{p}') w, regexp_extract_all(t, '{p}', {group}) g, string_split_regex(t, '{p}') s from d where regexp_matches(t, '{p}')"
    for k, (kind, p, group, least) in enumerate(_SECRETS)
)

_TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"


def _rounds() -> str:
    """Named steps of the codebooks: b0, then a round's nearest entries a and new entries b, then the last nearest entries."""
    near = lambda i: f"""a{i} as materialized (select vec_id, k, min(struct_pack(d := d, e := e)) m from (
  select vec_id, k, e, list_sum(list_transform(list_zip(p, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint d from p join b{i} using (k)) group by vec_id, k)"""  # noqa: E731
    entry = lambda i: f"""b{i + 1} as materialized (select b.k, b.e, coalesce(n.c, b.c) c from b{i} b left join (
  select k, e, list(c order by j) c from (select k, m.e e, j, (sum(p[j]) - ((sum(p[j]) % count(*)) + count(*)) % count(*))::bigint // count(*) c
    from p join a{i} using (vec_id, k), unnest(range(1, len(p) + 1)) u(j) group by k, m.e, j) group by k, e) n on b.k = n.k and b.e = n.e)"""  # noqa: E731
    return ",\n".join([x for i in range(ROUNDS) for x in (near(i), entry(i))] + [near(ROUNDS)])


SQL = {
    "op11_infill": rf"""
with d as (select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '{_TOKEN}') w, sha256('42:' || doc_id) h from documents),
u as (select *, len(w) n, ('0x' || h[1:8])::bigint h1, ('0x' || h[9:16])::bigint h2, ('0x' || h[17:24])::bigint h3, ('0x' || h[25:32])::bigint h4 from d),
f as (select *, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end form,
  array_to_string(w[1:least(h1 % (n + 1), h2 % (n + 1))], '') p, array_to_string(w[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') m,
  array_to_string(w[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') s from u)
select doc_id, n, form, case when form <> 'plain' then length(p) end prefix_chars, case when form <> 'plain' then length(m) end middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) output_sha256,
  sha256(t) restored_sha256 from f""",
    "op13_vectors": f"""
with v as materialized (select vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as materialized (select vec_id, k, v[(k * (len(v) // {PARTS}) + 1)::bigint:((k + 1) * (len(v) // {PARTS}))::bigint] p from v, unnest(range({PARTS})) u(k)),
b0 as materialized (select k, row_number() over (partition by k order by vec_id) - 1 e, p c from p where vec_id in (select vec_id from v order by vec_id limit {ENTRIES})),
{_rounds()},
r as (select vec_id, string_agg(printf('%02x', m.e), '' order by k) code, sum(m.d)::bigint error from a{ROUNDS} group by vec_id)
select vec_id, code, error, sum(error) over (partition by label)::bigint label_error,
  sha256((select string_agg(array_to_string(c, ','), ',' order by k, e) from b{ROUNDS})) codebooks_sha256 from r join v using (vec_id)""",
    "op7_secrets": f"""
with d as (select row_number() over () n, doc_id, coalesce(text, '') t from documents),
m as ({_SECRET_MATCHES}),
x as (select n, o, kind, least, unnest(range(1, len(w) + 1)) i, w, g, s from m),
f as (select n, o, kind, list_sum(list_transform(s[1:i], lambda y: length(y)))::bigint + coalesce(list_sum(list_transform(w[1:i - 1], lambda y: length(y))), 0)::bigint a, length(w[i]) size from x where length(g[i]) >= least),
r as (select n, count(*) filter (o = 0) n_assign, count(*) filter (o = 1) n_access, count(*) filter (o = 2) n_hex,
  string_agg(kind || ':' || a || ':' || (a + size), ',' order by a, o) filter (o < 3) base, string_agg(kind || ':' || a || ':' || (a + size), ',' order by a, o) spans from f group by n)
select doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans from d left join r using (n)""",
    "op5_decontamination": f"""
with i as (select item_id, {_WORDS} w from benchmark),
g as (select distinct item_id, list_slice(w, k, k + 9) g from i, unnest(range(1, greatest(2, len(w) - 8))) u(k) where len(w) > 0),
d as (select doc_id, row_number() over () as n, {_WORDS} w from documents),
s as (select distinct len(g) size from g),
p as (select n, k, list_slice(w, k, k + size - 1) g from d, s, unnest(range(1, greatest(1, len(w) - size + 2))) u(k)),
h as (select distinct p.n, p.k, len(g.g) size, g.item_id from p join g on p.g = g.g),
c as (select n, count(distinct k + j) n_hit from h, unnest(range(0, size)) u(j) group by n),
t as (select n, count(*) n_items, string_agg(x, ',' order by x) x from (select distinct n, item_id::varchar x from h where item_id is not null) group by n)
select doc_id, len(w) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(x, '')) items_sha256, n_hit is not null contaminated
from d left join c using (n) left join t using (n)""",
    "op3_chat": f"""
with t as (
  select conv_id, turn, coalesce(role, '') r, coalesce(text, '') x from conversations
  union all select * from (values {", ".join(f"({c}, {t}, '{r}', '{x}')" for c, t, r, x in SAMPLE)}) v(a, b, c, d)),
o as (select *, row_number() over w i, lag(r) over w p, lead(r) over w n from t window w as (partition by conv_id order by turn nulls first, r, x)),
s as (select *, case when p is distinct from r then '<s>[ROLE]' || {_ESCAPE.format("r")} || '[/ROLE]' else '[TURN]' end
  || {_ESCAPE.format("x")} || case when n is distinct from r then '</s>' else '' end f from o)
select conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' order by i)) turns_sha256,
  coalesce(sum(length(x)) filter (r = 'assistant'), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(x, '' order by i) filter (r = 'assistant'), '')) loss_sha256,
  sum(length(f))::bigint formatted_chars
from s group by conv_id""",
    "op10_urls": rf"""
with p as (select page_id, url, html, {_HOST} host, {_PATH} path, case when strpos(url, '://') > 0 then {_QUERY} end q from pages),
c as (select *, case when strpos(url, '://') > 0 then regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(\.html?)?/*$', '')
  || case when len(k) = 0 then '' else '?' || array_to_string(k, '&') end end canonical_url
  from (select *, list_filter(string_split(q, '&'), lambda x: x <> '' and not starts_with(x, 'utm_')) k from p)),
l as (select distinct canonical_url u from c where contains(html, '{JUNK}') and canonical_url is not null),
f as (select page_id, host, path, canonical_url, u is not null listed,
  case when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
    when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
    when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end rule
  from c left join l on canonical_url = u)
select page_id, host, path, rule, canonical_url, listed,
  case when rule in ('example.net/en/', 'org/fr/') then 'allow' when rule is not null or listed then 'block' else 'allow' end verdict
from f""",
}

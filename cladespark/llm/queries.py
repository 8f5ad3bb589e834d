"""The corpus operators applied to the tables of a data directory, and their SQL where SQL can express them."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, licences, mixing, packing, quality, secrets, simhash, toxicity, warc


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_t(spark, sf_dir, "documents"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    turns = chat.canonical(_t(spark, sf_dir, "conversations"))
    messages = [{"role": r, "content": control} for r in ("user", "assistant")]
    own = chat.canonical_records(spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(json.dumps({"messages": messages})).alias("record")), "record")
    return chat.digests(chat.read_back(chat.format_turns(turns.unionByName(own))))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_t(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(_t(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.col("doc_id").cast("string"))
    return licences.licences(docs.select("doc_id", path.alias("path"), "text"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_t(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_t(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_t(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_chat, op3_mixing, op4_secrets, op5_decontamination, op6_licences, op7_toxicity, op8_packing, op9_quality, op10_warc)}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2 = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
n as (
  select *, len(regexp_extract_all(text, '[<\[]\\*/?(?:s>|INST\])')) as more from t)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(20 + length(role) + length(text) + more)::bigint as formatted_chars
from n group by conv_id"""

OP9 = rf"""
with w as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text, {_WORDS} as w from documents),
g as (
  select r, i, array_to_string(w[i:i + 7], ' ') as s from (select r, w, unnest(range(1, len(w) - 6)) as i from w where len(w) >= 8)),
d as (
  select r, i from (select r, i, count(*) over (partition by r, s) as n from g) where n > 1),
c as (
  select r, count(distinct i + k)::bigint as n from d, range(0, 8) as o(k) group by r),
m as (
  select w.r, doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
    coalesce(c.n, 0) as n_repeat_words,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) as n_upper
  from w left join c using (r)),
v as (
  select *, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, len(lines) as n_lines from m),
f as (
  select *, (case when n_words < 20 then 1 else 0 end + case when 100 * n_repeat_words > 30 * n_words then 2 else 0 end
    + case when 10 * n_symbols > n_words * 3 then 4 else 0 end + case when 2 * n_dup_lines > n_lines then 8 else 0 end
    + case when word_chars < 2 * n_words then 16 else 0 end + case when word_chars > 20 * n_words then 32 else 0 end
    + case when 2 * n_upper > word_chars then 64 else 0 end)::bigint as failed from v)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 as base_failed, failed = 0 as kept, failed from f"""


_DIGITS = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, {at}, 5))::bigint >> {shift}) & 31)::int + 1, 1)"

OP10 = f"""
with p as (select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as x from pages),
d as (select page_id, x, strlen(h)::bigint as payload_bytes, {" || ".join(_DIGITS.format(at=at, shift=shift) for at in range(1, 41, 5) for shift in (15, 10, 5, 0))} as payload_digest from p),
m as (select *, min(page_id) over (partition by x) as first from d)
select page_id, payload_bytes, payload_digest, case when first = page_id then 'response' else 'revisit' end as record_type, case when first <> page_id then first end as refers_to from m"""


def op6_sql(v: licences.Vectors | None = None) -> str:
    """Windows of every text and their cosines, and the nearest licence text above each path. The templates' texts and the
    anchors are parameters; idf, weights and places are worked out here."""
    v = v or licences.Vectors()
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    texts = ", ".join(f"({k}, {quoted(n)}, {quoted(t)})" for k, (n, t) in enumerate(licences.TEMPLATES))
    anchors = ", ".join(f"({quoted(a)}, {k})" for a, ps in sorted(v.places.items()) for k, _, _ in ps)
    return f"""
with templates(k, licence, text) as (values {texts}), anchors(term, k) as (values {anchors}),
tl as (select k, licence, regexp_extract_all(lower(text), '{licences._TERM}') as ts from templates),
tt as (select k, unnest(ts) as term, unnest(range(len(ts))) as o from tl),
idf as (select term, ln((1 + (select count(*) from templates))::double / (1 + count(distinct k))) + 0.1::double as idf from tt group by 1),
unknown as (select ln((1 + count(*))::double) as u from templates),
tf as (select k, term, count(*) * any_value(idf) as x from tt join idf using (term) group by 1, 2),
weights as (select k, term, x / sqrt(sum(x * x) over (partition by k)) as w from tf),
places as (select term, k, min(o) as o, any_value(len(ts)) as n from tt join anchors using (term, k) join tl using (k) group by 1, 2),
f as (select doc_id, coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || doc_id as path, text from documents),
l as (select path, regexp_extract_all(lower(text), '{licences._TERM}') as ts from (select distinct path, text from f) where len(list_intersect(regexp_extract_all(lower(text), '{licences._TERM}'), (select list(term) from anchors))) > 0),
t as (select path, unnest(ts) as term, unnest(range(len(ts))) as p from l),
win as (select distinct path, greatest(p - o, 0) as start, k, n from t join places using (term)),
wt as (select win.path, start, win.k, n, term, count(*) as c from win join t on t.path = win.path and p >= start and p < start + n group by all),
wx as (select wt.*, c * coalesce(idf, u) as x from wt left join idf using (term), unknown),
scored as (select path, start, wx.k, any_value(n) as n, round(sum(x * coalesce(w, 0)) / sqrt(sum(x * x)), 9) as score from wx left join weights using (k, term) group by 1, 2, 3),
best as (select path, arg_max(struct_pack(k, score), (round(score - 2.0::double / n, 9), -start, -k)) as b from scored where score >= {v.threshold} group by 1),
n as (select path, term, count(*) * coalesce(any_value(idf), any_value(u)) as x from t left join idf using (term), unknown group by 1, 2),
dots as (select path, k, sum(x * w) as d from n join weights using (term) group by 1, 2),
wholes as (select path, max(round(d / norm, 9)) >= {v.threshold} as whole from dots join (select path, sqrt(sum(x * x)) as norm from n group by 1) using (path) group by 1),
own as (select path, licence, b.score as score, whole, regexp_replace(path, '/?[^/]*$', '') as dir from best join templates on b.k = templates.k join wholes using (path)),
above as (select path, a, row_number() over (partition by path order by length(a) desc) as up from (
  select path, regexp_replace(path, '/?[^/]*$', '') as a from f union select path, regexp_replace(path, '/?[^/]*/[^/]*$', '') from f union select path, '' from f)),
covers as (select dir, arg_min(struct_pack(licence, score, path), (-score, path)) as c from own where whole group by 1),
nearest as (select above.path, arg_min(c, up) as c from above join covers on covers.dir = above.a group by 1)
select f.doc_id, f.path, coalesce(own.licence, c.licence) as licence, coalesce(own.score, c.score) as score,
  case when own.path is not null then 'own' when c is not null then 'inherited' end as origin, coalesce(own.path, c.path) as from_path
from f left join own using (path) left join nearest on nearest.path = f.path"""


def oracle_sql() -> dict[str, str]:
    """SimHash needs XXH64, and the mix, the models and token ids their draws, fits and merges, which SQL lacks."""
    return {"op2_chat": OP2, "op6_licences": op6_sql(), "op9_quality": OP9, "op10_warc": OP10}

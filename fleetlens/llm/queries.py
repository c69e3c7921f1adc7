"""One query per operator over the given tables, and check SQL where SQL can say the same."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import tune
from . import chat, embeddings, jaccard, language, licenses, mixing, packing, phrases, pii, quality, secret_scan, substring, whitening

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_substrings(_table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(_table(spark, sf_dir, "embeddings"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(_table(spark, sf_dir, "documents"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_table(spark, sf_dir, "documents")).drop("found")


#: The conversation that the query adds: control strings of a common template, said by both sides.
CONTROL = "</s>[INST] ok [/INST]"


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"),
    )
    messages = given.unionByName(more).select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))
    return chat.digest(chat.format_chats(messages))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), added=True)


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_languages(_table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf_dir, "documents"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan_secrets(_table(spark, sf_dir, "documents")))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.digest(whitening.whiten(_table(spark, sf_dir, "embeddings")))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    fn.__name__: fn
    for fn in (
        op1_quality_bands, op2_substring_dedup, op3_embedding_dedup, op4_jaccard_join, op5_personal_data,
        op6_chat_format, op7_packing, op8_source_mix, op9_language_id, op10_license_scan,
        op11_secret_scan, op12_embedding_whitening, op13_phrase_collocations,
    )
}

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _plain_case(expression: str) -> str:
    """Case-insensitive ASCII groups as classes: elsewhere ``(?i:k)`` also means the Kelvin sign."""
    return re.sub(
        r"\(\?i:([^)]*)\)", lambda m: "(?:" + re.sub("[a-z]", lambda c: f"[{c[0].upper()}{c[0]}]", m[1]) + ")", expression
    )


def _spans_sql(turn: int, rule: secret_scan.Rule) -> str:
    """Matches of a rule, the texts before them, and the parts whose size counts, as three lists of a document."""
    said = "'" + _plain_case(rule.expression).replace("'", "''") + "'"
    return (
        f"select nr, {turn} as turn, '{rule.kind}' as kind, {rule.least} as least, regexp_extract_all(t, {said}) as m, "
        f"regexp_extract_all(t, {said}, {rule.group}) as body, string_split_regex(t, {said}) as gap from doc where regexp_matches(t, {said})"
    )


ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": f"""
with doc as (select doc_id, {_WORDS.format(text="coalesce(text, '')")} as w from documents),
start as (select doc_id, w, unnest(range(1, len(w) - 18)) as s from doc where len(w) >= 20),
win as (select doc_id, s, array_to_string(w[s:s + 19], ' ') as k from start),
again as (select doc_id, s from (select doc_id, s, row_number() over (partition by k order by doc_id, s) as r from win) where r > 1),
gone as (select distinct doc_id, s + o as i from again, range(0, 20) as t(o)),
word as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as i from doc),
kept as (select word.doc_id, string_agg(x, ' ' order by word.i) as t, count(*) as n from word anti join gone on word.doc_id = gone.doc_id and word.i = gone.i group by 1)
select doc.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from doc left join kept on doc.doc_id = kept.doc_id""",
    "op3_embedding_dedup": """
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
link as (
  select a.vec_id as u, b.vec_id as v from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.98),
reach as (select u, v from link union select r.u, l.v from reach r join link l on r.v = l.u),
low as (select u, min(v) as m from reach group by 1),
n as (select u, count(*) as n_links from link group by 1)
select g.vec_id, coalesce(n_links, 0) as n_links, least(g.vec_id, coalesce(m, g.vec_id)) as component_id,
  g.vec_id = least(g.vec_id, coalesce(m, g.vec_id)) as kept
from embeddings g left join low on low.u = g.vec_id left join n on n.u = g.vec_id""",
    "op4_jaccard_join": f"""
with recursive doc as (
  select doc_id, {_WORDS.format(text=f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} as w from documents),
shingle as (
  select distinct doc_id, array_to_string(w[s:s + 4], ' ') as k
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as s from doc where len(w) > 0)),
size as (select doc_id, count(*) as n from shingle group by 1),
pair as (select a.doc_id as u, b.doc_id as v, count(*) as shared from shingle a join shingle b on a.k = b.k and a.doc_id < b.doc_id group by 1, 2),
half as (select u, v from pair join size x on x.doc_id = u join size y on y.doc_id = v where 100 * shared >= 75 * (x.n + y.n - shared)),
link as (select u, v from half union all select v, u from half),
reach as (select u, v from link union select r.u, l.v from reach r join link l on r.v = l.u),
low as (select u, min(v) as m from reach group by 1)
select doc.doc_id, coalesce(n, 0) as n_shingles, least(doc.doc_id, coalesce(m, doc.doc_id)) as component_id
from doc left join size on size.doc_id = doc.doc_id left join low on low.u = doc.doc_id""",
    "op6_chat_format": f"""
with said as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '{CONTROL}' union all select -7, 1, 'assistant', '{CONTROL}'),
coded as (
  select *, replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lb;') as r,
    replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lb;') as t from said),
formed as (select *, '{chat.TURN}' || r || '{chat.BODY}' || t || '{chat.END}' as f from coded)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, f)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, f) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length(f))::bigint as formatted_chars
from formed group by conv_id""",
    "op11_secret_scan": f"""
with doc as (select row_number() over () as nr, doc_id, coalesce(text, '') as t from documents),
part as ({" union all ".join(_spans_sql(i, r) for i, r in enumerate(secret_scan.RULES))}),
flat as (select nr, turn, kind, least, unnest(m) as m, unnest(body) as body, unnest(gap[:len(m)]) as gap, unnest(range(len(m))) as i from part),
placed as (select *, sum(length(gap) + length(m)) over (partition by nr, turn order by i) as e from flat),
span as (select nr, turn, kind, e - length(m) as s, kind || ':' || (e - length(m)) || ':' || e as said from placed where strlen(body) >= least),
told as (
  select nr, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
    string_agg(said, ',' order by s, turn) filter (turn < {len(secret_scan.BASE)}) as base, string_agg(said, ',' order by s, turn) as spans, count(*) as n_spans
  from span group by nr)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_spans, 0) as n_spans
from doc left join told using (nr)""",
    "op13_phrase_collocations": f"""
with doc as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') as t from documents),
piece as (select lang, unnest(regexp_extract_all(t, '[^.,;:!?\x0A-\x0D]+')) as x from doc),
said as (select lang, regexp_extract_all(x, '[^\x20\x09]+') as w from piece),
gram as (
  select lang, size, array_to_string(w[s:s + size - 1], ' ') as phrase
  from (select lang, w, size, unnest(range(1, len(w) - size + 2)) as s from said, (values (1), (2), (3)) as t(size) where len(w) >= size)),
counted as (select lang, size, phrase, count(*) as f from gram group by all),
total as (select lang, sum(f)::bigint as n from counted where size = 1 group by 1),
candidate as (select lang, size, phrase, f as a, string_split(phrase, ' ') as w from counted where size >= 2 and f >= 10),
cut as (select *, array_to_string(w[:k], ' ') as head, array_to_string(w[k + 1:], ' ') as rest from candidate, (values (1), (2)) as t(k) where k < size),
scored as (
  select cut.lang, cut.size, cut.phrase, a, k, x.f as l, y.f as r, ((1000000::hugeint * a * a) // (x.f::hugeint * y.f))::bigint as score
  from cut join counted x on x.lang = cut.lang and x.phrase = head join counted y on y.lang = cut.lang and y.phrase = rest),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inside as (select lang, phrase, max(longer) as longer from (
  select lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as phrase, a as longer from candidate where size = 3) group by all),
alone as (select best.* from best left join inside using (lang, phrase) where coalesce(100 * longer < 50 * a, true)),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from alone)
select lang, rank, phrase, a, l, r, n, score from ranked join total using (lang) where rank <= 2000""",
}

"""Registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorale.llm import (
    decontaminate, divergence, language, lexical, materialise, mixing, neighbours, ngrams, paragraphs, quality, simhash,
    templates, urlfilter,
)
from chorale.session import work_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.report(templates.recurring(_table(spark, sf_dir, "documents")))


# Captures and a list's log, shaped from `pages` alike in both engines: the fetch time from the page's
# number, and for every third host, and every fifth first directory of a host, up to three entries.
def _log(spark: SparkSession, pages: DataFrame) -> DataFrame:
    host, path = urlfilter.host_of(F.col("url")), urlfilter.path_of(F.col("url"))
    first = F.concat(host, F.lit("/"), F.substring_index(F.substring(path, 2, 1_000_000), "/", 1), F.lit("/"))
    keys = pages.filter(host != "").select(F.explode(F.array(
        F.struct(host.alias("key"), F.lit(3).alias("share")), F.struct(first.alias("key"), F.lit(5).alias("share")))).alias("k"))
    number = lambda k: F.conv(F.substring(F.md5(F.concat("key", F.lit(k))), 1, 6), 16, 10).cast("long")
    keys = keys.select("k.*").distinct().filter(number("x") % F.col("share") == 0)
    entries = F.explode(F.array(*[F.struct(F.lit(a).alias("action"), number(k).alias("n"))
                                  for a, k in (("add", "a"), ("remove", "b"), ("add", "c"))]))
    return keys.withColumn("e", entries).select(
        "key", "e.action", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("e.n") % 31_536_000).alias("listed_at"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.timestamp_seconds(
        F.lit(1_704_067_200) + (F.col("page_id") * 7_919) % 525_600 * 60))
    return urlfilter.screened(captures, _log(spark, pages)).select(
        "page_id", F.unix_timestamp("fetched_at").alias("fetched"), "blocked", F.array_join("matches", " ").alias("matches"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.passages(_table(spark, sf_dir, "documents")).drop("across")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return groups.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "size", "source_size", "target", "taken")


OP2_SQL = r"""
with parts as (
  select page_id, url, 1704067200 + (page_id * 7919) % 525600 * 60 as fetched,
         rtrim(lower(regexp_replace(regexp_replace(regexp_extract(trim(url),
           '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1), '^.*@', ''), ':\d*$', '')), '.') as host,
         coalesce(nullif(regexp_extract(trim(url),
           '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*(/[^?#]*)', 1), ''), '/') as path
  from (select distinct page_id, url from pages)),
listed as (
  select distinct host as key, 3 as share from parts where host <> ''
  union select distinct host || '/' || split_part(substr(path, 2), '/', 1) || '/', 5 from parts where host <> ''),
log as (
  select key, action, 1704067200 + ('0x' || substr(md5(key || k), 1, 6))::bigint % 31536000 as since
  from listed, (values ('add', 'a'), ('remove', 'b'), ('add', 'c')) as e(action, k)
  where ('0x' || substr(md5(key || 'x'), 1, 6))::bigint % share = 0),
spans as (
  select key, action, since, lead(since) over (partition by key order by since, action) as until
  from (select distinct * from log)),
asks as (
  select distinct page_id, url, fetched, unnest(
    list_transform(range(1, len(string_split(host, '.')) + 1),
                   lambda i: array_to_string(string_split(host, '.')[i:], '.'))
    || list_transform(range(1, len(string_split(path, '/')) + 1),
                   lambda i: host || array_to_string(string_split(path, '/')[1:i], '/')
                        || case when i < len(string_split(path, '/')) then '/' else '' end)) as key
  from parts where host <> ''),
hits as (
  select a.page_id, a.url, a.fetched, string_agg(distinct a.key, ' ' order by a.key) as matches
  from asks a join spans s on a.key = s.key and s.action = 'add' and s.since <= a.fetched
    and (s.until is null or s.until > a.fetched)
  group by all)
select p.page_id, p.fetched, h.matches is not null as blocked, coalesce(h.matches, '') as matches
from parts p left join hits h using (page_id, url, fetched)
"""

OP6_SQL = r"""
with sizes as (
  select doc_id, source, md5('7:' || cast(doc_id as varchar)) as k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size
  from documents),
per as (select source, sum(size)::bigint as s from sizes group by source),
placed as (
  select source, s, row_number() over (order by source nulls last) as place from per),
weighed as (
  select *, ((place - 1) % 3 + 1)::bigint as w, 3 * s as cap,
         sum(s) over (order by place) - s as before from placed),
filled as (
  select *, sum(cap) over (order by cap / w, place) as caps, sum(w) over (order by cap / w, place) as parts,
         sum(s) over () as total, sum(w) over () as all_parts from weighed),
held as (select *, caps * w + cap * (all_parts - parts) < total * w as is_held from filled),
level as (
  select (max(total) - coalesce(sum(cap) filter (is_held), 0))::double
         / nullif(max(all_parts) - coalesce(sum(w) filter (is_held), 0), 0)::double as water from held),
targets as (
  select source, place, s, before, total,
         case when is_held then cap::double else least(w * water, cap::double) end as target
  from held, level),
queue as (
  select z.*, t.place, t.s, t.target, t.total,
         sum(z.size) over (partition by t.place order by z.k, z.doc_id rows unbounded preceding) as upto
  from sizes z join targets t on z.source is not distinct from t.source),
items as (
  select q.*, e, (upto + s * e)::double / target as finish
  from queue q, (values (0), (1), (2)) as v(e) where size > 0),
stream as (
  select *, sum(size) over (order by finish, place, e rows unbounded preceding) as words from items),
-- The longest start of at most the total: nothing behind the first item that goes over it.
taken as (
  select doc_id, source, sum(size)::bigint as taken from stream
  where words <= total group by doc_id, source)
select q.doc_id, q.source, q.size, q.s as source_size, q.target, coalesce(t.taken, 0)::bigint as taken
from queue q left join taken t on q.doc_id = t.doc_id and q.source is not distinct from t.source
"""


def op7_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise.materialise(_table(spark, sf_dir, "documents"), work_dir(spark, "training"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    found = language.predicted(docs, language.fit(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 7
    found = ngrams.scored(docs, ngrams.fit(docs, remainder != 2))
    return found.select("doc_id", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known",
                        "train_tokens", "base_score", "score", "perplexity")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
with docs as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
  from documents),
found as (
  select r, lang, source, term, count(*) as n
  from (select r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs)
  group by all),
kept as (select lang, term from found group by lang, term having count(*) >= 10),
words as (select lang, count(*) as v from kept group by lang),
counts as (select lang, source, term, sum(n)::hugeint as n from found semi join kept using (lang, term) group by all),
members as (select distinct lang, source from docs),
totals as (
  select m.lang, m.source, coalesce(sum(c.n), 0) + 2 * coalesce(max(w.v), 0) as d
  from members m left join counts c using (lang, source) left join words w on w.lang = m.lang group by all),
whole as (
  select lang, term, sum(n) as n, sum(sum(n)) over (partition by lang) + 2 * count(*) over (partition by lang) as d
  from counts group by lang, term),
shares as (
  select m.lang, m.source, k.term, coalesce(c.n, 0) as n,
         (1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // t.d)::hugeint as p
  from members m join kept k using (lang) join totals t using (lang, source)
  left join counts c on c.lang = m.lang and c.source = m.source and c.term = k.term),
pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0) as value
  from members a join members b on a.lang = b.lang and a.source <> b.source
  left join (
    select x.lang, x.source as a, y.source as b, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) as value
    from shares x join shares y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all) s
  on s.lang = a.lang and s.a = a.source and s.b = b.source),
lang_shares as (select lang, term, 1 + (1000000000::hugeint * (n + 2)) // d as q from whole),
terms as (
  select s.lang, s.source, 'term' as part, s.term as item, ((p - q) * (p - q)) // (p + q) as value
  from shares s join lang_shares using (lang, term) where s.n > 0 and p > q),
ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as rank
  from (select * from pairs union all select * from terms))
select lang, source, part, item, value::bigint as value, rank::integer as rank from ranked
where part = 'pair' or rank <= 10
"""

OP13_SQL = r"""
with docs as (select row_number() over () as r, doc_id, text from documents),
tokens as (
  select r, doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from docs),
tf as (select r, doc_id, term, count(*)::bigint as tf from tokens group by all),
sizes as (select r, sum(tf)::bigint as n from tf group by r),
stats as (select count(*)::bigint as docs, sum(n)::bigint as terms from sizes),
df as (select term, count(*)::bigint as df from tf group by term),
asked as (
  select item_id, text, term, count(*)::bigint as reps
  from (select item_id, text, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from (select distinct item_id, text from benchmark)) group by all),
weighed as (
  select a.*, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint as w
  from asked a join df using (term), stats),
scored as (
  select item_id, q.text, t.r, t.doc_id,
         sum(reps * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms))))::bigint as score
  from weighed q join tf t using (term) join sizes using (r), stats group by all),
ranked as (
  select *, row_number() over (partition by item_id, text order by score desc, doc_id nulls last) as rank
  from scored where score > 0)
select item_id, rank::integer as rank, doc_id, score from ranked where rank <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_line_dedup": op1_line_dedup, "op2_url_filter": op2_url_filter,
            "op3_substring_dedup": op3_substring_dedup, "op4_nearest": op4_nearest,
            "op5_simhash": op5_simhash, "op6_mixing": op6_mixing, "op7_training_order": op7_training_order,
            "op8_language": op8_language, "op9_quality": op9_quality, "op10_decontamination": op10_decontamination,
            "op11_lm_scoring": op11_lm_scoring, "op12_divergence": op12_divergence, "op13_search": op13_search}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": OP2_SQL, "op6_mixing": OP6_SQL, "op12_divergence": OP12_SQL, "op13_search": OP13_SQL}

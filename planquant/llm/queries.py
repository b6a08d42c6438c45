"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from planquant.llm.common import documents, sha256_of, table, tokenizer_file

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def span_text(spans):
    return F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planquant.llm.quality_rules import quality_rules

    return quality_rules(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planquant.llm.secret_scan import KINDS, secrets

    found = secrets(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: ~s["decoded"])
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), sha256_of(span_text(base)).alias("base_sha256"), F.array_join(span_text(F.col("spans")), ",").alias("spans"))


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planquant.llm.token_counts import token_counts

    return token_counts(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planquant.llm.decontamination import contamination

    found = contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), sha256_of(F.col("items")).alias("items_sha256"), "contaminated")


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planquant.llm.packing import pack

    return pack(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planquant.llm.line_dedup import dedup_lines

    return dedup_lines(documents(spark, sf_dir), columns=["doc_id", "text"])


ORACLE_SQL["op9_line_dedup"] = r"""
with lines as (
  select doc_id, text, i - 1 as pos, string_split(text, chr(10))[i] as line
  from (select doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from (select distinct doc_id, text from documents where text is not null))
), counted as (
  select *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as w from lines
), worded as (
  select *, row_number() over (partition by doc_id, text order by pos) as k,
         sum(w) over (partition by doc_id, text order by pos) as c
  from counted where w > 0
), ends as (
  select s.doc_id, s.text, s.k as k1, min(e.k) as k2
  from worded s join worded e on s.doc_id = e.doc_id and s.text = e.text and e.k between s.k and s.k + 50 and e.c - s.c + s.w > 50
  group by all
  union
  select e.doc_id, e.text, max(s.k), e.k
  from worded s join worded e on s.doc_id = e.doc_id and s.text = e.text and s.k between e.k - 50 and e.k and e.c - s.c + s.w > 50
  group by e.doc_id, e.text, e.k
), bodies as (
  select n.doc_id, n.text, min(w.pos) as first_at, max(w.pos) as last_at, string_agg(w.line, chr(10) order by w.k) as body
  from ends n join worded w on n.doc_id = w.doc_id and n.text = w.text and w.k between n.k1 and n.k2
  group by n.doc_id, n.text, n.k1, n.k2
), again as (
  select doc_id, text, first_at, last_at from bodies
  qualify row_number() over (partition by body order by doc_id, first_at) > 1
), gone as (
  select distinct l.doc_id, l.text, l.pos from lines l join again a on l.doc_id = a.doc_id and l.text = a.text and l.pos between a.first_at and a.last_at
), left_over as (
  select l.doc_id, l.text, coalesce(string_agg(l.line, chr(10) order by l.pos) filter (where g.pos is null), '') as kept, count(*) as n_lines, count(g.pos) as n_removed
  from lines l left join gone g on l.doc_id = g.doc_id and l.text = g.text and l.pos = g.pos
  group by l.doc_id, l.text
)
select d.doc_id, case when d.text is null then null else k.kept end as text, cast(coalesce(k.n_lines, 0) as bigint) as n_lines, cast(coalesce(k.n_removed, 0) as bigint) as n_removed
from documents d left join left_over k on d.doc_id = k.doc_id and d.text = k.text
"""


@query
def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planquant.llm.near_duplicates import classes

    return classes(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "class_id", "n_links")


ORACLE_SQL["op8_ngram_jaccard_join"] = r"""
with recursive words as (
  select doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from documents where text is not null
), sets as (
  select distinct doc_id, unnest([list_aggregate(w[i:i + 4], 'string_agg', ' ') for i in range(1, greatest(len(w) - 4, 1) + 1)]) as s
  from words where len(w) > 0
), sizes as (
  select doc_id, count(*) as n from sets group by doc_id
), pairs as (
  select a.doc_id as x, b.doc_id as y from sets a join sets b on a.s = b.s and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id
  having 9 * count(*) >= 4 * ((select n from sizes where doc_id = a.doc_id) + (select n from sizes where doc_id = b.doc_id))
), reach as (
  select x as doc_id, x as to_id from (select distinct x from pairs)
  union
  select r.doc_id, p.y from reach r join pairs p on r.to_id = p.x
)
select d.doc_id, coalesce(c.class_id, d.doc_id) as class_id, coalesce(l.n, 0) as n_links
from documents d
left join (select doc_id, min(to_id) as class_id from reach group by doc_id) c on d.doc_id = c.doc_id
left join (select x, count(*) as n from pairs group by x) l on d.doc_id = l.x
"""


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planquant.llm.language_id import identify, learn

    docs = documents(spark, sf_dir)
    return identify(docs, learn(docs))


@query
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planquant.llm.quality_classifier import classify, fit, label

    docs = documents(spark, sf_dir)
    return classify(docs, fit(docs, label(docs)))


@query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planquant.llm.pii import KINDS, personal_data

    found = personal_data(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), sha256_of(span_text(base)).alias("base_sha256"), F.array_join(span_text(F.col("spans")), ",").alias("spans"))


_ITEM_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL["op7_decontamination"] = f"""
with d as (
  select doc_id, {_ITEM_WORDS} as w from documents where text is not null
), i as (
  select item_id, {_ITEM_WORDS} as w from benchmark where text is not null and item_id is not null
), starts as (
  select item_id, w, least(13, len(w)) as n, unnest(range(1, len(w) - least(13, len(w)) + 2)) as k from i where len(w) > 0
), win as (
  select distinct item_id, n, array_to_string(w[k:k + n - 1], ' ') as s from starts
), places as (
  select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as k from d, (select distinct n from win) where len(w) >= n
), hits as (
  select p.doc_id, p.n, p.k, x.item_id from (select doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') as s from places) p join win x on p.n = x.n and p.s = x.s
), covered as (
  select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(k, k + n)) as pos from hits) group by doc_id
), who as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by doc_id
)
select x.doc_id, coalesce(len(d.w), 0) as n_words, coalesce(c.n_hit, 0) as n_hit, coalesce(h.n_items, 0) as n_items, sha256(coalesce(h.items, '')) as items_sha256,
       coalesce(c.n_hit, 0) > 0 and 20 * coalesce(c.n_hit, 0) >= coalesce(len(d.w), 0) as contaminated
from documents x left join d on x.doc_id = d.doc_id left join covered c on x.doc_id = c.doc_id left join who h on x.doc_id = h.doc_id
"""


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planquant.llm.fill_in_middle import fill_in_middle, restored

    out = fill_in_middle(documents(spark, sf_dir))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored("output", "form"), 256).alias("restored_sha256"))


ORACLE_SQL["op11_fill_in_middle"] = r"""
with base as (
  select doc_id, coalesce(text, '') as t, sha256('42:' || doc_id) as h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as w
  from documents
), numbers as (
  select doc_id, t, w, len(w) as n, [('0x' || h[8 * k + 1:8 * k + 8])::ubigint for k in range(0, 4)] as r from base
), ends as (
  select doc_id, t, n, r, least(r[1] % (n + 1), r[2] % (n + 1)) as a, greatest(r[1] % (n + 1), r[2] % (n + 1)) as b, list_transform(w, lambda x: length(x)) as s from numbers
), chars as (
  select doc_id, t, n, r, cast(coalesce(list_sum(s[1:a]), 0) as bigint) as p, cast(coalesce(list_sum(s[1:b]), 0) as bigint) as q from ends
), forms as (
  select *, case when t = '' or regexp_matches(t, '<[PSM]>') or r[3] % 100 >= 50 then 'plain' when r[4] % 100 < 80 then 'spm' else 'psm' end as form from chars
)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then p end as prefix_chars, case when form <> 'plain' then q - p end as middle_chars,
       sha256(case form when 'plain' then t
              when 'psm' then concat('<P>', substr(t, 1, p), '<S>', substr(t, q + 1), '<M>', substr(t, p + 1, q - p))
              else concat('<S>', substr(t, q + 1), '<P>', substr(t, 1, p), '<M>', substr(t, p + 1, q - p)) end) as output_sha256,
       sha256(t) as restored_sha256
from forms
"""


@query
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planquant.llm.ranked_search import index, search

    return search(index(documents(spark, sf_dir)), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL["op12_ranked_search"] = f"""
with d as (
  select row_number() over () as k, doc_id, {_TERMS} as w from documents where text is not null
), whole as (
  select count(*) as big_n, sum(len(w)) as big_l from d where len(w) > 0
), places as (
  select k, doc_id, len(w) as n, unnest(w) as term from d
), tf as (
  select k, doc_id, n, term, count(*) as tf from places group by all
), df as (
  select term, count(*) as df from tf group by term
), q as (
  select item_id, text, term, count(*) as qn from (select item_id, text, unnest({_TERMS}) as term from (select distinct item_id, text from benchmark where item_id is not null)) group by all
), scored as (
  select q.item_id, q.text, tf.k, tf.doc_id,
         cast(sum(q.qn * cast(floor(1000 * ln((2 * big_n + 2) / (2 * df.df + 1))) as bigint) * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * (75 + cast((25 * tf.n * big_n) // big_l as bigint))))) as bigint) as score
  from q join df using (term) join tf using (term), whole group by all
)
select item_id, cast(row_number() over (partition by item_id, text order by score desc, doc_id) as int) as rank, doc_id, score
from scored where score > 0 qualify row_number() over (partition by item_id, text order by score desc, doc_id) <= 20
"""


@query
def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planquant.llm.sharding import shards

    return shards(documents(spark, sf_dir)).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")

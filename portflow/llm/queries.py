"""The registered queries of this subpackage: thin uses of its operators with production parameters, on whole tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


@query
def op1_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(table(spark, sf_dir, "pages"))


@query
def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import QUERY_EVERY, nearest

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors.where(F.col("vec_id") % QUERY_EVERY == 0), vectors)


ORACLE["op2_neighbours"] = """
with v as (
  select vec_id, list_transform(embedding, lambda x: x::double) as e, len(embedding) as d from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), r as (
  select q.vec_id as query_id, b.vec_id, list_inner_product(q.e, b.e) as score
  from v q join v b on q.d = b.d and q.vec_id <> b.vec_id where q.vec_id % 20 = 0
), k as (
  select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id) as rank from r
)
select query_id, rank::int as rank, vec_id, score from k where rank <= 20
"""


@query
def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).drop("n_class")


ORACLE["op3_near_duplicates"] = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws
  from documents
), s as (
  select doc_id, unnest(case when len(ws) < 2 then ws else list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) end) as g from w
), n as (
  select doc_id, count(*) as n from s group by doc_id
), p as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all
), e as (
  select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)
), both_ways as (
  select a as u, b as v from e union all select b, a from e
), reach(doc_id, other) as (
  select doc_id, doc_id from w union select both_ways.v, reach.other from reach join both_ways on both_ways.u = reach.doc_id
)
select w.doc_id, coalesce(n.n, 0) as n_shingles, r.component_id, w.doc_id = r.component_id as kept
from w left join n on n.doc_id = w.doc_id join (select doc_id, min(other) as component_id from reach group by doc_id) r on r.doc_id = w.doc_id
"""


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fold, score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id",
        F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simple8b import read_ids, write_ids

    return read_ids(write_ids(table(spark, sf_dir, "documents")))


@query
def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licences import scan

    labels = F.array_distinct(F.concat(F.split("base_labels", ","), F.col("spans.label")))
    digest = F.array_join(F.array_sort(F.array_remove(labels, "")), ",")
    return scan(table(spark, sf_dir, "documents")).withColumn("labels", digest).drop("spans")


@query
def op7_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line that is alike another, with the line kept in its place."""
    from .line_dedup import fuzzy_lines

    return fuzzy_lines(table(spark, sf_dir, "documents"))


@query
def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


@query
def op9_contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each benchmark item found in a document."""
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import COLUMNS, pack

    return pack(table(spark, sf_dir, "documents")).select(*COLUMNS)


@query
def op11_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .inner_search import QUERY_EVERY, top_inner_products

    return top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0)


# sums of products of whole doubles are exact up to 2**53
ORACLE["op11_inner_products"] = """
with v as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as e, len(embedding) as d from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(1024 * x::double))) = 0
), s as (
  select q.r, q.vec_id as query_id, b.vec_id, case when q.d = 0 then 0 else list_inner_product(q.e, b.e)::bigint end as score
  from v q join v b on q.d = b.d and q.r <> b.r where q.vec_id % 100 = 0
), k as (
  select query_id, vec_id, score, row_number() over (partition by r order by score desc, vec_id) as rank from s
)
select query_id, rank::int as rank, vec_id, score from k where rank <= 10
"""


@query
def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversations import damage, repair, with_ids

    turns = table(spark, sf_dir, "conversations")
    return with_ids(repair(damage(turns)), turns)


ORACLE["op12_conversations"] = r"""
with recursive harm as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, row_number() over () as r,
    list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda c: ascii(c)::bigint) as bytes
  from conversations
), crc as (
  select * exclude (bytes), xor(4294967295, list_reduce(bytes, lambda crc, byte:
    list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384)), 4294967295)) % 20 as h
  from harm
), damaged as (
  select conv_id, turn, case when h = 4 then 'user' else role end as role,
    case when h = 1 then '' when h = 2 then translate(text, '.!?', '') else text end as text, r, copy
  from crc, (values (1), (2)) c(copy) where h <> 0 and (copy = 1 or h = 3)
), placed as (
  select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn nulls first, role, text, r, copy) as i from damaged
), marked as (
  select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank'
      when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
      when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') then 'truncated' else '' end as fault,
    role[1] as c, lag(role[1]) over (partition by conv_id order by i) || role[1] not in ('su', 'ua', 'au') as illegal
  from placed
), stats as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
    count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated, count(*) filter (illegal) as illegal, count(*) as n
  from marked group by conv_id
), best as (
  -- by rows done: the least cost (9 digits) and letters, by the last role written (none, system, user, assistant)
  select conv_id, 0::bigint as i, '000000000' as v0, null::varchar as v1, '000000003I' as v2, '000000006II' as v3 from stats
  union all
  select conv_id, i, v0, v1, v2, least(v3, lpad((left(v2, 9)::int + 3)::varchar, 9, '0') || substr(v2, 10) || 'I') from (
    select conv_id, i, v0, v1, v3, least(v2, lpad((left(least(v0, v1, v3), 9)::int + 3)::varchar, 9, '0') || substr(least(v0, v1, v3), 10) || 'I') as v2 from (
      select b.conv_id, m.i,
        lpad((left(v0, 9)::int + 4)::varchar, 9, '0') || substr(v0, 10) || 'D' as v0,
        least(lpad((left(v1, 9)::int + 4)::varchar, 9, '0') || substr(v1, 10) || 'D', case when w.ok and c = 's' then lpad((left(v0, 9)::int + w.x)::varchar, 9, '0') || substr(v0, 10) || 'K' end) as v1,
        least(lpad((left(v2, 9)::int + 4)::varchar, 9, '0') || substr(v2, 10) || 'D',
          case when w.ok then lpad((left(least(v0, v1, v3), 9)::int + w.x + case when c = 'u' then 0 else 3 end)::varchar, 9, '0') || substr(least(v0, v1, v3), 10) || case when c = 'u' then 'K' else 'R' end end) as v2,
        least(lpad((left(v3, 9)::int + 4)::varchar, 9, '0') || substr(v3, 10) || 'D',
          case when w.ok then lpad((left(v2, 9)::int + w.x + case when c = 'a' then 0 else 3 end)::varchar, 9, '0') || substr(v2, 10) || case when c = 'a' then 'K' else 'R' end end) as v3
      from best b join marked m on m.conv_id is not distinct from b.conv_id and m.i = b.i + 1,
        lateral (select m.fault not in ('blank', 'duplicate') as ok, case when m.fault = 'truncated' then 3 else 0 end as x) w
    )
  )
), final as (
  select s.*, left(least(v0, v3), 9)::bigint as cost, substr(least(v0, v3), 10) as audit from stats s join best b on b.conv_id is not distinct from s.conv_id and b.i = s.n
), letters as (
  select conv_id, p, audit[p] as e, p - length(replace(left(audit, p), 'I', '')) as inserted, length(replace(left(audit, p), 'D', '')) as kept from (select conv_id, audit, unnest(range(1, length(audit) + 1)) as p from final)
), edits as (
  select l.conv_id, l.p, l.e, l.kept, m.role, m.text, max(case when l.kept = 1 and l.e = 'K' and m.c = 's' then 1 else 0 end) over (partition by l.conv_id) as system
  from letters l left join marked m on l.e <> 'I' and m.conv_id is not distinct from l.conv_id and m.i = l.p - l.inserted where l.e <> 'D'
), text as (
  select conv_id, sha256(string_agg(case when e = 'K' then role when (kept - system) % 2 = 1 then 'user' else 'assistant' end || ':' || case when e = 'I' then '' else text end, chr(10) order by p)) as h from edits group by conv_id
)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, coalesce(cost, 0) as cost, coalesce(audit, '') as audit, coalesce(h, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) o left join final f on f.conv_id is not distinct from o.conv_id left join text t on t.conv_id is not distinct from o.conv_id
"""


@query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import source_divergence

    return source_divergence(table(spark, sf_dir, "documents"))


ORACLE["op13_source_divergence"] = r"""
with d as (
  select coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ts
  from documents
), c as (
  select lang, source, term, count(*) as n from (select lang, source, unnest(ts) as term from d) group by all
), k as (
  select lang, term from (select lang, unnest(list_distinct(ts)) as term from d) group by all having count(*) >= 3
), v as (
  select lang, count(*) as v from k group by all
), g as (
  select distinct d.lang, d.source, coalesce(v.v, 0) as v from d left join v using (lang)
), cells as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n, g.v from g join k using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term
), p as (
  select lang, source, term, n, 1 + (1000000000::hugeint * (n + 1)) // (sum(n) over (partition by lang, source) + v) as p from cells
), ql as (
  select lang, term, 1 + (1000000000::hugeint * (n + 1)) // (sum(n) over (partition by lang) + v) as q
  from (select lang, term, v, sum(n) as n from cells group by all)
), pairs as (
  select x.lang, x.source, 'pair' as part, y.source as item, coalesce(sum((a.p - b.p) * (a.p - b.p) // b.p), 0) as value
  from g x join g y on x.lang = y.lang and x.source <> y.source
  left join p a on a.lang = x.lang and a.source = x.source left join p b on b.lang = y.lang and b.source = y.source and b.term = a.term
  where a.term is null or b.term is not null group by all
), terms as (
  select p.lang, p.source, 'term' as part, p.term as item, (p.p - ql.q) * (p.p - ql.q) // ql.q as value
  from p join ql on ql.lang = p.lang and ql.term = p.term where p.n > 0 and p.p > ql.q
)
select lang, source, part, item, value::bigint as value, rank::int as rank
from (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (from pairs union all from terms))
where part = 'pair' or rank <= 200
"""

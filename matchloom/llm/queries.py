"""Queries of the training-data operators, by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchloom.llm import decontaminate, html_text, jaccard_join, langid, pieces, quality_classifier, quality_rules, secrets, substring_dedup, suffix_dedup
from matchloom.llm.common import read


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), unnamed=True))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.query(read(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.query(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.secrets(read(spark, sf_dir, "documents")))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(read(spark, sf_dir, "documents"), pieces.default_model())


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.query(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.query(read(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.query(read(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_substring_dedup, op3_html_text, op4_quality_rules, op5_quality, op6_secrets, op7_decontaminate, op8_langid, op9_suffix_dedup, op10_jaccard_join)}

SQL: dict[str, str] = {
    "op2_substring_dedup": r"""
        with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
        win as (select doc_id, k, hash(w[k:k + 12]) as h, md5(array_to_string(w[k:k + 12], ' ')) as s from (select doc_id, w, unnest(range(1, len(w) - 11)) as k from d)),
        low as (select h, s, min(doc_id) as first from win group by h, s having min(doc_id) < max(doc_id)),
        gone as (select doc_id, list(distinct p) as g from (select doc_id, unnest(range(k, k + 13)) as p from win join low using (h, s) where doc_id > first) group by doc_id)
        select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(len(g), 0) as bigint) as n_removed,
               sha256(array_to_string(list_filter(w, lambda x, i: not list_contains(coalesce(g, []), i)), ' ')) as kept_sha256
        from d left join gone using (doc_id)
    """,
    "op7_decontaminate": r"""
        with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
        b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
        bw as (select distinct cast(item_id as varchar) as item_id, len(w[k:k + 9]) as n, array_to_string(w[k:k + 9], ' ') as s
               from (select item_id, w, unnest(range(1, greatest(2, len(w) - 8))) as k from b where len(w) > 0)),
        sizes as (select distinct n from bw),
        dw as (select doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') as s
               from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as k from d, sizes)),
        hit as (select doc_id, k, dw.n, item_id from dw join bw using (n, s)),
        words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(k, k + n)) as p from hit) group by doc_id),
        items as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as s from hit group by doc_id)
        select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
               sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from d left join words using (doc_id) left join items using (doc_id)
    """,
    "op9_suffix_dedup": r"""
        with d as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
        each as (select r, doc_id, k, hash(substring(h, 2 * k + 1, 100)) as x from (select r, doc_id, h, unnest(range(0, length(h) // 2 - 49)) as k from d)),
        twice as (select x from each group by x having min(doc_id) < max(doc_id)),
        win as (select r, each.doc_id, k, substring(h, 2 * k + 1, 100) as s from each join twice using (x) join d using (r)),
        low as (select s, min(doc_id) as first from win group by s having min(doc_id) < max(doc_id)),
        hit as (select r, k, lag(k) over (partition by r order by k) as p from win join low using (s) where doc_id > first),
        runs as (select r, k, sum(case when k <= p + 50 then 0 else 1 end) over (partition by r order by k) as run from hit),
        spans as (select r, min(k) as a, max(k) + 50 as b, lag(max(k) + 50, 1, 0) over (partition by r order by min(k)) as before from runs group by r, run),
        cut as (select r, count(*) as n_spans, sum(b - a) as n_removed, string_agg(substring(h, 2 * before + 1, 2 * (a - before)), '' order by a) as start, max(b) as rest from spans join d using (r) group by r)
        select doc_id, cast(length(h) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans,
               sha256(unhex(coalesce(start, '') || substring(h, 2 * coalesce(rest, 0) + 1))) as kept_sha256
        from d left join cut using (r)
    """,
    "op10_jaccard_join": r"""
        with recursive d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
        sh as (select distinct r, array_to_string(w[k:k + 4], ' ') as s from (select r, w, unnest(range(1, greatest(2, len(w) - 3))) as k from d where len(w) > 0)),
        n as (select r, count(*) as n from sh group by r),
        shared as (select x.r as a, y.r as b, count(*) as c from sh x join sh y on x.s = y.s and x.r <> y.r group by x.r, y.r),
        link as (select a, b from shared join n x on x.r = a join n y on y.r = b where 100 * c >= 80 * (x.n + y.n - c)),
        reach as (select r, r as other from d union select reach.r, link.b from reach join link on link.a = reach.other)
        select d.doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, c.component_id
        from d left join n using (r) join (select reach.r, min(e.doc_id) as component_id from reach join d e on e.r = reach.other group by reach.r) c on c.r = d.r
    """,
}

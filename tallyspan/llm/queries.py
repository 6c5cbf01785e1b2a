"""Queries over the driver's tables, one for each operator of this folder, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspan.llm import bpe, decontaminate, html, langid, licenses, linededup, quality, rules, simhash, substrings
from tallyspan.llm.common import table

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return rules.verdicts(docs, rules.fit(docs, labels)).select("doc_id", *rules.BASE, "base_failed", "kept", "rule")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return linededup.digests(docs, linededup.keep_bitmaps(docs))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    # At the repository's top; it may be deleted together with this folder, never without it.
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_html_extraction, op3_license_scan, op4_benchmark_decontamination, op5_simhash_near_dedup,
        op6_substring_dedup, op7_language_id, op8_quality_rules, op9_byte_bpe, op10_line_dedup, pipeline,
    )
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLES: dict[str, str] = {
    "op4_benchmark_decontamination": rf"""
        with d as (
            select doc_id, coalesce(regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) w from documents
        ), b as (
            select cast(item_id as varchar) item, coalesce(regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) w from benchmark
        ), win as (
            select distinct item, list_slice(w, i, i + least(10, len(w)) - 1) x
            from b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) u(i) where len(w) > 0
        ), occ as (
            select d.doc_id, s.i, n.n, win.item
            from d, (select distinct len(x) n from win) n, unnest(range(1, len(d.w) - n.n + 2)) s(i)
            join win on win.x = list_slice(d.w, s.i, s.i + n.n - 1)
        ), hit as (
            select doc_id, count(distinct p) n_hit from occ, unnest(range(i, i + n)) u(p) group by doc_id
        ), its as (
            select doc_id, count(*) n_items, string_agg(item, ',' order by item) items from (select distinct doc_id, item from occ) group by doc_id
        )
        select d.doc_id, cast(len(d.w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
               sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
        from d left join hit on hit.doc_id = d.doc_id left join its on its.doc_id = d.doc_id
    """,
    "op6_substring_dedup": r"""
        with d as (
            select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) w from documents
        ), win as (
            select doc_id, i, list_slice(w, i, i + 12) x from d, unnest(range(1, len(w) - 11)) u(i)
        ), late as (
            select doc_id, i from (select doc_id, i, min(doc_id) over (partition by x) low from win) where doc_id > low
        ), gone as (
            select distinct doc_id, p from late, unnest(range(i, i + 13)) u(p)
        ), kept as (
            select d.doc_id, p, d.w[p] word from d, unnest(range(1, len(d.w) + 1)) u(p)
            where not exists (select 1 from gone where gone.doc_id = d.doc_id and gone.p = u.p)
        ), joined as (
            select doc_id, count(*) n, string_agg(word, ' ' order by p) t from kept group by doc_id
        )
        select d.doc_id, cast(len(d.w) as bigint) n_words, cast(len(d.w) - coalesce(n, 0) as bigint) n_removed, sha256(coalesce(t, '')) kept_sha256
        from d left join joined on joined.doc_id = d.doc_id
    """,
    "op10_line_dedup": f"""
        with l as (
            select doc_id, i, ls[i] line, {_LOWER.format(f"trim(ls[i], {_BLANKS})")} k
            from (select doc_id, string_split(coalesce(text, ''), chr(10)) ls from documents), unnest(range(1, len(ls) + 1)) u(i)
        ), common as (
            select k, max(doc_id) keeper from l where length(k) >= 40 group by k having count(distinct doc_id) >= 5
        ), marked as (
            select l.doc_id, i, line, c.k is null or l.doc_id = keeper kept from l left join common c on c.k = l.k
        )
        select doc_id, count(*) n_lines, count(*) filter (not kept) n_dropped,
               sha256(coalesce(string_agg(line, chr(10) order by i) filter (kept), '')) kept_sha256
        from marked group by doc_id
    """,
}

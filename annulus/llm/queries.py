"""The corpus queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annulus.llm import codebooks as codebooks_op
from annulus.llm import conversations as conversations_op
from annulus.llm import decontam as decontam_op
from annulus.llm import fingerprints as fingerprints_op
from annulus.llm import licenses as licenses_op
from annulus.llm import packing as packing_op
from annulus.llm import pieces as pieces_op
from annulus.llm import quality as quality_op
from annulus.llm import secrets as secrets_op
from annulus.llm import simhash as simhash_op
from annulus.llm import tokens as tokens_op
from annulus.llm import toxicity as toxicity_op
from annulus.llm import warc as warc_op
from annulus.llm.common import read_table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_op.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_op.token_counts(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_op.secrets(read_table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_op.near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_op.pack(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as two records, a full response and a not-modified revisit; each revisit resolved."""
    r = warc_op.resolve(warc_op.crawl(read_table(spark, sf_dir, "pages")))
    headers = F.array_join(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return r.select("record_id", "canonical_url", "base_id", "age_seconds", "validator", "resolved", "status", "digest", headers.alias("headers"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam_op.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_op.quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses_op.licenses(read_table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints_op.edited_halves(read_table(spark, sf_dir, "documents"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = pieces_op.round_trip(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    n = (F.octet_length("ids") / 4).cast("bigint")
    return r.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "agrees")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codebooks_op.compress(read_table(spark, sf_dir, "embeddings"))
    r = codebooks_op.by_label(coded)
    return r.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(codebooks_op.digest(books)).alias("codebooks_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = conversations_op.prefix_trie(read_table(spark, sf_dir, "conversations"))
    return r.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


OP6 = r"""
with pages1 as (
  select page_id as p, 1704067200 + page_id as t0, url, sha256(coalesce(html, '')) as digest, strlen(coalesce(html, '')) as size,
         1704067200 + page_id + case when page_id % 5 = 4 then -7200 else 86400 + page_id % 1000 end as later,
         regexp_replace(regexp_replace(trim(coalesce(url, '')), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as u
  from pages
), parts as (
  select *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(u, '^[^/?]*', 0)), '^.*@', ''), '^(?:www\d*|m)\.', ''), ':(?:80|443)?$', '') as host,
         regexp_replace(regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/index\.\w+$', '/'), '/+$', '') as path,
         list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'),
           lambda x: x <> '' and lower(string_split(x, '=')[1]) not in ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'gclid', 'fbclid', 'ref', 'sessionid'))) as q
  from pages1
), c as (
  select *, host || path || case when len(q) > 0 then '?' || array_to_string(q, '&') else '' end as canonical_url,
         '"' || substring(digest, 1, 16) || '"' as tag, '"' || reverse(substring(digest, 1, 16)) || '"' as other,
         strftime(make_timestamp((t0) * 1000000), '%Y-%m-%dT%H:%M:%SZ') as at_text,
         strftime(make_timestamp((t0 - 60) * 1000000), '%Y-%m-%dT%H:%M:%SZ') as before_text,
         strftime(make_timestamp((later) * 1000000), '%Y-%m-%dT%H:%M:%SZ') as later_text,
         strftime(make_timestamp((later + 3600) * 1000000), '%Y-%m-%dT%H:%M:%SZ') as expires_text
  from parts
), asked as (
  select 2 * p + 1 as record_id, canonical_url, url, later as t, p % 2 = 0 as by_tag,
         case when p % 7 = 3 then other else tag end as tag, case when p % 7 = 3 then before_text else at_text end as modified, later_text, expires_text
  from c
), pairs as (
  select a.*, f.p as base_p, f.t0, f.tag as base_tag, f.at_text, f.digest, f.size,
         row_number() over (partition by a.record_id order by f.t0 desc, f.p desc) as n
  from asked a left join c f on f.canonical_url = a.canonical_url and a.url is not null and f.url is not null and (f.t0 < a.t or (f.t0 = a.t and 2 * f.p < a.record_id))
), found as (
  select *, case when base_p is null then 'none' when by_tag then case when tag = base_tag then 'etag' else 'mismatch' end
            else case when modified = at_text then 'last-modified' else 'mismatch' end end as validator
  from pairs where n = 1
)
select record_id, canonical_url, 2 * base_p as base_id, t - t0 as age_seconds, validator, base_p is not null and validator <> 'mismatch' as resolved,
       case when base_p is not null and validator <> 'mismatch' then 200 else 304 end as status,
       case when base_p is not null and validator <> 'mismatch' then digest end as digest,
       case when base_p is not null and validator <> 'mismatch' then
         'content-length=' || size || ';content-type=text/html;date=' || later_text || ';etag=' || base_tag || case when by_tag then ';expires=' || expires_text else '' end || ';last-modified=' || at_text
       when by_tag then 'content-length=0;date=' || later_text || ';etag=' || tag || ';expires=' || expires_text
       else 'date=' || later_text || ';last-modified=' || modified || ';set-cookie=a=b' end as headers
from found
"""

OP7 = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') as w from documents),
b as (select item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') as w from (select distinct item_id, text from benchmark where item_id is not null)),
di as (select r, doc_id, w, unnest(range(1, len(w) - 3)) as i from d where len(w) >= 5),
ds as (select distinct r, doc_id, array_to_string(w[i:i+4], ' ') as s from di),
bi as (select item_id, w, unnest(range(1, len(w) - 3)) as i from b where len(w) >= 5),
bs as (select distinct item_id, array_to_string(w[i:i+4], ' ') as s from bi),
size as (select item_id, count(*) as n from bs group by 1),
hit as (select r, doc_id, item_id, count(*) as k from ds join bs using (s) group by 1, 2, 3)
select doc_id, item_id, k as n_shared, n as n_item, k / n as containment from hit join size using (item_id) where k >= 0.8 * n - 1e-9
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_token_counts, op3_secrets, op4_simhash, op5_packing, op6_warc_revisits, op7_decontamination, op8_quality, op9_licenses, op10_fingerprints, op11_sentencepiece, op12_vector_codes, op13_prefix_trie)}


def oracle_sql() -> dict[str, str]:
    return {"op6_warc_revisits": OP6, "op7_decontamination": OP7}

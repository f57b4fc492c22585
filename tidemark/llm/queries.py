"""Registered queries of this subpackage and the SQL of those that DuckDB can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, chat, decontaminate, line_dedup, quality, search, secret_scan, sharding, simhash, substring_dedup, token_files, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"), 8)


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id bigint, turn bigint, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.read_back(chat.format_turns(turns))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), *_vocabulary())


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive_pages(_table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        F.size("removed").cast("bigint").alias("n_removed"),
        F.array_join("removed", ",").alias("removed_lines"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
        F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("kept_chars"),
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.token_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(_table(spark, sf_dir, "embeddings"))
    each = out.select("vec_id", "n", F.col("deviation").cast("bigint").alias("deviation"), "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "of"))
    return each.select("vec_id", (F.col("place") + 1).cast("int").alias("component"), "n", "deviation", "of.whitened", "of.explained", "identity_error")


_OP2 = r"""
with turns as (
  select conv_id, turn, role, coalesce(text, '') as t from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked as (
  select *, length(role) + 6 + length(t) + 8
    + len(regexp_extract_all(t, '\\|</turn>|### (?:System|User|Assistant|role=)')) as formatted
  from turns
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || t || chr(10), '' order by turn)) as turns_sha256,
  cast(coalesce(sum(length(t)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(t, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(formatted) as bigint) as formatted_chars
from marked group by conv_id
"""

_OP6 = """
with p as (
  select page_id, strlen(coalesce(html, '')) as n, sha256(coalesce(html, '')) as d from pages
), f as (
  select d, min(page_id) as first from p where n >= 100 group by d
)
select p.page_id, cast(p.n as bigint) as payload_bytes, p.d as payload_digest,
  case when f.first < p.page_id then 'revisit' else 'response' end as record_type,
  case when f.first < p.page_id then f.first end as refers_to
from p left join f on p.d = f.d and p.n >= 100
"""

_OP10 = r"""
with item as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where text is not null
), win as (
  select distinct item_id, least(len(w), 10) as n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as s
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from item where len(w) > 0)
), doc as (
  select row_number() over () as k, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w
  from documents
), place as (
  select k, n, i, array_to_string(w[i:i + n - 1], ' ') as s
  from (select k, w, n, unnest(range(1, len(w) - n + 2)) as i from doc, (select distinct n from win))
), met as (
  select place.k, place.i, place.n, win.item_id from place join win on place.s = win.s and place.n = win.n
), hit as (
  select k, count(distinct j) as n_hit from (select k, unnest(range(i, i + n)) as j from met) group by k
), its as (
  select k, count(item) as n_items, string_agg(item, ',' order by item) as items from (select distinct k, cast(item_id as varchar) as item from met) group by k
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc left join hit using (k) left join its using (k)
"""

_OP11 = r"""
with doc as (
  select row_number() over () as k, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents where text is not null
), item as (
  select row_number() over () as q, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w
  from benchmark where text is not null
), whole as (
  select count(*) as n_docs, cast(sum(len(w)) as bigint) as n_words from doc where len(w) > 0
), size as (
  select k, doc_id, 100 - 25 + ((25 * cast(len(w) as bigint) * n_docs) // n_words) as m from doc, whole where len(w) > 0
), tf as (
  select k, t, count(*) as tf from (select k, unnest(w) as t from doc) group by k, t
), weight as (
  select t, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) as bigint) as weight
  from (select t, count(*) as df from tf group by t), whole
), mention as (
  select q, t, count(*) as mentions from (select q, unnest(w) as t from item) group by q, t
), scored as (
  select q, k, cast(sum(mentions * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) as bigint) as score
  from mention join weight using (t) join tf using (t) join size using (k) group by q, k
), ranked as (
  select q, doc_id, score, row_number() over (partition by q order by score desc, doc_id) as rank
  from scored join size using (k) where score > 0
)
select item_id, cast(rank as int) as rank, doc_id, score from ranked join item using (q) where rank <= 20
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_sharding, op2_chat, op3_substring_dedup, op4_bpe, op5_simhash,
        op6_warc, op7_secret_scan, op8_line_dedup, op9_quality_rules, op10_decontaminate,
        op11_search, op12_token_files, op13_whitening,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat": _OP2, "op6_warc": _OP6, "op10_decontaminate": _OP10, "op11_search": _OP11}

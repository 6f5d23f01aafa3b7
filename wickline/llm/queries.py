"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wickline.llm import bpe, decontam, lines, pii, quality, sharding, simhash, toxicity, urls, warc
from wickline.llm.common import cut, fresh_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def default_vocabulary() -> str:
    """Where the installed package of public vocabularies keeps the byte-level BPE file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@_query
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


@_query
def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = default_vocabulary()
    coded = bpe.code(table(spark, sf_dir, "documents", "doc_id", "text"), path, drop_text=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@_query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality.ledger(table(spark, sf_dir, "documents", "doc_id", "text")).drop("text")
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality.passes(F.col("failed"), quality.POLICIES["v1"])).alias("base_failed"),
        quality.passes(F.col("failed"), quality.POLICIES[quality.CURRENT]).alias("kept"),
        F.col("failed").alias("failed_bits"),
    )


OP4_SHARDS = 40


@_query
def op4_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.records(table(spark, sf_dir, "documents", "doc_id", "text"))
    stats = cut(sharding.slot_stats(rows), 1)  # a row per slot
    store = fresh_path(spark, "slot-map")
    sharding.save_map(sharding.first_map(spark, OP4_SHARDS), store)
    sharding.save_map(sharding.rebalance(sharding.load_map(spark, store, 0), stats, OP4_SHARDS), store)
    placed = sharding.place(rows, sharding.load_map(spark, store), stats)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )


@_query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return decontam.matches(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


@_query
def op10_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages", "page_id", "url", "html"), path)
    return warc.read_archives(spark, path).select(
        F.col("page").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"), "status",
    )


@_query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(toxicity.fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@_query
def op9_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents", "doc_id", "text")).drop("text")
    count = lambda kind: F.size(F.filter("pii", lambda s: s.base & (s.kind == kind))).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in pii.KINDS[:4]],
        F.sha2(pii.span_string(F.filter("pii", lambda s: s.base)), 256).alias("base_sha256"),
        pii.span_string(F.col("pii")).alias("spans"),
        F.size("pii").cast("long").alias("n_spans"),
    )


@_query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.classify(table(spark, sf_dir, "pages", "page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "value")


@_query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.repeats(table(spark, sf_dir, "documents", "doc_id", "text"))


_WORDS = "list_filter(string_split_regex({text}, '{sep}'), lambda w: w <> '')"

ORACLE_SQL["op7_decontamination"] = f"""
with d as (select doc_id, {_WORDS.format(text="lower(coalesce(text, ''))", sep="[^\\p{L}\\p{M}\\p{N}]+")} as w from documents),
b as (select item_id, {_WORDS.format(text="lower(coalesce(text, ''))", sep="[^\\p{L}\\p{M}\\p{N}]+")} as w from benchmark),
ds as (select distinct doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) as s from d where len(w) >= 5),
bs as (select distinct item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) as s from b where len(w) >= 5),
n as (select item_id, count(*) as n_shingles from bs group by item_id),
m as (select doc_id, item_id, count(*) as shared from ds join bs using (s) group by doc_id, item_id)
select doc_id, item_id, shared, n_shingles, shared / n_shingles as containment from m join n using (item_id) where shared >= ceil({decontam.THRESHOLD} * n_shingles - 1e-9)
"""

_BITS = " + ".join(f"case when {rule} then {1 << bit} else 0 end" for bit, rule in enumerate(quality.RULES.values()))

ORACLE_SQL["op8_quality_rules"] = f"""
with d as (select doc_id, coalesce(text, '') as t, {_WORDS.format(text="coalesce(text, '')", sep="[ \\t-\\r]+")} as w from documents),
g as (select doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as g, unnest(range(1, len(w) - 1)) as i from d),
r as (select doc_id, i from g qualify count(*) over (partition by doc_id, g) > 1),
c as (select doc_id, count(distinct i + k) as n from r, range(0, 3) x(k) group by doc_id),
l as (select doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) as ls from d),
m as (select doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
  len(ls) as n_lines, len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(n, 0) as n_repeat_words, (length(t) - length(replace(t, '!!', ''))) // 2 as n_shouts
  from d join l using (doc_id) left join c using (doc_id)),
f as (select *, ({_BITS})::bigint as failed_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & {quality.POLICIES["v1"]} <> 0 as base_failed, failed_bits & {quality.POLICIES[quality.CURRENT]} = 0 as kept, failed_bits from f
"""

_B32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> {s}) & 31) + 1, 1)" for s in (15, 10, 5, 0))

ORACLE_SQL["op10_warc_segments"] = f"""
with p as (select page_id, coalesce(html, '') as h, min(page_id) over (partition by coalesce(html, '')) as first from pages),
x as (select page_id, first, octet_length(encode(h)) as payload_bytes, list_transform(range(0, 8), lambda i: ('0x' || substr(sha1(h), 1 + 5 * i, 5))::bigint) as parts from p)
select page_id, payload_bytes, array_to_string(list_transform(parts, lambda n: {_B32}), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to, 'ok' as status from x
"""

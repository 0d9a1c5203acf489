"""The queries of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat, credentials, langid, mixing, pieces, quality, simhash, suffixdedup, syncmers, warc
from tidemark.llm.common import table


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16("fp").alias("fingerprint"), "component_id")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(quality.measure(table(spark, sf_dir, "documents"))).drop("longest_repeat")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents"))


def op4_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = syncmers.fingerprints(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        syncmers.as_text(F.col("sketch")).alias("fingerprint"),
        syncmers.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        syncmers.likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        syncmers.likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixdedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repaired(table(spark, sf_dir, "conversations"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), remembered=96 << 20, over_tasks=True)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = credentials.scan(table(spark, sf_dir, "documents"))
    count = {f"n_{k}": F.size(credentials.of_kinds(F.col("spans"), k)).cast("long") for k in credentials.KINDS[:3]}
    base = credentials.as_text(credentials.of_kinds(F.col("spans"), *credentials.KINDS[:3]))
    return found.select("doc_id", *[c.alias(n) for n, c in count.items()], F.sha2(base.cast("binary"), 256).alias("base_sha256"), credentials.as_text(F.col("spans")).alias("spans"), F.size("links").cast("long").alias("n_links"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = warc.read_chunks(warc.write_archives(table(spark, sf_dir, "pages")), data=False)
    return chunks.filter("last").select(
        warc.page_id_of("record_id").alias("page_id"),
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        "record_type",
        warc.page_id_of("refers_to").alias("refers_to"),
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, docs.filter(~langid.held_out()))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_simhash_dedup, op2_quality_rules, op3_mixing, op4_syncmers, op5_suffix_dedup, op6_chat_format, op7_sentencepiece, op8_secrets, op9_warc, op10_language_id,
)}

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

ORACLES: dict[str, str] = {
    "op2_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
p AS (SELECT doc_id, ws, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
g AS (SELECT doc_id, i, CASE WHEN i + 2 <= n THEN array_to_string(ws[i:i+2], ' ') END AS g3, CASE WHEN i + 9 <= n THEN array_to_string(ws[i:i+9], ' ') END AS g10, CASE WHEN i + 100 <= n THEN md5(array_to_string(ws[i:i+100], ' ')) END AS g101 FROM p),
r AS (SELECT doc_id, i, (g3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g3) > 1)::INT AS r3, (g10 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g10) > 1)::INT AS r10, (g101 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g101) > 1)::INT AS r101 FROM g),
c AS (SELECT doc_id, max(r3) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c3, max(r10) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS c10, r101 FROM r),
s AS (SELECT doc_id, CAST(sum(c3) AS BIGINT) AS c3, CAST(sum(c10) AS BIGINT) AS c10, max(r101) AS long FROM c GROUP BY 1),
f AS (SELECT doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines FROM d),
j AS (SELECT f.*, coalesce(c3, 0) AS n_repeat_words, coalesce(c10, 0) AS covered_words, coalesce(long, 0) AS long FROM f LEFT JOIN s ON f.doc_id = s.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND covered_words <= CAST(0.2 AS DOUBLE) * n_words AND long = 0 AS kept FROM j""",
    "op3_mixing": rf"""
WITH d AS (SELECT doc_id, coalesce('=' || source, '') AS s, len({_WORDS}) AS size, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '-')) AS key FROM documents),
t AS (SELECT s, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
w AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY (s = '')::INT, s) - 1) % 3 + 1] AS DOUBLE) AS weight, source_size * CAST(3 AS DOUBLE) AS cap FROM t),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER f, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS level FROM w WINDOW f AS (ORDER BY cap / weight, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT s, source_size, least(cap, weight * max(level) OVER ()) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM g),
b AS (SELECT d.*, source_size, target, epochs, CAST(floor(target) AS BIGINT) - epochs * source_size AS rest, CAST(sum(size) OVER (PARTITION BY d.s ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS before FROM d JOIN e ON d.s = e.s)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM b""",
    "op5_suffix_dedup": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, unnest(range(0, greatest(length(h) // 2 - 399, 0))) AS i, h FROM d),
k AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 800)) AS k FROM p),
c AS (SELECT doc_id, i FROM k QUALIFY count(*) OVER (PARTITION BY k) > 1),
m AS (SELECT doc_id, i, coalesce((i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400)::INT, 1) AS new FROM c),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 400 AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM m) GROUP BY 1, 2),
o AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_ FROM r),
x AS (SELECT o.doc_id, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed, string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM o JOIN d ON o.doc_id = d.doc_id GROUP BY 1)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN x ON d.doc_id = x.doc_id""",
    "op9_warc": r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS kept FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND kept <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 1000 AND kept <> page_id THEN kept END AS refers_to FROM k""",
}

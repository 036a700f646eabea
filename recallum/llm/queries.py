"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from recallum.llm import alignment, bpe, ctph, divergence, mixing, mpeg, packing, pii, quality, simhash, toxicity, urls, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_groups(table(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonyms(docs, pii.key_of(spark)).select("doc_id", "text", F.array_join("pii_kinds", ",").alias("kinds"), F.size("pii_kinds").alias("n_changed"))


def op3_ctph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.edited_pairs(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_mpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mpeg.decode(mpeg.encode(table(spark, sf_dir, "documents")))
    offsets = F.substring(F.sha2(F.array_join("seek_offsets", ","), 256), 1, 16)
    feature = F.concat_ws(":", "tags", "vbr_kind", "vbr_frames", "frames", "samples", "sample_rate", "kbit", "crc_good", "crc_bad", "skipped", offsets)
    return got.select(
        F.col("id").alias("doc_id"), "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"), "duration_s",
    )


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.decode(bpe.encode(table(spark, sf_dir, "documents")))).withColumnRenamed("id", "doc_id")


def predicted(scored: DataFrame, threshold: float = 0.7) -> DataFrame:
    return scored.select(F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicted(quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicted(toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


#: Rules of op7: (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("row.page_id", "host", "path", "rule", "verdict")


OP7_SQL = """
WITH split AS (
  SELECT page_id,
         CASE WHEN position('://' IN coalesce(url, '')) = 0 THEN '' ELSE translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS host,
         CASE WHEN position('://' IN coalesce(url, '')) = 0 THEN '' ELSE regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) END AS path
  FROM pages
), rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))
SELECT page_id, host, path,
       (SELECT arg_max(h || p, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule,
       coalesce((SELECT arg_max(v, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)), 'allow') AS verdict
FROM split
"""


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.read(warc.archive(table(spark, sf_dir, "pages")))
    return got.select(F.col("row").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


OP8_SQL = """
WITH rows AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, unhex(sha1(coalesce(html, '')))::BIT::VARCHAR AS bits, sha1(coalesce(html, '')) AS sha FROM pages)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + 16 * substr(bits, (5 * i + 1)::INT, 1)::INT + 8 * substr(bits, (5 * i + 2)::INT, 1)::INT + 4 * substr(bits, (5 * i + 3)::INT, 1)::INT + 2 * substr(bits, (5 * i + 4)::INT, 1)::INT + substr(bits, (5 * i + 5)::INT, 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = min(page_id) OVER (PARTITION BY sha) THEN 'response' ELSE 'revisit' END AS record_type,
       nullif(min(page_id) OVER (PARTITION BY sha), page_id) AS refers_to
FROM rows
"""


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = packing.pack(table(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.copies(table(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies", "part")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH docs AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), vocabulary AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM docs) GROUP BY lang, term HAVING count(*) >= 3
), used AS (
  SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM docs) JOIN vocabulary USING (lang, term) GROUP BY lang, source, term
), kept AS (
  SELECT lang, count(*) AS v FROM vocabulary GROUP BY lang
), groups AS (
  SELECT g.lang, g.source, coalesce(sum(n), 0) + coalesce(any_value(v), 0) AS size FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN used USING (lang, source) LEFT JOIN kept USING (lang) GROUP BY g.lang, g.source
), langs AS (
  SELECT lang, sum(n) + any_value(v) AS size FROM used JOIN kept USING (lang) GROUP BY lang
), p AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // size AS p FROM groups JOIN vocabulary USING (lang) LEFT JOIN used USING (lang, source, term)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // any_value(size) AS q FROM used JOIN langs USING (lang) GROUP BY lang, term
), rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM rows) WHERE part = 'pair' OR rank <= 200
"""


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = alignment.aligned(table(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_pii": op2_pii,
    "op3_ctph": op3_ctph,
    "op4_mpeg": op4_mpeg,
    "op5_bpe": op5_bpe,
    "op6_quality": op6_quality,
    "op7_urls": op7_urls,
    "op8_warc": op8_warc,
    "op9_toxicity": op9_toxicity,
    "op10_packing": op10_packing,
    "op11_mixing": op11_mixing,
    "op12_divergence": op12_divergence,
    "op13_alignment": op13_alignment,
}

ORACLE_SQL: dict[str, str] = {
    "op7_urls": OP7_SQL,
    "op8_warc": OP8_SQL,
    "op12_divergence": OP12_SQL,
}

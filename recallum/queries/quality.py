"""Statistics, clearance, tuning, calibration, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from recallum.operators import filters, lexical as L, rank as R
from recallum.plans import metrics as M
from recallum.queries import query
from recallum.queries.search import _TOPS, _VIEWS, channels
from recallum.sources import tables as S
from recallum.sources.tables import REF_DATE, REF_NOW, sql

_STATS = "count(*) AS n, round(avg(latency_ms), 4) AS avg_ms, round(quantile_cont(latency_ms, 0.5), 4) AS p50, round(quantile_cont(latency_ms, 0.95), 4) AS p95, round(avg(coalesce(results_count, 0)), 4) AS avg_results, round(avg(top_score), 4) AS avg_top"


@query(sql(f"SELECT CAST(created_at AS DATE) AS day, {_STATS} FROM query_log GROUP BY day", "query_log"))
def query_stats(spark: SparkSession, d: str) -> DataFrame:
    return M.stats(S.query_log(spark, d).withColumn("day", F.col("created_at").cast("date")), "day")


@query(sql(f"SELECT method, {_STATS} FROM query_log GROUP BY method", "query_log"))
def stats_by_method(spark: SparkSession, d: str) -> DataFrame:
    return M.stats(S.query_log(spark, d), "method")


@query(sql(f"SELECT memory_id, count(*) AS n, max(accessed_at) AS last FROM access_log WHERE accessed_at >= TIMESTAMP '{REF_NOW}' - INTERVAL 7 DAY GROUP BY memory_id", "access_log"))
def access_counts_7d(spark: SparkSession, d: str) -> DataFrame:
    since = F.lit(REF_NOW).cast("timestamp_ntz") - F.expr("INTERVAL 7 DAYS")
    return S.access_log(spark, d).where(F.col("accessed_at") >= since).groupBy("memory_id").agg(F.count("*").alias("n"), F.max("accessed_at").alias("last"))


@query(sql("SELECT source, count(*) AS n, count(DISTINCT memory_id) AS ids, count(DISTINCT user_id) AS users FROM access_log GROUP BY source", "access_log"))
def access_stats(spark: SparkSession, d: str) -> DataFrame:
    return S.access_log(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("memory_id").alias("ids"), F.count_distinct("user_id").alias("users"))


@query(sql("SELECT tag, n, rank FROM (SELECT tag, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, tag) AS rank FROM (SELECT lower(trim(unnest(list_concat(tags, categories)))) AS tag FROM memory) WHERE length(tag) > 2 AND NOT starts_with(tag, 'possible_injection') GROUP BY tag) WHERE rank <= 10", "memory"))
def tag_top10(spark: SparkSession, d: str) -> DataFrame:
    tags = S.memory(spark, d).select(F.explode(F.concat("tags", "categories")).alias("t")).select(F.lower(F.trim("t")).alias("tag")).where("length(tag) > 2 AND NOT startswith(tag, 'possible_injection')")
    best = tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(10)
    return filters.top(best.withColumn("all", F.lit(1)), 10, "all", F.desc("n"), F.col("tag")).drop("all")


@query(sql("SELECT level, count(embedding) AS hot, count(*) - count(embedding) AS warm, count(*) FILTER (critical) AS critical FROM memory GROUP BY level", "memory"))
def tier_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.memory(spark, d).groupBy("level").agg(F.count("embedding").alias("hot"), F.count_if(F.col("embedding").isNull()).alias("warm"), F.count_if("critical").alias("critical"))


_COLD = f"SELECT id, date FROM memory WHERE level = 'episodic' AND date < DATE '{REF_DATE}' - 90 AND 'v' || id NOT IN (SELECT memory_id FROM access_log WHERE accessed_at >= DATE '{REF_DATE}' - 90)"


@query(sql("SELECT id, date FROM cold", "memory", "access_log", cold=_COLD))
def cold_episodic(spark: SparkSession, d: str) -> DataFrame:
    return M.cold(S.memory(spark, d), S.access_log(spark, d), F.lit(REF_DATE).cast("date")).select("id", "date")


@query(
    sql(
        """SELECT lang, n, redundant, cold, round(100.0 * redundant / n, 4) AS dup_pct, round(100.0 * cold / n, 4) AS cold_pct, 100.0 * redundant / n > 2 OR 100.0 * cold / n > 20 AS needed FROM (
        SELECT lang, count(*) AS n, count(*) - count(DISTINCT md5(lower(trim(content)))) AS redundant, count(c.id) AS cold FROM memory LEFT JOIN (SELECT id FROM cold) c USING (id) GROUP BY lang)""",
        "memory", "access_log", cold=_COLD,
    )
)
def clearance_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = S.memory(spark, d)
    c = M.cold(m, S.access_log(spark, d), F.lit(REF_DATE).cast("date")).select("id", F.lit(1).alias("c"))
    g = m.join(c, "id", "left").groupBy("lang").agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct(F.md5(F.lower(F.trim("content"))))).alias("redundant"), F.count("c").alias("cold"))
    dup, cold = 100.0 * F.col("redundant") / F.col("n"), 100.0 * F.col("cold") / F.col("n")
    return g.select("lang", "n", "redundant", "cold", F.round(dup, 4).alias("dup_pct"), F.round(cold, 4).alias("cold_pct"), ((dup > 2) | (cold > 20)).alias("needed"))


@query(sql(f"SELECT method, n, p95, avg_top, CASE WHEN p95 > 80 THEN 0.75 WHEN p95 < 20 THEN 0.65 ELSE 0.7 END AS confidence, CASE WHEN n <= 10 THEN 0.6 WHEN avg_top < 15 THEN 0.6 WHEN avg_top > 30 THEN 0.55 ELSE 0.6 END AS alpha FROM (SELECT method, {_STATS} FROM query_log GROUP BY method) WHERE n >= 5", "query_log"))
def tune_rules(spark: SparkSession, d: str) -> DataFrame:
    return M.tuned(M.stats(S.query_log(spark, d), "method")).select("method", "n", "p95", "avg_top", "confidence", "alpha")


_REL = "SELECT qid, id, 1 AS gain FROM query JOIN memory ON contains(content, text)"
_GRADED = """SELECT {by} qid, round(found / total, 6) AS recall, round(found / least(10, n), 6) AS precision, round(coalesce(1.0 / first, 0), 6) AS rr, CASE WHEN first = 1 THEN 1 WHEN first IS NULL THEN NULL ELSE 0 END AS top1, round(dcg / list_sum(list_transform(range(1, CAST(least(total, 10) AS INT) + 1), lambda r: 1.0 / log2(r + 1))), 6) AS ndcg FROM (
  SELECT {by} qid, sum(coalesce(gain, 0)) AS found, count(*) AS n, min(rank) FILTER (gain > 0) AS first, sum(coalesce(gain, 0) / log2(rank + 1)) AS dcg FROM {hits} LEFT JOIN rel USING (qid, id) WHERE rank <= 10 GROUP BY {by} qid) JOIN (SELECT qid, sum(gain) AS total FROM rel GROUP BY qid) USING (qid)"""


def _relevant(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a query's text literally."""
    q = S.query_table(spark, d).select("qid", F.array("text").alias("terms"))
    return L.scan(q, S.memory(spark, d).select("id", F.col("content").alias("text")), ["id"]).select("qid", "id", F.lit(1).alias("gain"))


@query(sql(_GRADED.format(by="", hits="tops"), "memory", "query", **_VIEWS, tops=_TOPS, rel=_REL))
def retrieval_eval(spark: SparkSession, d: str) -> DataFrame:
    tops = filters.top(R.fuse(channels(spark, d)).select("qid", "id", "score"), 15, "qid", F.desc("score"), F.col("id"))
    return M.graded(tops, _relevant(spark, d), [])


_GRID = "SELECT a AS alpha, qid, id, row_number() OVER (PARTITION BY a, qid ORDER BY round(greatest(a * coalesce(vec, 0) + (1 - a) * coalesce(lex, 0), coalesce(struct, 0)), 3) DESC, id) AS rank FROM fused, (SELECT CAST(k AS DOUBLE) / 10 AS a FROM range(11) t(k))"


@query(sql(f"SELECT *, alpha = arg_min(alpha, (-f1, alpha)) OVER () AS best_f1, alpha = arg_min(alpha, (-ndcg, alpha)) OVER () AS best_ndcg, alpha = arg_min(alpha, (-precision, alpha)) OVER () AS best_precision FROM (SELECT alpha, count(*) AS n, round(avg(recall), 5) AS recall, round(avg(precision), 5) AS precision, round(avg(ndcg), 5) AS ndcg, round(avg(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0)), 5) AS f1 FROM ({_GRADED.format(by='alpha,', hits='grid')}) GROUP BY alpha)", "memory", "query", **_VIEWS, grid=_GRID, rel=_REL))
def alpha_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Mean metrics for each of eleven alphas, and which is the best by each (the smallest of equals): the fused hits are made once and weighed anew."""
    f = R.fuse(channels(spark, d)).withColumn("alpha", F.explode(F.array(*[F.lit(k / 10) for k in range(11)])))
    a = F.col("alpha")
    s = F.round(F.greatest(a * F.coalesce("vec", F.lit(0.0)) + (1 - a) * F.coalesce("lex", F.lit(0.0)), F.coalesce("struct", F.lit(0.0))), 3)
    keyed = f.select("alpha", "qid", "id", s.alias("score"), F.struct("alpha", "qid").alias("k"))
    top = filters.top(keyed, 10, "k", F.desc("score"), F.col("id")).drop("k")
    g = M.graded(top, _relevant(spark, d), ["alpha"])
    return M.calibrated(g)

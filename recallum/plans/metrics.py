"""Statistics, clearance metrics, tuning, calibration and retrieval evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def stats(log: DataFrame, by: str | None = None) -> DataFrame:
    """Count, mean and exact percentiles of latency, mean results and top score; nulls count as 0."""
    g = log.groupBy(by) if by else log.groupBy()
    return g.agg(F.count("*").alias("n"), F.round(F.avg("latency_ms"), 4).alias("avg_ms"), F.round(F.percentile("latency_ms", F.lit(0.5)), 4).alias("p50"), F.round(F.percentile("latency_ms", F.lit(0.95)), 4).alias("p95"), F.round(F.avg(F.coalesce("results_count", F.lit(0))), 4).alias("avg_results"), F.round(F.avg("top_score"), 4).alias("avg_top"))


def tuned(stats: DataFrame, alpha: float = 0.6, confidence: float = 0.7) -> DataFrame:
    """New thresholds from statistics: slow queries raise the confidence, fast ones lower it; low and high scores move alpha."""
    conf = F.when((F.col("p95") > 80) & (F.lit(confidence) < 0.75), confidence + 0.05).when((F.col("p95") < 20) & (F.lit(confidence) > 0.5), confidence - 0.05).otherwise(confidence)
    al = F.when(F.col("n") <= 10, alpha).when(F.col("avg_top") < 15, F.least(F.lit(0.6), F.lit(alpha + 0.05))).when(F.col("avg_top") > 30, F.greatest(F.lit(0.4), F.lit(alpha - 0.05))).otherwise(alpha)
    return stats.where("n >= 5").select("*", F.round(conf, 2).alias("confidence"), F.round(al, 2).alias("alpha"))


def cold(memory: DataFrame, access_log: DataFrame, ref: Column, days: int = 90) -> DataFrame:
    """Episodic rows older than `days` without an access in that time: an anti-join on recent accesses."""
    since = F.date_sub(ref, days)
    used = access_log.where(F.col("accessed_at") >= since).select("memory_id").distinct()
    old = memory.where((F.col("level") == "episodic") & (F.col("date") < since)).withColumn("memory_id", F.concat(F.lit("v"), "id"))
    return old.join(used, "memory_id", "left_anti")


def graded(hits: DataFrame, relevant: DataFrame, by: list[str], k: int = 10) -> DataFrame:
    """(…, qid, id, rank) and (qid, id, gain) → recall, precision, reciprocal rank, top-1 and nDCG at k for each query."""
    j = hits.where(F.col("rank") <= k).join(relevant, ["qid", "id"], "left").fillna(0, ["gain"])
    total = relevant.groupBy("qid").agg(F.sum("gain").alias("total"))
    g = j.groupBy(*by, "qid").agg(F.sum("gain").alias("found"), F.count("*").alias("n"), F.min(F.when(F.col("gain") > 0, F.col("rank"))).alias("first"), F.sum(F.col("gain") / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    g = g.join(total, "qid").where("total > 0")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("total"), F.lit(k)).cast("int")), F.lit(0.0), lambda acc, r: acc + 1.0 / F.log2(r + 1.0))
    return g.select(*by, "qid", F.round(F.col("found") / F.col("total"), 6).alias("recall"), F.round(F.col("found") / F.least(F.lit(k), F.col("n")), 6).alias("precision"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("rr"), (F.col("first") == 1).cast("int").alias("top1"), F.round(F.col("dcg") / ideal, 6).alias("ndcg"))


def calibrated(graded: DataFrame) -> DataFrame:
    """`graded` rows by alpha → mean metrics of each alpha, F1 of each query included, and whether it is the best by F1, nDCG and precision, the smallest of equals."""
    p, r = F.col("precision"), F.col("recall")
    f1 = F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))
    rows = graded.withColumn("f1", f1).groupBy("alpha").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 5).alias(c) for c in ("recall", "precision", "ndcg", "f1")])
    best = rows.agg(*[F.min_by("alpha", F.struct(-F.col(c), "alpha")).alias(f"b_{c}") for c in ("f1", "ndcg", "precision")])
    return rows.join(F.broadcast(best)).select("alpha", "n", "recall", "precision", "ndcg", "f1", *[(F.col("alpha") == F.col(f"b_{c}")).alias(f"best_{c}") for c in ("f1", "ndcg", "precision")])  # one row

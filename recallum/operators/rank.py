"""Fusion, decay, boosts, re-ranking and diversity of hits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


#: What the channels of the plain search count as.
CHANNELS = {"vector": "vec", "lexical": "lex", "fulltext": "lex", "chunk": "lex", "structured": "struct"}


def fuse(hits: DataFrame, alpha: float = 0.6, kinds: dict[str, str] = CHANNELS) -> DataFrame:
    """(qid, id, channel, score) → one row for each (qid, id): alpha times the best vector score plus the rest times the best lexical one, at least the structured one.

    `kinds` says which channels are of vectors (vec), words (lex) and structure (struct).
    """
    best = lambda kind: F.max(F.when(F.col("channel").isin(*[c for c, k in kinds.items() if k == kind]), F.col("score"))).alias(kind)
    g = hits.groupBy("qid", "id").agg(best("vec"), best("lex"), best("struct"), F.array_sort(F.collect_set("channel")).alias("channels"))
    mixed = alpha * F.coalesce("vec", F.lit(0.0)) + (1 - alpha) * F.coalesce("lex", F.lit(0.0))
    return g.withColumn("score", F.round(F.greatest(mixed, F.coalesce("struct", F.lit(0.0))), 4))


def decay_factor(day: Column, ref: Column, lam: float = 0.05) -> Column:
    """1 up to a week, then exponential, not below 0.2; 1 without a date."""
    days = F.datediff(ref, day)
    return F.when(day.isNull() | (days <= 7), 1.0).otherwise(F.greatest(F.lit(0.2), F.exp(-lam * days)))


def fatigue(n7d: Column, age_hours: Column) -> Column:
    """At most 15 points for recent use, fading over a week; below 0.1 none."""
    b = F.least(F.lit(15.0), 5.0 * F.log1p(n7d)) * F.exp(-age_hours / 168.0)
    return F.when(b > 0.1, b).otherwise(0.0)


def gate(hits: DataFrame) -> DataFrame:
    """(qid, rank, score, bonus, structured?) → (qid, rerank): whether a query's order is unsure enough to be judged again; not if a structured hit leads."""
    w = Window.partitionBy("qid")
    g = hits.withColumn("n", F.count("*").over(w)).withColumn("next", F.lead("score").over(w.orderBy("rank"))).where("rank = 1")
    gap = F.col("score") - F.coalesce("next", F.lit(0.0))
    s = F.col("score")
    sure = (F.col("n") < 3) | (s >= 90) | (F.col("structured") if "structured" in hits.columns else F.lit(False)) | ((F.col("bonus") >= 25) & (s >= 45)) | ((s >= 85) & (gap >= 8)) | ((s >= 70) & (gap >= 15))
    return g.select("qid", "n", "score", F.round(gap, 4).alias("gap"), F.when(sure, False).when((s < 65) | (gap < 6), True).otherwise(s < 80).alias("rerank"))


def rerank(hits: DataFrame, verdicts: DataFrame, top_n: int = 8) -> DataFrame:
    """The first `top_n` hits of each query times 0.5 + 0.5 p of their verdict; those without one, and the rest, stay."""
    j = hits.join(verdicts, ["qid", "id"], "left")
    mixed = F.when((F.col("rank") <= top_n) & F.col("p").isNotNull(), F.round(F.col("score") * (0.5 + 0.5 * F.col("p")), 5)).otherwise(F.col("score"))
    j = j.withColumn("mixed", mixed).withColumn("late", (F.col("rank") > top_n).cast("int"))
    return j.withColumn("new_rank", F.row_number().over(Window.partitionBy("qid").orderBy("late", F.desc("mixed"), "id"))).drop("late")


def mmr(hits: DataFrame, lam: float = 0.7, n: int = 30) -> DataFrame:
    """(qid, id, score, embedding) → with `pick`: the first n hits of each query in order of marginal relevance; those without a vector come after."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True]).head(n).reset_index(drop=True)
        has = [k for k, v in enumerate(pdf["embedding"]) if v is not None]
        x = np.stack([np.asarray(pdf["embedding"][k], float) for k in has]) if has else np.zeros((0, 1))
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
        score = pdf["score"].to_numpy()[has] / 100.0
        order: list[int] = []
        near = np.zeros(len(has))
        left = list(range(len(has)))
        while left:
            k = left[0] if not order else max(left, key=lambda i: (lam * score[i] - (1 - lam) * near[i], -i))
            order.append(k)
            left.remove(k)
            near = np.maximum(near, x @ x[k])
        picked = [has[k] for k in order] + [k for k in range(len(pdf)) if k not in set(has)]
        out = pdf.loc[picked, ["qid", "id", "score"]].reset_index(drop=True)
        out["pick"] = range(1, len(out) + 1)
        return out

    kept = hits.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))).where(F.col("r") <= n).drop("r")
    return kept.groupBy("qid").applyInPandas(one, "qid bigint, id bigint, score double, pick int")


def label(score: Column) -> Column:
    return F.when(score >= 75, "high").when(score >= 45, "medium").otherwise("low")


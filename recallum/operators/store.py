"""Appends, gates and log maintenance around the memory table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def with_categories(items: DataFrame, bridge: DataFrame, categories: DataFrame) -> DataFrame:
    """Items with the names of their categories; items without one stay, with null."""
    return items.join(bridge, "item_id", "left").join(categories, "category_id", "left")


def accesses(hits: DataFrame, queries: DataFrame, first: int = 10) -> DataFrame:
    """One access row for each distinct row among a query's first hits, under the query's hash."""
    q = queries.select("qid", F.substring(F.sha2("clean", 256), 1, 12).alias("query_hash"))
    return hits.where(F.col("rank") <= first).join(q, "qid").select(F.concat(F.lit("v"), "id").alias("memory_id"), "query_hash").distinct()


def query_rows(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """A metrics row for each query: its text cut at 200 characters, number of hits, best and mean score; 0 without hits."""
    g = hits.groupBy("qid").agg(F.count("*").alias("n"), F.max("score").alias("top"), F.avg("score").alias("mean"))
    return queries.select("qid", F.substring("text", 1, 200).alias("query_text")).join(g, "qid", "left").select("qid", "query_text", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("top", F.lit(0.0)).alias("top"), F.round(F.coalesce("mean", F.lit(0.0)), 3).alias("mean"))


def gate(new: DataFrame, similar: DataFrame, least: float) -> DataFrame:
    """New rows with the most similar stored row, if one reaches `least`: those are blocked."""
    best = similar.where(F.col("similarity") >= least).groupBy("qid").agg(F.max(F.struct("similarity", (-F.col("id")).alias("back"))).alias("b"))
    return new.select("qid").join(best, "qid", "left").select("qid", F.col("b").isNotNull().alias("blocked"), (-F.col("b.back")).alias("twin"))


def kept(log: DataFrame, now: Column, days: int, ts: str = "accessed_at") -> DataFrame:
    """Log rows of the last `days`."""
    return log.where(F.col(ts) >= now - F.make_dt_interval(F.lit(days)))


def delete_links(links: DataFrame, gone: DataFrame) -> DataFrame:
    """Links less those that `gone` (src, dst, rel or null for any) names."""
    named = gone.where("rel IS NOT NULL").select("src", "dst", "rel")
    any_rel = gone.where("rel IS NULL").select("src", "dst")
    return links.join(named, ["src", "dst", "rel"], "left_anti").join(any_rel, ["src", "dst"], "left_anti")


def touch_links(links: DataFrame, touched: DataFrame, now: Column) -> DataFrame:
    """Links with `last_accessed` set to now where `touched` has their id."""
    t = touched.select("id").distinct().withColumn("hit", F.lit(True))
    return links.join(t, "id", "left").withColumn("last_accessed", F.when(F.col("hit"), now).otherwise(F.col("last_accessed"))).drop("hit")


def vetoed(groups: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(id, kept, action) and (id, same) → a group merges unless a verdict on one of its rows is false; rows without one pass."""
    bad = groups.join(verdicts.where(~F.col("same")), "id").select("kept").distinct().withColumn("veto", F.lit(True))
    return groups.join(bad, "kept", "left").withColumn("action", F.when(F.col("veto"), "keep").otherwise(F.col("action"))).drop("veto")


def within_budget(hits: DataFrame, size: str, budget: int, always: int = 3) -> DataFrame:
    """Hits of a query in order of rank until the running size passes the budget; the first `always` stay."""
    w = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return hits.withColumn("used", F.sum(size).over(w)).where((F.col("rank") <= always) | (F.col("used") <= budget))


def live(judgments: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """The newest judgment of each key, unless it has expired."""
    newest = judgments.groupBy("key").agg(F.max_by("verdict", "created_at").alias("verdict"), F.max("created_at").alias("created_at"), F.count("*").alias("hits"))
    return newest.where(F.datediff(now, F.col("created_at")) <= days)


def seeded(table: DataFrame, defaults: DataFrame, key: str) -> DataFrame:
    """The table and those defaults whose key it lacks."""
    return table.unionByName(defaults.join(table, key, "left_anti"))


def provenance(author: Column, level: Column, reads: Column) -> Column:
    return F.concat_ws("; ", F.concat(F.lit("by "), author), F.concat(F.lit("level "), level), F.when(reads > 0, F.concat(F.lit("read "), reads.cast("string"), F.lit(" times"))))


def path_query(path: Column, last: int = 3) -> Column:
    """The last distinct segments of a path that are longer than two characters, as a query."""
    parts = F.array_distinct(F.filter(F.split(path, "[/?#=&.]+"), lambda p: F.length(p) > 2))
    return F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - last + 1), F.lit(last)), " ")

"""Maintenance as reviewable change plans: (id, action, reason, …), applied only by `apply`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def consolidate(memory: DataFrame, ref: Column, days: int = 7) -> DataFrame:
    """Episodic rows older than `days` become semantic; rows without a date stay."""
    old = memory.where((F.coalesce("level", F.lit("episodic")) == "episodic") & (F.datediff(ref, F.col("date")) >= days))
    return old.select("id", F.lit("set_level").alias("action"), F.lit("semantic").alias("after"), F.datediff(ref, F.col("date")).alias("age"))


def review_rules(memory: DataFrame, ref: Column, days: int = 30) -> DataFrame:
    """Every automatic row is reviewed once more; those never reviewed and older than `days` are degraded."""
    rows = memory.where("level = 'automatic'")
    stale = (F.col("review_count") == 0) & (F.col("date").isNull() | (F.datediff(ref, F.col("date")) > days))
    return rows.select("id", (F.col("review_count") + 1).alias("review_count"), F.when(stale, "degrade").otherwise("keep").alias("action"))


def last_access(memory: DataFrame, access_log: DataFrame) -> DataFrame:
    """Rows with `last`: the newest access, else the row's own date."""
    newest = access_log.groupBy("memory_id").agg(F.max("accessed_at").alias("seen"))
    return memory.withColumn("memory_id", F.concat(F.lit("v"), "id")).join(newest, "memory_id", "left").withColumn("last", F.coalesce(F.col("seen").cast("date"), F.col("date")))


def linked(links: DataFrame) -> DataFrame:
    return links.select(F.col("src").alias("id")).union(links.select(F.col("dst").alias("id"))).distinct()


def _free() -> Column:
    """Not protected by level or flags; unknown ones protect nothing."""
    return ~F.coalesce("level", F.lit("episodic")).isin("semantic", "automatic") & ~F.coalesce("critical", F.lit(False)) & ~F.coalesce("trade", F.lit(False))


DECAY_DAYS = {"infrastructure": 180, "project_specific": 90, "temporary": 14}


def forget(memory: DataFrame, access_log: DataFrame, links: DataFrame, ref: Column, default: int = 60, least_age: int = 0) -> DataFrame:
    """Rows to archive: not protected by level, flags or links, and not used for their domain's number of days."""
    days = F.lit(default)
    for name, n in DECAY_DAYS.items():
        days = F.when(F.col("domain_profile") == name, n).otherwise(days)
    free = memory.where(_free()).join(linked(links), "id", "left_anti")
    idle = F.datediff(ref, F.col("last"))
    return last_access(free, access_log).where(F.col("last").isNull() | ((idle > days) & (idle >= least_age))).select("id", F.lit("archive").alias("action"), idle.alias("idle"))


def budget(memory: DataFrame, access_log: DataFrame, links: DataFrame, ref: Column, cap: int, slack: int = 50) -> DataFrame:
    """Rows to demote while more than `cap` hold a vector: the stalest unprotected ones first, to COLD after 90 idle days, else to WARM."""
    over = memory.agg(F.count("embedding")).first()[0] - cap
    if over <= 0:
        return memory.limit(0).select("id", F.lit("").alias("action"), F.lit(0).alias("idle"))
    free = memory.where(F.col("embedding").isNotNull() & _free()).join(linked(links), "id", "left_anti")
    idle = F.datediff(ref, F.col("last"))
    rows = last_access(free, access_log).select("id", F.when(F.col("last").isNull() | (idle > 90), "cold").otherwise("warm").alias("action"), idle.alias("idle"), "last")
    return rows.orderBy(F.asc_nulls_first("last"), "id").limit(over + slack).drop("last")


def budget_state(memory: DataFrame, cap: int, warn: float = 0.9) -> DataFrame:
    """(vectors, cap, share, state): ok, warning from the share `warn` of the cap on, over above it."""
    n = memory.agg(F.count("embedding").alias("vectors"))
    share = F.col("vectors") / F.lit(cap)
    return n.select("vectors", F.lit(cap).cast("bigint").alias("cap"), F.round(share, 4).alias("share"), F.when(share > 1, "over").when(share >= warn, "warning").otherwise("ok").alias("state"))


def backfill_summaries(memory: DataFrame, most: int = 600) -> DataFrame:
    """(id, content, summary) → (id, summary) of rows whose text is longer than a summary and that have none."""
    from recallum.functions.text import summarise

    return memory.where((F.length("content") > most) & F.col("summary").isNull()).select("id", summarise(F.col("content"), most).alias("summary"))


def newest_rows(rows: DataFrame, most: int = 500) -> DataFrame:
    """The newest `most` rows by date, then by id; a sample to look for duplicates in where all rows are too many."""
    return rows.orderBy(F.desc_nulls_last("date"), F.desc("id")).limit(most)


def checkpoint(memory: DataFrame, ref: Column, chars: int = 150, listed: int = 20) -> DataFrame:
    """One row for each (age scale, project): how many rows, their tags, the heads of the first `listed` in order of ids, joined, and a digest of all heads.

    Heads are cut before the shuffle, partial lists keep the smallest ids alone,
    and the digest is a sum over rows, so no group has to fit one task.
    """
    age = F.datediff(ref, F.col("date"))
    scale = F.when(F.col("date").isNull(), "undated").when(age <= 1, "24h").when(age <= 7, "7d").when(age <= 30, "30d").when(age <= 90, "90d").otherwise("all")
    rows = memory.where("level <> 'automatic'").select("id", scale.alias("scale"), F.col("source").alias("project"), F.substring("content", 1, chars).alias("head"), "tags")
    by = ["scale", "project"]
    tags = rows.select(*by, F.explode("tags").alias("tag")).groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", "id", "head")), 1, 12), 16, 10).cast("decimal(20,0)")
    heads = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.sum(F.length("head")).alias("chars"), F.sum(bits).cast("string").alias("digest"))
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("r") <= listed)
    joined = first.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "head"))), lambda x: x["head"]), " | ").alias("heads"))
    return heads.join(joined, by).join(tags, by)


def due(memory: DataFrame, ref: Column, most: int = 150, days: int = 30) -> DataFrame:
    """(project, n, oldest, due): projects with more than `most` rows, or whose oldest is older than `days`, need a checkpoint."""
    g = memory.groupBy(F.col("source").alias("project")).agg(F.count("*").alias("n"), F.min("date").alias("oldest"))
    return g.withColumn("due", (F.col("n") > most) | F.coalesce(F.datediff(ref, F.col("oldest")) > days, F.lit(False)))


def exact_groups(memory: DataFrame) -> DataFrame:
    """Texts that occur more than once: by their digest, how many, and the smallest id that stays."""
    return memory.groupBy(F.md5("content").alias("digest")).agg(F.count("*").alias("n"), F.min("id").alias("keep")).where("n > 1")


def dedup(memory: DataFrame, keep: str = "first") -> DataFrame:
    """(id, action, kept): what to do with each row whose text occurs more than once; `latest` keeps the largest id."""
    keyed = memory.select("id", F.md5("content").alias("digest"))
    pick = F.min("id") if keep == "first" else F.max("id")
    groups = keyed.groupBy("digest").agg(pick.alias("kept"), F.count("*").alias("n")).where("n > 1")
    return keyed.join(groups, "digest").select("id", F.when(F.col("id") == F.col("kept"), "keep").otherwise("remove").alias("action"), "kept")


def leaders(classes: DataFrame, sizes: DataFrame) -> DataFrame:
    """(id, component) and (id, size) → (id, component, keep): the longest text of each component stays, then the smallest id."""
    c = classes.join(sizes, "id")
    best = c.groupBy("component").agg(F.max_by("id", F.struct("size", -F.col("id"))).alias("kept"))
    return c.join(best, "component").select("id", "component", (F.col("id") == F.col("kept")).alias("keep"))


def merge_patch(rows: DataFrame, patches: DataFrame) -> DataFrame:
    """(id, content, meta) and (id, patch, content?) → patched rows: patch keys override, others stay; null content keeps the old one."""
    p = patches.select("id", "patch", F.col("content").alias("new"))
    meta = F.map_concat(F.map_filter("meta", lambda k, _: ~F.coalesce(F.array_contains(F.map_keys("patch"), k), F.lit(False))), F.coalesce("patch", F.create_map().cast("map<string,string>")))
    return rows.join(p, "id", "left").select("id", F.coalesce("new", "content").alias("content"), meta.alias("meta"), F.col("patch").isNotNull().alias("changed"))


def upsert_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, chunk_index, content, embedding) and new (id, chunk_index, content) → the new state and what changed: an embedding stays only with an equal text; vanished indexes are dropped."""
    o = old.select("id", "chunk_index", F.col("content").alias("was"), "embedding")
    j = o.join(new, ["id", "chunk_index"], "full")
    same = F.col("content").eqNullSafe(F.col("was"))
    action = F.when(F.col("content").isNull(), "drop").when(F.col("was").isNull(), "insert").when(same, "keep").otherwise("replace")
    return j.select("id", "chunk_index", "content", F.when(same, F.col("embedding")).alias("embedding"), action.alias("action"))


#: What takes a row out of memory: `archive`, `cold` and `remove` keep it in the archive, `delete` does not.
GONE, KEPT = ["archive", "cold", "remove", "delete"], ["archive", "cold", "remove"]


def apply(memory: DataFrame, plan: DataFrame, archive: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Memory (and archive) after a plan; applying it again changes nothing.

    Actions: `set_level` (to the plan's `after`), `degrade` (an automatic rule
    becomes semantic), `warm` (the vector goes, the text stays), `archive`, `cold`,
    `remove` (to the archive), `delete`, `update` (the plan's `content`, where it
    has one; the vector is made anew later).  `keep` and unknown ones do nothing.
    Several actions of a row all take effect.
    """
    said = lambda *names: F.coalesce(F.bool_or(F.col("action").isin(*names)), F.lit(False))
    value = lambda name, of: (F.max(F.when(F.col("action") == of, F.col(name))) if name in plan.columns else F.lit(None).cast("string"))
    acts = plan.groupBy("id").agg(said(*GONE).alias("p_gone"), said(*KEPT).alias("p_kept"), said("warm").alias("p_warm"), said("degrade").alias("p_degraded"), value("after", "set_level").alias("p_level"), value("content", "update").alias("p_content"))
    j = memory.join(acts, "id", "left")
    if archive is not None:
        moved = j.where("p_kept").select("id", "content", F.to_json(F.struct("tags", "level")).alias("meta"))
        archive = archive.unionByName(moved.join(archive, "id", "left_anti"))
    new = {"level": F.when(F.col("p_level").isNotNull(), F.col("p_level")).when(F.col("p_degraded") & (F.col("level") == "automatic"), "semantic").otherwise(F.col("level")), "content": F.coalesce("p_content", "content")}
    if "embedding" in memory.columns:
        new["embedding"] = F.when(F.col("p_warm") | (F.col("p_content") != F.col("content")), None).otherwise(F.col("embedding"))
    return j.where(~F.coalesce("p_gone", F.lit(False))).withColumns(new).select(memory.columns), archive


def apply_links(links: DataFrame, plan: DataFrame) -> DataFrame:
    """Links after a plan (id, action, after): `update` sets the weight, `delete` removes."""
    p = plan.select(F.col("id"), F.col("action").alias("p_action"), F.col("after").alias("p_after"))
    j = links.join(p, "id", "left").where(~F.coalesce(F.col("p_action") == "delete", F.lit(False)))
    return j.withColumn("weight", F.when(F.col("p_action") == "update", F.col("p_after")).otherwise(F.col("weight"))).select(links.columns)


def restore(archive: DataFrame, ref: Column) -> DataFrame:
    """(id, content, meta json) → memory rows: archive keys stripped, level episodic by default, stamped."""
    level = F.coalesce(F.get_json_object("meta", "$.level"), F.lit("episodic"))
    return archive.select("id", "content", level.alias("level"), F.from_json(F.get_json_object("meta", "$.tags"), "array<string>").alias("tags"), ref.alias("restored_at"))


def newest(df: DataFrame, by: str, order: str) -> DataFrame:
    """The newest row of each key."""
    return df.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).where("r = 1").drop("r")

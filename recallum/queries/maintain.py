"""Duplicates and the life cycle of memory, as change plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from recallum.operators import knn as K
from recallum.functions import text as T
from recallum.plans import lifecycle as P
from recallum.queries import query
from recallum.sources import tables as S
from recallum.sources.tables import REF_DATE, sql

_REF = f"DATE '{REF_DATE}'"


def ref():
    return F.lit(REF_DATE).cast("date")


@query(sql("SELECT md5(content) AS digest, count(*) AS n, min(id) AS keep FROM memory GROUP BY content HAVING count(*) > 1", "memory"))
def exact_dup_groups(spark: SparkSession, d: str) -> DataFrame:
    return P.exact_groups(S.memory(spark, d))


@query(sql("SELECT lang, count(*) AS n, count(*) - count(DISTINCT md5(lower(trim(content)))) AS redundant, round(100.0 * (count(*) - count(DISTINCT md5(lower(trim(content))))) / count(*), 4) AS pct FROM memory GROUP BY lang", "memory"))
def normalized_dup_rate(spark: SparkSession, d: str) -> DataFrame:
    m = S.memory(spark, d).groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct(F.md5(F.lower(F.trim("content")))).alias("u"))
    return m.select("lang", "n", (F.col("n") - F.col("u")).alias("redundant"), F.round(100.0 * (F.col("n") - F.col("u")) / F.col("n"), 4).alias("pct"))


@query(sql("SELECT id, CASE WHEN id = kept THEN 'keep' ELSE 'remove' END AS action, kept FROM (SELECT id, min(id) OVER (PARTITION BY content) AS kept, count(*) OVER (PARTITION BY content) AS n FROM memory) WHERE n > 1", "memory"))
def dedup_plan(spark: SparkSession, d: str) -> DataFrame:
    return P.dedup(S.memory(spark, d))


@query(
    sql(
        """SELECT id, component, id = arg_max(id, struct_pack(s := size, k := -id)) OVER (PARTITION BY component) AS keep FROM (SELECT id, min(node) AS component, any_value(length(content)) AS size FROM walk JOIN memory USING (id) GROUP BY id)""".replace("id = arg_max(id, struct_pack(s := size, k := -id)) OVER (PARTITION BY component)", "id = first_value(id) OVER (PARTITION BY component ORDER BY size DESC NULLS LAST, id)"),
        "memory",
        pairs="SELECT a.id AS a, b.id AS b FROM memory a JOIN memory b ON a.id <> b.id AND list_cosine_similarity(a.embedding, b.embedding) >= 0.9",
        walk="SELECT id, id AS node FROM memory UNION SELECT walk.id, b FROM walk JOIN pairs ON a = node",
    )
)
def semantic_dedup_leader(spark: SparkSession, d: str) -> DataFrame:
    """Every row with the class of rows that links of cosine 0.9 or more join it to; the longest text of each class stays."""
    m = S.memory(spark, d)
    return P.leaders(K.near_classes(m, 0.9), m.select("id", F.length("content").alias("size")))


@query(
    sql(
        """SELECT qid, CASE WHEN similarity >= 0.9 THEN 'update' ELSE 'insert' END AS action, CASE WHEN similarity >= 0.9 THEN id END AS target FROM (SELECT qid, id, similarity, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) AS r FROM (
        SELECT q.qid, m.id, round(list_cosine_similarity(q.embedding, m.embedding), 6) AS similarity FROM query q, memory m WHERE q.embedding IS NOT NULL AND m.embedding IS NOT NULL AND m.level = 'semantic')) WHERE r = 1""",
        "memory", "query",
    )
)
def profile_nearest_or_insert(spark: SparkSession, d: str) -> DataFrame:
    """A new profile updates the nearest semantic row if that is near enough, else it is inserted."""
    near = K.knn(S.query_table(spark, d), S.memory(spark, d).where("level = 'semantic'"), 1)
    close = F.col("similarity") >= 0.9
    return near.select("qid", F.when(close, "update").otherwise("insert").alias("action"), F.when(close, F.col("id")).alias("target"))


@query(sql(f"SELECT id, 'set_level' AS action, 'semantic' AS after, date_diff('day', date, {_REF}) AS age FROM memory WHERE level = 'episodic' AND date_diff('day', date, {_REF}) >= 7", "memory"))
def consolidation_plan(spark: SparkSession, d: str) -> DataFrame:
    return P.consolidate(S.memory(spark, d), ref())


@query(sql(f"SELECT id, review_count + 1 AS review_count, CASE WHEN review_count = 0 AND date_diff('day', date, {_REF}) > 30 THEN 'degrade' ELSE 'keep' END AS action FROM memory WHERE level = 'automatic'", "memory"))
def rule_review_plan(spark: SparkSession, d: str) -> DataFrame:
    return P.review_rules(S.memory(spark, d), ref())


@query(sql(f"SELECT id, coalesce(o, 0) AS \"out\", coalesce(i, 0) AS \"in\", coalesce(i, 0) = 0 AND review_count = 0 AND date_diff('day', date, {_REF}) > 30 AS orphan FROM memory LEFT JOIN (SELECT src AS id, count(*) AS o FROM link GROUP BY src) USING (id) LEFT JOIN (SELECT dst AS id, count(*) AS i FROM link GROUP BY dst) USING (id) WHERE level = 'automatic'", "memory", "link"))
def rule_validation(spark: SparkSession, d: str) -> DataFrame:
    from recallum.operators.graph import degrees

    deg = degrees(S.links(spark, d)).withColumnRenamed("node", "id")
    m = S.memory(spark, d).where("level = 'automatic'").join(deg, "id", "left").fillna(0, ["out", "in"])
    return m.select("id", "out", "in", ((F.col("in") == 0) & (F.col("review_count") == 0) & (F.datediff(ref(), F.col("date")) > 30)).alias("orphan"))


_LAST = "SELECT m.*, coalesce(CAST(seen AS DATE), date) AS last FROM memory m LEFT JOIN (SELECT memory_id, max(accessed_at) AS seen FROM access_log GROUP BY memory_id) ON memory_id = 'v' || id WHERE level NOT IN ('semantic', 'automatic') AND NOT critical AND NOT trade AND id NOT IN (SELECT src FROM link UNION SELECT dst FROM link)"


@query(sql(f"SELECT id, 'archive' AS action, date_diff('day', last, {_REF}) AS idle FROM lasts WHERE date_diff('day', last, {_REF}) > CASE domain_profile WHEN 'infrastructure' THEN 180 WHEN 'project_specific' THEN 90 WHEN 'temporary' THEN 14 ELSE 60 END", "memory", "access_log", "link", lasts=_LAST))
def forget_plan(spark: SparkSession, d: str) -> DataFrame:
    return P.forget(S.memory(spark, d), S.access_log(spark, d), S.links(spark, d), ref())


@query(sql(f"SELECT id, CASE WHEN date_diff('day', last, {_REF}) > 90 THEN 'cold' ELSE 'warm' END AS action, date_diff('day', last, {_REF}) AS idle FROM lasts WHERE embedding IS NOT NULL ORDER BY last NULLS FIRST, id LIMIT (SELECT CASE WHEN count(embedding) > 400 THEN count(embedding) - 350 ELSE 0 END FROM memory)", "memory", "access_log", "link", lasts=_LAST))
def budget_plan(spark: SparkSession, d: str) -> DataFrame:
    return P.budget(S.memory(spark, d), S.access_log(spark, d), S.links(spark, d), ref(), cap=400)


@query(sql(f"SELECT id, level, array_to_string(tags, ',') AS tags, length(content) AS chars, {_REF} AS restored_at FROM lasts WHERE date_diff('day', last, {_REF}) > 60", "memory", "access_log", "link", lasts=_LAST))
def restore_plan(spark: SparkSession, d: str) -> DataFrame:
    """Rows idle for more than 60 days are archived, and restored from the archive."""
    m = S.memory(spark, d)
    free = m.where("level NOT IN ('semantic', 'automatic') AND NOT critical AND NOT trade").join(P.linked(S.links(spark, d)), "id", "left_anti")
    old = P.last_access(free, S.access_log(spark, d)).where(F.datediff(ref(), F.col("last")) > 60).select("id", F.lit("archive").alias("action"))
    empty = m.limit(0).select("id", "content", F.lit("").alias("meta"))
    _, archive = P.apply(m, old, empty)
    return P.restore(archive, ref()).select("id", "level", F.array_join("tags", ",").alias("tags"), F.length("content").alias("chars"), "restored_at")


@query(
    sql(
        f"""SELECT scale, project, n, first_id, last_id, chars, digest, heads, tags FROM (SELECT scale, project, count(*) AS n, min(id) AS first_id, max(id) AS last_id, sum(length(head)) AS chars, CAST(sum(CAST('0x' || md5(id || '|' || head)[1:12] AS BIGINT)) AS VARCHAR) AS digest,
        string_agg(head, ' | ' ORDER BY id) FILTER (r <= 20) AS heads, array_to_string(list_sort(list_distinct(flatten(list(tags)))), ',') AS tags FROM (SELECT *, row_number() OVER (PARTITION BY scale, project ORDER BY id) AS r FROM (
        SELECT *, source AS project, content[1:150] AS head, CASE WHEN date_diff('day', date, {_REF}) <= 1 THEN '24h' WHEN date_diff('day', date, {_REF}) <= 7 THEN '7d' WHEN date_diff('day', date, {_REF}) <= 30 THEN '30d' WHEN date_diff('day', date, {_REF}) <= 90 THEN '90d' ELSE 'all' END AS scale FROM memory WHERE level <> 'automatic')) GROUP BY scale, project)""",
        "memory",
    )
)
def checkpoint_rollup(spark: SparkSession, d: str) -> DataFrame:
    return P.checkpoint(S.memory(spark, d), ref())


@query(sql(f"SELECT project, n, CAST(oldest AS VARCHAR) AS oldest, n > 150 OR date_diff('day', oldest, {_REF}) > 30 AS due FROM (SELECT source AS project, count(*) AS n, min(date) AS oldest FROM memory GROUP BY source)", "memory"))
def checkpoint_due(spark: SparkSession, d: str) -> DataFrame:
    return P.due(S.memory(spark, d), ref()).withColumn("oldest", F.col("oldest").cast("string"))


@query(sql(f"SELECT id, CASE WHEN level = 'episodic' AND date_diff('day', date, {_REF}) >= 7 THEN 'semantic' WHEN level = 'automatic' AND review_count = 0 AND date_diff('day', date, {_REF}) > 30 THEN 'semantic' ELSE level END AS level, CASE WHEN id % 6 = 1 THEN NULL ELSE embedding[1] END AS first_value FROM memory WHERE id % 11 <> 0", "memory"))
def set_level(spark: SparkSession, d: str) -> DataFrame:
    """Memory after a plan of consolidations, degraded rules, rows that go to WARM (every sixth) and deletions (every eleventh)."""
    m = S.memory(spark, d)
    picked = lambda k, n, action: m.where(F.col("id") % k == n).select("id", F.lit(action).alias("action"), F.lit(None).cast("string").alias("after"))
    plan = P.consolidate(m, ref()).select("id", "action", "after").unionByName(P.review_rules(m, ref()).select("id", "action", F.lit(None).cast("string").alias("after"))).unionByName(picked(6, 1, "warm")).unionByName(picked(11, 0, "delete"))
    return P.apply(m, plan)[0].select("id", "level", F.get("embedding", F.lit(0)).alias("first_value"))


@query(sql("SELECT session_id, count(*) AS listed, count(m.id) AS present, count(*) - count(m.id) AS missing FROM (SELECT 's' || (conv_id % 50) AS session_id, conv_id * 37 + turn AS id FROM conversations) l LEFT JOIN (SELECT id FROM memory) m USING (id) GROUP BY session_id", "memory"))
def snapshot_presence(spark: SparkSession, d: str) -> DataFrame:
    listed = S.table(spark, d, "conversations").select(F.concat(F.lit("s"), F.col("conv_id") % 50).alias("session_id"), (F.col("conv_id") * 37 + F.col("turn")).alias("id"))
    known = S.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit(1).alias("here"))
    g = listed.join(known, "id", "left").groupBy("session_id").agg(F.count("*").alias("listed"), F.count("here").alias("present"))
    return g.withColumn("missing", F.col("listed") - F.col("present"))


@query(sql("SELECT id, CASE WHEN embedding IS NULL THEN 'missing' ELSE 'stale' END AS reason, md5(content[1:28000]) AS signature FROM memory WHERE embedding IS NULL OR (CASE WHEN id % 7 = 0 THEN 'old' ELSE md5(content[1:28000]) END) IS DISTINCT FROM md5(content[1:28000])", "memory"))
def embedding_out_of_sync(spark: SparkSession, d: str) -> DataFrame:
    """Rows without a vector, or whose stored signature (here wrong for every seventh row) isn't that of their text."""
    sig = F.md5(F.substring("content", 1, 28000))
    m = S.memory(spark, d).select("id", "embedding", sig.alias("signature"), F.when(F.col("id") % 7 == 0, "old").otherwise(sig).alias("stored"))
    out = m.where(F.col("embedding").isNull() | ~F.col("stored").eqNullSafe(F.col("signature")))
    return out.select("id", F.when(F.col("embedding").isNull(), "missing").otherwise("stale").alias("reason"), "signature")


_CHUNKS = "SELECT id, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS chunk_index, unnest(string_split(content, chr(10))) AS content FROM memory"


@query(
    sql(
        """SELECT coalesce(o.id, n.id) AS id, coalesce(o.chunk_index, n.chunk_index) AS chunk_index, md5(n.content) AS digest, coalesce(n.content = o.content, false) AS embedded, CASE WHEN n.id IS NULL THEN 'drop' WHEN o.id IS NULL THEN 'insert' WHEN n.content = o.content THEN 'keep' ELSE 'replace' END AS action
        FROM (SELECT * FROM chunks WHERE chunk_index < 3) o FULL JOIN (SELECT id, chunk_index, CASE WHEN chunk_index = 1 THEN content || '!' ELSE content END AS content FROM chunks WHERE chunk_index <> 2) n ON o.id = n.id AND o.chunk_index = n.chunk_index""",
        "memory", chunks=_CHUNKS,
    )
)
def chunk_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Old chunks are the first three lines; new ones have line 1 changed, no line 2, and all later lines."""
    lines = S.memory(spark, d).select("id", F.posexplode(F.split("content", "\n")).alias("chunk_index", "content"))
    old = lines.where("chunk_index < 3").withColumn("embedding", F.array(F.lit(1.0)))
    new = lines.where("chunk_index <> 2").withColumn("content", F.when(F.col("chunk_index") == 1, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return P.upsert_chunks(old, new).select("id", "chunk_index", F.md5("content").alias("digest"), F.col("embedding").isNotNull().alias("embedded"), "action")


@query(sql("SELECT id, md5(CASE WHEN p AND id % 6 = 0 THEN content || '!' ELSE content END) AS digest, CASE WHEN p THEN 'semantic' ELSE level END AS level, lang, CASE WHEN p THEN 'yes' END AS stamped, coalesce(p, false) AS changed FROM memory LEFT JOIN (SELECT doc_id AS id, true AS p FROM labels) USING (id)", "memory"))
def merge_patch(spark: SparkSession, d: str) -> DataFrame:
    """Labelled rows get a patch of level and stamp, every second of them a new text; other keys stay."""
    m = S.memory(spark, d)
    rows = m.select("id", "content", F.create_map(F.lit("level"), "level", F.lit("lang"), "lang").alias("meta"))
    patch = S.table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.create_map(F.lit("level"), F.lit("semantic"), F.lit("stamped"), F.lit("yes")).alias("patch"))
    fresh = m.where("id % 6 = 0").select("id", F.concat("content", F.lit("!")).alias("content"))
    out = P.merge_patch(rows, patch.join(fresh, "id", "left"))
    return out.select("id", F.md5("content").alias("digest"), F.col("meta")["level"].alias("level"), F.col("meta")["lang"].alias("lang"), F.col("meta")["stamped"].alias("stamped"), "changed")


@query(sql("SELECT vectors, CAST(520 AS BIGINT) AS cap, round(vectors / 520, 4) AS share, CASE WHEN vectors / 520 > 1 THEN 'over' WHEN vectors / 520 >= 0.9 THEN 'warning' ELSE 'ok' END AS state FROM (SELECT count(embedding) AS vectors FROM memory)", "memory"))
def budget_warning(spark: SparkSession, d: str) -> DataFrame:
    """How full the budget of vectors is (520 here)."""
    return P.budget_state(S.memory(spark, d), 520)


@query(sql(f"SELECT id, {T.sql_summary('content')} AS summary FROM memory WHERE length(content) > 600 AND id % 3 <> 0", "memory"))
def summary_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Summaries for the long rows that have none (two thirds here)."""
    return P.backfill_summaries(S.memory(spark, d).withColumn("summary", F.when(F.col("id") % 3 == 0, F.col("code"))))


@query(sql("SELECT digest, n, keep FROM (SELECT md5(content) AS digest, count(*) AS n, min(id) AS keep FROM (SELECT * FROM memory ORDER BY date DESC NULLS LAST, id DESC LIMIT 500) GROUP BY content HAVING count(*) > 1)", "memory"))
def newest_dup_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of equal texts among the newest 500 rows (a sampling operator; `exact_dup_groups` takes all)."""
    return P.exact_groups(P.newest_rows(S.memory(spark, d), 500))

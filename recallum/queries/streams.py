"""Source trees, and streaming jobs over the event log (as a table; tests replay them as streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from recallum.queries import query
from recallum.sources import tables as S
from recallum.sources.files import changes, digest_by
from recallum.sources.tables import sql
from recallum.streaming import jobs as J, state as ST

_PATH = "regexp_replace(url, '^[a-z]+://', '')"


def _listing(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"), F.md5("html").alias("hash"))


@query(
    sql(
        f"""SELECT coalesce(a.page_id, b.page_id) AS page_id, CASE WHEN b.page_id IS NULL THEN 'gone' WHEN a.page_id IS NULL THEN 'new' WHEN a.hash <> b.hash THEN 'changed' ELSE 'same' END AS state
        FROM (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'old' ELSE md5(html) END AS hash FROM pages WHERE page_id % 3 <> 0) a FULL JOIN (SELECT page_id, md5(html) AS hash FROM pages WHERE page_id % 7 <> 0) b USING (page_id)"""
    )
)
def file_change_detect(spark: SparkSession, d: str) -> DataFrame:
    """A manifest (without every third page, every fifth stale) against a listing (without every seventh)."""
    now = _listing(spark, d)
    manifest = now.where("page_id % 3 <> 0").select("page_id", F.when(F.col("page_id") % 5 == 0, "old").otherwise(F.col("hash")).alias("hash"))
    return changes(manifest, now.where("page_id % 7 <> 0").select("page_id", "hash"), "page_id")


@query(sql("SELECT dir, count(*) AS files, CAST(sum(CAST('0x' || md5(page_id || '|' || hash)[1:12] AS BIGINT)) AS VARCHAR) AS digest FROM (SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS dir, md5(html) AS hash FROM pages) GROUP BY dir"))
def dir_digest(spark: SparkSession, d: str) -> DataFrame:
    return digest_by(_listing(spark, d).withColumn("dir", F.regexp_extract("path", "^([^/?#]+)", 1)), "dir", "page_id", "hash")


@query(sql("SELECT session_id, block, n, digest FROM (SELECT session_id, (r - 1) // 5 AS block, count(*) AS n, md5(string_agg(text[1:200], '|' ORDER BY r)) AS digest FROM (SELECT 's' || (conv_id % 50) AS session_id, text, row_number() OVER (PARTITION BY conv_id % 50 ORDER BY conv_id * 1000 + turn) AS r FROM conversations) GROUP BY session_id, block) WHERE n = 5"))
def session_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = S.table(spark, d, "conversations").select(F.concat(F.lit("s"), F.col("conv_id") % 50).alias("session_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), "text")
    return J.session_rollup(rows, every=5)


@query(sql("SELECT sub_id, id FROM memory JOIN (SELECT item_id AS sub_id, text AS pattern FROM benchmark) ON contains(lower(content), lower(pattern))", "memory"))
def standing_query_alerts(spark: SparkSession, d: str) -> DataFrame:
    subs = S.table(spark, d, "benchmark").select(F.col("item_id").alias("sub_id"), F.col("text").alias("pattern"))
    return J.alerts(S.memory(spark, d).select("id", "content"), subs)


@query()
def admission_windows(spark: SparkSession, d: str) -> DataFrame:
    return J.admit(S.table(spark, d, "events").select("user_id", "event_id", "ts"))


@query(sql("SELECT date_trunc('hour', created_at) AS start, method, count(*) AS n, round(avg(latency_ms), 4) AS avg_ms, max(latency_ms) AS max_ms FROM query_log GROUP BY start, method", "query_log"))
def hourly_query_metrics(spark: SparkSession, d: str) -> DataFrame:
    return J.hourly_metrics(S.query_log(spark, d))


@query(
    sql(
        """SELECT min(accessed_at) AS start, max(accessed_at) + INTERVAL 30 MINUTE AS "end", user_id, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY accessed_at, event_id) AS s FROM (
        SELECT *, CASE WHEN accessed_at >= lag(accessed_at) OVER (PARTITION BY user_id ORDER BY accessed_at, event_id) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM access_log)) GROUP BY user_id, s""",
        "access_log",
    )
)
def access_sessions(spark: SparkSession, d: str) -> DataFrame:
    return J.sessions(S.access_log(spark, d))


@query(sql("SELECT start, memory_id, count(*) AS n FROM (SELECT memory_id, unnest(generate_series(date_trunc('day', accessed_at) - INTERVAL 6 DAY, date_trunc('day', accessed_at), INTERVAL 1 DAY)) AS start FROM access_log) GROUP BY start, memory_id", "access_log"))
def sliding_access_windows(spark: SparkSession, d: str) -> DataFrame:
    return J.access_windows(S.access_log(spark, d))


@query(sql("SELECT user_id AS id, arg_max(props, ts) AS content, max(ts) AS ts FROM events GROUP BY user_id"))
def latest_by_key(spark: SparkSession, d: str) -> DataFrame:
    return J.latest(S.table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("props").alias("content"), "ts"), "ts")


@query(
    sql(
        """SELECT id, failures, CASE WHEN failures = 0 THEN 'repaired' WHEN failures > 3 THEN 'given up' ELSE 'waiting' END AS status, CASE failures WHEN 1 THEN failed_at + INTERVAL 5 SECOND WHEN 2 THEN failed_at + INTERVAL 30 SECOND WHEN 3 THEN failed_at + INTERVAL 120 SECOND END AS next_at
        FROM (SELECT user_id AS id, count(*) FILTER (NOT ok AND (good IS NULL OR ts > good)) AS failures, max(ts) FILTER (NOT ok AND (good IS NULL OR ts > good)) AS failed_at FROM (SELECT *, max(ts) FILTER (ok) OVER (PARTITION BY user_id) AS good FROM (SELECT user_id, ts, event_type IN ('purchase', 'signup') AS ok FROM events)) GROUP BY user_id)"""
    )
)
def repair_due(spark: SparkSession, d: str) -> DataFrame:
    """When each row's next try is due after a log of tries (here each user's events, purchases and sign-ups as successes)."""
    return ST.repair_state(S.table(spark, d, "events").select(F.col("user_id").alias("id"), "ts", F.col("event_type").isin("purchase", "signup").alias("ok")))


@query(
    sql(
        """SELECT reason, unnest(generate_series(1, most)) AS k FROM (SELECT 'saves' AS reason, count(*) // 50 AS most FROM events UNION ALL SELECT 'time', CAST(epoch_ms(max(ts)) - epoch_ms(min(ts)) AS BIGINT) // 86400000 FROM events)"""
    )
)
def maintenance_triggers(spark: SparkSession, d: str) -> DataFrame:
    """When maintenance is due if every event is a save: each 50 saves and each day."""
    return ST.triggers(S.table(spark, d, "events"))


@query(sql("SELECT r // 50 AS k, event_id AS seq FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS r FROM events) WHERE r % 50 = 0"))
def maintenance_saves(spark: SparkSession, d: str) -> DataFrame:
    return ST.saves_due(S.table(spark, d, "events"))


@query(
    sql(
        """SELECT key, seq, CASE WHEN hit THEN verdict END AS verdict, hit, CASE WHEN hit THEN CAST(sum(CAST(hit AS INT)) OVER (PARTITION BY key, life ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) ELSE 0 END AS hits, put FROM (
        SELECT *, coalesce(epoch_ms(ts) < epoch_ms(made) + 86400000, false) AND NOT put AS hit, sum(CAST(fresh AS INT)) OVER (PARTITION BY key ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS life FROM (
          SELECT *, put AND coalesce(epoch_ms(ts) >= epoch_ms(lag(made) OVER (PARTITION BY key ORDER BY ts, seq)) + 86400000, true) AS fresh FROM (
            SELECT *, max(CASE WHEN put THEN ts END) OVER w AS made, last_value(CASE WHEN put THEN value END IGNORE NULLS) OVER w AS verdict FROM (SELECT 'k' || (user_id % 97) AS key, event_id AS seq, event_type = 'purchase' AS put, value, ts FROM events) WINDOW w AS (PARTITION BY key ORDER BY ts, seq ROWS UNBOUNDED PRECEDING))))
        QUALIFY NOT put"""
    ).replace("SELECT key, seq, CASE", "SELECT key, seq, verdict, hit, hits FROM (SELECT key, seq, CASE", 1).replace("QUALIFY NOT put", ") WHERE NOT put")
)
def judgment_answers(spark: SparkSession, d: str) -> DataFrame:
    """What a cache of judgments answers each question, with a life of a day (purchases are judgments, all else asks)."""
    e = S.table(spark, d, "events")
    return ST.answers(e.select(F.concat(F.lit("k"), F.col("user_id") % 97).alias("key"), F.col("event_id").alias("seq"), (F.col("event_type") == "purchase").alias("put"), F.col("value").alias("verdict"), "ts"), ttl=86_400_000)


@query(sql("SELECT sub_id, id, CASE id % 3 WHEN 0 THEN 'save' WHEN 1 THEN 'update' ELSE 'delete' END AS event FROM memory JOIN (SELECT item_id AS sub_id, text AS pattern FROM benchmark) ON contains(lower(content), lower(pattern))", "memory"))
def change_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Alerts on saved, updated and deleted rows."""
    subs = S.table(spark, d, "benchmark").select(F.col("item_id").alias("sub_id"), F.col("text").alias("pattern"))
    event = F.when(F.col("id") % 3 == 0, "save").when(F.col("id") % 3 == 1, "update").otherwise("delete")
    return J.alerts(S.memory(spark, d).select("id", "content", event.alias("event")), subs)


@query(sql("SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS calls FROM events"))
def sliding_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls of each user in the hour up to each call."""
    return J.calls_before(S.table(spark, d, "events"), 3600)

"""Appends, gates, logs, profile items and the composed maintenance run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from recallum.functions import rules, text as T
from recallum.operators import filters, graph as G, knn as K, lexical as L, rank as R, store as O
from recallum.operators.numbering import numbered
from recallum.plans import lifecycle as P
from recallum.queries import query
from recallum.queries.maintain import _LAST
from recallum.queries.search import _G, _KNN, _TOPS, _VIEWS, channels
from recallum.sources import tables as S
from recallum.sources.shared import against, cut
from recallum.sources.tables import REF_DATE, REF_NOW, sql

_ITEMS = "SELECT 'i' || conv_id || '_' || turn AS item_id, text AS summary, role, CASE WHEN turn % 2 = 0 THEN 'profile' ELSE 'event' END AS mem_type, conv_id, turn FROM conversations"
_NOW = f"TIMESTAMP '{REF_NOW}'"


def now():
    return F.lit(REF_NOW).cast("timestamp_ntz")


def items(spark: SparkSession, d: str) -> DataFrame:
    c = S.table(spark, d, "conversations")
    return c.select(F.concat(F.lit("i"), "conv_id", F.lit("_"), "turn").alias("item_id"), F.col("text").alias("summary"), "role", F.when(F.col("turn") % 2 == 0, "profile").otherwise("event").alias("mem_type"), "conv_id", "turn")


def _tops(spark: SparkSession, d: str) -> DataFrame:
    return filters.top(R.fuse(channels(spark, d)).select("qid", "id", "score"), 15, "qid", F.desc("score"), F.col("id"))


@query(sql("SELECT item_id, name FROM items LEFT JOIN bridge USING (item_id) LEFT JOIN (SELECT r_regionkey AS category_id, r_name AS name FROM region) USING (category_id)", items=_ITEMS, bridge="SELECT item_id, conv_id % 7 AS category_id FROM items WHERE turn % 3 <> 2 UNION ALL SELECT item_id, (conv_id + 1) % 7 FROM items WHERE turn % 3 = 1"))
def items_with_categories(spark: SparkSession, d: str) -> DataFrame:
    i = items(spark, d)
    bridge = i.where("turn % 3 <> 2").select("item_id", (F.col("conv_id") % 7).alias("category_id")).union(i.where("turn % 3 = 1").select("item_id", ((F.col("conv_id") + 1) % 7).alias("category_id")))
    names = S.table(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("category_id"), F.col("r_name").alias("name"))
    return O.with_categories(i, bridge, names).select("item_id", "name")


@query(
    sql(
        """SELECT qid, item_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item_id) AS rank FROM (SELECT qid, item_id, round(least(100.0, 55.0 * hits / n + CASE WHEN mem_type = 'profile' THEN 15.0 ELSE 5.0 END + CASE WHEN word THEN 10.0 ELSE 0.0 END), 4) AS score FROM (
        SELECT qid, item_id, mem_type, len(list_filter(strong, lambda t: contains(lower(summary), t))) AS hits, len(strong) AS n, list_has_any(string_split(lower(summary), ' '), strong) AS word FROM query, items) WHERE hits > 0)) WHERE rank <= 120""",
        "query", items=_ITEMS,
    )
)
def item_lexical(spark: SparkSession, d: str) -> DataFrame:
    q, i = S.query_table(spark, d).select("qid", "strong"), items(spark, d)
    found = L.scan(q.withColumnRenamed("strong", "terms"), i.select("item_id", F.lower("summary").alias("text")), ["item_id"])
    j = found.join(i, "item_id").join(q, "qid")
    bonus = F.when(F.col("mem_type") == "profile", 15.0).otherwise(5.0) + F.when(F.arrays_overlap(F.split(F.lower("summary"), " "), F.col("strong")), 10.0).otherwise(0.0)
    s = F.round(F.least(F.lit(100.0), 55.0 * F.col("hits") / F.col("n") + bonus), 4)
    return filters.top(j.select("qid", "item_id", s.alias("score")), 120, "qid", F.desc("score"), F.col("item_id"))


@query(
    sql(
        """SELECT qid, item_id, score, rank FROM (SELECT qid, item_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item_id) AS rank FROM (
        SELECT qid, item_id, least(100.0, round(100 * list_cosine_similarity(q.embedding, CAST(e.embedding AS DOUBLE[])), 3) + CASE WHEN mem_type = 'profile' THEN 5.0 ELSE 0.0 END) AS score FROM query q, items JOIN embeddings e ON vec_id = conv_id * 3 + turn WHERE q.embedding IS NOT NULL)) WHERE rank <= 30""",
        "query", items=_ITEMS,
    )
)
def item_vector(spark: SparkSession, d: str) -> DataFrame:
    """Items with a vector (that of id 3 conv_id + turn) by cosine, five points more for profiles."""
    v = S.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    i = items(spark, d).select((F.col("conv_id") * 3 + F.col("turn")).alias("id"), "item_id", "mem_type")
    q = S.query_table(spark, d)
    # The best of profiles and of other items apart, as the points for profiles shift one against the other.
    sides = [v.join(i.where(side).select("id").distinct(), "id", "left_semi") for side in ("mem_type = 'profile'", "mem_type <> 'profile'")]
    near = K.similarities(q, sides[0], k=60).unionByName(K.similarities(q, sides[1], k=60)).distinct().join(i, "id")
    s = F.least(F.lit(100.0), F.round(100 * F.col("similarity"), 3) + F.when(F.col("mem_type") == "profile", 5.0).otherwise(0.0))
    return filters.top(near.select("qid", "item_id", s.alias("score")), 30, "qid", F.desc("score"), F.col("item_id"))


@query(sql("SELECT DISTINCT 'v' || id AS memory_id, substr(sha256(clean), 1, 12) AS query_hash FROM tops JOIN query USING (qid) WHERE rank <= 10", "memory", "query", **_VIEWS, tops=_TOPS))
def access_append(spark: SparkSession, d: str) -> DataFrame:
    return O.accesses(_tops(spark, d), S.query_table(spark, d))


@query(sql("SELECT qid, text[1:200] AS query_text, count(id) AS n, coalesce(max(score), 0.0) AS top, round(coalesce(avg(score), 0.0), 3) AS mean FROM query LEFT JOIN tops USING (qid) GROUP BY qid, text", "memory", "query", **_VIEWS, tops=_TOPS))
def query_log_append(spark: SparkSession, d: str) -> DataFrame:
    return O.query_rows(_tops(spark, d), S.query_table(spark, d))


@query(sql("SELECT qid, memory_id FROM (SELECT qid, 'v' || id AS memory_id, row_number() OVER (PARTITION BY qid ORDER BY id DESC) AS r FROM query JOIN memory ON level = 'semantic' AND trade AND len(list_filter(strong, lambda t: contains(lower(content), t))) > 0) WHERE r <= 10", "memory", "query"))
def trade_reinforcement(spark: SparkSession, d: str) -> DataFrame:
    """For each query at most ten semantic trade rows that contain any of its strong terms."""
    m = L.substring_hits(S.query_table(spark, d), "strong", S.memory(spark, d).where("level = 'semantic' AND trade"))
    return filters.top(m, 10, "qid", F.desc("id")).select("qid", F.concat(F.lit("v"), "id").alias("memory_id"))


@query(sql(f"SELECT event_id, memory_id FROM access_log WHERE accessed_at >= {_NOW} - INTERVAL 14 DAY", "access_log"))
def log_retention(spark: SparkSession, d: str) -> DataFrame:
    return O.kept(S.access_log(spark, d), now(), 14).select("event_id", "memory_id")


@query(sql("SELECT qid, best IS NOT NULL AS blocked, best.twin AS twin FROM query LEFT JOIN (SELECT qid, max(struct_pack(s := round(similarity, 6), b := -id)) AS m, struct_pack(twin := -max(struct_pack(s := round(similarity, 6), b := -id)).b) AS best FROM sims WHERE round(similarity, 6) >= 0.3 GROUP BY qid) USING (qid)", "memory", "query", **_G))
def insert_gate_trigram(spark: SparkSession, d: str) -> DataFrame:
    q = S.query_table(spark, d)
    return O.gate(q, L.trigram_matches(q, "clean", S.memory(spark, d), 1).withColumn("similarity", F.round("similarity", 6)), 0.3)


@query(sql("SELECT qid, k.id IS NOT NULL AS blocked, k.id AS twin FROM query LEFT JOIN (SELECT * FROM (" + _KNN.format(k=1) + ") WHERE similarity >= 0.9) k USING (qid)", "memory", "query"))
def insert_gate_semantic(spark: SparkSession, d: str) -> DataFrame:
    q = S.query_table(spark, d)
    return O.gate(q, K.knn(q, S.memory(spark, d), 1), 0.9)


_GONE = "SELECT DISTINCT src, dst, CASE WHEN src % 2 = 0 THEN rel END AS rel FROM link WHERE id % 9 = 0"


@query(sql("SELECT id FROM link l WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.src = l.src AND g.dst = l.dst AND (g.rel IS NULL OR g.rel = l.rel))", "link", gone=_GONE))
def link_delete(spark: SparkSession, d: str) -> DataFrame:
    links = S.links(spark, d)
    gone = links.where("id % 9 = 0").select("src", "dst", F.when(F.col("src") % 2 == 0, F.col("rel")).alias("rel")).distinct()
    return O.delete_links(links, gone).select("id")


@query(sql(f"SELECT id, CASE WHEN id % 4 = 1 THEN {_NOW} ELSE last_accessed END AS last_accessed FROM link", "link"))
def link_touch(spark: SparkSession, d: str) -> DataFrame:
    links = S.links(spark, d)
    return O.touch_links(links, links.where("id % 4 = 1"), now()).select("id", "last_accessed")


@query(sql("SELECT rel, count(*) AS total, count(*) FILTER (after < 0.99 * weight) AS decayed, count(*) FILTER (after < 0.01) AS dead FROM (SELECT rel, weight, round(weight * pow(0.5, date_diff('day', CAST(last_accessed AS DATE), DATE '" + REF_DATE + "') / 90.0), 4) AS after FROM link) GROUP BY rel", "link"))
def link_decay_counters(spark: SparkSession, d: str) -> DataFrame:
    after = G.effective_weight(F.col("weight"), F.col("last_accessed"), now())
    return S.links(spark, d).withColumn("after", after).groupBy("rel").agg(F.count("*").alias("total"), F.count_if(F.col("after") < 0.99 * F.col("weight")).alias("decayed"), F.count_if(F.col("after") < 0.01).alias("dead"))


_TAGS = "SELECT DISTINCT lower(trim(t)) AS tag FROM (SELECT unnest(tags) AS t FROM memory UNION ALL SELECT role FROM conversations)"


@query(sql("SELECT tag FROM tags_all", "memory", tags_all=_TAGS))
def tag_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    t = S.memory(spark, d).select(F.explode("tags").alias("t")).union(S.table(spark, d, "conversations").select("role"))
    return t.select(F.lower(F.trim("t")).alias("tag")).distinct()


@query(sql("SELECT DISTINCT qid, tag FROM (SELECT qid, unnest(terms) AS t FROM query) JOIN tags_all ON contains(t, tag) OR contains(tag, t)", "memory", "query", tags_all=_TAGS))
def tag_term_match(spark: SparkSession, d: str) -> DataFrame:
    """Tags that contain a query term or are contained in one; the query's terms are the bounded side."""
    q = S.query_table(spark, d).select("qid", F.explode("terms").alias("t"))
    return against(tag_vocabulary(spark, d), q, F.contains("t", F.col("tag")) | F.contains("tag", F.col("t"))).select("qid", "tag").distinct()


@query(sql("SELECT day, sum(a) AS queries, sum(b) AS accesses, sum(a) + sum(b) > 150 AS due FROM (SELECT CAST(created_at AS DATE) AS day, 1 AS a, 0 AS b FROM query_log WHERE method = 'view' UNION ALL SELECT CAST(accessed_at AS DATE), 0, 1 FROM access_log) GROUP BY day", "query_log", "access_log"))
def maintenance_gate(spark: SparkSession, d: str) -> DataFrame:
    q = S.query_log(spark, d).where("method = 'view'").select(F.col("created_at").cast("date").alias("day"), F.lit(1).alias("a"), F.lit(0).alias("b"))
    a = S.access_log(spark, d).select(F.col("accessed_at").cast("date").alias("day"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    return q.union(a).groupBy("day").agg(F.sum("a").alias("queries"), F.sum("b").alias("accesses")).withColumn("due", F.col("queries") + F.col("accesses") > 150)


@query(sql("SELECT lang, count(*) AS groups, sum(n - 1) AS redundant, sum(n) AS total FROM (SELECT lang, content, count(*) AS n FROM memory GROUP BY lang, content HAVING count(*) > 1) GROUP BY lang", "memory"))
def dedup_report(spark: SparkSession, d: str) -> DataFrame:
    g = S.memory(spark, d).groupBy("lang", F.md5("content").alias("k")).agg(F.count("*").alias("n")).where("n > 1")
    return g.groupBy("lang").agg(F.count("*").alias("groups"), F.sum(F.col("n") - 1).alias("redundant"), F.sum("n").alias("total"))


@query(sql("SELECT id, kept, CASE WHEN bool_or(quality = 0) OVER (PARTITION BY kept) THEN 'keep' WHEN id = kept THEN 'keep' ELSE 'remove' END AS action FROM (SELECT id, min(id) OVER (PARTITION BY content) AS kept, count(*) OVER (PARTITION BY content) AS n FROM memory) LEFT JOIN labels ON doc_id = id WHERE n > 1", "memory"))
def verdict_gate(spark: SparkSession, d: str) -> DataFrame:
    v = S.table(spark, d, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("same"))
    return O.vetoed(P.dedup(S.memory(spark, d)), v).select("id", "kept", "action")


@query(sql("SELECT id, concat_ws('; ', 'by ' || author, 'level ' || level, CASE WHEN n > 0 THEN 'read ' || n || ' times' END) AS source_line FROM memory LEFT JOIN (SELECT memory_id, count(*) AS n FROM access_log GROUP BY memory_id) ON memory_id = 'v' || id", "memory", "access_log"))
def provenance(spark: SparkSession, d: str) -> DataFrame:
    reads = S.access_log(spark, d).groupBy(F.substring("memory_id", 2, 20).cast("bigint").alias("id")).agg(F.count("*").alias("n"))
    m = S.memory(spark, d).join(reads, "id", "left")
    return m.select("id", O.provenance(F.col("author"), F.col("level"), F.coalesce("n", F.lit(0))).alias("source_line"))


@query(sql("SELECT page_id, array_to_string(p[greatest(1, len(p) - 2):len(p)], ' ') AS context FROM (SELECT page_id, " + S.sql_distinct("x") + " AS p FROM (SELECT page_id, list_filter(regexp_split_to_array(url, '[/?#=&.]+'), lambda s: length(s) > 2) AS x FROM pages))"))
def context_query(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "pages").select("page_id", O.path_query(F.col("url")).alias("context"))


@query(sql("SELECT qid, id, rank, used FROM (SELECT qid, id, rank, sum(least(600, length(content))) OVER (PARTITION BY qid ORDER BY rank) AS used FROM tops JOIN memory USING (id)) WHERE rank <= 3 OR used <= 4000", "memory", "query", **_VIEWS, tops=_TOPS))
def context_budget(spark: SparkSession, d: str) -> DataFrame:
    """Hits whose summaries (600 characters at most) fit a budget of 4,000 characters; the first three always."""
    t = _tops(spark, d).join(S.memory(spark, d).select("id", F.least(F.lit(600), F.length("content")).alias("size")), "id")
    return O.within_budget(t, "size", 4000).select("qid", "id", "rank", "used")


@query()
def context_compression(spark: SparkSession, d: str) -> DataFrame:
    """For each query its hits within the budget, each compressed to the sentences with most query terms."""
    kept = context_budget(spark, d).join(S.memory(spark, d).select("id", "content"), "id").join(S.query_table(spark, d).select("qid", "strong"), "qid")
    return kept.select("qid", "id", "rank", F.substring(T.compress(F.col("content"), F.col("strong")), 1, 600).alias("short"))


@query(sql("SELECT qid, count(*) FILTER (vec IS NOT NULL) AS vector, count(*) FILTER (lex IS NOT NULL) AS lexical, count(*) FILTER (struct IS NOT NULL) AS structured, count(*) AS fused FROM fused GROUP BY qid", "memory", "query", **_VIEWS))
def channel_counts(spark: SparkSession, d: str) -> DataFrame:
    f = R.fuse(channels(spark, d))
    return f.groupBy("qid").agg(F.count("vec").alias("vector"), F.count("lex").alias("lexical"), F.count("struct").alias("structured"), F.count("*").alias("fused"))


@query(sql(f"SELECT key, arg_max(verdict, created_at) AS verdict, count(*) AS hits FROM (SELECT user_id % 40 || '-' || event_type AS key, value AS verdict, ts AS created_at FROM events WHERE event_id % 3 = 0) GROUP BY key HAVING date_diff('day', CAST(max(created_at) AS DATE), DATE '{REF_DATE}') <= 5"))
def live_judgments(spark: SparkSession, d: str) -> DataFrame:
    j = S.table(spark, d, "events").where("event_id % 3 = 0").select(F.concat_ws("-", F.col("user_id") % 40, "event_type").alias("key"), F.col("value").alias("verdict"), F.col("ts").alias("created_at"))
    return O.live(j, now(), 5).select("key", "verdict", "hits")


@query(sql("SELECT name FROM (SELECT DISTINCT lang AS name FROM memory UNION ALL SELECT role FROM (SELECT DISTINCT role FROM conversations) WHERE role NOT IN (SELECT lang FROM memory))", "memory"))
def category_seeding(spark: SparkSession, d: str) -> DataFrame:
    return O.seeded(S.memory(spark, d).select(F.col("lang").alias("name")).distinct(), S.table(spark, d, "conversations").select(F.col("role").alias("name")).distinct(), "name")


@query(sql("SELECT id, length(content) AS chars, row_number() OVER (PARTITION BY lang ORDER BY id) AS turn FROM memory WHERE embedding IS NULL", "memory"))
def backfill_scan(spark: SparkSession, d: str) -> DataFrame:
    """Rows that lack a vector, with their turn within their language."""
    m = S.memory(spark, d).where("embedding IS NULL").select("id", "lang", F.length("content").alias("chars"))
    return numbered(m, "lang", ["id"], "turn").drop("lang")


@query()
def result_export(spark: SparkSession, d: str) -> DataFrame:
    """Hits as JSON records."""
    t = _tops(spark, d).join(S.memory(spark, d).select("id", "code", "level", "date", F.substring("content", 1, 120).alias("snippet")), "id")
    return t.select("qid", "rank", F.to_json(F.struct("id", "score", R.label(F.col("score")).alias("relevance"), "code", "level", "date", "snippet")).alias("record"))


@query(sql("SELECT id, 2 * code_hits + tech_hits >= 3 AS technical FROM (SELECT id, " + " + ".join(f"CAST(contains(lower(content), '{w}') AS INT)" for w in ("token =", "{", "()")) + " AS code_hits, " + " + ".join(f"CAST(contains(lower(content), '{w}') AS INT)" for w in ("version", "license", "|", "@")) + " AS tech_hits FROM memory)", "memory"))
def technical_text(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower("content")
    count = lambda words: sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
    return S.memory(spark, d).select("id", (2 * count(("token =", "{", "()")) + count(("version", "license", "|", "@")) >= 3).alias("technical"))


@query()
def project_index(spark: SparkSession, d: str) -> DataFrame:
    """Pages as source files: each one's state against a stale manifest, and how many chunks it gives."""
    from recallum.queries.streams import file_change_detect

    chunks = T.code_chunks(S.table(spark, d, "pages"), "page_id", "html").groupBy(F.col("id").alias("page_id")).agg(F.count("*").alias("chunks"))
    return file_change_detect(spark, d).join(chunks, "page_id", "left").groupBy("state").agg(F.count("*").alias("files"), F.sum(F.coalesce("chunks", F.lit(0))).alias("chunks"))


_AGE = f"date_diff('day', date, DATE '{REF_DATE}')"
_DECAYED_LINK = f"SELECT * REPLACE (CASE WHEN after < 0.99 * weight THEN after ELSE weight END AS weight) FROM (SELECT *, round(weight * pow(0.5, date_diff('day', CAST(last_accessed AS DATE), DATE '{REF_DATE}') / 90.0), 4) AS after FROM link) WHERE after >= 0.01"


@query(
    sql(
        f"""SELECT step, action, count(*) AS n FROM (SELECT 1 AS step, 'set_level' AS action FROM memory WHERE level = 'episodic' AND {_AGE} >= 7
        UNION ALL SELECT 2, CASE WHEN after < 0.01 THEN 'delete' ELSE 'update' END FROM (SELECT weight, round(weight * pow(0.5, date_diff('day', CAST(last_accessed AS DATE), DATE '{REF_DATE}') / 90.0), 4) AS after FROM link) WHERE after < 0.01 OR after < 0.99 * weight
        UNION ALL SELECT 3, 'archive' FROM old
        UNION ALL SELECT 4, CASE WHEN id = kept THEN 'keep' ELSE 'remove' END FROM (SELECT id, min(id) OVER (PARTITION BY content) AS kept, count(*) OVER (PARTITION BY content) AS n FROM m1 WHERE id NOT IN (SELECT id FROM old)) WHERE n > 1) GROUP BY step, action""",
        "memory", "access_log", "link",
        m1=f"SELECT * REPLACE (CASE WHEN level = 'episodic' AND {_AGE} >= 7 THEN 'semantic' ELSE level END AS level) FROM memory", l1=_DECAYED_LINK,
        lasts=_LAST.replace("FROM memory m", "FROM m1 m").replace("FROM link", "FROM l1"),
        old=f"SELECT id FROM lasts WHERE date_diff('day', last, DATE '{REF_DATE}') > CASE domain_profile WHEN 'infrastructure' THEN 180 WHEN 'project_specific' THEN 90 WHEN 'temporary' THEN 14 ELSE 60 END",
    )
)
def maintenance_run(spark: SparkSession, d: str) -> DataFrame:
    """A maintenance cycle, each plan made of what the ones before have left: consolidate, decay links, forget, remove duplicates."""
    m, links = S.memory(spark, d), S.links(spark, d)
    day = F.lit(REF_DATE).cast("date")
    plans = [cut(P.consolidate(m, day))]
    m, _ = P.apply(m, plans[0])
    plans.append(cut(G.decay_plan(links, now())))
    links = P.apply_links(links, plans[1])
    plans.append(cut(P.forget(m, S.access_log(spark, d), links, day)))
    m, _ = P.apply(m, plans[2])
    plans.append(P.dedup(m))
    rows = None
    for k, p in enumerate(plans, 1):
        one = p.select(F.lit(k).alias("step"), "action")
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("step", "action").agg(F.count("*").alias("n"))


@query(sql("SELECT id, hits FROM (SELECT id, " + " + ".join(f"CAST(regexp_matches(lower(content), '{p}') AS INT)" for p in rules.EXAMPLE_HIGH) + " AS hits FROM memory) WHERE hits > 0", "memory"))
def durable_knowledge(spark: SparkSession, d: str) -> DataFrame:
    return S.memory(spark, d).select("id", rules.hits(F.col("content"), rules.EXAMPLE_HIGH).alias("hits")).where("hits > 0")

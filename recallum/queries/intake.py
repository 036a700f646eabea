"""Inserts, deletes, embeddings, rule checks and reports over the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from recallum.functions import rulesets
from recallum.functions.text import sql_summary
from recallum.operators import filters, intake as I
from recallum.plans import metrics as M
from recallum.queries import query
from recallum.queries.quality import _STATS
from recallum.queries.search import _TOPS, _VIEWS, sql_vectors
from recallum.queries.store import _tops
from recallum.queries.text import _match
from recallum.sources import tables as S
from recallum.sources.shared import cut
from recallum.sources.tables import REF_DATE, sql

_FRESH = """SELECT conv_id * 1000 + turn AS id, CASE WHEN turn % 5 = 4 THEN ' ' ELSE text END AS content, CASE turn % 4 WHEN 0 THEN 'Semantic' WHEN 1 THEN NULL WHEN 2 THEN 'automatic' ELSE 'other' END AS level, CASE WHEN conv_id % 3 = 0 THEN 'user' WHEN conv_id % 7 = 1 THEN 'robot' END AS author, CASE WHEN conv_id % 2 = 0 THEN 'profile' END AS kind, [role, CASE WHEN conv_id % 5 = 0 THEN 'docker' ELSE 'x' END] AS categories FROM conversations"""
_H, _L, _T = (" + ".join(f"CAST({_match(p)} AS INT)" for p in x) for x in (rulesets.LASTING, rulesets.PASSING, rulesets.TRADE))


def _fresh(spark: SparkSession, d: str) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    level = F.when(t % 4 == 0, "Semantic").when(t % 4 == 2, "automatic").when(t % 4 == 3, "other")
    return S.table(spark, d, "conversations").select((c * 1000 + t).alias("id"), F.when(t % 5 == 4, " ").otherwise(F.col("text")).alias("content"), level.alias("level"), F.when(c % 3 == 0, "user").when(c % 7 == 1, "robot").alias("author"), F.when(c % 2 == 0, "profile").alias("kind"), F.array("role", F.when(c % 5 == 0, "docker").otherwise("x")).alias("categories"))


@query(
    sql(
        f"""SELECT id, CASE WHEN trim(content) = '' THEN 'empty' WHEN lv NOT IN ('episodic', 'semantic', 'automatic') THEN 'level' WHEN coalesce(author, 'agent') NOT IN ('agent', 'user', 'import') THEN 'author' ELSE 'ok' END AS verdict,
        CASE WHEN (dom OR tr > 0) AND (h >= 2 OR dom) AND lv = 'episodic' THEN 'semantic' ELSE lv END AS level, coalesce(kind, 'event') AS kind, dom OR tr > 0 AS trade, CASE WHEN lv = 'automatic' THEN 0 END AS review_count, md5({sql_summary('content')}) AS summary_digest
        FROM (SELECT *, lower(coalesce(level, 'episodic')) AS lv, {_H} AS h, {_T} AS tr, list_has_any(categories, [{', '.join(repr(x) for x in rulesets.DOMAINS)}]) AS dom FROM fresh)""",
        fresh=_FRESH,
    )
)
def batch_insert(spark: SparkSession, d: str) -> DataFrame:
    got = I.insert(_fresh(spark, d), F.lit(REF_DATE).cast("date"))
    return got.select("id", "verdict", "level", "kind", "trade", "review_count", F.md5("summary").alias("summary_digest"))


@query(sql("SELECT id, len(string_split(content, chr(10))) AS chunks FROM memory WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)", "memory"))
def batch_delete(spark: SparkSession, d: str) -> DataFrame:
    """What is left of memory, with its chunks, after the toxic rows are deleted."""
    m = S.memory(spark, d).select("id", "content")
    chunks = m.select("id", F.posexplode(F.split("content", "\n")).alias("chunk_index", "content"))
    ids = S.table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    rows, left = I.delete(m, chunks, ids)
    return rows.select("id").join(left.groupBy("id").agg(F.count("*").alias("chunks")), "id")


_GRAM = S.sql_tokens("content")
_EMBED = f"""SELECT id, k, sum(s) AS s FROM (SELECT id, c % 64 AS k, CASE WHEN (c // 64) % 2 = 0 THEN 1 ELSE -1 END AS s FROM (SELECT id, CAST('0x' || md5(g)[1:4] AS INT) AS c FROM (
  SELECT id, unnest(list_distinct(flatten(list_transform({_GRAM}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))) AS g FROM out_of_sync JOIN memory USING (id)))) GROUP BY id, k"""
_SYNC = "SELECT id, CASE WHEN embedding IS NULL THEN 'missing' ELSE 'stale' END AS reason, md5(content[1:28000]) AS signature FROM memory WHERE embedding IS NULL OR id % 7 = 0"


@query(sql("SELECT o.id, reason, signature, round(nullif(max(s) FILTER (k = 5), 0) / sqrt(sum(s * s)), 6) AS fifth, round(sum(s) / sqrt(sum(s * s)), 5) AS total FROM out_of_sync o JOIN parts USING (id) GROUP BY o.id, reason, signature HAVING sum(s * s) > 0", "memory", out_of_sync=_SYNC, parts=_EMBED))
def embedding_sync(spark: SparkSession, d: str) -> DataFrame:
    """New vectors and signatures of the rows that lack them or whose text has changed (here every seventh)."""
    from recallum.queries.maintain import embedding_out_of_sync

    stale = embedding_out_of_sync(spark, d)
    v = I.embed(S.memory(spark, d).join(stale.select("id"), "id", "left_semi"), "id", "content")
    fifth = F.element_at("embedding", 6)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return stale.join(v, "id").select("id", "reason", "signature", F.round(F.when(fifth != 0, fifth), 6).alias("fifth"), F.round(total, 5).alias("total"))


@query(sql("SELECT id, reason, row_number() OVER (ORDER BY reason <> 'missing', id) AS turn FROM out_of_sync QUALIFY turn <= 100", "memory", out_of_sync=_SYNC))
def sweep_order(spark: SparkSession, d: str) -> DataFrame:
    from recallum.queries.maintain import embedding_out_of_sync

    return I.sweep(embedding_out_of_sync(spark, d).select("id", "reason"), 100)


@query(sql("SELECT lang, count(*) FILTER (embedding IS NULL) AS pending, count(*) AS total FROM memory GROUP BY lang", "memory"))
def pending_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return S.memory(spark, d).groupBy("lang").agg(F.count_if(F.col("embedding").isNull()).alias("pending"), F.count("*").alias("total"))


@query(sql("SELECT src, count(*) AS strong, max(weight) AS most FROM link WHERE rel = 'contradicts' AND weight >= 0.5 GROUP BY src", "link"))
def strong_contradictions(spark: SparkSession, d: str) -> DataFrame:
    return S.links(spark, d).where("rel = 'contradicts' AND weight >= 0.5").groupBy("src").agg(F.count("*").alias("strong"), F.max("weight").alias("most"))


@query(sql(f"SELECT key, CAST(max(ts) AS DATE) AS day FROM (SELECT user_id % 40 || '-' || event_type AS key, ts FROM events) GROUP BY key HAVING date_diff('day', CAST(max(ts) AS DATE), DATE '{REF_DATE}') > 3"))
def expired_judgments(spark: SparkSession, d: str) -> DataFrame:
    """Judgments whose last use is more than three days old."""
    e = S.table(spark, d, "events").select(F.concat_ws("-", F.col("user_id") % 40, "event_type").alias("key"), "ts")
    last = e.groupBy("key").agg(F.max("ts").cast("date").alias("day"))
    return last.where(F.datediff(F.lit(REF_DATE).cast("date"), F.col("day")) > 3)


@query(
    sql(
        """SELECT round(100.0 * redundant / n, 4) AS dup_pct, round(100.0 * cold / n, 4) AS cold_pct, round(100.0 * orphans / greatest(auto, 1), 4) AS orphan_pct, contradictions, 100.0 * redundant / n > 2 OR 100.0 * cold / n > 20 OR 100.0 * orphans / greatest(auto, 1) > 5 OR contradictions > 50 AS needed FROM (
        SELECT count(*) AS n, count(*) - count(DISTINCT md5(lower(trim(content)))) AS redundant, count(*) FILTER (level = 'automatic') AS auto, count(*) FILTER (level = 'automatic' AND id NOT IN (SELECT dst FROM link)) AS orphans, count(*) FILTER (id IN (SELECT id FROM cold)) AS cold,
        (SELECT count(*) FROM link WHERE rel = 'contradicts' AND weight >= 0.5) AS contradictions FROM memory)""",
        "memory", "access_log", "link", cold=f"SELECT id FROM memory WHERE level = 'episodic' AND date < DATE '{REF_DATE}' - 90 AND 'v' || id NOT IN (SELECT memory_id FROM access_log WHERE accessed_at >= DATE '{REF_DATE}' - 90)",
    )
)
def clearance_flag(spark: SparkSession, d: str) -> DataFrame:
    """All four criteria of a clearance over the whole store."""
    m, links = S.memory(spark, d), S.links(spark, d)
    c = M.cold(m, S.access_log(spark, d), F.lit(REF_DATE).cast("date")).select("id", F.lit(1).alias("c"))
    into = links.select(F.col("dst").alias("id")).distinct().withColumn("linked", F.lit(True))
    j = m.select("id", "level", F.md5(F.lower(F.trim("content"))).alias("k")).join(c, "id", "left").join(into, "id", "left")
    auto = F.col("level") == "automatic"
    g = j.agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct("k")).alias("redundant"), F.count_if(auto).alias("auto"), F.count_if(auto & F.col("linked").isNull()).alias("orphans"), F.count("c").alias("cold"))
    g = g.withColumn("contradictions", F.lit(links.where("rel = 'contradicts' AND weight >= 0.5").count()))
    dup, cold, orphan = 100.0 * F.col("redundant") / F.col("n"), 100.0 * F.col("cold") / F.col("n"), 100.0 * F.col("orphans") / F.greatest(F.col("auto"), F.lit(1))
    return g.select(F.round(dup, 4).alias("dup_pct"), F.round(cold, 4).alias("cold_pct"), F.round(orphan, 4).alias("orphan_pct"), "contradictions", ((dup > 2) | (cold > 20) | (orphan > 5) | (F.col("contradictions") > 50)).alias("needed"))


@query(sql("SELECT src, id, place FROM (SELECT src, id, row_number() OVER (PARTITION BY src ORDER BY weight DESC, id) AS place FROM link) WHERE place <= 5", "link"))
def explore_order(spark: SparkSession, d: str) -> DataFrame:
    """The five links of each row to explore first: heavier ones, then older ones."""
    return filters.top(S.links(spark, d), 5, "src", F.desc("weight"), F.col("id")).select("src", "id", F.col("rank").alias("place"))


@query(sql("SELECT qid, id, score AS score_before, rank AS rank_before FROM tops WHERE qid IN (SELECT qid FROM tops GROUP BY qid HAVING count(*) >= 3)", "memory", "query", **_VIEWS, tops=_TOPS))
def rerank_marks(spark: SparkSession, d: str) -> DataFrame:
    """Hits handed to an outside judge keep their score and rank; queries of fewer than three hits are not."""

    t = cut(_tops(spark, d))
    enough = t.groupBy("qid").count().where("count >= 3").select("qid")
    return t.join(enough, "qid", "left_semi").select("qid", "id", F.col("score").alias("score_before"), F.col("rank").alias("rank_before"))


@query(sql(f"SELECT method, n, p95, avg_top, array_to_string(list_filter([CASE WHEN p95 > 10000 THEN 'latency_very_high' END, CASE WHEN p95 > 5000 AND p95 <= 10000 THEN 'latency_high' END, CASE WHEN avg_top < 15 THEN 'low_relevance' END, CASE WHEN n < 10 THEN 'few_data' END], lambda x: x IS NOT NULL), ',') AS advice FROM (SELECT method, {_STATS} FROM query_log GROUP BY method)", "query_log"))
def recommendations(spark: SparkSession, d: str) -> DataFrame:
    return I.recommended(M.stats(S.query_log(spark, d), "method")).select("method", "n", "p95", "avg_top", "advice")


@query(sql("SELECT event_id, CAST(regexp_replace(memory_id, '[^0-9]', '', 'g') AS BIGINT) AS number, '#' || regexp_replace(memory_id, '[^0-9]', '', 'g') AS readable FROM access_log", "access_log"))
def readable_ids(spark: SparkSession, d: str) -> DataFrame:
    digits = F.regexp_replace("memory_id", "[^0-9]", "")
    return S.access_log(spark, d).select("event_id", digits.cast("bigint").alias("number"), F.concat(F.lit("#"), digits).alias("readable"))


@query(sql("SELECT page_id, path FROM watched ANTI JOIN (SELECT page_id FROM pages WHERE page_id % 5 = 0) g USING (page_id)", watched="SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'new:' || url ELSE url END AS path FROM pages WHERE page_id % 2 = 0 OR page_id % 3 = 0"))
def watch_register(spark: SparkSession, d: str) -> DataFrame:
    """A register of watched paths: the even pages, with every third added or replaced, and every fifth removed."""
    p = S.table(spark, d, "pages").select("page_id", F.col("url").alias("path"))
    new = p.where("page_id % 3 = 0").withColumn("path", F.concat(F.lit("new:"), "path"))
    return I.register(p.where("page_id % 2 = 0"), new, p.where("page_id % 5 = 0"), "page_id")


@query(sql("SELECT lang, sum(length(content)) AS taken, sum(least(600, length(content))) AS given, round(1 - sum(least(600, length(content))) / greatest(sum(length(content)), 1), 6) AS ratio FROM memory GROUP BY lang", "memory"))
def compression_totals(spark: SparkSession, d: str) -> DataFrame:
    """What summaries of 600 characters at most save."""
    size = F.length("content")
    g = S.memory(spark, d).groupBy("lang").agg(F.sum(size).alias("taken"), F.sum(F.least(F.lit(600), size)).alias("given"))
    return g.withColumn("ratio", F.round(1 - F.col("given") / F.greatest(F.col("taken"), F.lit(1)), 6))


_NAMED = r"SELECT DISTINCT id, name FROM (SELECT id, unnest(list_filter(regexp_extract_all(lower(content), '(?:the|und|de)\s+(\S+)', 1), lambda x: length(x) >= 9)) AS name FROM memory WHERE level = 'automatic')"


@query(sql("SELECT a.name, count(DISTINCT a.id) AS rules FROM named a GROUP BY a.name HAVING count(DISTINCT a.id) > 1", "memory", named=_NAMED))
def same_file_rules(spark: SparkSession, d: str) -> DataFrame:
    """Names (here long words after an article) that several automatic rules speak of."""
    names = F.filter(F.regexp_extract_all(F.lower("content"), F.lit(r"(?:the|und|de)\s+(\S+)"), F.lit(1)), lambda x: F.length(x) >= 9)
    named = S.memory(spark, d).where("level = 'automatic'").select("id", F.explode(names).alias("name")).distinct()
    return named.groupBy("name").agg(F.count("*").alias("rules")).where("rules > 1")


@query()
def negation_probe(spark: SparkSession, d: str) -> DataFrame:
    """For each row with a successor whether the successor is nearer to the row's negation than to the row, by default embeddings."""
    m = S.memory(spark, d).select("id", F.col("content").alias("t"))
    own = cut(I.embed(m, "id", "t", before=["no"]).where("embedding_1 IS NOT NULL"))
    after = own.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("b_v"))
    return I.contradicts(own.withColumnsRenamed({"embedding": "a_v", "embedding_1": "probe_v"}).join(after, "id")).select("id", "contradicts")


_SAYS = "SELECT conv_id * 1000 + turn AS id, text AS content FROM conversations"
_VETO = "SELECT c.id, doc_id AS neighbour FROM says c JOIN labels ON doc_id % 50 = c.id % 50"


@query(
    sql(
        "SELECT s.id, md5(content[1:28000]) AS signature, CASE " + " ".join(f"WHEN {_match(p)} THEN {k}" for k, p in enumerate(rulesets.SCREEN, 1)) + """ END AS rule, neighbour, similarity, CASE WHEN similarity >= 0.92 THEN 'similar' WHEN similarity IS NOT NULL THEN 'related' END AS rel FROM says s LEFT JOIN (SELECT * FROM near WHERE r <= 3 AND (id, neighbour) NOT IN (SELECT (id, neighbour) FROM veto)) n ON n.id = s.id""", "memory",
        says=_SAYS, veto=_VETO, sv=sql_vectors("says", "id", "content"), mv=sql_vectors("memory", "id", "content"),
        dots="SELECT a.id, b.id AS neighbour, sum(a.s * b.s) / sqrt(any_value(a.n) * any_value(b.n)) AS c FROM (SELECT *, sum(s * s) OVER (PARTITION BY id) AS n FROM sv) a JOIN (SELECT *, sum(s * s) OVER (PARTITION BY id) AS n FROM mv) b USING (k) WHERE a.n > 0 AND b.n > 0 AND a.id <> b.id GROUP BY a.id, b.id",
        near="SELECT id, neighbour, similarity, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, neighbour) AS r FROM (SELECT id, neighbour, round(c, 6) AS similarity FROM dots) WHERE similarity >= 0.6",
    )
)
def semantic_audit(spark: SparkSession, d: str) -> DataFrame:
    """All turns of conversations as new rows against all memory: signature, screening rule and up to three links, but for those that a verdict vetoes."""
    from recallum.streaming.audit import audit

    says = S.table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("content"))
    verdicts = S.table(spark, d, "labels").select(F.col("doc_id").alias("neighbour")).distinct()
    veto = lambda links: links.where(F.col("id") % 50 == F.col("neighbour") % 50).join(verdicts, "neighbour").withColumn("veto", F.lit(True))  # noqa: E731  of the links alone, as all pairs of turns and labels are many
    table = cut(I.embed(S.memory(spark, d), "id", "content"))  # read once for each block of turns
    return audit(says, table, veto).select("id", "signature", "rule", "neighbour", "similarity", "rel")


_AGED = f"SELECT CASE WHEN coalesce(level, 'episodic') = 'episodic' AND date_diff('day', date, DATE '{REF_DATE}') >= 7 THEN 'semantic' ELSE level END AS level FROM memory"


@query(sql("SELECT 1 AS version, level, count(*) AS n FROM memory GROUP BY level UNION ALL SELECT 2, level, count(*) FROM aged GROUP BY level", "memory", aged=_AGED))
def versioned_maintenance(spark: SparkSession, d: str) -> DataFrame:
    """Memory as version 1 of a table, consolidation applied to it as version 2: rows by level in both."""
    import uuid

    from recallum.plans import lifecycle as P
    from recallum.plans.versions import Versions
    from recallum.sources.shared import shared_dir

    table = Versions(spark, f"{shared_dir(spark)}/memory-{uuid.uuid4().hex}")
    first = table.commit(S.memory(spark, d).select("id", "content", "embedding", "level", "tags", "date"), 0, "load")
    now = table.read(first)
    after, _ = P.apply(now, P.consolidate(now, F.lit(REF_DATE).cast("date")))
    table.commit(after, first, "consolidation")
    of = lambda v: table.read(v).groupBy("level").agg(F.count("*").alias("n")).select(F.lit(v).alias("version"), "level", "n")
    return of(1).unionByName(of(2))

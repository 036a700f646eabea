"""Typed views of the memory domain over the driver tables, and the same views as SQL.

Every loader takes (spark, dir) and stays lazy; sizes that a view depends on are
Parquet row counts.  `REF_NOW` is the "now" of all time-dependent jobs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

REF_NOW, REF_DATE = "2024-02-01 00:00:00", "2024-02-01"
TOKEN = r"[\p{L}\p{N}_]+"
#: Words that neither discover nor expand; an example set, a parameter of the operators that use it.
STOPWORDS = ["the", "and", "that", "with", "for", "from", "this", "was", "are", "une", "les", "des", "que", "der", "die", "und", "los", "las"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def strong_terms(text: Column, most: int = 12, stopwords: list[str] = STOPWORDS) -> Column:
    """Distinct tokens of three characters or more that are no stopwords, in order of appearance."""
    kept = F.filter(F.array_distinct(tokens(text)), lambda t: (F.length(t) >= 3) & ~t.isin(stopwords))
    return F.slice(kept, 1, most)


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    i = F.col("doc_id")
    return d.join(e, d.doc_id == e.vec_id, "left").select(
        i.alias("id"), F.col("text").alias("content"), F.col("embedding").cast("array<double>").alias("embedding"), F.concat_ws("_", "source", "lang").alias("code"), F.array("lang", "source").alias("categories"), F.array(F.col("lang"), F.concat(F.lit("m"), i % 7)).alias("tags"),
        F.concat(F.lit("s"), i % 50).alias("session_id"), F.element_at(F.array(F.lit("agent"), F.lit("user"), F.lit("import")), (i % 3 + 1).cast("int")).alias("author"),
        F.when(i % 10 == 0, "automatic").when((i % 10).isin(1, 2, 3), "semantic").otherwise("episodic").alias("level"), (i % 17 == 0).alias("critical"), (i % 13 == 0).alias("trade"), (i % 3).cast("int").alias("review_count"),
        F.when(i % 4 == 0, "infrastructure").when(i % 4 == 1, "project_specific").when(i % 4 == 2, "temporary").alias("domain_profile"), F.date_add(F.lit("2023-06-01").cast("date"), (i % 300).cast("int")).alias("date"), "lang", "source",
    )


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").count()
    u, e = F.col("user_id"), F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("v"), (u * u * 7 + e % 3) % n).alias("memory_id"), F.col("ts").alias("accessed_at"), F.col("event_type").alias("source"), "user_id")


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.floor(F.col("value") * 10).cast("int").alias("latency_ms"), F.col("event_type").alias("method"), F.col("value").alias("top_score"), (F.col("event_id") % 11).cast("int").alias("results_count"), F.col("ts").alias("created_at"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, v = table(spark, sf_dir, "documents").count(), table(spark, sf_dir, "embeddings").count()
    g = int(0.6 * min(n, v))
    e = F.col("event_id")
    rel = F.create_map(*[F.lit(x) for x in ("error", "contradicts", "click", "similar", "view", "follow_up", "purchase", "part_of", "signup", "related")])[F.col("event_type")]
    rows = table(spark, sf_dir, "events").select(
        e.alias("id"), (e % g).alias("src"), (((e % g) * 7 + F.floor(e / g) * 37 + 3) % g + F.when(e % 97 == 0, 100000).otherwise(0)).cast("bigint").alias("dst"), F.least(F.lit(1.0), F.col("value") / 50).alias("weight"), F.col("ts").alias("last_accessed"), F.coalesce(rel, F.lit("related")).alias("rel"),
    )
    first = rows.where("src <> dst").groupBy("src", "dst", "rel").agg(F.min_by(F.struct("id", "weight", "last_accessed"), "id").alias("r"))
    return first.select("r.id", "src", "dst", "rel", "r.weight", "r.last_accessed")


def query_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries of all batch searches: benchmark passages with their terms and vectors."""
    b, e = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "embeddings")
    clean = F.array_join(tokens(F.col("text")), " ")
    return b.join(e, b.item_id == e.vec_id, "left").select(F.col("item_id").alias("qid"), "text", clean.alias("clean"), F.array_distinct(tokens(clean)).alias("terms"), strong_terms(clean).alias("strong"), F.col("embedding").cast("array<double>").alias("embedding"))


_N = "(SELECT count(*) FROM documents)"
_G = "(SELECT CAST(floor(0.6 * least((SELECT count(*) FROM documents), (SELECT count(*) FROM embeddings))) AS BIGINT))"
_TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def sql_tokens(x: str) -> str:
    return _TOKENS.format(x)


def sql_distinct(x: str) -> str:
    """A list's distinct elements in order of appearance."""
    return f"list_filter({x}, lambda t, i: list_position({x}, t) = i)"


def sql_strong(x: str) -> str:
    t = sql_tokens(x)
    return f"list_filter({sql_distinct(t)}, lambda t: length(t) >= 3 AND t NOT IN ({_STOP}))[1:12]"


_CLEAN = f"array_to_string({sql_tokens('text')}, ' ')"
SQL_VIEWS = {
    "memory": """SELECT doc_id AS id, text AS content, CAST(embedding AS DOUBLE[]) AS embedding, source || '_' || lang AS code, [lang, source] AS categories, [lang, 'm' || (doc_id % 7)] AS tags, 's' || (doc_id % 50) AS session_id,
       ['agent', 'user', 'import'][doc_id % 3 + 1] AS author, CASE WHEN doc_id % 10 = 0 THEN 'automatic' WHEN doc_id % 10 IN (1, 2, 3) THEN 'semantic' ELSE 'episodic' END AS level, doc_id % 17 = 0 AS critical, doc_id % 13 = 0 AS trade, CAST(doc_id % 3 AS INT) AS review_count,
       CASE doc_id % 4 WHEN 0 THEN 'infrastructure' WHEN 1 THEN 'project_specific' WHEN 2 THEN 'temporary' END AS domain_profile, DATE '2023-06-01' + CAST(doc_id % 300 AS INT) AS date, lang, source
       FROM documents LEFT JOIN embeddings ON vec_id = doc_id""",
    "access_log": f"SELECT event_id, 'v' || ((user_id * user_id * 7 + event_id % 3) % {_N}) AS memory_id, ts AS accessed_at, event_type AS source, user_id FROM events",
    "query_log": "SELECT event_id, CAST(floor(value * 10) AS INT) AS latency_ms, event_type AS method, value AS top_score, CAST(event_id % 11 AS INT) AS results_count, ts AS created_at FROM events",
    "link": f"""SELECT arg_min(id, id) AS id, src, dst, rel, arg_min(weight, id) AS weight, arg_min(last_accessed, id) AS last_accessed FROM (
       SELECT event_id AS id, event_id % {_G} AS src, ((event_id % {_G}) * 7 + (event_id // {_G}) * 37 + 3) % {_G} + CASE WHEN event_id % 97 = 0 THEN 100000 ELSE 0 END AS dst, least(1.0, value / 50) AS weight, ts AS last_accessed,
       CASE event_type WHEN 'error' THEN 'contradicts' WHEN 'click' THEN 'similar' WHEN 'view' THEN 'follow_up' WHEN 'purchase' THEN 'part_of' ELSE 'related' END AS rel FROM events) WHERE src <> dst GROUP BY src, dst, rel""",
    "query": f"SELECT item_id AS qid, text, {_CLEAN} AS clean, {sql_distinct(sql_tokens(_CLEAN))} AS terms, {sql_strong(_CLEAN)} AS strong, CAST(embedding AS DOUBLE[]) AS embedding FROM benchmark LEFT JOIN embeddings ON vec_id = item_id",
}


def sql(body: str, *views: str, **more: str) -> str:
    """`body` after WITH clauses for the named views and further ones."""
    parts = [f"{v} AS ({SQL_VIEWS[v]})" for v in views] + [f"{k} AS ({v})" for k, v in more.items()]
    return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body

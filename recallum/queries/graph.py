"""The link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from recallum.operators import filters, graph as G, knn as K
from recallum.queries import query
from recallum.sources import tables as S
from recallum.sources.tables import REF_NOW, sql


@query(
    sql(
        f"""SELECT id, before, after, CASE WHEN after < 0.01 THEN 'delete' ELSE 'update' END AS action FROM (SELECT id, weight AS before, round(weight * pow(0.5, date_diff('day', CAST(last_accessed AS DATE), DATE '{REF_NOW[:10]}') / 90.0), 4) AS after FROM link) WHERE after < 0.01 OR after < 0.99 * before""",
        "link",
    )
)
def link_decay(spark: SparkSession, d: str) -> DataFrame:
    return G.decay_plan(S.links(spark, d), F.lit(REF_NOW).cast("timestamp"))


@query(
    sql(
        "SELECT root, node, min(level) AS level FROM walk GROUP BY root, node", "link",
        parts="SELECT DISTINCT src, dst FROM link",
        walk="SELECT DISTINCT src AS root, src AS node, 0 AS level FROM link WHERE src % 50 = 0 UNION SELECT root, dst, level + 1 FROM walk JOIN parts ON src = node WHERE level < 3",
    )
)
def graph_bfs(spark: SparkSession, d: str) -> DataFrame:
    links = S.links(spark, d)
    roots = links.where("src % 50 = 0").select(F.col("src").alias("node")).distinct()
    return G.bfs(links, roots, depth=3)


@query(
    sql(
        "SELECT src, dst, min(level) AS hops FROM (SELECT root AS src, node AS dst, level FROM walk) SEMI JOIN pairs p USING (src, dst) GROUP BY src, dst", "link",
        edges="SELECT src AS a, dst AS b FROM link UNION SELECT dst, src FROM link",
        pairs="SELECT DISTINCT src, (src * 7 + 11 * k * k) % (SELECT max(src) + 1 FROM link) AS dst FROM link, range(1, 21) t(k) WHERE src % 50 = 0",
        walk="SELECT DISTINCT src AS root, src AS node, 0 AS level FROM pairs UNION SELECT root, b, level + 1 FROM walk JOIN edges ON a = node WHERE level < 5",
    )
)
def shortest_path(spark: SparkSession, d: str) -> DataFrame:
    return G.shortest_paths(S.links(spark, d), _goals(spark, d), max_hops=5)


def _goals(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of ends: twenty goals for every fiftieth node."""
    links = S.links(spark, d)
    nodes = links.agg(F.max("src") + 1).first()[0] or 1
    goals = F.explode(F.array(*[(F.col("src") * 7 + 11 * k * k) % nodes for k in range(1, 21)]))
    return links.where("src % 50 = 0").select("src", goals.alias("dst")).distinct()


_PAIRS = "SELECT DISTINCT src, (src * 7 + 11 * k * k) % (SELECT max(src) + 1 FROM link) AS dst FROM link, range(1, 21) t(k) WHERE src % 50 = 0"


def _tree(key: str) -> str:
    """Trees of two levels at most from all ends: (end, node, level, parent, link)."""
    level = lambda n, before: f"SELECT e, b AS node, {n} AS level, arg_min(a, (link, a)) AS parent, min(link) AS link FROM ({before}) JOIN steps ON a = node GROUP BY e, b"
    zero = f"SELECT DISTINCT {key} AS e, {key} AS node FROM pairs"
    one = level(1, zero) + " HAVING b <> e"
    two = level(2, f"SELECT e, node FROM ({one})") + f" HAVING b <> e AND (e, b) NOT IN (SELECT (e, node) FROM ({one}))"
    return f"SELECT e, node, 0 AS level, NULL AS parent, NULL AS link FROM ({zero}) UNION ALL ({one}) UNION ALL ({two})"


_MET = """SELECT src, dst, src AS node, 0 AS hops FROM pairs WHERE src = dst AND src IN (SELECT a FROM steps) UNION ALL
  SELECT src, dst, min(node), arg_min(hops, hops) FROM (SELECT *, min(hops) OVER (PARTITION BY src, dst) AS least FROM (SELECT src, dst, f.node, f.level + b.level AS hops FROM pairs JOIN fwd f ON f.e = src JOIN bwd b ON b.e = dst AND b.node = f.node WHERE src <> dst AND f.level - b.level IN (0, 1))) WHERE hops = least GROUP BY src, dst"""


@query(
    sql(
        """SELECT m.src, m.dst, m.hops, array_to_string(list_filter([f2.parent, f.parent, m.node, b.parent, b2.parent], lambda x: x IS NOT NULL), '-') AS nodes, array_to_string(list_filter([f2.link, f.link, b.link, b2.link], lambda x: x IS NOT NULL), '-') AS links
        FROM met m LEFT JOIN fwd f ON f.e = m.src AND f.node = m.node LEFT JOIN fwd f2 ON f2.e = m.src AND f2.node = f.parent LEFT JOIN bwd b ON b.e = m.dst AND b.node = m.node LEFT JOIN bwd b2 ON b2.e = m.dst AND b2.node = b.parent""",
        "link",
        steps="SELECT a, b, min(link) AS link FROM (SELECT src AS a, dst AS b, id AS link FROM link UNION ALL SELECT dst, src, id FROM link) WHERE a <> b GROUP BY a, b", pairs=_PAIRS, fwd=_tree("src"), bwd=_tree("dst"), met=_MET,
    )
)
def link_paths(spark: SparkSession, d: str) -> DataFrame:
    """Shortest paths of up to four hops, node by node and link by link."""
    got = G.paths(S.links(spark, d), _goals(spark, d), max_hops=4)
    return got.select("src", "dst", "hops", F.array_join("nodes", "-").alias("nodes"), F.array_join("links", "-").alias("links"))


_EDGES = "SELECT src, dst AS node, max(weight) AS weight, arg_max(id, (weight, -id)) AS link FROM link WHERE src <> dst GROUP BY src, dst"


def _grown(level: int, front: str, seen: str) -> str:
    return f"""SELECT root, node, {level} AS level, parent, link, weight FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY weight DESC, link) AS r FROM (
      SELECT f.root, e.node, max(e.weight) AS weight, arg_max(e.link, (e.weight, -e.link)) AS link, arg_max(e.src, (e.weight, -e.link)) AS parent FROM {front} f JOIN edges e ON e.src = f.node WHERE (f.root, e.node) NOT IN (SELECT (root, node) FROM ({seen})) GROUP BY f.root, e.node)) x
      WHERE r <= 12 - (SELECT count(*) FROM ({seen}) s WHERE s.root = x.root)"""


_ROOT = "SELECT DISTINCT src AS root, src AS node FROM link WHERE src % 50 = 0"
_SEEN = "SELECT root, node FROM zero UNION ALL SELECT root, node FROM one"


@query(
    sql(
        "SELECT root, node, level, parent, link, weight FROM (SELECT root, node, 0 AS level, NULL AS parent, NULL AS link, NULL AS weight FROM zero UNION ALL SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three)", "link",
        edges=_EDGES, zero=_ROOT, one=_grown(1, "zero", "SELECT root, node FROM zero"), two=_grown(2, "one", _SEEN), three=_grown(3, "two", f"{_SEEN} UNION ALL SELECT root, node FROM two"),
    )
)
def graph_explore(spark: SparkSession, d: str) -> DataFrame:
    """The heaviest links first, three levels, at most twelve nodes a root."""
    links = S.links(spark, d)
    return G.explore(links, links.where("src % 50 = 0").select(F.col("src").alias("node")).distinct(), depth=3, most=12)


@query(
    sql(
        """SELECT rel, count(*) AS links, count(*) FILTER (id IN (SELECT unnest([f2.link, f.link, b.link, b2.link]) FROM met m LEFT JOIN fwd f ON f.e = m.src AND f.node = m.node LEFT JOIN fwd f2 ON f2.e = m.src AND f2.node = f.parent LEFT JOIN bwd b ON b.e = m.dst AND b.node = m.node LEFT JOIN bwd b2 ON b2.e = m.dst AND b2.node = b.parent)) AS reinforced FROM link GROUP BY rel""",
        "link",
        steps="SELECT a, b, min(link) AS link FROM (SELECT src AS a, dst AS b, id AS link FROM link UNION ALL SELECT dst, src, id FROM link) WHERE a <> b GROUP BY a, b", pairs=_PAIRS, fwd=_tree("src"), bwd=_tree("dst"), met=_MET,
    )
)
def path_reinforcement(spark: SparkSession, d: str) -> DataFrame:
    """Links on the paths found are reinforced: how many of each kind."""
    links = S.links(spark, d)
    after = G.reinforced(links, G.paths(links, _goals(spark, d), max_hops=4), F.lit(S.REF_NOW))
    return after.groupBy("rel").agg(F.count("*").alias("links"), F.count("reinforced_at").alias("reinforced"))


@query(sql("SELECT count(DISTINCT src) AS sources, count(*) AS edges, count(DISTINCT rel) AS types FROM link", "link"))
def graph_overview(spark: SparkSession, d: str) -> DataFrame:
    return G.overview(S.links(spark, d))


@query(sql("SELECT coalesce(a.node, b.node) AS node, coalesce(o, 0) AS \"out\", coalesce(i, 0) AS \"in\" FROM (SELECT src AS node, count(*) AS o FROM link GROUP BY src) a FULL JOIN (SELECT dst AS node, count(*) AS i FROM link GROUP BY dst) b USING (node)", "link"))
def graph_degrees(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(S.links(spark, d))


@query(sql("SELECT id, 'src' AS side FROM link WHERE src NOT IN (SELECT id FROM memory) UNION ALL SELECT id, 'dst' FROM link WHERE dst NOT IN (SELECT id FROM memory)", "link", "memory"))
def orphan_links(spark: SparkSession, d: str) -> DataFrame:
    return G.orphans(S.links(spark, d), S.table(spark, d, "documents").select(F.col("doc_id").alias("id")))


_NEAR = "SELECT a.id AS qid, b.id AS id, round(list_cosine_similarity(a.embedding, b.embedding), 6) AS similarity FROM memory a, memory b WHERE a.id % 50 = 0 AND a.id <> b.id AND a.embedding IS NOT NULL AND b.embedding IS NOT NULL"


def _near(spark: SparkSession, d: str, lo: float, hi: float, k: int) -> DataFrame:
    """At least the k nearest other rows within a window of similarity for every fiftieth row; the rest stay in the tasks."""
    m = S.memory(spark, d).select("id", "embedding")
    q = m.where("id % 50 = 0").select(F.col("id").alias("qid"), "embedding")
    near = K.similarities(q, m, lo - 6e-7, hi + 6e-7, k + 4).where("qid <> id").withColumn("similarity", F.round("similarity", 6))
    return near.where(F.col("similarity").between(lo, hi))


@query(sql("SELECT src, dst, rel, weight FROM (SELECT qid AS src, id AS dst, 'similar' AS rel, similarity AS weight, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) AS r FROM near WHERE similarity >= 0.25) n ANTI JOIN link l USING (src, dst, rel) WHERE r <= 3", "memory", "link", near=_NEAR))
def auto_link(spark: SparkSession, d: str) -> DataFrame:
    """Up to three `similar` links for each new row (every fiftieth) to its nearest rows, unless they exist."""
    return G.link_plan(_near(spark, d, 0.25, 2.0, 3), S.links(spark, d), "similar", 3)


@query(sql("SELECT qid, id, similarity, a.quality IS DISTINCT FROM b.quality AS differs, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) AS rank FROM near WHERE similarity BETWEEN 0.1 AND 0.3) n LEFT JOIN labels a ON a.doc_id = qid LEFT JOIN labels b ON b.doc_id = id WHERE rank <= 5", "memory", near=_NEAR))
def contradiction_window(spark: SparkSession, d: str) -> DataFrame:
    """Five nearest rows within a window of similarity, with whether the verdicts of the two differ."""
    v = S.table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality")
    near = filters.top(_near(spark, d, 0.1, 0.3, 5), 5, "qid", F.desc("similarity"), F.col("id"))
    a = near.join(v.withColumnsRenamed({"id": "qid", "quality": "qa"}), "qid", "left").join(v.withColumnRenamed("quality", "qb"), "id", "left")
    return a.select("qid", "id", "similarity", (~F.col("qa").eqNullSafe(F.col("qb"))).alias("differs"), "rank")


@query(
    sql(
        """SELECT src, dst, rel, CASE WHEN src = dst THEN 'self' WHEN src NOT IN (SELECT id FROM memory) OR dst NOT IN (SELECT id FROM memory) THEN 'missing' WHEN (src, dst, rel) IN (SELECT (src, dst, rel) FROM link) THEN 'duplicate' ELSE 'ok' END AS verdict FROM fresh""",
        "memory", "link", fresh="SELECT DISTINCT src, CASE WHEN id % 5 = 0 THEN src ELSE dst END AS dst, CASE WHEN id % 3 = 0 THEN 'related' ELSE rel END AS rel FROM link",
    )
)
def link_validate(spark: SparkSession, d: str) -> DataFrame:
    links = S.links(spark, d)
    fresh = links.select("src", F.when(F.col("id") % 5 == 0, F.col("src")).otherwise(F.col("dst")).alias("dst"), F.when(F.col("id") % 3 == 0, "related").otherwise(F.col("rel")).alias("rel")).distinct()
    return G.validate(fresh, S.table(spark, d, "documents").select(F.col("doc_id").alias("id")), links)


@query(sql("SELECT node, \"out\", rank FROM (SELECT src AS node, count(*) AS \"out\", row_number() OVER (ORDER BY count(*) DESC, src) AS rank FROM link GROUP BY src) WHERE rank <= 20", "link"))
def graph_top_sources(spark: SparkSession, d: str) -> DataFrame:
    """The twenty nodes with most outgoing links."""
    most = S.links(spark, d).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out")).orderBy(F.desc("out"), "node").limit(20)
    return most.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("out"), "node")))  # of twenty rows

"""Filters, lexical and vector search, fusion and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from recallum.functions import rules, rulesets, text as T, vectors as V
from recallum.operators import filters, knn as K, lexical as L, places as P, rank as R
from recallum.queries import query
from recallum.sources import tables as S
from recallum.sources.shared import cut
from recallum.sources.tables import REF_DATE, REF_NOW, sql


@query(sql("SELECT id, code, level, CAST(date AS VARCHAR) AS date_s FROM memory WHERE list_has_any(categories, ['en', 'src3']) AND lower(level) = 'semantic' AND CAST(date AS VARCHAR) BETWEEN '2023-07-01' AND '2024-02-15'", "memory"))
def structured_filter(spark: SparkSession, d: str) -> DataFrame:
    where = filters.structured(categories=["en", "src3"], level="SEMANTIC", after="2023-07-01", before="2024-02-15")
    return S.memory(spark, d).where(where).select("id", "code", "level", F.col("date").cast("string").alias("date_s"))


#: Query strings made of each passage: filters with synonyms, lists and repeats, a phrase, a number and plain words.
_RAW = """CASE item_id % 4 WHEN 0 THEN 'code:src' || (item_id % 20) || '_en since:' || (item_id % 400) || 'd' WHEN 1 THEN 'Cat:en,src' || (item_id % 20) || '; level:Semantic type:agent' WHEN 2 THEN '#' || item_id || ' until:today' ELSE 'session:s' || (item_id % 50) || ' level:x nivel:episodic' END || ' "' || replace(text, '"', ' ') || '" ' || text"""
_PAIRS = rf"""SELECT qid, phrases, bare, list_transform(list_zip(regexp_extract_all(bare, '{filters.FILTER}', 1), regexp_extract_all(bare, '{filters.FILTER}', 2)), lambda p: struct_pack(k := lower(p[1]), v := regexp_replace(p[2], '^[,;]+|[,;]+$', '', 'g'))) AS pairs
  FROM (SELECT qid, list_filter(list_transform(regexp_extract_all(raw, '{filters.PHRASE}', 1), lambda p: trim(p)), lambda p: p <> '') AS phrases, regexp_replace(raw, '{filters.PHRASE}', ' ', 'g') AS bare FROM (SELECT item_id AS qid, trim({_RAW}) AS raw FROM benchmark))"""


def _values(name: str) -> str:
    keys = ", ".join(f"'{k}'" for k in filters.KEYS[name].split("|"))
    return f"list_transform(list_filter(pairs, lambda p: p.k IN ({keys}) AND p.v <> ''), lambda p: p.v)"


def _listed(name: str) -> str:
    return f"list_filter(flatten(list_transform({_values(name)}, lambda v: regexp_split_to_array(v, '[,;]'))), lambda v: v <> '')"


def _date(name: str) -> str:
    v = f"{_values(name)}[-1]"
    return f"CASE WHEN lower({v}) IN ('today', 'hoy') THEN '{REF_DATE}' WHEN regexp_matches(lower({v}), '^[0-9]{{1,4}}d$') THEN CAST(DATE '{REF_DATE}' - CAST(regexp_extract({v}, '^([0-9]+)', 1) AS INT) AS VARCHAR) ELSE {v} END"


_COMPILED = rf"""SELECT qid, {_values('code')}[-1] AS code, {_listed('category')} AS categories, lower({_values('level')}[-1]) AS level, lower({_values('kind')}[-1]) AS kind,
  CASE WHEN len({_listed('id')}) > 0 THEN {_listed('id')} WHEN regexp_extract(bare, '{filters.NUMBER}', 1) <> '' THEN [regexp_extract(bare, '{filters.NUMBER}', 1)] ELSE [] END AS ids, {_date('after')} AS after, {_date('before')} AS before, {_values('session')}[-1] AS session, phrases,
  trim(regexp_replace(regexp_replace(regexp_replace(bare, '{filters.FILTER}', ' ', 'g'), '(^|[^\p{{L}}\p{{N}}_])#\d{{1,9}}($|\D)', '\1 \2', 'g'), '\s+', ' ', 'g'), ' ,;') AS clean FROM pairs_of"""


def _compiled(spark: SparkSession, d: str) -> DataFrame:
    raw = S.table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.expr(_RAW).alias("raw"))
    return filters.compile_queries(raw, REF_DATE)


@query(sql("SELECT qid, code, array_to_string(categories, ',') AS categories, level, kind, array_to_string(ids, ',') AS ids, after, before, session, array_to_string(phrases, '|') AS phrases, clean FROM compiled", pairs_of=_PAIRS, compiled=_COMPILED))
def filter_compile(spark: SparkSession, d: str) -> DataFrame:
    c = _compiled(spark, d)
    return c.select("qid", "code", F.array_join("categories", ",").alias("categories"), "level", "kind", F.array_join("ids", ",").alias("ids"), "after", "before", "session", F.array_join("phrases", "|").alias("phrases"), "clean")


@query(
    sql(
        """SELECT qid, m.id FROM compiled c, memory m WHERE (c.code IS NOT NULL OR len(c.categories) > 0 OR c.level IS NOT NULL OR kind IS NOT NULL OR len(ids) > 0 OR after IS NOT NULL OR before IS NOT NULL OR session IS NOT NULL)
        AND (c.code IS NULL OR lower(m.code) = lower(c.code)) AND (len(c.categories) = 0 OR list_has_any(m.categories, c.categories)) AND (c.level IS NULL OR lower(m.level) = c.level) AND (kind IS NULL OR author = kind) AND (len(ids) = 0 OR list_contains(ids, CAST(m.id AS VARCHAR)))
        AND (after IS NULL OR CAST(date AS VARCHAR) >= after) AND (before IS NULL OR CAST(date AS VARCHAR) <= before) AND (session IS NULL OR session_id = session)""",
        "memory", pairs_of=_PAIRS, compiled=_COMPILED,
    )
)
def prefilter_ids(spark: SparkSession, d: str) -> DataFrame:
    """The rows that each compiled query's filters leave to its channels."""
    return filters.allowed(_compiled(spark, d), S.memory(spark, d))


@query(
    sql(
        "SELECT raw, id, level, code FROM (SELECT ['', '#', 'v', 'l', 'tv', 'vmi'][1 + conv_id % 6] || conv_id AS raw, CASE WHEN conv_id % 6 < 5 THEN conv_id END AS target FROM conversations GROUP BY conv_id) LEFT JOIN memory ON id = target",
        "memory",
    )
)
def lookup_by_id(spark: SparkSession, d: str) -> DataFrame:
    form = F.element_at(F.array(*map(F.lit, ["", "#", "v", "l", "tv", "vmi"])), (F.col("conv_id") % 6 + 1).cast("int"))
    raw = S.table(spark, d, "conversations").select("conv_id").distinct().select(F.concat(form, F.col("conv_id")).alias("raw"))
    return filters.lookup(raw, S.memory(spark, d)).select("raw", "id", "level", "code")


@query(sql("SELECT id, code, CAST(date AS VARCHAR) AS date_s, 75 AS score FROM memory WHERE level = 'semantic' ORDER BY date DESC NULLS LAST, id DESC LIMIT 20 OFFSET 20", "memory"))
def structured_listing(spark: SparkSession, d: str) -> DataFrame:
    rows = S.memory(spark, d).where(filters.structured(level="semantic"))
    return filters.page(rows, 20, 20).select("id", "code", F.col("date").cast("string").alias("date_s"), F.lit(75).alias("score"))


_TRIGGERS = "SELECT qid, unnest(CASE qid % 4 WHEN 0 THEN ['en', 'src' || (qid % 20)] WHEN 1 THEN ['fr', 'src' || (qid % 20)] WHEN 2 THEN ['de', 'src' || (qid % 20)] ELSE ['es', 'src' || (qid % 20)] END) AS c FROM query"


@query(
    sql(
        """SELECT qid, id, hits, score, rank FROM (SELECT *, CASE WHEN hits = 2 THEN 100.0 ELSE 30.0 END AS score, row_number() OVER (PARTITION BY qid ORDER BY hits DESC, auto DESC, date DESC NULLS LAST, id) AS rank FROM (
        SELECT qid, id, count(*) AS hits, any_value(date) AS date, any_value(level = 'automatic') AS auto FROM t JOIN (SELECT id, date, level, unnest(categories) AS c FROM memory) USING (c) GROUP BY qid, id)) WHERE rank <= 60""",
        "memory", "query", t=_TRIGGERS,
    )
)
def trigger_overlap(spark: SparkSession, d: str) -> DataFrame:
    lang = F.element_at(F.array(*map(F.lit, ["en", "fr", "de", "es"])), (F.col("qid") % 4 + 1).cast("int"))
    t = S.query_table(spark, d).select("qid", F.array(lang, F.concat(F.lit("src"), F.col("qid") % 20)).alias("t"))
    m = S.memory(spark, d).select("id", "date", (F.col("level") == "automatic").alias("auto"), F.array_sort("categories").alias("c"))
    # A query's sixty rows are among the first sixty of those with both its words and the first 120 of each word.
    order = (F.desc("auto"), F.desc_nulls_last("date"), F.col("id"))
    both = filters.top(m.withColumn("k", F.array_join("c", "|")), 60, "k", *order).select("id", "date", "auto", "c", "k")
    one = filters.top(m.withColumn("k", F.explode("c")), 120, "k", *order).select("id", "date", "auto", "c", "k")
    keys = t.select("qid", "t", F.explode(F.concat("t", F.array(F.array_join(F.array_sort("t"), "|")))).alias("k"))
    g = both.unionByName(one).join(keys, "k").select("qid", "id", F.size(F.array_intersect("c", "t")).cast("bigint").alias("hits"), "date", "auto").distinct()
    return filters.top(g.withColumn("score", F.when(F.col("hits") == 2, 100.0).otherwise(60.0 / 2)), 60, "qid", F.desc("hits"), F.desc("auto"), F.desc_nulls_last("date"), F.col("id")).select("qid", "id", "hits", "score", "rank")


@query(
    sql(
        """SELECT qid, id, score, rank FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, date DESC, id) AS rank FROM (
        SELECT qid, id, date, CASE WHEN code = 'src' || (qid % 20) || '_en' THEN 100 WHEN starts_with(code, 'src' || (qid % 20) || '_') THEN 92 END AS score FROM query JOIN memory ON source = 'src' || (qid % 20))) WHERE rank <= 30""",
        "memory", "query",
    )
)
def code_match(spark: SparkSession, d: str) -> DataFrame:
    q = S.query_table(spark, d).select("qid", F.concat(F.lit("src"), F.col("qid") % 20).alias("source"))
    m = S.memory(spark, d).select("id", "date", "source", F.when(F.col("code") == F.concat("source", F.lit("_en")), 100).otherwise(92).alias("score"))
    # The order is the same for all queries of a source, so its first thirty are all that meet them.
    best = filters.top(m, 30, "source", F.desc("score"), F.desc("date"), F.col("id"))
    return best.join(q, "source").select("qid", "id", "score", "rank")


@query(sql("SELECT qid, id, hits FROM (SELECT qid, id, len(list_filter(strong, lambda t: contains(lower(content), t))) AS hits FROM query, memory) WHERE hits > 0", "memory", "query"))
def ilike_any_match(spark: SparkSession, d: str) -> DataFrame:
    return L.substring_hits(S.query_table(spark, d), "strong", S.memory(spark, d)).select("qid", "id", "hits")


_GRAMS = "SELECT {k} AS k, unnest(list_distinct(flatten(list_transform(" + S.sql_tokens("{t}").replace("{", "{{").replace("}", "}}").replace("{{t}}", "{t}") + ", lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))) AS g FROM {v}"
_SIMS = """SELECT qid, id, c / (nq + nd - c) AS similarity FROM (SELECT q.k AS qid, m.k AS id, count(*) AS c FROM qg q JOIN dg m USING (g) GROUP BY q.k, m.k) JOIN (SELECT k AS qid, count(*) AS nq FROM qg GROUP BY k) USING (qid) JOIN (SELECT k AS id, count(*) AS nd FROM dg GROUP BY k) USING (id)"""
_G = dict(qg=_GRAMS.format(k="qid", t="clean", v="query"), dg=_GRAMS.format(k="id", t="content", v="memory"), sims=_SIMS)


@query(sql("SELECT qid, id, similarity, rank FROM (SELECT qid, id, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY qid ORDER BY round(similarity, 6) DESC, id) AS rank FROM sims) WHERE rank <= 5", "memory", "query", **_G))
def trigram_similarity_topk(spark: SparkSession, d: str) -> DataFrame:
    s = L.trigram_matches(S.query_table(spark, d), "clean", S.memory(spark, d), 5)
    return filters.top(s.withColumn("similarity", F.round("similarity", 6)), 5, "qid", F.desc("similarity"), F.col("id"))


_STEMS = ", ".join(f"('{r}', '{v}')" for r, vs in rulesets.STEMS.items() for v in vs)
_SYNONYMS = ", ".join(f"('{r}', '{v}')" for r, vs in rulesets.SYNONYMS.items() for v in vs)
_UNEXPANDED = ", ".join(f"'{w}'" for w in rulesets.UNEXPANDED)


@query(
    sql(
        f"""SELECT DISTINCT qid, term FROM (SELECT qid, t AS term FROM asked UNION ALL SELECT qid, variant FROM asked JOIN (SELECT * FROM roots UNION ALL SELECT * FROM (VALUES {_SYNONYMS}) s(root, variant)) ON t = root
        UNION ALL SELECT qid, variant FROM asked JOIN roots ON length(t) >= 4 AND length(root) >= 4 AND t NOT IN ({_UNEXPANDED}) AND (contains(t, root) OR contains(root, t)))""",
        "query", asked="SELECT qid, unnest(terms) AS t FROM query UNION ALL SELECT qid, 'medicinal' FROM query WHERE qid % 5 = 0",
        roots=f"SELECT DISTINCT root, root || '_' || length(root) AS variant FROM (SELECT unnest(strong) AS root FROM query) WHERE length(root) >= 6 UNION ALL SELECT * FROM (VALUES {_STEMS}) t(root, variant)",
    )
)
def term_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Terms (every fifth query also asks for one of the fixed roots) with variants by the fixed tables and by the queries' own long words."""
    q = S.query_table(spark, d)
    roots = q.select(F.explode("strong").alias("root")).where(F.length("root") >= 6).distinct().withColumn("variant", F.concat_ws("_", "root", F.length("root")))
    stems, synonyms = T.fixed_variants(spark)
    more = q.withColumn("terms", F.when(F.col("qid") % 5 == 0, F.array_append("terms", F.lit("medicinal"))).otherwise(F.col("terms")))
    return T.expand_terms(more, roots.unionByName(stems), synonyms=synonyms)


def _share(words: list[str]) -> str:
    return f"least(1.0, 20.0 * ({' + '.join(f'CAST(contains(lower(text), {w!r}) AS INT)' for w in words)}) / {len(words)})"


_ROUTED = f"SELECT conv_id, turn, round({_share(rulesets.PROFILE_WORDS)}, 6) AS profile, round({_share(rulesets.TECHNICAL_WORDS)}, 6) AS technical FROM conversations"


@query(sql("SELECT conv_id, turn, profile, technical, CASE WHEN profile > technical THEN 'profile' WHEN technical > 0 THEN 'technical' ELSE 'mixed' END AS mode FROM routed", routed=_ROUTED))
def tag_router(spark: SparkSession, d: str) -> DataFrame:
    """Whether a turn of a conversation asks about a person or about technical things."""
    r = S.table(spark, d, "conversations").select("conv_id", "turn", rules.route(F.col("text")).alias("r"))
    return r.select("conv_id", "turn", F.round("r.profile", 6).alias("profile"), F.round("r.technical", 6).alias("technical"), "r.mode")


_POSTS = f"SELECT id, t AS term, count(*) AS tf, min(pos) AS first FROM (SELECT id, unnest({S.sql_tokens('content')}) AS t, generate_subscripts({S.sql_tokens('content')}, 1) - 1 AS pos FROM memory) GROUP BY id, t"


@query(sql("SELECT qid, id FROM (SELECT qid, len(strong) AS n, unnest(strong) AS term FROM query) JOIN posts USING (term) GROUP BY qid, id HAVING count(*) = any_value(n)", "memory", "query", posts=_POSTS))
def token_and_match(spark: SparkSession, d: str) -> DataFrame:
    """Documents that have every strong term of a query as a word."""
    q = S.query_table(spark, d)
    return L.and_match(q, "strong", L.postings(S.memory(spark, d), "id", "content", L.asked(q, "strong")))


_FULL = """SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (SELECT qid, id, round(greatest(30.0, least(100.0, 45.0 + 300.0 * (tf / (tf + 40.0)) * coverage)), 4) AS score FROM (
        SELECT qid, id, count(*) / any_value(n) AS coverage, sum(tf) AS tf FROM (SELECT qid, len(strong) AS n, unnest(strong) AS term FROM query) JOIN posts USING (term) GROUP BY qid, id))) WHERE rank <= 30"""


@query(sql(_FULL, "memory", "query", posts=_POSTS))
def fulltext_topk(spark: SparkSession, d: str) -> DataFrame:
    """Any-term search; the rank is tf / (tf + 40) times the share of terms present."""
    q = S.query_table(spark, d)
    got = L.or_match(q, "strong", L.postings(S.memory(spark, d), "id", "content", L.asked(q, "strong")))
    return filters.top(got.withColumn("score", L.fulltext_score(F.col("tf") / (F.col("tf") + 40.0) * F.col("coverage"))), 30, "qid", F.desc("score"), F.col("id")).select("qid", "id", "score", "rank")


_WORDS = f"SELECT id, pos, regexp_replace(word, '{P.STEM}', '\\1') AS term FROM (SELECT id, unnest(range(len(t))) AS pos, unnest(t) AS word FROM (SELECT id, {S.sql_tokens('content')} AS t FROM memory))"
_STEMS = f"SELECT qid, list_distinct(list_transform(strong, lambda t: regexp_replace(t, '{P.STEM}', '\\1'))) AS stems FROM query"
_USES = "SELECT qid, id, pos, term, n FROM (SELECT qid, len(stems) AS n, unnest(stems) AS term FROM stems) JOIN words USING (term)"
_COVERS = """SELECT qid, id, round(sum(0.1 / (1 + (pos - low) - (place - p.low_place))), 6) AS density FROM (
  SELECT c.*, u.place AS low_place FROM (SELECT qid, id, pos, any_value(before) AS before, any_value(place) AS place, min(last) AS low FROM (
      SELECT r.qid, r.id, r.pos, r.n, r.before, r.place, o.term, max(o.pos) AS last FROM numbered r JOIN uses o ON o.qid = r.qid AND o.id = r.id AND o.pos <= r.pos GROUP BY ALL) GROUP BY qid, id, pos HAVING count(*) = any_value(n)) c
  JOIN numbered u ON u.qid = c.qid AND u.id = c.id AND u.pos = c.low WHERE coalesce(c.before, -1) < c.low) p GROUP BY qid, id"""
_NUMBERED = "SELECT *, lag(pos) OVER (PARTITION BY qid, id, term ORDER BY pos) AS before, row_number() OVER (PARTITION BY qid, id ORDER BY pos) AS place FROM uses SEMI JOIN (SELECT qid, id FROM uses GROUP BY qid, id HAVING count(DISTINCT term) = any_value(n)) USING (qid, id)"


@query(sql("SELECT qid, id, round(greatest(30.0, least(100.0, 45.0 + 300.0 * density)), 4) AS score, density, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY density DESC, id) AS rank FROM covers) WHERE rank <= 30", "memory", "query", words=_WORDS, stems=_STEMS, uses=_USES, numbered=_NUMBERED, covers=_COVERS))
def cover_rank(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the stems of all of a query's terms, by cover density."""
    got = P.cover_ranks(S.query_table(spark, d), "strong", S.memory(spark, d), 30).withColumnRenamed("rank", "density")
    return filters.top(got, 30, "qid", F.desc("density"), F.col("id")).select("qid", "id", L.fulltext_score(F.col("density")).alias("score"), "density", "rank")


@query(sql("SELECT qid, id, density, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY density DESC, id) AS rank FROM (SELECT qid, id, round(0.1 * count(*), 6) AS density FROM uses GROUP BY qid, id)) WHERE rank <= 60", "memory", "query", words=_WORDS, stems=_STEMS, uses=_USES))
def cover_rank_any(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the stem of any of a query's terms: each use is a cover of its own."""
    got = P.cover_ranks(S.query_table(spark, d), "strong", S.memory(spark, d), 60, every=False).withColumnRenamed("rank", "density")
    return filters.top(got, 60, "qid", F.desc("density"), F.col("id")).select("qid", "id", "density", "rank")


@query()
def concept_proximity(spark: SparkSession, d: str) -> DataFrame:
    """Where the concepts of each query (terms with their variants) stand near one another, and the passage around them."""
    q = S.query_table(spark, d).select("qid", P.concepts(F.col("strong")).alias("concepts"))
    return P.concept_windows(q, S.memory(spark, d))


_LEX = "SELECT qid, id, round(least(100.0, 70.0 * hits / n + 20.0 * coalesce(similarity, 0) + 15.0), 4) AS score FROM (SELECT qid, id, len(list_filter(strong, lambda t: contains(lower(content), t))) AS hits, len(strong) AS n FROM query, memory) LEFT JOIN sims USING (qid, id) WHERE hits > 0"


def _lexical(spark: SparkSession, d: str, k: int | None = None, among: DataFrame | None = None) -> DataFrame:
    """(qid, id, score) of rows that contain a strong term, or (at least) the best k; `among` limits the rows by id."""
    m = S.memory(spark, d)
    hits = L.lexical_hits(S.query_table(spark, d), m if among is None else m.join(among, "id", "left_semi"), k)
    return hits.select("qid", "id", L.lexical_score(F.col("hits"), F.col("n"), F.col("similarity")).alias("score"))


@query(sql("SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM lex) WHERE rank <= 200", "memory", "query", **_G, lex=_LEX))
def lexical_score(spark: SparkSession, d: str) -> DataFrame:
    return filters.top(_lexical(spark, d, 200), 200, "qid", F.desc("score"), F.col("id"))


@query(
    sql(
        "SELECT qid, id, score, rank FROM (SELECT qid, f.id, l.score, row_number() OVER (PARTITION BY qid ORDER BY l.score DESC NULLS LAST, f.id DESC) AS rank FROM (SELECT qid, m.id FROM compiled c, memory m WHERE (c.code IS NOT NULL OR len(c.categories) > 0 OR c.level IS NOT NULL OR kind IS NOT NULL OR len(ids) > 0 OR after IS NOT NULL OR before IS NOT NULL OR session IS NOT NULL) AND (c.code IS NULL OR lower(m.code) = lower(c.code)) AND (len(c.categories) = 0 OR list_has_any(m.categories, c.categories)) AND (c.level IS NULL OR lower(m.level) = c.level) AND (kind IS NULL OR author = kind) AND (len(ids) = 0 OR list_contains(ids, CAST(m.id AS VARCHAR))) AND (after IS NULL OR CAST(date AS VARCHAR) >= after) AND (before IS NULL OR CAST(date AS VARCHAR) <= before) AND (session IS NULL OR session_id = session)) f LEFT JOIN lex l USING (qid, id)) WHERE rank <= 10",
        "memory", "query", **_G, lex=_LEX, pairs_of=_PAIRS, compiled=_COMPILED,
    )
)
def filtered_search(spark: SparkSession, d: str) -> DataFrame:
    """Lexical search within each query's filters; rows without a term come last, newest ids first."""
    ids = prefilter_ids(spark, d)
    return filters.top(ids.join(_lexical(spark, d), ["qid", "id"], "left"), 10, "qid", F.desc_nulls_last("score"), F.desc("id"))


_COS = "list_cosine_similarity({}, {})"
_KNN = "SELECT qid, id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) AS rank FROM (SELECT qid, id, round(list_cosine_similarity(q.embedding, m.embedding), 6) AS similarity FROM query q, memory m WHERE q.embedding IS NOT NULL AND m.embedding IS NOT NULL)) WHERE rank <= {k}"


@query(sql(_KNN.format(k=30), "memory", "query"))
def knn_exact(spark: SparkSession, d: str) -> DataFrame:
    return K.knn(S.query_table(spark, d), S.memory(spark, d), 30)


@query(sql("SELECT * FROM (" + _KNN.format(k=5).replace("m.embedding IS NOT NULL)", "m.embedding IS NOT NULL) WHERE similarity BETWEEN 0.1 AND 0.3") + ")", "memory", "query"))
def knn_window(spark: SparkSession, d: str) -> DataFrame:
    near = K.similarities(S.query_table(spark, d), S.memory(spark, d), 0.1 - 6e-7, 0.3 + 6e-7, 9).withColumn("similarity", F.round("similarity", 6)).where("similarity BETWEEN 0.1 AND 0.3")
    return filters.top(near, 5, "qid", F.desc("similarity"), F.col("id")).select("qid", "id", "similarity", "rank")


_SELF = "SELECT a.id AS qid, b.id AS id, round(list_cosine_similarity(a.embedding, b.embedding), 6) AS similarity FROM memory a, memory b WHERE a.id % 50 = 0 AND a.id <> b.id AND a.embedding IS NOT NULL AND b.embedding IS NOT NULL"


def _every_50th(m: DataFrame) -> DataFrame:
    return m.where("id % 50 = 0").select(F.col("id").alias("qid"), "embedding")


@query(sql(f"SELECT qid, id, similarity FROM ({_SELF}) WHERE similarity >= 0.3", "memory"))
def self_similarity_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Links of similarity 0.3 or more from every fiftieth vector to all others."""
    m = S.memory(spark, d)
    return K.similarities(_every_50th(m), m, 0.299).where("qid <> id").withColumn("similarity", F.round("similarity", 6)).where("similarity >= 0.3")


@query(sql(f"SELECT qid, id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) AS rank FROM ({_SELF})) WHERE rank = 1", "memory"))
def nearest_twin(spark: SparkSession, d: str) -> DataFrame:
    m = S.memory(spark, d)
    return K.knn(_every_50th(m), m, 1, other=True).select("qid", "id", "similarity")


@query()
def ann_lsh_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall at 10 of the inverted-file index against exact search, for every fiftieth vector, with the share of cells probed.

    Cells are about the square root of the rows; how many are probed is measured
    on a sample of queries, for a recall of 0.95.  Vectors without structure need most cells.
    """
    m = cut(S.memory(spark, d).select("id", "embedding").where("embedding IS NOT NULL"))  # joined once for all passes
    cells = K.Cells().fit(m)
    q, indexed = _every_50th(m), cut(cells.index(m))
    n = cells.probes(q, m, indexed, 10)
    found = cells.search(q, indexed, 10, probes=n).select("qid", "id").withColumn("found", F.lit(1))
    recall = K.knn(q, m, 10).join(found, ["qid", "id"], "left").groupBy("qid").agg(F.avg(F.coalesce("found", F.lit(0))).alias("recall"))
    return recall.withColumn("probed", F.lit(round(n / len(cells.centroids), 4)))


@query(sql("SELECT qid, id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) AS rank FROM (SELECT qid, id, round(list_cosine_similarity(q.embedding, m.embedding), 6) AS similarity FROM query q, memory m WHERE q.embedding IS NOT NULL AND m.embedding IS NOT NULL AND lang = 'en' AND level IS DISTINCT FROM 'automatic')) WHERE rank <= 10", "memory", "query"))
def code_search(spark: SparkSession, d: str) -> DataFrame:
    """Vector search in the rows of one language that are not of an obsolete kind; the filter runs before the vectors."""
    m = S.memory(spark, d).where((F.col("lang") == "en") & ~F.col("level").eqNullSafe("automatic"))
    return K.knn(S.query_table(spark, d), m, 10)


_LINES = "SELECT id, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS chunk_index, unnest(string_split(content, chr(10))) AS chunk FROM memory"


_CHUNKS = """SELECT qid, id, chunk_index, score FROM (SELECT *, row_number() OVER (PARTITION BY qid, id ORDER BY score DESC, chunk_index) AS r FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id, chunk_index) AS place FROM (
        SELECT qid, id, chunk_index, round(least(45.0, 30.0 + 60.0 * (hits / (hits + 8.0)) + 10.0 * hits / n), 4) AS score FROM (SELECT qid, id, chunk_index, len(list_filter(strong, lambda t: contains(lower(chunk), t))) AS hits, len(strong) AS n FROM query, lines) WHERE hits > 0)) WHERE place <= 60) WHERE r = 1"""


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of all documents (here their lines), in lower case."""
    return S.memory(spark, d).select("id", F.posexplode(F.split(F.lower("content"), "\n")).alias("chunk_index", "text"))


@query(sql(_CHUNKS, "memory", "query", lines=_LINES))
def chunk_best_parent(spark: SparkSession, d: str) -> DataFrame:
    """Of each query's sixty best chunks the best of each document: score first, then the earlier chunk."""
    return L.best_chunks(S.query_table(spark, d), _chunks(spark, d))


_HITS = """SELECT qid, id, 'vector' AS channel, round(100.0 * similarity, 4) AS score FROM ({knn}) UNION ALL SELECT qid, id, 'lexical', score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM lex) WHERE r <= 200
  UNION ALL SELECT qid, id, 'fulltext', score FROM ({full}) UNION ALL SELECT qid, id, 'chunk', score FROM ({chunks})
  UNION ALL SELECT qid, id, 'structured', 75.0 FROM query JOIN memory ON source = 'src' || (qid % 20) AND level = 'automatic'""".format(knn=_KNN.format(k=30), full=_FULL, chunks=_CHUNKS)
_FUSED = """SELECT qid, id, round(greatest(0.6 * coalesce(vec, 0) + 0.4 * coalesce(lex, 0), coalesce(struct, 0)), 4) AS score, channels, vec, lex, struct FROM (
  SELECT qid, id, max(score) FILTER (channel = 'vector') AS vec, max(score) FILTER (channel IN ('lexical', 'fulltext', 'chunk')) AS lex, max(score) FILTER (channel = 'structured') AS struct, array_to_string(list_sort(list_distinct(list(channel))), ',') AS channels FROM hits GROUP BY qid, id)"""
_VIEWS = dict(**_G, posts=_POSTS, lines=_LINES, lex=_LEX, hits=_HITS, fused=_FUSED)


def channels(spark: SparkSession, d: str) -> DataFrame:
    """Hits (qid, id, channel, score) of the vector, lexical, full-text, chunk and structured channels."""
    q, m = S.query_table(spark, d), S.memory(spark, d)
    vector = K.knn(q, m, 30).select("qid", "id", F.lit("vector").alias("channel"), F.round(100.0 * F.col("similarity"), 4).alias("score"))
    lexical = filters.top(_lexical(spark, d, 200), 200, "qid", F.desc("score"), F.col("id")).select("qid", "id", F.lit("lexical").alias("channel"), "score")
    source = q.select("qid", F.concat(F.lit("src"), F.col("qid") % 20).alias("source"))
    structured = m.where(filters.structured(level="automatic")).join(source, "source").select("qid", "id", F.lit("structured").alias("channel"), F.lit(75.0).alias("score"))
    full = fulltext_topk(spark, d).select("qid", "id", F.lit("fulltext").alias("channel"), "score")
    chunk = chunk_best_parent(spark, d).select("qid", "id", F.lit("chunk").alias("channel"), "score")
    return vector.unionByName(lexical).unionByName(full).unionByName(chunk).unionByName(structured)


@query(sql("SELECT qid, id, score, channels FROM fused", "memory", "query", **_VIEWS))
def hybrid_fusion(spark: SparkSession, d: str) -> DataFrame:
    return R.fuse(channels(spark, d)).select("qid", "id", "score", F.array_join("channels", ",").alias("channels"))


_PHRASES = "SELECT qid, id FROM query JOIN memory ON length(clean) >= 10 AND contains(clean, ' ') AND contains(lower(content), clean)"
_DECAYED = f"""SELECT qid, id, struct, p.id IS NOT NULL AS literal, fused.score AS score0, round(CASE WHEN struct IS NOT NULL OR p.id IS NOT NULL THEN fused.score ELSE fused.score * CASE WHEN date_diff('day', date, DATE '{REF_DATE}') <= 7 THEN 1.0 ELSE greatest(0.2, exp(-0.05 * date_diff('day', date, DATE '{REF_DATE}'))) END END, 4) AS score
  FROM fused JOIN memory USING (id) LEFT JOIN phrases p USING (qid, id)"""


def _phrases(spark: SparkSession, d: str) -> DataFrame:
    """(qid, id): documents that contain a query's words literally; a query of one word or under ten characters is no phrase."""
    q = S.query_table(spark, d).where((F.length("clean") >= 10) & F.contains("clean", F.lit(" "))).select("qid", F.array("clean").alias("p"))
    return L.substring_hits(q, "p", S.memory(spark, d)).select("qid", "id")


def _decayed(spark: SparkSession, d: str) -> DataFrame:
    """Fused hits after decay; structured hits and literal ones don't decay."""
    f = R.fuse(channels(spark, d)).join(S.memory(spark, d).select("id", "date"), "id").join(_phrases(spark, d).withColumn("literal", F.lit(True)), ["qid", "id"], "left")
    keeps = F.col("struct").isNotNull() | F.coalesce("literal", F.lit(False))
    return f.select("qid", "id", "struct", F.coalesce("literal", F.lit(False)).alias("literal"), F.col("score").alias("score0"), F.round(F.when(keeps, F.col("score")).otherwise(F.col("score") * R.decay_factor(F.col("date"), F.lit(REF_DATE).cast("date"))), 4).alias("score"))


@query(sql("SELECT qid, id, score0, score FROM decayed", "memory", "query", **_VIEWS, phrases=_PHRASES, decayed=_DECAYED))
def time_decay(spark: SparkSession, d: str) -> DataFrame:
    return _decayed(spark, d).select("qid", "id", "score0", "score")


_RECENT = f"SELECT memory_id, count(*) FILTER (accessed_at >= TIMESTAMP '{REF_NOW}' - INTERVAL 7 DAY) AS n7d, (epoch_us(TIMESTAMP '{REF_NOW}') - epoch_us(max(accessed_at))) / 3.6e9 AS age_h FROM access_log GROUP BY memory_id"
_BOOST = "CASE WHEN least(15.0, 5.0 * ln(1 + n7d)) * exp(-age_h / 168.0) > 0.1 THEN least(15.0, 5.0 * ln(1 + n7d)) * exp(-age_h / 168.0) ELSE 0.0 END"


def recent(spark: SparkSession, d: str) -> DataFrame:
    """(memory_id, n7d, age_h): uses in seven days and hours since the last."""
    now = F.lit(REF_NOW).cast("timestamp")
    return S.access_log(spark, d).groupBy("memory_id").agg(F.count_if(F.col("accessed_at") >= now - F.expr("INTERVAL 7 DAYS")).alias("n7d"), F.max("accessed_at").alias("last")).select("memory_id", "n7d", (F.timestamp_diff("MICROSECOND", F.col("last"), now) / 3.6e9).alias("age_h"))


@query(sql(f"SELECT memory_id, n7d, round({_BOOST}, 4) AS boost FROM recent", "access_log", recent=_RECENT))
def fatigue_boost(spark: SparkSession, d: str) -> DataFrame:
    return recent(spark, d).select("memory_id", "n7d", F.round(R.fatigue(F.col("n7d"), F.col("age_h")), 4).alias("boost"))


#: Hits of each query whose texts are looked into for phrases and passages.
ANNOTATED = 60
_BOOSTED = f"""SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS place FROM (SELECT qid, id, struct, literal, round(least(100.0, score + CASE WHEN struct IS NULL THEN coalesce(round({_BOOST}, 4), 0.0) ELSE 0.0 END), 4) AS score FROM decayed LEFT JOIN recent ON memory_id = 'v' || id)"""
_SPANS = """SELECT qid, id, len(places) AS n, m, list_max(places) - list_min(places) AS span FROM (SELECT qid, id, list_filter(list_transform(strong, lambda t: instr(lower(content), t)), lambda p: p > 0) AS places, len(strong) AS m FROM boosted JOIN query USING (qid) JOIN memory USING (id) WHERE place <= 60)"""
_ANNOTATED = """SELECT qid, id, round(least(100.0, score + CASE WHEN literal THEN 20.0 ELSE 0.0 END + coalesce(CASE WHEN n < 2 THEN 0 WHEN n = m AND span <= 150 THEN 30 WHEN n = m AND span <= 350 THEN 20 WHEN n = m AND span <= 700 THEN 8 WHEN span <= 150 THEN 10 ELSE 0 END, 0)), 4) AS score, struct IS NOT NULL AS structured,
  coalesce(CASE WHEN n < 2 THEN 0 WHEN n = m AND span <= 150 THEN 30 WHEN n = m AND span <= 350 THEN 20 WHEN n = m AND span <= 700 THEN 8 WHEN span <= 150 THEN 10 ELSE 0 END, 0) AS bonus FROM boosted LEFT JOIN spans USING (qid, id)"""
_WHOLE = dict(**_VIEWS, phrases=_PHRASES, decayed=_DECAYED, recent=_RECENT, boosted=_BOOSTED, spans=_SPANS, annotated=_ANNOTATED)


def annotated(spark: SparkSession, d: str) -> DataFrame:
    """(qid, id, score, structured, bonus): fused hits after decay, fatigue, phrase and proximity boosts.

    The texts of the best sixty hits of each query are looked into; the rest have no bonus.
    """
    r = recent(spark, d).select(F.substring("memory_id", 2, 20).cast("bigint").alias("id"), F.round(R.fatigue(F.col("n7d"), F.col("age_h")), 4).alias("boost"))
    fatigue = F.when(F.col("struct").isNull(), F.coalesce("boost", F.lit(0.0))).otherwise(0.0)
    s = _decayed(spark, d).join(r, "id", "left").withColumn("score", F.round(F.least(F.lit(100.0), F.col("score") + fatigue), 4)).select("qid", "id", "struct", "literal", "score")
    # Ids and scores are kept: the texts that are looked into depend on the order.
    s = cut(s.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))))
    near = s.where(F.col("place") <= ANNOTATED).select("qid", "id").join(S.query_table(spark, d).select("qid", "strong"), "qid").join(S.memory(spark, d).select("id", "content"), "id").select("qid", "id", T.proximity(F.col("content"), F.col("strong")).alias("bonus"))
    bonus = F.coalesce("bonus", F.lit(0))
    up = F.col("score") + F.when(F.col("literal"), 20.0).otherwise(0.0) + bonus
    return s.join(near, ["qid", "id"], "left").select("qid", "id", F.round(F.least(F.lit(100.0), up), 4).alias("score"), F.col("struct").isNotNull().alias("structured"), bonus.alias("bonus"))


@query(
    sql(
        """SELECT qid, id, score, rank, CASE WHEN score >= 75 THEN 'high' WHEN score >= 45 THEN 'medium' ELSE 'low' END AS relevance FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM annotated WHERE score >= 10) WHERE rank <= 10""",
        "memory", "query", "access_log", **_WHOLE,
    )
)
def hybrid_search_topk(spark: SparkSession, d: str) -> DataFrame:
    """All queries against all memory: five channels, fusion, decay, fatigue, phrases, proximity, floor, top ten with labels."""
    return filters.top(annotated(spark, d).where("score >= 10"), 10, "qid", F.desc("score"), F.col("id")).select("qid", "id", "score", "rank", R.label(F.col("score")).alias("relevance"))


@query()
def hybrid_search_diverse(spark: SparkSession, d: str) -> DataFrame:
    """The whole search with its last steps: quoted mentions weigh less, then marginal relevance orders the first thirty hits."""
    top = cut(filters.top(annotated(spark, d).where("score >= 10"), 30, "qid", F.desc("score"), F.col("id")))
    m = S.memory(spark, d).select("id", "content", "embedding")
    j = top.join(m, "id").join(S.query_table(spark, d).select("qid", "clean"), "qid")
    score = F.when(F.col("structured"), F.col("score")).otherwise(T.mention_penalty(F.col("score"), F.col("content"), F.col("clean")))
    return R.mmr(j.select("qid", "id", score.alias("score"), "embedding"))


@query(
    sql(
        """SELECT qid, id, phrase_score FROM (SELECT qid, id, least(100.0, score + CASE WHEN contains(lower(content), lower(text)) THEN 25.0 ELSE 0 END + CASE WHEN contains(lower(content), clean) THEN 20.0 ELSE 0 END) AS phrase_score, score FROM lex JOIN query USING (qid) JOIN memory USING (id)) WHERE phrase_score > score""",
        "memory", "query", **_G, lex=_LEX,
    )
)
def phrase_boost(spark: SparkSession, d: str) -> DataFrame:
    """Lexical hits that contain the query's text, or its clean words, literally."""
    q, m = S.query_table(spark, d), S.memory(spark, d)
    literal = lambda phrase, points: L.substring_hits(q.withColumn("p", F.array(phrase)), "p", m).select("qid", "id", F.lit(points).alias("up"))
    found = cut(literal(F.lower("text"), 25.0).unionByName(literal(F.col("clean"), 20.0)).groupBy("qid", "id").agg(F.sum("up").alias("up")))
    j = _lexical(spark, d, among=found.select("id").distinct()).join(found, ["qid", "id"])
    return j.withColumn("phrase_score", F.least(F.lit(100.0), F.col("score") + F.col("up"))).where("phrase_score > score").select("qid", "id", "phrase_score")


@query(
    sql(
        """SELECT qid, id, CASE WHEN n < 2 THEN 0 WHEN n = m AND span <= 150 THEN 30 WHEN n = m AND span <= 350 THEN 20 WHEN n = m AND span <= 700 THEN 8 WHEN span <= 150 THEN 10 ELSE 0 END AS bonus FROM (
        SELECT qid, id, len(places) AS n, m, list_max(places) - list_min(places) AS span FROM (SELECT qid, id, list_filter(list_transform(strong, lambda t: instr(lower(content), t)), lambda p: p > 0) AS places, len(strong) AS m FROM query, memory)) WHERE n >= 2""",
        "memory", "query",
    )
)
def proximity_bonus(spark: SparkSession, d: str) -> DataFrame:
    m = L.substring_hits(S.query_table(spark, d), "strong", S.memory(spark, d), least=2, spans=True)
    return m.select("qid", "id", T.proximity_bonus(F.col("hits"), F.col("n"), F.col("span")).alias("bonus"))


@query()
def meta_mention_penalty(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a query's text, with the score that quoted mentions leave."""
    q = S.query_table(spark, d).select("qid", F.lower("text").alias("phrase"))
    found = L.substring_hits(q.withColumn("p", F.array("phrase")), "p", S.memory(spark, d)).select("qid", "id")
    m = found.join(S.memory(spark, d).select("id", "content"), "id").join(q, "qid")
    return m.select("qid", "id", T.mention_penalty(F.lit(100.0), F.col("content"), F.col("phrase")).alias("score"))


@query()
def mmr_diversify(spark: SparkSession, d: str) -> DataFrame:
    f = R.fuse(channels(spark, d)).select("qid", "id", "score")
    return R.mmr(f.join(S.memory(spark, d).select("id", "embedding"), "id"))


_TOPS = "SELECT qid, id, score, rank FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM fused) WHERE rank <= 15"


def _tops(spark: SparkSession, d: str) -> DataFrame:
    return filters.top(R.fuse(channels(spark, d)).select("qid", "id", "score"), 15, "qid", F.desc("score"), F.col("id"))


@query(
    sql(
        """SELECT qid, n, score, round(gap, 4) AS gap, CASE WHEN n < 3 OR score >= 90 OR structured OR (bonus >= 25 AND score >= 45) OR (score >= 85 AND gap >= 8) OR (score >= 70 AND gap >= 15) THEN false WHEN score < 65 OR gap < 6 THEN true ELSE score < 80 END AS rerank
        FROM (SELECT *, count(*) OVER (PARTITION BY qid) AS n, score - coalesce(lead(score) OVER (PARTITION BY qid ORDER BY rank), 0) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM annotated) WHERE rank <= 15) WHERE rank = 1""",
        "memory", "query", "access_log", **_WHOLE,
    )
)
def rerank_gate(spark: SparkSession, d: str) -> DataFrame:
    return R.gate(filters.top(annotated(spark, d), 15, "qid", F.desc("score"), F.col("id")))


@query(
    sql(
        """SELECT qid, id, mixed, row_number() OVER (PARTITION BY qid ORDER BY rank > 8, mixed DESC, id) AS new_rank FROM (SELECT qid, id, rank, CASE WHEN rank <= 8 AND quality IS NOT NULL THEN round(score * (0.5 + 0.5 * quality), 5) ELSE score END AS mixed FROM tops LEFT JOIN labels ON doc_id = id)""",
        "memory", "query", **_VIEWS, tops=_TOPS,
    )
)
def rerank_mix(spark: SparkSession, d: str) -> DataFrame:
    tops = _tops(spark, d)
    verdicts = tops.select("qid", "id").join(S.table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("p")), "id")
    return R.rerank(tops, verdicts).select("qid", "id", "mixed", "new_rank")


@query(
    sql(
        """SELECT qid, id, 20 AS score, rank FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY shared DESC, id) AS rank FROM (
        SELECT t.qid, m.id, count(DISTINCT t.tag) AS shared FROM (SELECT DISTINCT qid, unnest(tags) AS tag FROM tops JOIN memory USING (id) WHERE rank <= 3) t JOIN (SELECT id, unnest(tags) AS tag FROM memory) m USING (tag) ANTI JOIN (SELECT qid, id FROM tops) x ON x.qid = t.qid AND x.id = m.id GROUP BY t.qid, m.id)) WHERE rank <= 5""",
        "memory", "query", **_VIEWS, tops=_TOPS,
    )
)
def tag_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Up to five rows for each query that share most tags with its first three hits and are no hits yet."""
    m, tops = S.memory(spark, d), _tops(spark, d)
    tags = tops.where("rank <= 3").join(m.select("id", "tags"), "id").select("qid", F.explode("tags").alias("tag")).distinct()
    # Rows with the same tags share as many, so of each set of tags the first by id will do: five, and as many as can be hits already.
    sets = m.select("id", F.array_sort(F.array_distinct("tags")).alias("tags"))
    first = cut(filters.top(sets.withColumn("k", F.to_json("tags")), 5 + 15, "k", F.col("id")).select("k", "id", "tags"))
    kinds = first.select("k", F.explode("tags").alias("tag")).distinct()
    shared = kinds.join(tags, "tag").groupBy("qid", "k").agg(F.count_distinct("tag").alias("shared")).join(first.select("k", "id"), "k")
    new = shared.join(tops.select("qid", "id"), ["qid", "id"], "left_anti")
    return filters.top(new, 5, "qid", F.desc("shared"), F.col("id")).select("qid", "id", F.lit(20).alias("score"), "rank")


@query(
    sql(
        """SELECT qid, id, phase, score FROM (SELECT qid, id, phase, score, row_number() OVER (PARTITION BY qid, id ORDER BY phase) AS r FROM (
          SELECT qid, id, 1 AS phase, score FROM p1 UNION ALL SELECT qid, id, 2, score FROM p2 SEMI JOIN open1 USING (qid) UNION ALL SELECT qid, id, 3, score FROM p3 SEMI JOIN open2 USING (qid))) WHERE r = 1 AND score >= 10""",
        "memory", "query", **_G,
        p1="SELECT qid, id, round(100 * similarity, 4) AS score FROM (" + _KNN.format(k=15) + ")",
        s="SELECT qid, id, len(list_filter(strong, lambda t: contains(lower(content), t))) AS hits, len(strong) AS n FROM query, memory",
        p2="SELECT qid, id, round(60.0 * hits / n + 25.0 * similarity + 10.0, 4) AS score FROM sims JOIN s USING (qid, id) WHERE similarity >= 0.05",
        p3="SELECT qid, id, round(70.0 * hits / n + 10.0, 4) AS score FROM s WHERE hits > 0",
        open1="SELECT qid FROM query LEFT JOIN p1 USING (qid) GROUP BY qid HAVING (coalesce(max(score), 0) < 60 OR count(id) < 3) AND count(*) FILTER (score >= 50) < 3",
        open2="SELECT qid FROM (SELECT qid FROM open1) LEFT JOIN p2 USING (qid) GROUP BY qid HAVING (coalesce(max(score), 0) < 35 OR count(*) FILTER (score >= 20) < 2) AND count(*) FILTER (score >= 30) < 5",
    )
)
def cascade_search(spark: SparkSession, d: str) -> DataFrame:
    """Vectors first; trigrams only for queries that stay unsure; substrings only for those still unsure then."""
    q, m = S.query_table(spark, d), S.memory(spark, d)
    p1 = K.knn(q, m, 15).select("qid", "id", F.round(100 * F.col("similarity"), 4).alias("score"))
    c1 = q.select("qid").join(p1, "qid", "left").groupBy("qid").agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("top"), F.count("id").alias("n"), F.count_if(F.col("score") >= 50).alias("good"))
    open1 = c1.where("(top < 60 OR n < 3) AND good < 3").select("qid")
    q1 = q.join(open1, "qid", "left_semi")
    # One scan gives both text phases; it is kept, as the third phase depends on the second.
    both = cut(L.scan(q1.select("qid", F.col("strong").alias("terms"), "clean"), m.select("id", F.lower("content").alias("text")), ["id"], least_similarity=0.05))
    n = F.greatest(F.col("n"), F.lit(1))
    p2 = both.where("similarity >= 0.05").select("qid", "id", L.cascade_scores(F.col("hits"), n, F.col("similarity"))[0].alias("score"))
    c2 = open1.join(p2, "qid", "left").groupBy("qid").agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("top"), F.count_if(F.col("score") >= 20).alias("fair"), F.count_if(F.col("score") >= 30).alias("good"))
    open2 = c2.where("(top < 35 OR fair < 2) AND good < 5").select("qid")
    p3 = both.where("hits > 0").join(open2, "qid", "left_semi").select("qid", "id", L.cascade_scores(F.col("hits"), F.col("n"), F.lit(0.0))[1].alias("score"))
    every = p1.withColumn("phase", F.lit(1)).unionByName(p2.withColumn("phase", F.lit(2))).unionByName(p3.withColumn("phase", F.lit(3)))
    first = every.withColumn("r", F.row_number().over(Window.partitionBy("qid", "id").orderBy("phase"))).where("r = 1 AND score >= 10")
    return first.select("qid", "id", "phase", "score")


@query(sql("SELECT a.qid, m.id, round(list_cosine_similarity(a.embedding, m.embedding), 6) AS similarity FROM query a JOIN memory m ON a.qid = m.id WHERE a.embedding IS NOT NULL", "memory", "query"))
def cosine_by_id(spark: SparkSession, d: str) -> DataFrame:
    """The built-in cosine of paired vectors."""
    q = S.query_table(spark, d).withColumnRenamed("embedding", "v")
    m = S.memory(spark, d)
    return m.join(q, m.id == q.qid).where("v IS NOT NULL").select("qid", "id", F.round(V.cosine(F.col("v"), F.col("embedding")), 6).alias("similarity"))


def sql_vectors(source: str, key: str, text: str) -> str:
    """The default vectors of a source's texts as rows (key, k, s), not normalised."""
    return f"""SELECT {key}, k, sum(s) AS s FROM (SELECT {key}, c % 64 AS k, CASE WHEN (c // 64) % 2 = 0 THEN 1 ELSE -1 END AS s FROM (SELECT {key}, CAST('0x' || md5(g)[1:4] AS INT) AS c FROM (
      SELECT {key}, unnest(list_distinct(flatten(list_transform({S.sql_tokens(text)}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))) AS g FROM {source}))) GROUP BY {key}, k"""


@query(
    sql(
        """SELECT qid, id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) AS rank FROM (SELECT qid, cid // 100000 AS id, round(max(dot / sqrt(qn * cn)), 6) AS similarity FROM (
          SELECT qid, cid, sum(a.s * b.s) AS dot, any_value(a.n) AS qn, any_value(b.n) AS cn FROM (SELECT *, sum(s * s) OVER (PARTITION BY qid) AS n FROM qv) a JOIN (SELECT *, sum(s * s) OVER (PARTITION BY cid) AS n FROM cv) b USING (k) WHERE a.n > 0 AND b.n > 0 GROUP BY qid, cid) GROUP BY qid, id)) WHERE rank <= 30""",
        "memory", "query",
        chunks="SELECT id * 100000 + i AS cid, chunk FROM (SELECT id, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS i, unnest(string_split(content, chr(10))) AS chunk FROM memory)", qv=sql_vectors("query", "qid", "clean"), cv=sql_vectors("chunks", "cid", "chunk"),
    )
)
def chunk_knn(spark: SparkSession, d: str) -> DataFrame:
    """The thirty documents of each query whose nearest chunk (here a line) is nearest, by the default vectors."""
    from recallum.operators import intake as I

    chunks = S.memory(spark, d).select("id", F.posexplode(F.split("content", "\n")).alias("i", "chunk")).select((F.col("id") * 100000 + F.col("i")).alias("cid"), "chunk")
    children = I.embed(chunks, "cid", "chunk").select(F.floor(F.col("id") / 100000).alias("id"), "embedding")
    asked = I.embed(S.query_table(spark, d), "qid", "clean").withColumnRenamed("id", "qid")
    return K.knn_of_several(asked, children, 30)

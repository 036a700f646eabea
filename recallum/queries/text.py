"""Classification, screening, redaction, chunks, summaries and passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from recallum.functions import rules as R, rulesets, text as T
from recallum.operators import filters, lexical as L
from recallum.queries import query
from recallum.sources import tables as S
from recallum.sources.tables import REF_DATE, sql


def _match(p: str, x: str = "content") -> str:
    return "regexp_matches(lower({}), '{}')".format(x, p.replace("'", "''"))


_TAG_RULES = [(names, rulesets.words(p)) for p, names in rulesets.TAGS] + [([name], p) for name, p in R.EXAMPLE_TAGS]
_CATEGORY_RULES = [(name, rulesets.words(p)) for p, name in rulesets.CATEGORIES] + R.EXAMPLE_CATEGORIES
_LASTING, _PASSING, _SCREENED = rulesets.LASTING + R.EXAMPLE_HIGH, rulesets.PASSING + R.EXAMPLE_LOW, rulesets.SCREEN + R.EXAMPLE_SCREEN
_TAGS = "list_sort(list_distinct(flatten([" + ", ".join(f"CASE WHEN {_match(p)} THEN {names} ELSE [] END" for names, p in _TAG_RULES) + "])))"
_CATEGORY = "CASE " + " ".join(f"WHEN {_match(p)} THEN '{n}'" for n, p in _CATEGORY_RULES) + f" ELSE '{rulesets.DEFAULT_CATEGORY}' END"
_HIGH, _LOW, _TRADE = (" + ".join(f"CAST({_match(p)} AS INT)" for p in x) for x in (_LASTING, _PASSING, rulesets.TRADE))


@query(sql(f"SELECT id, array_to_string({_TAGS}, ',') AS found FROM memory", "memory"))
def auto_tag(spark: SparkSession, d: str) -> DataFrame:
    return S.memory(spark, d).select("id", F.array_join(R.tags(F.col("content"), R.EXAMPLE_TAGS), ",").alias("found"))


@query(sql(f"SELECT id, category, CASE WHEN category IN ({', '.join(repr(p) for p in rulesets.PROFILES)}) THEN 'profile' ELSE 'event' END AS mem_type FROM (SELECT id, {_CATEGORY} AS category FROM memory)", "memory"))
def auto_category(spark: SparkSession, d: str) -> DataFrame:
    return S.memory(spark, d).select("id", R.category(F.col("content"), R.EXAMPLE_CATEGORIES).alias("category")).withColumn("mem_type", R.memory_type(F.col("category")))


_CLASSES = f"""SELECT id, level, dom OR tr > 0 AS is_trade, CASE WHEN h >= 2 OR dom THEN 'high' WHEN h >= 1 OR l = 0 THEN 'medium' ELSE 'low' END AS reusability, CASE WHEN h >= 2 OR dom THEN 'infrastructure' WHEN h >= 1 OR l = 0 THEN 'project_specific' ELSE 'temporary' END AS domain_profile, h >= 2 OR dom AS promote
  FROM (SELECT id, level, {_HIGH} AS h, {_LOW} AS l, {_TRADE} AS tr, list_has_any(categories, [{', '.join(repr(p) for p in rulesets.DOMAINS)}]) AS dom FROM memory)"""


def _classes(spark: SparkSession, d: str) -> DataFrame:
    return S.memory(spark, d).select("id", "level", R.trade(F.col("content"), F.col("categories"), _LASTING, _PASSING).alias("t")).select("id", "level", "t.*")


@query(sql("SELECT id, is_trade, reusability, domain_profile, CASE domain_profile WHEN 'infrastructure' THEN 180 WHEN 'project_specific' THEN 90 ELSE 14 END AS decay_days, CASE WHEN is_trade AND reusability = 'high' AND level = 'episodic' THEN 'semantic' ELSE level END AS level FROM classes", "memory", classes=_CLASSES))
def trade_classify(spark: SparkSession, d: str) -> DataFrame:
    """Every row's class, days of decay, and level: reusable episodic trade knowledge becomes semantic."""
    r = _classes(spark, d)
    days = F.when(F.col("domain_profile") == "infrastructure", 180).when(F.col("domain_profile") == "project_specific", 90).otherwise(14)
    up = F.col("is_trade") & (F.col("reusability") == "high") & (F.col("level") == "episodic")
    return r.select("id", "is_trade", "reusability", "domain_profile", days.alias("decay_days"), F.when(up, "semantic").otherwise(F.col("level")).alias("level"))


@query(sql("SELECT domain_profile, count(*) AS total, count(*) FILTER (is_trade) AS trade, count(*) FILTER (reusability = 'high') AS high, count(*) FILTER (is_trade AND reusability = 'high' AND level = 'episodic') AS promoted FROM classes GROUP BY domain_profile", "memory", classes=_CLASSES))
def trade_rollup(spark: SparkSession, d: str) -> DataFrame:
    """A classification run's counts."""
    high = F.col("reusability") == "high"
    return _classes(spark, d).groupBy("domain_profile").agg(F.count("*").alias("total"), F.count_if("is_trade").alias("trade"), F.count_if(high).alias("high"), F.count_if(F.col("is_trade") & high & (F.col("level") == "episodic")).alias("promoted"))


@query(sql("SELECT id, is_trade, rank FROM (SELECT id, is_trade, row_number() OVER (ORDER BY id DESC) AS rank FROM classes WHERE is_trade OR reusability = 'high') WHERE rank <= 50", "memory", classes=_CLASSES))
def trade_list(spark: SparkSession, d: str) -> DataFrame:
    """The fifty newest rows of trade or highly reusable knowledge."""
    return filters.top(_classes(spark, d).where("is_trade OR reusability = 'high'").withColumn("one", F.lit(1)), 50, "one", F.desc("id")).select("id", "is_trade", "rank")


@query(sql(f"SELECT id, date_diff('day', last, DATE '{REF_DATE}') AS idle FROM (SELECT id, trade, critical, coalesce(CAST(seen AS DATE), date) AS last FROM memory LEFT JOIN (SELECT memory_id, max(accessed_at) AS seen FROM access_log GROUP BY memory_id) ON memory_id = 'v' || id) WHERE trade AND NOT critical AND date_diff('day', last, DATE '{REF_DATE}') >= 100", "memory", "access_log"))
def trade_review(spark: SparkSession, d: str) -> DataFrame:
    from recallum.plans.lifecycle import last_access

    idle = F.datediff(F.lit(REF_DATE).cast("date"), F.col("last"))
    return last_access(S.memory(spark, d).where("trade AND NOT critical"), S.access_log(spark, d)).where(idle >= 100).select("id", idle.alias("idle"))


_SCREEN = "CASE " + " ".join(f"WHEN {_match(p)} THEN {k}" for k, p in enumerate(_SCREENED, 1)) + " END"


@query(sql(f"SELECT id, rule, array_to_string(list_distinct(list_append(tags, 'possible_injection_regex')), ',') IS NOT NULL AS tagged FROM (SELECT id, tags, {_SCREEN} AS rule FROM memory) WHERE rule IS NOT NULL", "memory"))
def injection_screen(spark: SparkSession, d: str) -> DataFrame:
    m = S.memory(spark, d).withColumn("rule", R.screened(F.col("content"), _SCREENED)).where("rule IS NOT NULL")
    warned = F.array_union("tags", F.array(F.lit("possible_injection_regex")))
    return m.select("id", "rule", F.exists(warned, lambda t: F.startswith(t, F.lit("possible_injection"))).alias("tagged"))


@query()
def redact_secrets(spark: SparkSession, d: str) -> DataFrame:
    done = S.memory(spark, d).select("id", R.redacted(F.col("content"), R.EXAMPLE_REDACTIONS).alias("done"))
    return done.select("id", F.col("done.text").alias("content"), "done.n")


@query()
def text_chunks(spark: SparkSession, d: str) -> DataFrame:
    return T.chunk(S.memory(spark, d), "id", "content")


@query(sql(f"SELECT id, {T.sql_summary('content')} AS summary FROM memory", "memory"))
def extractive_summary(spark: SparkSession, d: str) -> DataFrame:
    return S.memory(spark, d).select("id", T.summarise(F.col("content")).alias("summary"))


@query()
def best_passage(spark: SparkSession, d: str) -> DataFrame:
    """The best passage of each query's ten best lexical hits."""
    q, docs = S.query_table(spark, d), S.memory(spark, d)
    top = filters.top(L.lexical_hits(q, docs, 10).withColumn("score", L.lexical_score(F.col("hits"), F.col("n"), F.col("similarity"))), 10, "qid", F.desc("score"), F.col("id"))
    m = top.select("qid", "id").join(docs.select("id", "content"), "id").join(q.select("qid", "strong"), "qid")
    return T.best_passage(m, "content", "strong").select("qid", "id", "passage", "coverage")


@query()
def extractive_compress(spark: SparkSession, d: str) -> DataFrame:
    terms = F.array(*map(F.lit, ["the", "que", "der"]))
    return S.memory(spark, d).select("id", T.compress(F.col("content"), terms).alias("short"))


@query(sql(r"SELECT id, length(trim(regexp_replace(regexp_replace(regexp_replace(content, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'))) AS chars, content = lower(content) AS lower_case FROM memory", "memory"))
def normalised_text(spark: SparkSession, d: str) -> DataFrame:
    return S.memory(spark, d).select("id", F.length(T.normalise_space(F.col("content"))).alias("chars"), (F.col("content") == F.lower("content")).alias("lower_case"))


_LANGUAGE = "CASE page_id % 5 WHEN 0 THEN 'php' WHEN 1 THEN 'python' WHEN 2 THEN 'javascript' WHEN 3 THEN 'typescript' ELSE 'html' END"
#: Pages as source files: their paragraphs as definitions of the file's language.
_FILES = f"""SELECT page_id, language, regexp_replace(html, '<(p|h1|div)>', CASE language WHEN 'python' THEN '
def ' WHEN 'typescript' THEN '
interface ' ELSE '
function ' END || '\\1 ', 'g') AS code FROM (SELECT page_id, html, {_LANGUAGE} AS language FROM pages)"""
_STARTS = " ".join(f"WHEN '{k}' THEN regexp_matches(line || chr(10), '{p}')" for k, p in T.DEFINITIONS.items())
_CODE_LINES = f"""SELECT *, sum(CAST(starts AND i > 0 AS INT)) OVER (PARTITION BY page_id ORDER BY i) AS block FROM (
  SELECT page_id, language, i, line, CASE language {_STARTS} ELSE i % 200 = 0 END AS starts FROM (
    SELECT page_id, language, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS line FROM (SELECT page_id, language, CASE WHEN ends_with(code, chr(10)) THEN string_split(code, chr(10))[:-2] ELSE string_split(code, chr(10)) END AS l FROM (SELECT page_id, language, replace(replace(code, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS code FROM files))))"""
_CODE_BLOCKS = """SELECT *, language <> 'html' AND n < 3 AS small, block = max(block) OVER (PARTITION BY page_id) AS last FROM (SELECT page_id, any_value(language) AS language, block, count(*) AS n FROM code_lines GROUP BY page_id, block)"""
_CODE_CHUNKS = """SELECT page_id, goal, min(i) + 1 AS line_start, max(i) + 1 AS line_end, trim(string_agg(line, chr(10) ORDER BY i), chr(10) || chr(9) || chr(11) || chr(12) || ' ') AS content FROM (
  SELECT l.*, CASE WHEN NOT small THEN b.block WHEN last THEN max(CASE WHEN NOT small THEN b.block END) OVER (PARTITION BY l.page_id) END AS goal FROM code_lines l JOIN code_blocks b USING (page_id, block)) WHERE goal IS NOT NULL GROUP BY page_id, goal"""


def files(spark: SparkSession, d: str) -> DataFrame:
    """(page_id, language, code): pages as source files of five languages."""
    language = F.element_at(F.array(*map(F.lit, ["php", "python", "javascript", "typescript", "html"])), (F.col("page_id") % 5 + 1).cast("int"))
    word = F.when(F.col("language") == "python", "\ndef $1 ").when(F.col("language") == "typescript", "\ninterface $1 ").otherwise("\nfunction $1 ")
    return S.table(spark, d, "pages").select("page_id", "html", language.alias("language")).select("page_id", "language", F.regexp_replace("html", F.lit("<(p|h1|div)>"), word).alias("code"))


@query(sql("SELECT page_id AS id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY goal) - 1 AS INT) AS chunk_index, line_start, line_end, md5(content[:50000]) AS digest FROM (SELECT * FROM code_chunks WHERE length(content) >= 20)", files=_FILES, code_lines=_CODE_LINES, code_blocks=_CODE_BLOCKS, code_chunks=_CODE_CHUNKS))
def code_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of all files by the definitions of their languages."""
    return T.code_chunks(files(spark, d), "page_id", "code", F.col("language")).select("id", "chunk_index", "line_start", "line_end", "digest")

"""Structured filters and the compilation of query strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from recallum.functions.text import canonical_id
from recallum.sources.shared import against


def structured(code: str | None = None, categories: list[str] | None = None, level: str | None = None, ids: list[int] | None = None, after: str | None = None, before: str | None = None, session: str | None = None, kind: str | None = None) -> Column:
    """One predicate over memory rows, all parts joined by AND; Catalyst pushes it to the scan.  `kind` is the memory type (here the author)."""
    parts = [F.lit(True)]
    if code:
        parts.append(F.lower("code") == code.lower())
    if categories:
        parts.append(F.arrays_overlap("categories", F.array(*map(F.lit, categories))))
    if level:
        parts.append(F.lower("level") == level.lower())
    if ids:
        parts.append(F.col("id").isin(ids))
    if after:
        parts.append(F.col("date").cast("string") >= after)
    if before:
        parts.append(F.col("date").cast("string") <= before)
    if kind:
        parts.append(F.lower("author") == kind.lower())
    if session:
        parts.append(F.col("session_id") == session)
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


# The keys of a query string, with their synonyms.
KEYS = {"code": "code", "category": "category|categories|cat", "level": "nivel|level", "kind": "type|memory_type", "id": "id", "after": "after|since", "before": "before|until", "session": "session"}
FILTER = rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])({'|'.join(k for ks in KEYS.values() for k in sorted(ks.split('|'), key=len, reverse=True))}):(\S+)"
NUMBER = r"(?:^|[^\p{L}\p{N}_])#(\d{1,9})(?:$|\D)"
PHRASE = '"([^"]{2,})"'


def relative_date(text: Column, ref_date: str) -> Column:
    """`today` and `<n>d` as ISO dates before `ref_date`; anything else as it is; empty is null."""
    days = F.regexp_extract(F.lower(text), r"^(\d{1,4})d$", 1)
    ref = F.lit(ref_date).cast("date")
    return F.when(text == "", None).when(F.lower(text).isin("today", "hoy"), F.lit(ref_date)).when(days != "", F.date_sub(ref, days.cast("int")).cast("string")).otherwise(text)


def compile_queries(raw: DataFrame, ref_date: str, text_col: str = "raw") -> DataFrame:
    """Query strings → (qid, code, categories, level, kind, ids, after, before, session, phrases, clean).

    Phrases are taken out first.  Categories and ids may be lists and repeat; of
    other keys the last value counts.  A `#number` is an id where no `id:` is.
    """
    t = F.trim(text_col)
    phrases = F.filter(F.transform(F.regexp_extract_all(t, F.lit(PHRASE), F.lit(1)), lambda p: F.trim(p)), lambda p: p != "")
    bare = F.regexp_replace(t, PHRASE, " ")
    keys, values = (F.regexp_extract_all(bare, F.lit(FILTER), F.lit(k)) for k in (1, 2))
    pairs = F.transform(keys, lambda k, i: F.struct(F.lower(k).alias("k"), F.regexp_replace(F.get(values, i), r"^[,;]+|[,;]+$", "").alias("v")))
    rows = raw.select("qid", phrases.alias("phrases"), bare.alias("bare"), pairs.alias("pairs"))
    of = lambda name: F.transform(F.filter("pairs", lambda p: p["k"].isin(KEYS[name].split("|")) & (p["v"] != "")), lambda p: p["v"])
    last = lambda name: F.get(F.reverse(of(name)), F.lit(0))
    listed = lambda name: F.filter(F.flatten(F.transform(of(name), lambda v: F.split(v, "[,;]"))), lambda v: v != "")
    numbers = F.filter(listed("id"), lambda v: v.rlike(r"^\d+$"))
    hashed = F.regexp_extract("bare", NUMBER, 1)
    ids = F.when(F.size(numbers) > 0, numbers).when(hashed != "", F.array(hashed)).otherwise(F.array().cast("array<string>"))
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("bare", FILTER, " "), r"(^|[^\p{L}\p{N}_])#\d{1,9}($|\D)", "$1 $2"), r"\s+", " ")
    return rows.select(
        "qid", last("code").alias("code"), listed("category").alias("categories"), F.lower(last("level")).alias("level"), F.lower(last("kind")).alias("kind"), ids.alias("ids"),
        relative_date(last("after"), ref_date).alias("after"), relative_date(last("before"), ref_date).alias("before"), last("session").alias("session"), "phrases", F.trim(clean, F.lit(" ,;")).alias("clean"),
    )


def allowed(compiled: DataFrame, memory: DataFrame) -> DataFrame:
    """(qid, id) of the rows that each compiled query's filters let through, before any channel; queries without filters are left out.

    The query table goes to the rows in blocks of counted size.
    """
    q = compiled.where(F.expr("code IS NOT NULL OR size(categories) > 0 OR level IS NOT NULL OR kind IS NOT NULL OR size(ids) > 0 OR after IS NOT NULL OR before IS NOT NULL OR session IS NOT NULL"))
    q = q.select("qid", F.lower("code").alias("q_code"), F.col("categories").alias("q_categories"), F.col("level").alias("q_level"), F.col("kind").alias("q_kind"), F.col("ids").cast("array<bigint>").alias("q_ids"), F.col("after").alias("q_after"), F.col("before").alias("q_before"), F.col("session").alias("q_session"))
    day = F.col("date").cast("string")
    part = lambda name, test: F.col(name).isNull() | test
    on = (
        part("q_code", F.lower("code") == F.col("q_code")) & ((F.size("q_categories") == 0) | F.arrays_overlap("categories", "q_categories")) & part("q_level", F.lower("level") == F.col("q_level")) & part("q_kind", F.lower("author") == F.col("q_kind"))
        & ((F.size("q_ids") == 0) | F.array_contains("q_ids", F.col("id"))) & part("q_after", day >= F.col("q_after")) & part("q_before", day <= F.col("q_before")) & part("q_session", F.col("session_id") == F.col("q_session"))
    )
    return against(memory.select("id", "code", "categories", "level", "author", "date", "session_id"), q, on).select("qid", "id")


def exact_query(clean: Column, ids: Column, code: Column) -> Column:
    """Whether a query names rows rather than describes them: ids, a code, or one token like an identifier."""
    return F.coalesce((F.size(ids) > 0) | code.isNotNull() | clean.rlike(r"^[A-Za-z0-9_.:\-]{10,}$"), F.lit(False))


def trigger_only(text: Column) -> Column:
    """Whether all words of a query are `trigger:` ones."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    return (F.size(words) > 0) & F.forall(words, lambda w: F.startswith(F.lower(w), F.lit("trigger:")))


def route(text: Column, clean: Column, ids: Column, code: Column) -> Column:
    """How a query is answered: `trigger` by its trigger words alone, without a vector; `exact` by what it names, never re-ranked; else `search`."""
    return F.when(F.coalesce(trigger_only(text), F.lit(False)), "trigger").when(exact_query(clean, ids, code), "exact").otherwise("search")


def lookup(raw: DataFrame, memory: DataFrame) -> DataFrame:
    """(raw) id strings → the memory row each names, if there is one."""
    ids = raw.withColumn("cid", canonical_id(F.col("raw")))
    return ids.join(memory.withColumn("cid", F.concat(F.lit("v"), F.col("id"))), "cid", "left")


def page(df: DataFrame, k: int, offset: int = 0) -> DataFrame:
    """Newest first, nulls last, then the largest id; a page of the listing."""
    return df.orderBy(F.desc_nulls_last("date"), F.desc("id")).offset(offset).limit(k)


def top(df: DataFrame, k: int, by: str, *order: Column) -> DataFrame:
    """The first k rows of each `by` with their rank; Spark limits each group before it shuffles."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)

"""Rows on their way in and out: inserts, deletes, embeddings and small registers."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from recallum.functions import rules
from recallum.functions.text import summarise
from recallum.functions.vectors import cosine
from recallum.sources.tables import tokens

LEVELS, AUTHORS = ["episodic", "semantic", "automatic"], ["agent", "user", "import"]
#: Dimensions of the default embedding.
WIDTH = 64


def insert(rows: DataFrame, ref: Column, summary: int = 600) -> DataFrame:
    """(id, content, level, author, kind, categories) → the rows with defaults, a verdict, class, level, review count and summary.

    An empty text, an unknown level or author is rejected; a null level is
    episodic, a null kind `event`, a null author `agent`.  Reusable trade knowledge
    is promoted to semantic; automatic rules start with no review.
    """
    level, author = F.lower(F.coalesce("level", F.lit("episodic"))), F.coalesce("author", F.lit("agent"))
    blank = F.trim(F.coalesce("content", F.lit(""))) == ""
    verdict = F.when(blank, "empty").when(~level.isin(LEVELS), "level").when(~author.isin(AUTHORS), "author").otherwise("ok")
    t = rows.withColumn("t", rules.trade(F.col("content"), F.col("categories")))
    up = F.col("t.is_trade") & (F.col("t.reusability") == "high") & (level == "episodic")
    return t.select(
        "id", "content", verdict.alias("verdict"), F.when(up, "semantic").otherwise(level).alias("level"), author.alias("author"), F.coalesce("kind", F.lit("event")).alias("kind"), F.col("t.domain_profile").alias("domain_profile"), F.col("t.is_trade").alias("trade"),
        F.when(level == "automatic", 0).alias("review_count"), F.when(level == "automatic", ref).alias("created_at"), summarise(F.col("content"), summary).alias("summary"),
    )


def delete(memory: DataFrame, chunks: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Memory and chunks without the ids: a row's chunks go with it."""
    gone = ids.select("id").distinct()
    return memory.join(gone, "id", "left_anti"), chunks.join(gone, "id", "left_anti")


def register(old: DataFrame, new: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """A small register (subscriptions, watched paths) after additions, which replace rows of the same key, and removals."""
    return old.join(new.select(key), key, "left_anti").unionByName(new).join(gone.select(key), key, "left_anti")


def cases(spark, path: str) -> DataFrame:
    """Evaluation cases from a JSON file {"cases": [{"query": …, "expected": […]}]} → (case, query, id)."""
    raw = spark.read.schema("cases array<struct<query:string,expected:array<bigint>>>").json(path, multiLine=True)
    rows = raw.select(F.posexplode("cases").alias("case", "c"))
    return rows.select("case", "c.query", F.explode("c.expected").alias("id"))


def _places(s: pa.Array, width: int, known: dict[tuple[int, ...], int]) -> np.ndarray:
    """Words of each text, lower-cased and parted by single blanks → the sum of its distinct trigrams' signs in each of `width` places."""
    out = np.zeros((len(s), width), np.int32)
    text = ["" if t is None or t == "" else f"  {t.replace(' ', '   ')} " for t in s.to_pylist()]
    points = np.frombuffer("".join(text).encode("utf-32-le"), np.uint32)
    if len(points) < 3:
        return out
    of = np.repeat(np.arange(len(text)), [len(t) for t in text])
    # A trigram neither ends in two blanks nor reaches into the next text.
    real = np.flatnonzero(((points[1:-1] != 32) | (points[2:] != 32)) & (of[:-2] == of[2:]))
    letters = np.flatnonzero(np.bincount(points))
    code = np.zeros(int(letters[-1]) + 1, np.int64)
    code[letters] = np.arange(len(letters))
    code, size = code[points], len(letters)
    code = ((code[:-2] * size + code[1:-1]) * size + code[2:])[real]
    if size**3 <= 1 << 24:  # else sorted
        gram = np.flatnonzero(np.bincount(code, minlength=1))
        at = np.zeros(size**3, np.int32)
        at[gram] = np.arange(len(gram))
        at = at[code]
    else:
        gram, at = np.unique(code, return_inverse=True)
    here = np.zeros((len(text), len(gram)), bool)
    here[of[real], at] = True
    row, at = np.nonzero(here)
    if len(known) > 1 << 20:
        known.clear()
    digest = np.zeros(len(gram), np.int64)
    for k, g in enumerate(zip(*(letters[x].tolist() for x in (gram // size**2, gram // size % size, gram % size)), strict=True)):
        if (d := known.get(g)) is None:
            d = known[g] = int(md5("".join(map(chr, g)).encode()).hexdigest()[:4], 16)
        digest[k] = d
    digest = digest[at]
    np.add.at(out.reshape(-1), row * width + digest % width, np.where(digest // width % 2 == 0, 1, -1).astype(np.int32))
    return out


def embed(df: DataFrame, id_col: str, text_col: str, width: int = WIDTH, before: list[str] = []) -> DataFrame:  # noqa: B006
    """→ (id, embedding): a unit vector of hashed trigrams, the default where no model is given; texts without trigrams have none.

    Each distinct trigram adds 1 or -1 to one of `width` places, by its digest.  All is done where a row lies; only rows that
    repeat an id, if there are any, are added up in a shuffle.  With `before`, further columns embedding_1, … are the vectors of the
    text behind each of these words: one reading of the text serves all.
    """
    kind = df.schema[id_col].dataType.simpleString()
    words = F.array_join(tokens(F.col(text_col)), " ")
    names = ["embedding", *(f"embedding_{k}" for k in range(1, len(before) + 1))]

    def lists(x: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(0, width * len(x) + 1, width, dtype=np.int32)), pa.array(x.ravel()))

    def units(x: np.ndarray) -> pa.Array:
        norm = np.sqrt((x.astype(np.int64) ** 2).sum(1))
        return pc.if_else(pa.array(norm > 0), lists(x / np.where(norm > 0, norm, 1)[:, None]), None)

    def run(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, ...], int] = {}
        for b in (whole.slice(k, 256) for whole in batches for k in range(0, whole.num_rows, 256)):
            own = b.column(1)
            every = [own, *(pc.binary_join_element_wise(w, own, " ") for w in before)]
            yield pa.RecordBatch.from_arrays([b.column(0), *((units if last else lists)(_places(x, width, known)) for x in every)], names=["id", *names])

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *(units(c.flatten().to_numpy().reshape(-1, width)) for c in b.columns[1:])], names=["id", *names])

    schema = lambda of: f"id {kind}, " + ", ".join(f"{n} array<{of}>" for n in names)
    rows = df.select(F.col(id_col).alias("id"), words.alias("w"))
    if df.groupBy(id_col).count().where("count > 1").isEmpty():
        return rows.mapInArrow(lambda batches: run(batches, True), schema("double")).where("embedding IS NOT NULL")
    sums = rows.mapInArrow(lambda batches: run(batches, False), schema("int")).groupBy("id")
    added = sums.agg(*[F.array(*[F.sum(F.col(n)[k]) for k in range(width)]).alias(n) for n in names])
    return added.mapInArrow(scaled, schema("double")).where("embedding IS NOT NULL")


def contradicts(pairs: DataFrame, margin: float = 0.05) -> DataFrame:
    """(a_v, probe_v, b_v) vectors of a text, of its negation and of another text → with `contradicts`: whether the negation is nearer by the margin."""
    return pairs.withColumn("contradicts", cosine(F.col("probe_v"), F.col("b_v")) > cosine(F.col("a_v"), F.col("b_v")) + margin)


def sweep(rows: DataFrame, most: int) -> DataFrame:
    """(id, reason) → the next `most` rows to embed: those without a vector first, then by id."""
    order = Window.orderBy(F.col("reason") != "missing", "id")
    best = rows.orderBy(F.col("reason") != "missing", "id").limit(most)  # the window sees `most` rows
    return best.withColumn("turn", F.row_number().over(order))


def recommended(stats: DataFrame) -> DataFrame:
    """Statistics (n, p95, avg_top) → with `advice`: what to do, by thresholds."""
    rules_ = [("no_data", F.col("n") == 0), ("latency_very_high", F.col("p95") > 10000), ("latency_high", (F.col("p95") > 5000) & (F.col("p95") <= 10000)), ("low_relevance", F.col("avg_top") < 15), ("few_data", F.col("n") < 10)]
    return stats.withColumn("advice", F.array_join(F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules_])), ","))

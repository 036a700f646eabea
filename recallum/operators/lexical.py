"""Lexical search: postings for whole words; one scan of the texts for substrings and trigrams of a block of queries; scores."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from recallum.sources.shared import hinted, query_blocks
from recallum.sources.tables import tokens


def postings(df: DataFrame, id_col: str, text_col: str, terms: DataFrame | None = None) -> DataFrame:
    """→ (term, id, tf, first): uses of each token (of those in `terms`) in each text and its first place; combined before the shuffle."""
    rows = df.select(F.col(id_col).alias("id"), F.posexplode(tokens(F.col(text_col))).alias("pos", "term"))
    if terms is not None:
        rows = rows.join(hinted(terms), "term", "left_semi")
    return rows.groupBy("id", "term").agg(F.count("*").alias("tf"), F.min("pos").alias("first"))


def asked(queries: DataFrame, terms_col: str) -> DataFrame:
    """The distinct terms of a query table."""
    return queries.select(F.explode(terms_col).alias("term")).distinct()


def and_match(queries: DataFrame, terms_col: str, posts: DataFrame) -> DataFrame:
    """Documents that have all terms of a query: an equi-join on terms and a count."""
    q = queries.select("qid", F.size(terms_col).alias("n"), F.explode(terms_col).alias("term"))
    return q.join(posts.select("term", "id"), "term").groupBy("qid", "id").agg(F.count("*").alias("hits"), F.first("n").alias("n")).where("hits = n").select("qid", "id")


def or_match(queries: DataFrame, terms_col: str, posts: DataFrame) -> DataFrame:
    """(qid, id, coverage, tf): documents with any term, the share of terms and their uses."""
    q = queries.select("qid", F.size(terms_col).alias("n"), F.explode(terms_col).alias("term"))
    return q.join(posts, "term").groupBy("qid", "id").agg((F.count("*") / F.first("n")).alias("coverage"), F.sum("tf").alias("tf"))


WORDS = re.compile(r"\w+")


class Block:
    """A block of queries as an automaton over their terms and matrices from terms and trigrams to queries."""

    def __init__(self, qids: np.ndarray, terms: list[list[str]], texts: list[str | None] | None) -> None:
        self.qids, self.n = qids, np.array([len(t) for t in terms], np.int32)
        at = {t: k for k, t in enumerate(dict.fromkeys(t for ts in terms for t in ts if t))}
        self.own = [np.array([at[t] for t in ts if t], np.int64) for ts in terms]
        self.of_term = np.zeros((len(at), len(qids)), np.float32)
        for q, mine in enumerate(self.own):
            np.add.at(self.of_term, (mine, q), 1)
        self.sizes = np.array([len(t) for t in at], np.int64)
        self.automaton = None
        if at:
            self.automaton = ahocorasick.Automaton()
            for t, k in at.items():
                self.automaton.add_word(t, k)
            self.automaton.make_automaton()
        grams = [_grams(t or "") for t in texts] if texts is not None else []
        self.gram = {g: k for k, g in enumerate(dict.fromkeys(g for gs in grams for g in gs))}
        self.nq = np.array([len(g) for g in grams], np.float64)
        self.of_gram = np.zeros((len(self.gram), len(qids)), np.float32)
        for q, gs in enumerate(grams):
            self.of_gram[[self.gram[g] for g in gs], q] = 1

    def scores(self, texts: list[str], spans: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
        """(queries x texts) numbers of terms that occur, trigram similarities, and the distance between the terms' first places."""
        first = np.full((len(texts), len(self.sizes)), -1, np.int32)
        if self.automaton is not None:
            for r, text in enumerate(texts):
                seen: dict[int, int] = {}
                for end, k in self.automaton.iter(text):
                    if k not in seen:
                        seen[k] = end
                if seen:
                    k = np.fromiter(seen, np.int64, len(seen))
                    first[r, k] = np.fromiter(seen.values(), np.int64, len(seen)) - self.sizes[k] + 1
        hits = ((first >= 0).astype(np.float32) @ self.of_term).T
        span = similarity = None
        if spans:
            span = np.zeros(hits.shape, np.int32)
            for q, mine in enumerate(self.own):
                if len(mine):
                    p = first[:, mine]
                    span[q] = np.where(p >= 0, p, -1).max(1) - np.where(p >= 0, p, 1 << 30).min(1)
        if len(self.nq):
            has, nd = np.zeros((len(texts), len(self.gram)), np.float32), np.zeros(len(texts))
            for r, text in enumerate(texts):
                gs = _grams(text)
                nd[r] = len(gs)
                has[r, [self.gram[g] for g in gs if g in self.gram]] = 1
            both = (has @ self.of_gram).T.astype(np.float64)
            similarity = both / np.maximum(self.nq[:, None] + nd[None, :] - both, 1)
        return hits, similarity, span


def _grams(text: str) -> set[str]:
    out: set[str] = set()
    for w in set(WORDS.findall(text.lower())):
        p = f"  {w} "
        out.update([p[i : i + 3] for i in range(len(w) + 1)])
    return out


def _best(q: np.ndarray, score: np.ndarray, keys: list[np.ndarray], k: int) -> np.ndarray:
    """Places of each query's k best rows by score, then by keys."""
    order = np.lexsort((*reversed(keys), -score, q))
    start = np.searchsorted(q[order], q[order], side="left")
    return order[np.arange(len(q)) - start < k]


def scan(queries: DataFrame, corpus: DataFrame, keys: list[str], k: int | None = None, least_hits: int = 1, least_similarity: float | None = None, by: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None, spans: bool = False) -> DataFrame:
    """(qid, terms, clean?) and (keys…, text) → (qid, keys…, hits, n, similarity, span) of pairs with `least_hits` terms as substrings or `least_similarity`.

    Each text is read once for a block of queries: an automaton over all their
    terms finds those it contains, and its trigrams are multiplied with the
    queries' (where there is a column `clean`).  With `k` only each query's k best
    rows of a task by `by(hits, n, similarity)`, then by the keys, leave it.
    """
    trigrams = "clean" in queries.columns
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in corpus.select(*keys).schema]
    schema = ", ".join(["qid bigint", *fields, "hits int", "n int", "similarity double", "span int"])
    rows, sc = corpus.select(*keys, "text").where("text IS NOT NULL"), queries.sparkSession.sparkContext
    out = None
    for got in query_blocks(queries, ["qid", "terms", *(["clean"] if trigrams else [])]):
        sent = sc.broadcast((got["qid"].to_numpy(), [t or [] for t in got["terms"].to_pylist()], got["clean"].to_pylist() if trigrams else None))

        def run(batches: Iterator[pa.RecordBatch], sent: object = sent) -> Iterator[pa.RecordBatch]:
            block = Block(*sent.value)
            least = np.full(len(block.qids), -np.inf)
            held: list[tuple] = []

            def cut_down() -> None:
                q, s, cols, rest = _joined(held)
                some = _best(q, s, [c.to_numpy(zero_copy_only=False) for c in cols], k)
                held[:] = [(q[some], s[some], [c.take(pa.array(some)) for c in cols], [x[some] for x in rest])]
                for at, score in zip(q[some], s[some], strict=True):
                    full[at] += 1
                    lowest[at] = min(lowest[at], score)
                least[:] = np.where(full >= k, lowest, -np.inf)
                full[:], lowest[:] = 0, np.inf

            full, lowest = np.zeros(len(least), np.int64), np.full(len(least), np.inf)
            for b in (whole.slice(a, 256) for whole in batches for a in range(0, whole.num_rows, 256)):
                hits, similarity, span = block.scores(b.column(len(keys)).to_pylist(), spans)
                keep = hits >= least_hits
                if least_similarity is not None and similarity is not None:
                    keep |= similarity >= least_similarity
                score = None
                if k is not None:
                    score = np.floor(by(hits, block.n[:, None], similarity) * 1e6 + 0.5) / 1e6
                    keep &= score >= least[:, None]
                q, r = np.nonzero(keep)
                at = pa.array(r)
                rest = [hits[q, r].astype(np.int32), block.n[q], similarity[q, r] if similarity is not None else np.zeros(len(q)), span[q, r] if span is not None else np.zeros(len(q), np.int32)]
                held.append((q, score[q, r] if score is not None else q, [b.column(c).take(at) for c in range(len(keys))], rest))
                if k is None:
                    yield _batch(block, held, keys)
                    held = []
                elif sum(len(h[0]) for h in held) > max(1 << 18, 4 * k * len(block.qids)):
                    cut_down()
            if held:
                if k is not None:
                    cut_down()
                yield _batch(block, held, keys)

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else rows.limit(0).mapInArrow(lambda batches: iter(()), schema)


def _joined(held: list[tuple]) -> tuple[np.ndarray, np.ndarray, list[pa.Array], list[np.ndarray]]:
    q, s, cols, rest = zip(*held, strict=True)
    return np.concatenate(q), np.concatenate(s), [pa.concat_arrays(c) for c in zip(*cols, strict=True)], [np.concatenate(x) for x in zip(*rest, strict=True)]


def _batch(block: Block, held: list[tuple], keys: list[str]) -> pa.RecordBatch:
    q, _, cols, rest = _joined(held)
    return pa.RecordBatch.from_arrays([pa.array(block.qids[q]), *cols, *map(pa.array, rest)], names=["qid", *keys, "hits", "n", "similarity", "span"])


def substring_hits(queries: DataFrame, terms_col: str, corpus: DataFrame, least: int = 1, spans: bool = False) -> DataFrame:
    """(qid, id, hits, n, span): rows that contain at least `least` terms as substrings."""
    return scan(queries.select("qid", F.col(terms_col).alias("terms")), corpus.select("id", F.lower("content").alias("text")), ["id"], least_hits=least, spans=spans).drop("similarity")


def trigram_matches(queries: DataFrame, q_text: str, corpus: DataFrame, k: int) -> DataFrame:
    """(qid, id, similarity): the k rows of the largest trigram similarity to each query, of those that share a trigram, by task."""
    got = scan(queries.select("qid", F.array().cast("array<string>").alias("terms"), F.col(q_text).alias("clean")), corpus.select("id", F.col("content").alias("text")), ["id"], k, least_similarity=1e-12, by=lambda hits, n, similarity: similarity)
    return got.select("qid", "id", "similarity")


def lexical_hits(queries: DataFrame, corpus: DataFrame, k: int | None = None) -> DataFrame:
    """(qid, id, hits, n, similarity) of rows that contain a strong term; with k, at least the best k by `lexical_score`."""
    score = lambda hits, n, similarity: np.minimum(100.0, np.round(70.0 * hits.astype(np.float64) / np.maximum(n, 1) + 20.0 * similarity + 15.0, 4))
    return scan(queries.select("qid", F.col("strong").alias("terms"), "clean"), corpus.select("id", F.lower("content").alias("text")), ["id"], k, by=score).drop("span")


def best_chunks(queries: DataFrame, chunks: DataFrame, k: int = 60) -> DataFrame:
    """(qid, strong) and (id, chunk_index, text in lower case) → (qid, id, chunk_index, score): of each query's k best chunks the best of each row."""
    score = lambda hits, n, _: np.round(np.minimum(45.0, 30.0 + 60.0 * (hits / (hits + 8.0)) + 10.0 * hits / np.maximum(n, 1)), 4)
    hit = scan(queries.select("qid", F.col("strong").alias("terms")), chunks, ["id", "chunk_index"], k, by=lambda hits, n, s: score(hits.astype(np.float64), n, s))
    scored = hit.select("qid", "id", "chunk_index", chunk_score(F.col("hits") / (F.col("hits") + 8.0), F.col("hits") / F.col("n")).alias("score"))
    top = scored.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id", "chunk_index"))).where(F.col("r") <= k)
    return top.groupBy("qid", "id").agg(F.max(F.struct("score", (-F.col("chunk_index")).alias("k"))).alias("b")).select("qid", "id", (-F.col("b.k")).alias("chunk_index"), "b.score")


def lexical_score(hits: Column, n: Column, similarity: Column) -> Column:
    """At most 100: 70 times the share of terms, 20 times the trigram similarity, 15 for any term."""
    return F.round(F.least(F.lit(100.0), 70.0 * hits / n + 20.0 * similarity + F.when(hits > 0, 15.0).otherwise(0.0)), 4)


def fulltext_score(rank: Column) -> Column:
    return F.round(F.greatest(F.lit(30.0), F.least(F.lit(100.0), 45.0 + 300.0 * rank)), 4)


def chunk_score(rank: Column, coverage: Column) -> Column:
    return F.round(F.least(F.lit(45.0), 30.0 + 60.0 * rank + 10.0 * coverage), 4)


def cascade_scores(hits: Column, n: Column, similarity: Column) -> tuple[Column, Column]:
    """Scores of the trigram and the substring phase."""
    return F.round(60.0 * hits / n + 25.0 * similarity + 10.0, 4), F.round(70.0 * hits / n + 10.0, 4)

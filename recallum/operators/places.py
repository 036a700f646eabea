"""Ranking by where words stand: cover density of stemmed words, and the smallest window of groups of variants.

Texts are read once for a block of queries; a task keeps only each query's best rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from recallum.functions import rulesets
from recallum.operators.lexical import _best
from recallum.sources.shared import query_blocks
from recallum.sources.tables import TOKEN

#: A word's stem: what is left before the longest of these endings, of three letters at least.  Endings of Spanish; a parameter.
STEM = r"^(.{3,}?)(?:amientos?|imientos?|aciones|ación|adoras?|adores|ancias?|encias?|idades|idad|mente|ando|iendo|ad[ao]s?|id[ao]s?|aron|ieron|aban?|ar|er|ir|os|as|es|o|a|e|s)$"
#: What a cover counts that holds nothing but the words asked for.
WEIGHT = 0.1


def stemmed(word: Column, pattern: str = STEM) -> Column:
    return F.regexp_replace(word, pattern, "$1")


def covers(places: list[list[int]]) -> list[tuple[int, int]]:
    """(first and last place) of the minimal stretches that hold a place of each list, from rising lists of places."""
    entries = sorted((p, t) for t, of in enumerate(places) for p in of)
    count, left, missing, out = [0] * len(places), 0, len(places), []
    for p, t in entries:
        count[t] += 1
        missing -= count[t] == 1
        while not missing and count[entries[left][1]] > 1:
            count[entries[left][1]] -= 1
            left += 1
        if not missing and count[t] == 1:
            out.append((entries[left][0], p))
    return out


def density(places: list[list[int]]) -> float:
    """The sum over minimal stretches of WEIGHT / (1 + other words in them)."""
    every = np.sort(np.concatenate([np.array(p) for p in places]))
    found = np.array(covers(places))
    held = np.searchsorted(every, found[:, 1], "right") - np.searchsorted(every, found[:, 0])
    return float((WEIGHT / (1 + found[:, 1] - found[:, 0] + 1 - held)).sum())


def cover_ranks(queries: DataFrame, terms_col: str, corpus: DataFrame, k: int, every: bool = True, stem: str | None = STEM) -> DataFrame:
    """(qid, terms) and (id, content) → (qid, id, rank): at least each query's k best rows by cover density of the stems of its terms.

    With `every`, rows that hold all of a query's stems, by the minimal stretches that hold all; else rows that hold any,
    where each use is a stretch of its own.  Terms of equal stems are one; a query without terms finds nothing.
    """
    rows = corpus.select("id", F.col("content").alias("text")).where("text IS NOT NULL")
    sc, out, schema = queries.sparkSession.sparkContext, None, f"qid bigint, id {corpus.schema['id'].dataType.simpleString()}, rank double"
    for got in query_blocks(queries.select("qid", F.col(terms_col).alias("terms")), ["qid", "terms"]):
        sent = sc.broadcast((got["qid"].to_numpy(), [t or [] for t in got["terms"].to_pylist()]))

        def run(batches: Iterator[pa.RecordBatch], sent: object = sent) -> Iterator[pa.RecordBatch]:
            qid, asked = sent.value
            word, cut = regex.compile(TOKEN), re.compile(stem) if stem else None
            root = lambda w: cut.sub(r"\1", w) if cut else w
            own = [sorted({root(t.lower()) for t in ts}) for ts in asked]
            at = {t: i for i, t in enumerate(dict.fromkeys(t for ts in own for t in ts))}
            mine = [np.array([at[t] for t in ts], np.int64) for ts in own]
            of_term = np.zeros((len(at), len(qid)), np.float32)
            for q, m in enumerate(mine):
                of_term[m, q] = 1
            need = np.array([len(m) for m in mine])
            known: dict[str, int] = {}
            held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
            for b in (whole.slice(s, 256) for whole in batches for s in range(0, whole.num_rows, 256)):
                uses = np.zeros((b.num_rows, len(at)), np.float32)
                places: list[dict[int, list[int]]] = []
                for r, text in enumerate(b.column(1).to_pylist()):
                    here: dict[int, list[int]] = {}
                    for pos, w in enumerate(word.findall(text.lower())):
                        if (t := known.get(w)) is None:
                            if len(known) > 1 << 18:
                                known.clear()
                            t = known[w] = at.get(root(w), -1)
                        if t >= 0:
                            here.setdefault(t, []).append(pos)
                    for t, of in here.items():
                        uses[r, t] = len(of)
                    places.append(here)
                if every:
                    row, q = np.nonzero(((uses > 0).astype(np.float32) @ of_term >= need) & (need > 0))
                    rank = np.array([density([places[i][t] for t in mine[j].tolist()]) for i, j in zip(row.tolist(), q.tolist(), strict=True)], float)
                else:
                    found = uses @ of_term
                    row, q = np.nonzero(found)
                    rank = WEIGHT * found[row, q].astype(float)
                held.append((q, np.round(rank, 6), b.column(0).take(pa.array(row))))
                if sum(len(h[0]) for h in held) > max(1 << 16, 4 * k * len(qid)):
                    held = [_kept(held, k)]
            if held:
                q, rank, ids = _kept(held, k)
                yield pa.RecordBatch.from_arrays([pa.array(qid[q]), ids, pa.array(rank)], names=["qid", "id", "rank"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else rows.limit(0).mapInArrow(lambda batches: iter(()), schema)


def _kept(held: list[tuple[np.ndarray, np.ndarray, pa.Array]], k: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    q, rank = (np.concatenate([h[i] for h in held]) for i in (0, 1))
    ids = pa.concat_arrays([h[2] for h in held])
    some = _best(q, rank, [ids.to_numpy(zero_copy_only=False)], k)
    return q[some], rank[some], ids.take(pa.array(some))


def concepts(terms: Column, stems: dict[str, list[str]] = rulesets.STEMS, least: int = 3) -> Column:
    """Terms → for each (of `least` characters) the group of its variants: itself, and those of every root that it contains or that contains it."""

    def group(t: Column) -> Column:
        more = [F.when(F.contains(t, F.lit(root)) | F.contains(F.lit(root), t), F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>")) for root, names in stems.items()]
        return F.array_distinct(F.filter(F.concat(F.array(t), *more), lambda v: F.length(v) >= least))

    return F.transform(F.filter(terms, lambda t: F.length(t) >= least), group)


def _sides(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A group's places by start, each with the first end of it and all later ones."""
    order = np.argsort(starts, kind="stable")
    return starts[order], np.minimum.accumulate(ends[order][::-1])[::-1]


def _smallest(sides: list[tuple[np.ndarray, np.ndarray]], most: float = np.inf) -> tuple[int, int]:
    """`smallest_window` of `_sides`; if it is longer than `most`, a stretch that is longer, too.

    A stretch holds a place of the rarest group, so others' places matter only near one of those.
    """
    rare = min(sides, key=lambda s: len(s[0]))[0]
    starts = []
    for s, _ in sides:
        if most < np.inf and s is not rare and len(s) > 64:
            k = np.searchsorted(rare, s)
            s = s[(k < len(rare)) & (rare[np.minimum(k, len(rare) - 1)] - s <= most)]
        starts.append(s)
    at = np.unique(np.concatenate(starts))
    at = at[at <= min(s[-1] for s, _ in sides)]
    if not len(at):
        return 0, int(most) + 1
    last = np.max([e[np.searchsorted(s, at)] for s, e in sides], axis=0)
    best = int(np.argmin(last - at))
    return int(at[best]), int(last[best])


def smallest_window(groups: list[tuple[np.ndarray, np.ndarray]]) -> tuple[int, int]:
    """(start, end) of the shortest stretch with a place of each group, the first of equals, from (starts, ends) of the groups' places."""
    return _smallest([_sides(*g) for g in groups])


def bonus(found: int, groups: int, span: int) -> int:
    """30 up to 150 characters, 20 up to 350, 8 up to 700 where all groups are found; 10 up to 150 for two at least."""
    if found < 2:
        return 0
    full = found == groups
    return 30 if full and span <= 150 else 20 if full and span <= 350 else 8 if full and span <= 700 else 10 if span <= 150 else 0


def concept_windows(queries: DataFrame, corpus: DataFrame, before: int = 200, after: int = 300) -> DataFrame:
    """(qid, concepts) and (id, content) → (qid, id, found, span, bonus, passage) of rows where a query's concepts stand near one another.

    A concept is found where any of its variants occurs, as a substring of the lower-cased text; the span is that of the smallest window with a place of every concept
    found.  The passage reaches from `before` characters before the window to `after` behind it, from the next line or sentence on if one begins soon.
    """
    rows = corpus.select("id", F.col("content").alias("text")).where("text IS NOT NULL")
    sc, out, schema = queries.sparkSession.sparkContext, None, f"qid bigint, id {corpus.schema['id'].dataType.simpleString()}, found int, span int, bonus int, passage string"
    for got in query_blocks(queries.select("qid", "concepts"), ["qid", "concepts"]):
        sent = sc.broadcast((got["qid"].to_pylist(), got["concepts"].to_pylist()))

        def run(batches: Iterator[pa.RecordBatch], sent: object = sent) -> Iterator[pa.RecordBatch]:
            qid, groups = sent.value
            at = {v: i for i, v in enumerate(dict.fromkeys(v for gs in groups for g in gs or [] for v in g))}
            auto = ahocorasick.Automaton()
            for v, i in at.items():
                auto.add_word(v, (i, len(v)))
            if not at:
                return
            auto.make_automaton()
            # Concepts that queries share are found once: which variants each has, and which concepts each query.
            every = list(dict.fromkeys(tuple(g) for gs in groups for g in gs or []))
            place = {g: c for c, g in enumerate(every)}
            mine = [[place[tuple(g)] for g in gs or []] for gs in groups]
            of_variant: list[list[int]] = [[] for _ in at]
            for c, g in enumerate(every):
                for v in g:
                    of_variant[at[v]].append(c)
            of_concept = np.zeros((len(every), len(qid)), np.float32)
            for q, cs in enumerate(mine):
                np.add.at(of_concept, (cs, q), 1)
            for b in (whole.slice(s, 256) for whole in batches for s in range(0, whole.num_rows, 256)):
                rows, sides, low = [], [], b.column(1).to_pylist()
                has = np.zeros((b.num_rows, len(every)), np.float32)
                for r, text in enumerate(low):
                    here: dict[int, tuple[list[int], list[int]]] = {}
                    for end, (v, n) in auto.iter(text.lower()):
                        s, e = here.setdefault(v, ([], []))
                        s.append(end - n + 1)
                        e.append(end + 1)
                    has[r, [c for v in here for c in of_variant[v]]] = 1
                    sides.append(here)
                # Of a query at least two concepts are found: one product for all texts and queries.
                many = has @ of_concept
                last, made = -1, {}
                for r, q in zip(*(x.tolist() for x in np.nonzero(many >= 2)), strict=True):
                    if r != last:
                        last, made = r, {}
                    found = []
                    for c in mine[q]:
                        if c not in made:
                            own = [sides[r][at[v]] for v in every[c] if at[v] in sides[r]]
                            made[c] = _sides(np.array([x for s, _ in own for x in s]), np.array([x for _, e in own for x in e])) if own else None
                        if made[c] is not None:
                            found.append(made[c])
                    start, end = _smallest(found, 700 if len(found) == len(mine[q]) else 150)
                    if up := bonus(len(found), len(mine[q]), end - start):
                        rows.append((qid[q], b.column(0)[r].as_py(), len(found), end - start, up, _passage(low[r][max(0, start - before) : end + after], min(start, before))))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], b.column(0).type), *(pa.array(c, pa.int32()) for c in cols[2:5]), pa.array(cols[5], pa.string())], names=["qid", "id", "found", "span", "bonus", "passage"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else rows.limit(0).mapInArrow(lambda batches: iter(()), schema)


def _passage(part: str, lead: int) -> str:
    """`part` from the line, or else the sentence, that begins within its first characters, and not behind the window's start; blanks made single."""
    line = part.find("\n")
    if 0 <= line <= min(180, lead - 1):
        part = part[line + 1 :]
    elif (s := re.search(r"(?<=[.!?])\s+", part[: min(220, lead)])) is not None:
        part = part[s.end() :]
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", part)).strip()

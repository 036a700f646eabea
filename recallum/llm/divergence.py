"""Divergence of a language's sources from each other, by run-length columns.

A group (a language's source) is a column of counts over the language's vocabulary.
Terms whose counts agree in all groups differ in nothing here, so they are one entry with a length.  Entries
are numbered in the order of their counts, which clusters equal ones, and cut into blocks; a block
orders its entries by the largest groups' counts first and run-length encodes each group's column.  For a pair of groups
the boundaries of both columns' runs are merged; between two boundaries both counts are
constant, so the pair's value there is f times the length.  No task holds a vocabulary, and values add up over blocks.

Counts are made in the tasks (per document, then per task) before anything is shuffled.

Defined results: null text, language or source is ''; terms are matches of
`[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+` with A-Z lower-cased; a term stays where at least `LEAST` of a language's
documents have it; a group without such terms has counts of zero; a language without such terms gives pairs of value 0; a
repeated row is a document of its own; other columns are ignored; an empty table gives no rows.
All arithmetic is on 64-bit integers: exact up to 9 * 10^15 terms a group.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from recallum.operators.numbering import numbered
from recallum.sources.shared import cut, hinted

LEAST, TOP, SCALE = 3, 200, 1_000_000_000
#: Entries of a block; terms and bytes of text that a task counts before it passes its counts on.
BLOCK, HELD, BYTES = 2048, 1 << 18, 64 << 20

#: Lower-cases A-Z, keeps a-z and bytes from 128 on (parts of other letters); all else separates terms.
_LETTERS = bytes(b | 32 if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else b if chr(b) in "abcdefghijklmnopqrstuvwxyz" or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


def counted(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """`docs` → (lang, source, term, n, docs): occurrences and documents of each term, from each task's whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = size = 0

        def passed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in found.items():
                keys = list(n)
                for k in range(0, len(keys), 1 << 15):
                    some = keys[k : k + (1 << 15)]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array(some, pa.binary()), pa.array([n[t] for t in some], pa.int64()), pa.array([docs[t] for t in some], pa.int64())], names=["lang", "source", "term", "n", "docs"])
            found.clear()

        for b in batches:
            for text, lang, source in zip(b.column(0).cast(pa.binary()), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                got = terms(text.as_py())
                n, docs = found.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                n.update(got)
                docs.update(set(got))
                held, size = held + len(n) - before, size + len(text.as_buffer())
                if held >= HELD or size >= BYTES:
                    yield from passed_on()
                    held = size = 0
        yield from passed_on()

    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))))
    made = rows.mapInArrow(run, "lang string, source string, term binary, n bigint, docs bigint")
    return made.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def smoothed(count: Column, size: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / size) in 64-bit integers, three decimal digits at a time; `size` is above `count`."""
    left, value = count + 1, F.lit(0).cast("bigint")
    for _ in range(3):
        value = value * 1000 + F.call_function("div", left * 1000, size)
        left = left * 1000 % size
    return value + 1


def _smoothed(count: np.ndarray, size: int) -> np.ndarray:
    left, value = count + 1, np.zeros(len(count), np.int64)
    for _ in range(3):
        value = value * 1000 + left * 1000 // size
        left = left * 1000 % size
    return value + 1


def runs(column: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run-length encode a column whose entry k reaches to ends[k] → (ends of the runs, their values)."""
    last = np.flatnonzero(np.append(column[1:] != column[:-1], True))
    return ends[last], column[last]


def intersected(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
    """Two run-length columns of values p and q → the sums of floor((p-q)^2/q) and floor((p-q)^2/p) over all places."""
    ends = np.union1d(a[0], b[0])
    p, q = a[1][np.searchsorted(a[0], ends)], b[1][np.searchsorted(b[0], ends)]
    length, square = np.diff(ends, prepend=0), (p - q) ** 2
    return int((square // q * length).sum()), int((square // p * length).sum())


def block_sums(entries: pa.Table, groups: pa.Table) -> pa.Table:
    """A block's entries (counts, length) and all groups of its language (lang, gid, size) → (lang, gid, other, value)."""
    gid, size = np.array(groups["gid"]), groups["size"].to_pylist()
    lists = entries["counts"].combine_chunks()
    flat = lists.flatten()
    row = np.repeat(np.arange(len(lists)), np.diff(np.array(lists.offsets)))
    place = {g: k for k, g in enumerate(gid.tolist())}
    counts = np.zeros((len(lists), len(gid)), np.int64)
    counts[row, [place[g] for g in flat.field("gid").to_pylist()]] = np.array(flat.field("n"), np.int64)
    by_size = np.argsort([-s for s in size], kind="stable")
    order = np.lexsort(counts[:, by_size[::-1]].T) if len(lists) else np.zeros(0, np.int64)
    ends = np.cumsum(np.array(entries["length"], np.int64)[order])
    columns = []
    for k, s in enumerate(size):
        at, value = runs(counts[order, k], ends) if len(lists) else (ends, ends)
        columns.append((at, _smoothed(value, s) if len(value) else value))
    one, two, value = [], [], []
    for i in range(len(gid)):
        for j in range(i):
            x, y = intersected(columns[i], columns[j])
            one += (gid[i], gid[j])
            two += (gid[j], gid[i])
            value += (x, y)
    return pa.table({"lang": pa.array([groups["lang"][0].as_py()] * len(one), pa.string()), "gid": pa.array(one, pa.int64()), "other": pa.array(two, pa.int64()), "value": pa.array(value, pa.int64())})


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, block: int = BLOCK, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """`docs` → (lang, source, part, item, value, rank): every other source's divergence (`pair`) and the `top` terms that a source overuses (`term`)."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    groups = cut(numbered(docs.select(name(lang_col).alias("lang"), name(source_col).alias("source")).distinct(), "lang", ["source"], "gid"))
    known = hinted(groups.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), "gid"))
    found = counted(docs, text_col, lang_col, source_col).join(known, (F.col("lang") == F.col("__lang")) & (F.col("source") == F.col("__source")))
    vocabulary = cut(
        found.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("gid", "n"))).alias("counts"))
        .where(F.col("docs") >= least).select("lang", "term", "total", "counts")
    )

    used = vocabulary.select("lang", "term", "total", F.explode("counts").alias("c")).select("lang", "term", "total", "c.gid", "c.n")
    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("all"))
    sums = used.groupBy("lang", "gid").agg(F.sum("n").alias("n"))
    size = F.coalesce("n", F.lit(0)) + F.coalesce("v", F.lit(0))
    stats = cut(groups.join(sums, ["lang", "gid"], "left").join(langs, "lang", "left").select("lang", "gid", "source", size.alias("size"), (F.coalesce("all", F.lit(0)) + F.coalesce("v", F.lit(0))).alias("lang_size")))
    names = hinted(stats.select(F.col("lang").alias("__lang"), F.col("gid").alias("__gid"), "source", "size", "lang_size"))

    def ranked(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "gid").orderBy(F.desc("value"), "item")))

    p, q = smoothed(F.col("n"), F.col("size")), smoothed(F.col("total"), F.col("lang_size"))
    over = used.join(names, (F.col("lang") == F.col("__lang")) & (F.col("gid") == F.col("__gid"))).select("lang", "gid", "source", F.lit("term").alias("part"), F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    term = ranked(over.withColumn("value", F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q")))).where(F.col("rank") <= top)

    entries = cut(vocabulary.groupBy("lang", "counts").agg(F.count("*").alias("length")))
    blocks = numbered(entries, "lang", ["counts"], "n").select("lang", "counts", "length", F.floor((F.col("n") - 1) / block).alias("block"))
    many = entries.groupBy("lang").agg(F.count("*").alias("n"))
    sizes = stats.join(many, "lang", "left").select("lang", "gid", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0).cast("bigint"), F.floor((F.coalesce("n", F.lit(1)) - 1) / block)))).alias("block"))
    summed = blocks.groupBy("lang", "block").cogroup(sizes.groupBy("lang", "block")).applyInArrow(block_sums, "lang string, gid bigint, other bigint, value bigint")
    pairs = summed.groupBy("lang", "gid", "other").agg(F.sum("value").alias("value"))
    named = pairs.join(names, (F.col("lang") == F.col("__lang")) & (F.col("gid") == F.col("__gid"))).drop("__lang", "__gid", "size", "lang_size")
    others = hinted(stats.select(F.col("lang").alias("__lang"), F.col("gid").alias("__gid"), F.col("source").alias("item")))
    pair = ranked(named.join(others, (F.col("lang") == F.col("__lang")) & (F.col("other") == F.col("__gid"))).withColumn("part", F.lit("pair")))

    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pair.select(columns).unionByName(term.select(columns))

"""Alignment of two tokenizers by sparse products of token-byte incidence matrices.

A token sequence is a matrix of tokens by bytes, in compressed sparse rows: row i has a one at each byte that
token i covers.  The product of one tokenizer's matrix with the other's transpose, by Gustavson's row-wise method,
has an entry (its value: shared bytes) for each pair of tokens whose bytes overlap: the overlap links.  Bytes at which tokens of
both end cut the text into groups; the product of the two token-group incidence matrices has an entry for each pair
that shares a group.  Its pattern is counted row by row, not stored, where only the number is asked for.

No token of either tokenizer crosses a border where a space or line feed follows another character that is no white
space, so a text is the sequence of its segments.  A worker encodes a segment once and remembers it.  Both sequences of ids are kept
in the shared folder (two bytes a token), and a batch of texts is one block-diagonal product, cut where tokens of both end.

How many documents hold a link is counted in the tasks before the shuffle.  The most frequent links (at most `HOT`,
fewer bytes than 2^25) and the highest count of every id go to the tasks; what a document has of other links is joined
by shuffle, so no size of the table is beyond it.

Defined results: null or empty texts, and texts whose joined token bytes differ from space + text (those with U+2581),
have no tokens, zeros and '' for the hash; strings of special tokens are plain text; a repeated row is a
document of its own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from recallum.sources.shared import cut, hinted, written

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Links sent to all tasks; segments of a generation that a worker remembers, and the most characters of one; links that a task counts before it passes them on.
HOT, REMEMBERED, LONGEST, HELD = 1 << 21, 1 << 17, 48, 1 << 20
#: Bytes that a product covers at once, if the tokens have a common border in them.
AT_ONCE = 1 << 16
#: A segment goes up to a space or line feed after another character than white space.
SEGMENT = re.compile(r"\s*\S+(?:[^\S \n]\s*\S+)*(?:\s+\Z)?|\s+\Z")
#: Segments of these characters alone are of the same classes in any Unicode version; the rank encoder of tiktoken gives the tokenizer's ids for them.
PLAIN = re.compile(r"[\x00-\x1b -ͳ‐-‧€]*")
CLASSES = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Csr(NamedTuple):
    """Compressed sparse rows: row i has the columns cols[starts[i]:starts[i + 1]], in rising order, and its values there."""

    starts: np.ndarray
    cols: np.ndarray
    values: np.ndarray
    width: int

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))


def incidence(rows: int, width: int, row: np.ndarray, col: np.ndarray) -> Csr:
    """Ones at (row, col), given in rising order."""
    starts = np.zeros(rows + 1, np.int64)
    np.cumsum(np.bincount(row, minlength=rows), out=starts[1:])
    return Csr(starts, col, np.ones(len(col), np.int64), width)


def transposed(m: Csr) -> Csr:
    starts = np.zeros(m.width + 1, np.int64)
    np.cumsum(np.bincount(m.cols, minlength=m.width), out=starts[1:])
    if (m.cols[1:] >= m.cols[:-1]).all():
        return Csr(starts, m.rows, m.values, len(m.starts) - 1)
    order = np.argsort(m.cols, kind="stable")
    return Csr(starts, m.rows[order], m.values[order], len(m.starts) - 1)


def product(a: Csr, b: Csr) -> Csr:
    """a times b, row by row: row i gathers b's rows at the columns of a's row i and adds up equal columns."""
    n = np.diff(b.starts)[a.cols]
    if (n == 1).all():  # each of a's entries meets one of b's
        row, at, weight = a.rows, b.starts[a.cols], a.values
    else:
        row, weight = np.repeat(a.rows, n), np.repeat(a.values, n)
        at = np.repeat(b.starts[a.cols] - np.cumsum(n) + n, n) + np.arange(n.sum())
    key, value = row * b.width + b.cols[at], weight * b.values[at]
    if (key[1:] < key[:-1]).any():
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    summed = np.add.reduceat(value, first) if len(first) else np.zeros(0, np.int64)
    key = key[first]
    starts = np.zeros(len(a.starts), np.int64)
    np.cumsum(np.bincount(key // max(b.width, 1), minlength=len(a.starts) - 1), out=starts[1:])
    return Csr(starts, key % max(b.width, 1), summed, b.width)


class Aligner:
    """Both tokenizers: ids of texts by segments, and the matrices of two sequences of ids."""

    def __init__(self, a: str, b: str) -> None:
        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b)
        spelled = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [k for k in range(256) if k not in spelled]
        plain = {chr(k): k for k in spelled} | {chr(256 + i): k for i, k in enumerate(rest)}
        self.bytes_a = {i: bytes(map(plain.__getitem__, t)) for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.bytes_b = {i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))}
        self.width = len(self.bytes_b)
        sizes = lambda of: np.array([len(of.get(i, b"")) for i in range(max(of) + 1)], np.int64)
        self.size_a, self.size_b = sizes(self.bytes_a), sizes(self.bytes_b)
        merges = json.loads(self.a.to_str())["model"]["merges"]
        joined = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in merges]
        # Ids in the order of the merges are ranks.
        ranked = [self.a.token_to_id(t) for t in joined] == list(range(256, 256 + len(joined)))
        self.ranks = tiktoken.Encoding("a", pat_str=CLASSES, mergeable_ranks={t: i for i, t in self.bytes_a.items()}, special_tokens={}) if ranked else None
        self.names_a, self.names_b = (pa.array(list(map(str, range(n)))) for n in (len(self.size_a), self.width))
        self.now: tuple[dict[str, bytes | None], dict[str, bytes]] = ({}, {})
        self.before: tuple[dict[str, bytes | None], dict[str, bytes]] = ({}, {})

    def _learn(self, segments: list[str]) -> None:
        """Ids of new segments as two-byte integers; A's are None where the tokens don't spell the segment."""
        known_a, known_b = self.now
        # B's library puts a space before a text: it stands for a segment's own, or is taken off again before a line feed.
        ids_b = self.b.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        easy = [self.ranks is not None and PLAIN.fullmatch(s) is not None for s in segments]
        hard = iter(self.a.encode_batch([s for s, e in zip(segments, easy, strict=True) if not e], add_special_tokens=False))
        for s, e, b in zip(segments, easy, ids_b, strict=True):
            a = self.ranks.encode_ordinary(s) if e else next(hard).ids
            if s[0] != " ":
                del b[0]
            whole = s.encode()
            fits = b"".join([self.bytes_b[i] for i in b]) == whole and (e or b"".join([self.bytes_a[i] for i in a]) == whole)
            known_a[s], known_b[s] = array("H", a).tobytes() if fits else None, array("H", b).tobytes()

    def encode(self, texts: list[str | None]) -> tuple[list[bytes], list[bytes]]:
        """Ids of each text by both tokenizers, little-endian two-byte integers; none for texts without tokens."""
        if len(self.now[0]) > REMEMBERED:
            self.now, self.before = ({}, {}), self.now
        (known_a, known_b), (old_a, old_b) = self.now, self.before
        split = [SEGMENT.findall(f" {t}") if t else [] for t in texts]
        new = [s for s in set().union(*split) if s not in known_a]
        for s in new:
            if s in old_a:
                known_a[s], known_b[s] = old_a[s], old_b[s]
        new = [s for s in new if s not in old_a]
        for k in range(0, len(new), 4096):
            self._learn(new[k : k + 4096])
        out_a, out_b = [], []
        for x in split:
            ids = [known_a[s] for s in x]
            good = None not in ids
            out_a.append(b"".join(ids) if good else b"")
            out_b.append(b"".join([known_b[s] for s in x]) if good else b"")
        for s in new:
            if len(s) > LONGEST:
                del known_a[s], known_b[s]
        return out_a, out_b


class Matched(NamedTuple):
    """Two token sequences a document, laid end to end: the overlap links as (token of A, token of B), and each token's group."""

    a: np.ndarray
    b: np.ndarray
    doc_a: np.ndarray
    row: np.ndarray
    col: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    borders: np.ndarray


def matched(aligner: Aligner, ids_a: list[bytes], ids_b: list[bytes]) -> Matched:
    """The products of the block-diagonal matrices of a batch of documents."""
    a, b = (np.frombuffer(b"".join(x), "<u2").astype(np.int64) for x in (ids_a, ids_b))
    doc_a = np.repeat(np.arange(len(ids_a)), [len(x) // 2 for x in ids_a])
    size_a, size_b = aligner.size_a[a], aligner.size_b[b]
    end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
    borders = np.intersect1d(end_a, end_b, assume_unique=True)
    rows, cols = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    start = 0
    while start < (int(end_a[-1]) if len(end_a) else 0):
        # Up to the last common border within AT_ONCE bytes, or the next one.
        k = int(np.searchsorted(borders, start + AT_ONCE, "right")) - 1
        stop = int(borders[k]) if k >= 0 and borders[k] > start else int(borders[k + 1])
        (i, m), (j, n) = ((int(np.searchsorted(e, start, "right")), int(np.searchsorted(e, stop, "right"))) for e in (end_a, end_b))
        by_byte = lambda sizes, total=stop - start: incidence(len(sizes), total, np.repeat(np.arange(len(sizes)), sizes), np.arange(total))
        links = product(by_byte(size_a[i:m]), transposed(by_byte(size_b[j:n])))
        rows.append(links.rows + i)
        cols.append(links.cols + j)
        start = stop
    return Matched(a, b, doc_a, np.concatenate(rows), np.concatenate(cols), np.searchsorted(borders, end_a), np.searchsorted(borders, end_b), borders)


def links_of(aligner: Aligner, m: Matched) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, link, number) of each document's different links, in order; a link is A's id times the number of B's ids plus B's id."""
    both, n = np.unique(m.doc_a[m.row] << 32 | m.a[m.row] * aligner.width + m.b[m.col], return_counts=True)
    return both >> 32, both & 0xFFFFFFFF, n


def group_texts(aligner: Aligner, m: Matched, docs: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Of each document the number of groups, that of entries of the product of the token-group matrices, and its groups as text."""
    of = [incidence(len(g), len(m.borders), np.arange(len(g)), g) for g in (m.group_a, m.group_b)]
    in_a, in_b = transposed(of[0]), transposed(of[1])
    shared = np.diff(in_a.starts) * np.diff(in_b.starts)
    doc = m.doc_a[in_a.cols[in_a.starts[:-1]]]
    n_groups = np.bincount(doc, minlength=docs)
    n_shared = np.zeros(docs, np.int64)
    np.add.at(n_shared, doc, shared)
    sides = [pc.binary_join(pa.ListArray.from_arrays(pa.array(x.starts.astype(np.int32)), names.take(pa.array(ids[x.cols]))), ",") for x, names, ids in ((in_a, aligner.names_a, m.a), (in_b, aligner.names_b, m.b))]
    groups = pc.binary_join_element_wise(*sides, "|")
    ends = np.concatenate(([0], np.cumsum(n_groups))).astype(np.int32)
    return n_groups, n_shared, pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), groups), ";").to_pylist()


@cache
def load(a: str, b: str) -> Aligner:
    return Aligner(a, b)


def pieces(batches: Iterator[pa.RecordBatch], column: int, rows: int = 256, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most `rows` rows and about `size` bytes of a text column."""
    for b in batches:
        start = held = 0
        for k, t in enumerate(b.column(column)):
            n = t.as_buffer().size if t.is_valid else 0
            if k > start and (k - start >= rows or held + n > size):
                yield b.slice(start, k - start)
                start, held = k, 0
            held += n
        if b.num_rows > start:
            yield b.slice(start)


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str = A, b: str = B) -> DataFrame:
    """`docs` → (id, row, a, b): ids of every whole text by both tokenizers as two-byte integers; `row` tells rows apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = load(public_tokenizers.path(a), public_tokenizers.path(b))
        row = TaskContext.get().partitionId() << 40
        for part in pieces(batches, 1):
            x, y = aligner.encode(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(row + np.arange(len(x))), pa.array(x, pa.binary()), pa.array(y, pa.binary())], names=["id", "row", "a", "b"])
            row += len(x)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, row bigint, a binary, b binary")


def link_counts(ids: DataFrame, a: str = A, b: str = B) -> DataFrame:
    """Encoded rows → (link, docs): how many documents hold each link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = load(public_tokenizers.path(a), public_tokenizers.path(b))
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting: list[np.ndarray] = []
        held = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            fresh, n = np.unique(np.concatenate([np.zeros(0, np.int64), *waiting]), return_counts=True)
            key, at = np.unique(np.concatenate((keys, fresh)), return_inverse=True)
            return key, np.bincount(at, np.concatenate((counts, n)), minlength=len(key)).astype(np.int64)

        def passed_on() -> Iterator[pa.RecordBatch]:
            for k in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + (1 << 16)]), pa.array(counts[k : k + (1 << 16)])], names=["link", "docs"])

        for part in pieces(batches, 0):
            key = links_of(aligner, matched(aligner, part.column(0).to_pylist(), part.column(1).to_pylist()))[1]
            waiting.append(key)
            held += len(key)
            if held >= HELD:
                keys, counts = merged()
                waiting, held = [], 0
                if len(keys) >= HELD:
                    yield from passed_on()
                    keys, counts = keys[:0], counts[:0]
        keys, counts = merged()
        yield from passed_on()

    return ids.select("a", "b").mapInArrow(run, "link bigint, docs bigint").groupBy("link").agg(F.sum("docs").alias("docs"))


def frequent(counts: DataFrame, hot: int = HOT) -> tuple[DataFrame, int]:
    """The links of at least so many documents that there are at most `hot` of them, and that number of documents."""
    size = F.floor(F.log2("docs")).cast("int")
    least, total = 1, 0
    for k, n in sorted(counts.groupBy(size.alias("k")).count().collect(), reverse=True):  # a row for each power of two
        total += n
        if total > hot:
            least = 2 << k
            break
    return counts.where(F.col("docs") >= least), least


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str = A, b: str = B, hot: int = HOT) -> DataFrame:
    """`docs` → (id, n_a, n_b, n_groups, n_links, n_best, count_sum, n_shared, groups_sha256)."""
    ids = written(encoded(docs, id_col, text_col, a, b), "alignment")
    counts = cut(link_counts(ids, a, b))
    some, least = frequent(counts, hot)
    table = some.orderBy("link").toArrow()
    width = load(public_tokenizers.path(a), public_tokenizers.path(b)).width
    # The highest count of each id of A: as many rows as A has ids.
    best = counts.groupBy(F.floor(F.col("link") / width).alias("a")).agg(F.max("docs").alias("most")).toArrow()
    top = np.zeros(1 + max(best["a"].to_pylist(), default=0), np.int64)
    top[np.array(best["a"], np.int64)] = np.array(best["most"], np.int64)
    sent = docs.sparkSession.sparkContext.broadcast((np.array(table["link"], np.int64).astype(np.uint32), np.array(table["docs"], np.int64), top))
    rare = cut(counts.where(F.col("docs") < least)) if least > 1 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = load(public_tokenizers.path(a), public_tokenizers.path(b))
        link, held_by, most = sent.value
        for part in pieces(batches, 2):
            x, y = part.column(2).to_pylist(), part.column(3).to_pylist()
            m, size = matched(aligner, x, y), len(x)
            doc, key, n = links_of(aligner, m)
            at = np.minimum(np.searchsorted(link, key.astype(np.uint32)), max(len(link) - 1, 0))
            known = link[at] == key if len(link) else np.zeros(len(key), bool)
            count = np.where(known, held_by[at], 0) if len(link) else np.zeros(len(key), np.int64)
            total = lambda x, doc=doc, size=size: np.bincount(doc, x, minlength=size).astype(np.int64)
            sums = np.zeros(size, np.int64)
            np.add.at(sums, doc, n * count)
            rare_at = np.flatnonzero(~known)
            starts = np.searchsorted(doc[rare_at], np.arange(size + 1)).astype(np.int32)
            cold = pa.ListArray.from_arrays(pa.array(starts), pa.StructArray.from_arrays([pa.array(key[rare_at]), pa.array(n[rare_at])], names=["link", "n"]))
            n_groups, n_shared, texts = group_texts(aligner, m, size)
            digest = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts]
            tokens = [pa.array([len(v) // 2 for v in side], pa.int64()) for side in (x, y)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), *tokens, pa.array(n_groups), pa.array(total(n)), pa.array(total(n * (known & (count == most[key // width])))), pa.array(sums), pa.array(n_shared), pa.array(digest), cold],
                names=["id", "row", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "n_shared", "groups_sha256", "cold"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, row bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, n_shared bigint, groups_sha256 string, cold array<struct<link: bigint, n: bigint>>"
    made = ids.select("id", "row", "a", "b").mapInArrow(run, schema)
    if rare is None:
        return made.drop("row", "cold")
    made = cut(made)
    high = hinted(counts.groupBy(F.floor(F.col("link") / width).alias("a")).agg(F.max("docs").alias("most")))
    cold = made.select("row", F.explode("cold").alias("x")).select("row", "x.link", "x.n").join(rare, "link")
    cold = cold.withColumn("a", F.floor(F.col("link") / width)).join(high, "a")
    more = cold.groupBy("row").agg(F.sum(F.col("n") * F.col("docs")).alias("__sum"), F.sum(F.when(F.col("docs") == F.col("most"), F.col("n")).otherwise(0)).alias("__best"))
    joined = made.join(more, "row", "left").drop("row", "cold")
    return joined.withColumn("count_sum", F.col("count_sum") + F.coalesce("__sum", F.lit(0))).withColumn("n_best", F.col("n_best") + F.coalesce("__best", F.lit(0))).drop("__sum", "__best")

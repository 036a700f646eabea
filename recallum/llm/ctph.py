"""Context-triggered piecewise hashes of documents.

A rolling hash over seven bytes ends a chunk where its low bits are all ones, so
boundaries depend on the content near them alone.  Each chunk gives one of 64
characters; a fingerprint is `block size:signature:signature at twice the block
size`.  Two fingerprints are compared where a block size is common to both, by
the edit distance (insertions and deletions) of their signatures, if these have
a run of characters in common.

Block sizes are powers of two from 1, by length, for 32 to 64 chunks a text.  A
stretch of eight block sizes without a boundary (periodic text) is cut there, and
more than three repeats of up to eight characters are cut to three; a signature
that is still longer than MOST goes over to the next block size.  Hashes of
windows and chunks come from one prefix polynomial, so the work is a few vector
operations a byte.

Defined results: a null text counts as empty; the empty fingerprint `1::` is like
itself (1.0) and nothing else (0.0); ids are integers, a null id comes last in
descending order, and rows that repeat an id follow one another by text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

WINDOW, RUN, STRETCH, MOST = 7, 7, 8, 4096
BASE = np.uint32(0x2C1B3C6D)
INVERSE = np.uint32(pow(int(BASE), -1, 1 << 32))
LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
REPEATS = re.compile(r"(.{1,8}?)\1{3,}")
#: Bytes hashed at once.
AT_ONCE = 1 << 20
_POWERS = [np.ones(1, np.uint32), np.ones(1, np.uint32)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((BASE, INVERSE)):
            _POWERS[k] = np.concatenate((np.ones(1, np.uint32), np.cumprod(np.full(size - 1, base), dtype=np.uint32)))
    return _POWERS[0][:n], _POWERS[1][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
    h = (h ^ h >> np.uint32(12)) * np.uint32(0x297A2D39)
    return h ^ h >> np.uint32(15)


class Hashed:
    """Prefix hashes of a byte string, and the trigger value at each byte."""

    def __init__(self, data: bytes) -> None:
        n = len(data)
        raw = np.frombuffer(data, np.uint8)
        power, self.inverse = _powers(n + 1)
        self.prefix = np.zeros(n + 1, np.uint32)
        np.cumsum((raw + np.uint32(1)) * power[:n], dtype=np.uint32, out=self.prefix[1:])
        self.trigger = np.empty(n, np.uint32)
        for k in range(0, n, AT_ONCE):
            end = np.arange(k, min(n, k + AT_ONCE))
            start = np.maximum(end - WINDOW + 1, 0)
            self.trigger[k : k + AT_ONCE] = _mix((self.prefix[end + 1] - self.prefix[start]) * self.inverse[start])

    def signature(self, block: int) -> str:
        if not len(self.trigger):
            return ""
        mask = np.uint32(block - 1)
        ends = np.flatnonzero((self.trigger & mask) == mask) + 1
        if not len(ends) or ends[-1] != len(self.trigger):
            ends = np.append(ends, len(self.trigger))
        starts = np.concatenate(([0], ends[:-1]))
        if (long := np.flatnonzero(ends - starts > STRETCH * block)).size:
            ends = np.unique(np.concatenate([ends, *(np.arange(starts[k] + STRETCH * block, ends[k], STRETCH * block) for k in long)]))
            starts = np.concatenate(([0], ends[:-1]))
        h = _mix((self.prefix[ends] - self.prefix[starts]) * self.inverse[starts])
        return REPEATS.sub(r"\1\1\1", LETTERS[h >> np.uint32(26)].tobytes().decode())


def fingerprint(data: bytes) -> str:
    h = Hashed(data)
    block = 1 << max(0, (len(data) - 1) // 64).bit_length()
    while len(one := h.signature(block)) > MOST:
        block *= 2
    return f"{block}:{one}:{h.signature(2 * block)}"


def common(s: str, t: str) -> int:
    """Length of the longest common subsequence, by bits: insertions and deletions number len(s) + len(t) less twice this."""
    if len(s) > len(t):
        s, t = t, s
    at: dict[str, int] = {}
    for k, c in enumerate(s):
        at[c] = at.get(c, 0) | 1 << k
    full = (1 << len(s)) - 1
    v = full
    for c in t:
        u = v & at.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(s) - v.bit_count()


def _alike(s: str, t: str) -> float:
    if s == t:
        return 1.0
    if not s or not t:
        return 0.0
    run = min(RUN, max(1, min(len(s), len(t)) // 2))
    runs = {s[k : k + run] for k in range(len(s) - run + 1)}
    if not any(t[k : k + run] in runs for k in range(len(t) - run + 1)):
        return 0.0
    return 2 * common(s, t) / (len(s) + len(t))


def likeness(a: str, b: str) -> float:
    """0 to 1; 0 where no block size is common to both fingerprints."""
    if a == b:
        return 1.0
    (x, a1, a2), (y, b1, b2) = a.split(":"), b.split(":")
    x, y = int(x), int(y)
    if x == y:
        return max(_alike(a1, b1), _alike(a2, b2) if a2 and b2 and min(len(a2), len(b2)) >= RUN else 0.0)
    return _alike(a1, b2) if x == 2 * y else _alike(a2, b1) if y == 2 * x else 0.0


def _bucket(bounds: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """0 for the largest ids; bounds ascend."""
    return len(bounds) - np.searchsorted(bounds, ids, side="left")


def followed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """`docs` → (bucket, guest, id, key, fp, packed): each document in a bucket of neighbouring ids, each bucket ended by the document that follows its last.

    Ids alone are read to find the bounds and the largest id of each bucket; texts
    are shuffled once, compressed.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    lowest = -(1 << 63)
    buckets = 4 * parts  # several to a partition, so that partitions are even
    bounds = np.unique(np.array(rows.where("id IS NOT NULL").approxQuantile("id", [k / buckets for k in range(1, buckets)], 0.5 / buckets), float)).astype(np.int64)

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).fill_null(lowest).to_numpy(zero_copy_only=False)
            at = _bucket(bounds, ids)
            some = np.unique(at)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array([ids[at == k].max() for k in some], pa.int64())], names=["bucket", "top"])

    # One row for each bucket: four for each partition.
    top = {r.bucket: r.top for r in rows.select("id").mapInArrow(tops, "bucket bigint, top bigint").groupBy("bucket").agg(F.max("top").alias("top")).collect()}
    order = sorted(top)
    before = {k: order[i - 1] for i, k in enumerate(order)}  # the first follows the last

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                ids = part.column(0).fill_null(lowest).to_numpy(zero_copy_only=False)
                out = []
                for i, at, text in zip(ids.tolist(), _bucket(bounds, ids).tolist(), part.column(1), strict=True):
                    data = (text.as_py() or "").encode()
                    row = (i, hashlib.md5(data, usedforsecurity=False).digest(), fingerprint(data), pack(data))
                    out.append((at, False, *row))
                    if i == top[at]:
                        out.append((before[at], True, *row))
                kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["bucket", "guest", "id", "key", "fp", "packed"])

    sent = rows.mapInArrow(spread, "bucket bigint, guest boolean, id bigint, key binary, fp string, packed binary")
    return sent.repartition(parts, "bucket").sortWithinPartitions("bucket", "guest", F.desc("id"), "key")


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """`docs` → (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has its last third replaced by the first as many characters of
    the next document in descending order of ids (the first follows the last).
    """
    lowest = -(1 << 63)
    kind = docs.schema[id_col].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

        def row(i: int, text: str, fp: str, following: str, next_fp: str) -> tuple:
            third = len(text) // 3
            edited = (text[: len(text) - third] + following[:third]).encode()
            edited_fp = fingerprint(edited)
            return None if i == lowest else i, len(text), hashlib.sha256(edited).hexdigest(), fp, edited_fp, likeness(fp, edited_fp), likeness(fp, next_fp)

        last = None  # (bucket, id, text, fp) of the row before
        for b in batches:
            out = []
            for bucket, guest, i, _, fp, packed in zip(*b.columns, strict=True):
                bucket, guest, i, fp = bucket.as_py(), guest.as_py(), i.as_py(), fp.as_py()
                text = unpack(packed.as_py()).decode()
                # A guest is the first document of the next bucket; of guests that repeat an id only the first counts.
                if last and last[0] == bucket:
                    out.append(row(*last[1:], text, fp))
                last = None if guest else (bucket, i, text, fp)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    got = followed(docs, id_col, text_col, parts).mapInArrow(compare, "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return got.withColumn("id", F.col("id").cast(kind))

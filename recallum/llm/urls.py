"""URL rules behind a blocked Bloom filter.

Canonical rule strings (host and path) go into a split-block Bloom filter, built
by a distributed aggregation and bounded by `max_bytes`.  Every URL's own host
and the hosts above it, each with the path prefixes that rules can have, are
probed; possible hits go to an exact hash join with the rules, which removes the
false positives, and the longest rule wins.  If the list outgrows the filter's
bound, only its false positives rise; verdicts stay exact.

Defined results: a null URL or one without `://` has an empty host and path and
no rule; of equally long rules for one URL the one with the longer host wins,
then a block before an allow; repeated URLs and ids keep a row each; very long URLs
are judged whole; the input's own columns come back in the struct `row`, so none
clashes; without rules every verdict is the default; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LANES, WORD = 8, 64
#: Odd multipliers, one for each lane of a block.
SALTS = [2 * k * 0x9E3779B1 + 1 & 0x7FFFFFFF for k in range(1, LANES + 1)]


#: Keys probed at once, and rules up to which their table is broadcast.
AT_ONCE, BROADCAST = 1 << 18, 200_000


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _lane(h: Column, salt: int) -> Column:
    """The bit that a key sets in a lane: the top six of 32 mixed bits."""
    low = h.bitwiseAND(F.lit(0x7FFFFFFF))  # 31 bits times 31 bits: no overflow
    return F.shiftrightunsigned((low * F.lit(salt)).bitwiseAND(F.lit(0xFFFFFFFF)), 26).cast("int")


def build(keys: DataFrame, key_col: str = "key", bits_per_key: int = 16, max_bytes: int = 64 << 20, n: int | None = None) -> np.ndarray:
    """A split-block Bloom filter of (n) distinct keys: uint64 array (blocks, 8); each key sets one bit in each lane of its block."""
    n = keys.count() if n is None else n
    blocks = max(1, min(n * bits_per_key // (LANES * WORD) + 1, max_bytes // (LANES * WORD // 8)))
    h = F.xxhash64(F.col(key_col))
    rows = keys.select(F.pmod(F.shiftrightunsigned(h, 32), F.lit(blocks)).alias("block"), *[_lane(h, s).alias(f"b{k}") for k, s in enumerate(SALTS)])
    agg = rows.groupBy("block").agg(*[F.bit_or(F.expr(f"shiftleft(bigint(1), b{k})")).alias(f"w{k}") for k in range(LANES)])
    out = np.zeros((blocks, LANES), np.uint64)
    for b in agg.toArrow().to_batches():  # at most max_bytes, whatever the list's size
        out[b.column("block").to_numpy(zero_copy_only=False)] = np.stack([b.column(f"w{k}").to_numpy(zero_copy_only=False).view(np.uint64) for k in range(LANES)], 1)
    return out


def contains(bloom: np.ndarray, keys: list[str]) -> np.ndarray:
    h = np.fromiter((xxhash.xxh64_intdigest(k.encode(), 42) for k in keys), np.uint64, len(keys))
    block = bloom[(h >> np.uint64(32)) % np.uint64(len(bloom))]
    low = h & np.uint64(0x7FFFFFFF)
    bit = (low[:, None] * np.array(SALTS, np.uint64)[None, :] & np.uint64(0xFFFFFFFF)) >> np.uint64(26)
    return (block >> bit & np.uint64(1)).all(1)


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", max_bytes: int = 64 << 20) -> DataFrame:
    """`pages` and `rules` (host, path, verdict) → all columns of `pages` as struct `row`, with (host, path, rule, verdict).

    A rule fits its host and all subdomains if the URL's path starts with its own.
    """
    listed = rules.select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), F.col("verdict").alias("rule_verdict")).where("rule_host IS NOT NULL")
    listed = listed.groupBy("rule_host", "rule_path").agg(F.max("rule_verdict").alias("rule_verdict")).withColumn("key", F.concat("rule_host", "rule_path"))
    n = listed.count()
    bloom = build(listed.select("key"), max_bytes=max_bytes, n=n)
    lengths = sorted(r.n for r in listed.select(F.length("rule_path").alias("n")).distinct().collect())  # at most the longest path

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, owner = [], []

            def hits(b: pa.RecordBatch = b) -> pa.RecordBatch:
                hit = np.flatnonzero(contains(bloom, keys)) if keys else np.zeros(0, int)
                at = pa.array(np.array(owner, np.int64)[hit] if keys else hit)
                return pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array([keys[k] for k in hit], pa.string())], names=["host", "path", "key"])

            for i, (h, p) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                labels = h.split(".") if h else []
                for k in range(len(labels)):
                    above = ".".join(labels[k:])
                    for size in lengths:
                        if size > len(p):
                            break
                        keys.append(above + p[:size])
                        owner.append(i)
                if len(keys) >= AT_ONCE:
                    yield hits()
                    keys, owner = [], []
            yield hits()

    split = pages.select(F.struct("*").alias("row"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    possible = split.select("host", "path").where("host <> ''").distinct().mapInArrow(probe, "host string, path string, key string")
    exact = possible.join(F.broadcast(listed) if n <= BROADCAST else listed.hint("shuffle_hash"), "key")
    best = exact.groupBy("host", "path").agg(F.max(F.struct(F.length("key").alias("n"), F.length("rule_host").alias("h"), F.col("rule_verdict").alias("verdict"), F.col("key").alias("rule"))).alias("best"))
    return split.join(best, ["host", "path"], "left").select("row", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))

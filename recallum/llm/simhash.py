"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint is the bitwise majority of the XXH64 hashes (seed 42) of a text's
four-word shingles.  Two fingerprints at most `2 * radius` bits apart have some
variant in common that lies within `radius` bits of both.  So every distinct
fingerprint emits all its variants within `radius`, variants are shuffled, and
fingerprints that meet on a variant are linked.

The shuffle is by the variants' leading bits: all variants of a fingerprint that
share a prefix travel as that one fingerprint and are spelled out where they
arrive, which sends about a hundred rows for some two thousand variants.  What
meets in a bucket is reduced to a spanning forest there, so a large group of
near copies gives a number of links that is linear in its size.

Defined results: a null text counts as empty; a text without words has the
fingerprint zero, which links like any other; a repeated id keeps a row each;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from recallum.operators.components import connected_components
from recallum.sources.shared import cut, hinted

#: Shingle size and hash seed of the fingerprints.
WORDS, SEED = 4, 42
#: Variants spelled out at once; a larger bucket is worked through by further leading bits.
AT_ONCE = 1 << 21


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Unsigned 64-bit SimHash of one whole text; 0 where it has no words."""
    found = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[: -words] + 1))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[k : k + (1 << 15)].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h)).view(">u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """`docs` → (id, fp long): the fingerprint of every row, signed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), words) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


@cache
def masks(bits: int, radius: int) -> np.ndarray:
    """All masks over the lowest `bits` bits with at most `radius` of them set."""
    one = [np.uint64(1 << k) for k in range(bits)]
    return np.array([np.bitwise_or.reduce(np.array(c, np.uint64)) if c else np.uint64(0) for r in range(radius + 1) for c in combinations(one, r)], np.uint64)


def _by_key(keys: np.ndarray, fps: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(keys, kind="stable")
    keys, fps = keys[order], fps[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    yield from zip(keys[at].tolist(), np.split(fps, at[1:]), strict=True)


def _buckets(rows: np.ndarray, bits: int, deeper: int, hot: np.ndarray, radius: int, fps: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) for each bucket that holds a variant of a row's fingerprint (the row itself by default).

    A key is a 1 before the prefix; prefixes that are hot are longer by `deeper`.
    """
    fps = rows if fps is None else fps

    def spread(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        m = masks(n, radius)
        return ((fps[at] >> np.uint64(64 - n))[:, None] ^ m[None, :]).ravel() | np.uint64(1 << n), np.repeat(at, len(m))

    keys, owners = spread(np.arange(len(rows)), bits)
    if len(hot):
        warm = np.isin(keys, hot)
        far, whose = spread(np.unique(owners[warm]), bits + deeper)
        inside = np.isin(far >> np.uint64(deeper), hot)
        keys, owners = np.concatenate((keys[~warm], far[inside])), np.concatenate((owners[~warm], whose[inside]))
    return keys, rows[owners]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the links a-b."""
    at = np.arange(n)
    while len(a):
        low = np.minimum(at[a], at[b])
        before = at.copy()
        for x in (a, b, before[a], before[b]):
            np.minimum.at(at, x, low)
        while not np.array_equal(at, nxt := at[at]):
            at = nxt
        if np.array_equal(at, before):
            break
    return at


def meetings(fps: np.ndarray, prefix: int, bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that link all fingerprints with a common variant under a prefix; memory is bounded by AT_ONCE."""
    left = radius - np.bitwise_count((fps >> np.uint64(64 - bits)) ^ np.uint64(prefix)).astype(int)
    here = np.flatnonzero(left >= 0)
    if len(here) < 2:
        return here[:0], here[:0]
    by = [(r, here[left[here] == r]) for r in range(radius + 1)]
    size = [len(masks(64 - bits, r)) for r in range(radius + 1)]
    if sum(len(x) * size[r] for r, x in by) > AT_ONCE and bits + 4 <= 60:
        got = [meetings(fps[here], prefix << 4 | k, bits + 4, radius) for k in range(16)]
        a, b = (here[np.concatenate([g[i] for g in got])] for i in (0, 1))
        root = forest(len(fps), a, b)
        linked = np.flatnonzero(root != np.arange(len(fps)))
        return root[linked], linked
    low = np.uint64((1 << (64 - bits)) - 1)
    variants = np.concatenate([((fps[x] & low)[:, None] ^ masks(64 - bits, r)[None, :]).ravel() for r, x in by])
    ordered = np.sort(variants)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    del ordered
    if not len(twice):
        return here[:0], here[:0]
    at = np.minimum(np.searchsorted(twice, variants), len(twice) - 1)
    met = np.flatnonzero(twice[at] == variants)
    owner = np.concatenate([np.repeat(x, size[r]) for r, x in by])[met]
    group = at[met]
    order = np.lexsort((owner, group))
    owner, group = owner[order], group[order]
    first = np.concatenate(([True], group[1:] != group[:-1]))
    head = owner[np.maximum.accumulate(np.where(first, np.arange(len(owner)), 0))]
    pairs = np.unique(np.stack((head, owner), 1)[head != owner], axis=0)
    near = np.bitwise_count(fps[pairs[:, 0]] ^ fps[pairs[:, 1]]) <= 2 * radius
    return pairs[near, 0], pairs[near, 1]


def links(distinct: DataFrame, fp_col: str = "fp", radius: int = 2, bits: int | None = None) -> DataFrame:
    """Distinct fingerprints → links (src, dst) that join all fingerprints at most 2 * radius bits apart into the same components.

    A link is emitted between fingerprints that meet on a variant, never for all
    pairs of a bucket.  Buckets with far more than their share of the rows (at most
    four for each shuffle partition) are spread over longer prefixes.
    """
    spark = distinct.sparkSession
    fps = distinct.select(F.col(fp_col).alias("fp")).where("fp IS NOT NULL")
    n = fps.count()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = bits or min(28, max(8, (n // 256).bit_length(), (2 * parts).bit_length()))
    deeper = 8

    def emit(hot: np.ndarray, counts: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                for k in range(0, len(x), 1 << 13):
                    keys, owners = _buckets(x[k : k + (1 << 13)], bits, deeper, hot, radius)
                    if counts:
                        key, many = np.unique(keys, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(many)], names=["key", "n"])
                    else:
                        got = list(_by_key(keys, owners))
                        yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1].tobytes() for g in got], pa.binary())], names=["key", "fps"])

        return run

    sent = n * len(masks(bits, radius))
    share = max(4096, sent // (4 * parts), 8 * sent >> bits)
    hot = np.array([r.key for r in fps.mapInArrow(emit(np.zeros(0, np.uint64), True), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > share).collect()], np.uint64)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(key: int, parts: list[bytes]) -> pa.RecordBatch:
            x = np.unique(np.frombuffer(b"".join(parts), np.uint64))
            width = key.bit_length() - 1
            a, b = meetings(x, key - (1 << width), width, radius)
            root = forest(len(x), a, b)
            linked = np.flatnonzero(root != np.arange(len(x)))
            return pa.RecordBatch.from_arrays([pa.array(x[root[linked]].view(np.int64)), pa.array(x[linked].view(np.int64))], names=["src", "dst"])

        key, held = None, []
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != key and held:
                    yield solve(key, held)
                    held = []
                key = k
                held.append(v)
        if held:
            yield solve(key, held)

    spread = fps.mapInArrow(emit(hot, False), "key bigint, fps binary")
    return spread.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(meet, "src bigint, dst bigint").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """`docs` → (id, fp, component): the smallest id that each row reaches over links of at most 2 * radius bits, itself included."""
    fps = cut(fingerprints(docs, id_col, text_col))
    first = cut(fps.groupBy("fp").agg(F.min("id").alias("first")))
    comp = connected_components(links(first, radius=radius))
    rooted = first.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    return fps.join(rooted.join(least, "root").select("fp", "component"), "fp").select("id", "fp", "component")


# Near-duplicate texts: first candidates by several fingerprints, then all others by rare shingles; verified on shingles.

#: Fingerprints of a text's set of words, each with its own hash; texts whose sets differ by a few words agree in nearly all bits of some.
SETS = 12
#: Bounds of the first candidates only, which save work for the exact ones: at most FAR bits apart in a fingerprint of their shingles, of a bucket the PARTNERS nearest.
FAR, PARTNERS, NEXT = 16, 3, 4
#: Texts whose shingles order all shingles by rarity (any order is exact), and the uses in them from which a shingle counts as frequent.
SAMPLED, FREQUENT = 20_000, 4
#: Classes whose parities a text's shingle set is compared by before it is read, and bits of the bitmap of shared shingles.
PARITIES, SIEVE = 512, 25
#: Rounds in which texts are compared with their nearest candidate, and in which those of a shingle are compared with one of them, before all pairs are.
ROUNDS, STARS = 2, 1
#: Rows of the two sides of a join on one shingle; more are split into blocks.
ASKING, ASKED = 1024, 4096
#: Variants of word-set fingerprints spelled out at once, and shingles that a worker hands over at once.
SPELLED, HANDED = 1 << 18, 1 << 15


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def _majority(h: np.ndarray) -> np.ndarray:
    """Rows of hashes → one fingerprint a row."""
    ones = np.zeros((len(h), 64), np.int64)
    for k in range(0, h.shape[1], 1 << 12):
        part = h[:, k : k + (1 << 12)]
        ones += np.unpackbits(np.ascontiguousarray(part).astype(">u8").view(np.uint8), axis=1).reshape(len(h), -1, 64).sum(1, dtype=np.int64)
    return np.packbits(2 * ones > h.shape[1], axis=1).view(">u8").ravel().astype(np.uint64)


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles (fewer words: the whole sequence; none: none)."""
    found = (text or "").encode().lower().split()
    joined = [b" ".join(found[k : k + words]) for k in range(max(1, len(found) - words + 1))] if found else []
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in joined), np.uint64, len(joined)))


def sketches(texts: DataFrame, words: int) -> DataFrame:
    """(id, text) → (id, sets binary, fp): a text's word-set fingerprints, and the fingerprint of its shingles."""
    salts = _mix(np.arange(1, SETS + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets, fps = [], []
            for t in b.column(1):
                text = t.as_py() or ""
                found = set(text.encode().lower().split())
                h = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in found), np.uint64, len(found))
                sets.append(_majority(_mix(h[None, :] ^ salts[:, None])).tobytes())
                fps.append(_majority(_mix(shingles(text, words))[None, :])[0])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["id", "sets", "fp"])

    return texts.select("id", "text").mapInArrow(run, "id bigint, sets binary, fp bigint")


def _neighbours(a: np.ndarray, fp: np.ndarray, prefix: int, bits: int, radius: int) -> np.ndarray:
    """Index pairs that meet on a variant of `a` and are near by `fp`; linear in the bucket, bounded in memory by SPELLED."""
    left = radius - np.bitwise_count((a >> np.uint64(64 - bits)) ^ np.uint64(prefix)).astype(int)
    here = np.flatnonzero(left >= 0)
    if len(here) < 2:
        return np.zeros((0, 2), np.int64)
    if len(here) * (65 - bits) > SPELLED and bits + 4 <= 60:
        got = [_neighbours(a[here], fp[here], prefix << 4 | k, bits + 4, radius) for k in range(16)]
        return _nearest(here[np.concatenate(got)], fp)
    low = np.uint64((1 << (64 - bits)) - 1)
    by = [(r, here[left[here] == r]) for r in range(radius + 1)]
    variant = np.concatenate([((a[x] & low)[:, None] ^ masks(64 - bits, r)[None, :]).ravel() for r, x in by])
    owner = np.concatenate([np.repeat(x, len(masks(64 - bits, r))) for r, x in by])
    # Each variant sorts those that meet on it by another rotation of their shingle fingerprints, so near ones stand together.
    turn = _mix(variant) & np.uint64(63)
    turned = fp[owner] << turn | fp[owner] >> (np.uint64(64) - turn & np.uint64(63))
    order = np.lexsort((turned, variant))
    variant, owner = variant[order], owner[order]
    pairs = np.concatenate([np.stack((owner[:-k], owner[k:]), 1)[variant[:-k] == variant[k:]] for k in range(1, NEXT + 1) if len(owner) > k])
    # Two with one prefix that isn't this one meet in the bucket of their own, too, and count there.
    lead = a >> np.uint64(64 - bits)
    elsewhere = (lead[pairs[:, 0]] == lead[pairs[:, 1]]) & (lead[pairs[:, 0]] != np.uint64(prefix))
    return _nearest(pairs[~elsewhere], fp)


def _nearest(pairs: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Distinct pairs, of which each text keeps its PARTNERS nearest."""
    pairs = np.unique(np.sort(pairs, 1), axis=0)
    apart = np.bitwise_count(fp[pairs[:, 0]] ^ fp[pairs[:, 1]]).astype(int)
    pairs, apart = pairs[apart <= FAR], apart[apart <= FAR]
    kept = np.zeros(len(pairs), bool)
    for side in (0, 1):
        order = np.lexsort((apart, pairs[:, side]))
        node = pairs[order, side]
        start = np.maximum.accumulate(np.where(np.concatenate(([True], node[1:] != node[:-1])), np.arange(len(node)), 0)) if len(node) else node
        kept[order[np.arange(len(node)) - start < PARTNERS]] = True
    return pairs[kept]


def candidates(nodes: DataFrame, radius: int = 1) -> DataFrame:
    """(id, sets, fp) of distinct texts → pairs (a, b, apart), a < b, of near ones and the bits in which their shingle fingerprints differ; a bounded number for each text and bucket."""
    spark = nodes.sparkSession
    n, parts = nodes.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = min(28, max(8, (n // 1024).bit_length(), (parts // 2).bit_length()))
    deeper = 8
    kind = np.dtype([("id", "<i8"), ("a", "<u8"), ("fp", "<u8")])

    def emit(hot: dict[int, np.ndarray], counts: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = np.zeros(b.num_rows, kind)
                rows["id"] = b.column(0).to_numpy(zero_copy_only=False)
                rows["fp"] = b.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
                sets = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint64).reshape(-1, SETS)
                for s in range(SETS):
                    rows["a"] = sets[:, s]
                    keys, owners = _buckets(np.arange(len(rows)), bits, deeper, hot.get(s, np.zeros(0, np.uint64)), radius, rows["a"])
                    keys = keys | np.uint64(s) << np.uint64(48)
                    if counts:
                        key, many = np.unique(keys, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(many)], names=["key", "n"])
                    else:
                        got = list(_by_key(keys, owners))
                        yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([rows[g[1]].tobytes() for g in got], pa.binary())], names=["key", "rows"])

        return run

    sent = n * len(masks(bits, radius))
    share = max(4096, sent * SETS // (4 * parts), 8 * sent >> bits)
    found = nodes.select("id", "sets", "fp").mapInArrow(emit({}, True), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > share).collect()
    hot = {s: np.array([r.key & (1 << 48) - 1 for r in found if r.key >> 48 == s], np.uint64) for s in {r.key >> 48 for r in found}}

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(key: int, parts: list[bytes]) -> pa.RecordBatch:
            x = np.frombuffer(b"".join(parts), kind)
            key &= (1 << 48) - 1
            width = key.bit_length() - 1
            met = _neighbours(np.ascontiguousarray(x["a"]), np.ascontiguousarray(x["fp"]), key - (1 << width), width, radius)
            pairs, apart = x["id"][met], np.bitwise_count(x["fp"][met[:, 0]] ^ x["fp"][met[:, 1]]).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1, initial=1 << 62)), pa.array(pairs.max(axis=1, initial=-1)), pa.array(apart)], names=["a", "b", "apart"])

        key, held = None, []
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != key and held:
                    yield solve(key, held)
                    held = []
                key = k
                held.append(v)
        if held:
            yield solve(key, held)

    spread = nodes.select("id", "sets", "fp").mapInArrow(emit(hot, False), "key bigint, rows binary")
    return spread.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(meet, "a bigint, b bigint, apart int").distinct()


def frequent(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(id, text) → the frequent shingles of a bounded sample, sorted, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(k, 512) for whole in batches for k in range(0, whole.num_rows, 512)):
            tok, n = np.unique(np.concatenate([shingles(t.as_py(), words) for t in b.column(0)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(tok.view(np.int64)), pa.array(n)], names=["tok", "n"])

    n = texts.count()
    sample = texts if n <= SAMPLED else texts.where(F.pmod(F.xxhash64("id", F.lit(23)), F.lit(n)) < SAMPLED)
    got = sample.select("text").mapInArrow(run, "tok bigint, n bigint").groupBy("tok").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT).toArrow()
    tok, n = got["tok"].to_numpy().view(np.uint64), got["n"].to_numpy()
    order = np.argsort(tok)
    return tok[order], n[order]


def prefixes(texts: DataFrame, similarity: float, words: int) -> DataFrame:
    """(id, text) → (id, n, bits, toks): the number of shingles, their parities, and the rarest of them, without which too few are left for the similarity.

    Two texts of that similarity have the first of their common shingles, rare ones
    before frequent ones, among the toks of both.  The parities are those of the
    numbers of shingles in each of PARITIES classes by hash, as 64-bit words.
    """
    sent = texts.sparkSession.sparkContext.broadcast(frequent(texts, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, uses = sent.value
        for b in (whole.slice(k, 512) for whole in batches for k in range(0, whole.num_rows, 512)):
            sizes, toks, bits = [], [], []
            for t in b.column(1):
                s = shingles(t.as_py(), words)
                rank = np.zeros(len(s), np.int64)
                if len(often):
                    at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                    rank = np.where(often[at] == s, uses[at], 0)
                sizes.append(len(s))
                toks.append(s[np.lexsort((s, rank))][: len(s) - int(np.ceil(similarity * len(s) - 1e-9)) + 1].view(np.int64))
                bits.append(np.packbits(np.bincount((s >> np.uint64(40)).astype(np.int64) % PARITIES, minlength=PARITIES) & 1).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int32()), pa.array(bits, pa.list_(pa.int64())), pa.array(toks, pa.list_(pa.int64()))], names=["id", "n", "bits", "toks"])

    return texts.select("id", "text").mapInArrow(run, "id bigint, n int, bits array<bigint>, toks array<bigint>")


def by_length(b: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """`b` in parts whose lists hold about `most` values together, a row at least."""
    size = np.diff(b.column(column).offsets.to_numpy())
    ends = [0, *(np.flatnonzero(np.diff(np.cumsum(size) // most)) + 1).tolist(), b.num_rows]
    return (b.slice(x, y - x) for x, y in zip(ends, ends[1:], strict=False))


def placed(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """`rows` with the component of each id in `comp`; ids without links are their own."""
    return rows.join(hinted(comp.select(F.col("node").alias("id"), F.col("component").alias("comp"))), "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def meetings_of(rare: DataFrame, comp: DataFrame, similarity: float = 0.8) -> DataFrame:
    """`prefixes` → (tok, id, n, bits, at) of shingles on which texts of different components meet that can be similar by length and place.

    Most shingles are of one text; these are sifted out by a bitmap of bounded
    size before anything is shuffled, and what it lets through by a join.  Of the texts of a
    shingle those stay that have another one within the bounds of length and place.
    Only they get their parities, so what meets by chance is narrow.
    """
    toks = placed(rare.select("id", "toks"), comp).select("comp", F.explode("toks").alias("tok"))
    live = cut(toks.groupBy("tok").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("tok"))
    slot = F.col("tok").bitwiseAND(F.lit((1 << SIEVE) - 1))
    words = live.groupBy(F.shiftright(slot, 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(bigint(1), int(tok & 63))")).alias("v")).toArrow()
    sieve = np.zeros(1 << SIEVE - 6, np.uint64)
    sieve[words["w"].to_numpy()] = words["v"].to_numpy().view(np.uint64)
    sent = rare.sparkSession.sparkContext.broadcast(sieve)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = sent.value
        for b in (part for whole in batches for part in by_length(whole, 2, HANDED)):
            tok = b.column(2).flatten().to_numpy(zero_copy_only=False)
            size = np.fromiter((len(x) for x in b.column(2)), np.int64, b.num_rows)
            first = np.concatenate(([0], np.cumsum(size)[:-1])) if b.num_rows else size
            at = np.arange(len(tok)) - np.repeat(first, size)
            slot = tok & (1 << SIEVE) - 1
            kept = np.flatnonzero(sieve[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1))
            own = pa.array(np.repeat(np.arange(b.num_rows), size)[kept])
            yield pa.RecordBatch.from_arrays([pa.array(tok[kept]), b.column(0).take(own), b.column(1).take(own), pa.array(at[kept].astype(np.int32))], names=["tok", "id", "n", "at"])

    rows = rare.select("id", "n", "toks").mapInArrow(run, "tok bigint, id bigint, n int, at int").join(live.hint("merge"), "tok")
    by = Window.partitionBy("tok").orderBy("n", "id")
    longest = F.least(F.col("n") / similarity, (F.col("n") - F.col("at")) * (1 + similarity) / similarity - F.col("n")) + 1e-6  # of a text that it can be similar to
    rows = rows.withColumn("longest", longest)
    longer, shorter = F.lead("n").over(by) <= F.col("longest"), F.max("longest").over(by.rowsBetween(Window.unboundedPreceding, -1)) >= F.col("n")
    some = cut(rows.withColumn("some", F.coalesce(longer, F.lit(False)) | F.coalesce(shorter, F.lit(False))).where("some").select("tok", "id", "n", "at"))
    return cut(some.join(rare.select("id", "bits"), "id").select("tok", "id", "n", "bits", "at"))


def _enough(x: str, y: str, similarity: float) -> Column:
    """Whether two texts can be that similar if the shingle on which they meet is the first that they have in common.

    Sets differ in at least as many shingles as they have classes of different parity.
    """
    at, n = (lambda k: F.col(f"{k}.n") - F.col(f"{k}.at")), (lambda k: F.col(f"{k}.n"))
    apart = sum((F.bit_count(F.col(f"{x}.bits")[k].bitwiseXOR(F.col(f"{y}.bits")[k])) for k in range(PARITIES // 64)), F.lit(0))
    return (F.least(n(x), n(y)) >= similarity * F.greatest(n(x), n(y)) - 1e-9) & (F.least(at(x), at(y)) >= similarity / (1 + similarity) * (n(x) + n(y)) - 1e-9) & (apart <= (1 - similarity) / (1 + similarity) * (n(x) + n(y)) + 1e-9)


def _pairs(joined: DataFrame, x: str, y: str) -> DataFrame:
    return joined.select(F.least(f"{x}.id", f"{y}.id").alias("a"), F.greatest(f"{x}.id", f"{y}.id").alias("b")).distinct()


def star_pairs(rows: DataFrame, similarity: float, turn: int) -> DataFrame:
    """(tok, id, comp, n, bits, at) → pairs of each text with one text of each shingle's, of other components; one a row at most, another one each `turn`."""
    row = F.struct("id", "comp", "n", "bits", "at")
    centres = rows.groupBy("tok").agg(F.min_by(row, F.xxhash64("tok", "id", F.lit(turn))).alias("c"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("tok", "c")
    met = rows.join(cut(centres).hint("merge"), "tok").select(row.alias("r"), "c")
    return _pairs(met.where((F.col("r.comp") != F.col("c.comp")) & _enough("r", "c", similarity)), "r", "c")


def all_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """(tok, id, comp, n, bits, at) → all pairs of different components that meet on a shingle and can be similar.

    A pair that meets on several shingles passes on the first of them if on any, as all texts order shingles alike, and counts once.
    Texts of a shingle's largest component are not compared with one another, so
    linked copies cost nothing; what is left is joined as it lies by shingle, and
    only shingles of many texts are dealt anew in blocks of bounded size.
    """
    by = rows.groupBy("tok", "comp").agg(F.count("*").alias("m")).groupBy("tok").agg(F.sum("m").alias("c"), F.max("m").alias("most"), F.max_by("comp", F.struct("m", "comp")).alias("major")).where("c > most")
    asking, asked = F.ceil((F.col("c") - F.col("most")) / ASKING).alias("asking"), F.ceil(F.col("c") / ASKED).alias("asked")
    live = cut(by.select("tok", "major", asking, asked))
    row = F.struct("id", "comp", "n", "bits", "at")
    can = (F.col("x.comp") != F.col("y.comp")) & _enough("x", "y", similarity)
    few = rows.join(live.where("asking = 1 AND asked = 1").hint("merge"), "tok").where("comp != major").select("tok", row.alias("x"))
    small = few.join(rows.select("tok", row.alias("y")).hint("merge"), "tok").where(can)
    crowded = hinted(live.where("asking > 1 OR asked > 1"))
    met = rows.join(crowded, "tok")
    own = lambda many: F.pmod(F.xxhash64("id", F.lit(29)), F.col(many))
    every = lambda many: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(many) - 1))
    x = met.where("comp != major").select("tok", own("asking").alias("i"), every("asked").alias("j"), row.alias("x"))
    y = met.select("tok", every("asking").alias("i"), own("asked").alias("j"), row.alias("y"))
    return _pairs(small, "x", "y").unionByName(_pairs(x.join(y, ["tok", "i", "j"]).where(can), "x", "y")).distinct()


def alike(texts: DataFrame, pairs: DataFrame, similarity: float, words: int) -> DataFrame:
    """(id, text) and pairs (a, b) → links (src, dst): the pairs whose whole shingle sets are similar."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py(), words).tobytes() for t in b.column(1)], pa.binary())], names=["id", "s"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep, pa.bool_())), b.column(1).filter(pa.array(keep, pa.bool_()))], names=["src", "dst"])

    named = hinted(cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()))
    s = texts.join(named, "id", "left_semi").mapInArrow(sets, "id bigint, s binary").dropDuplicates(["id"])
    joined = pairs.join(s.withColumnsRenamed({"id": "a", "s": "s_a"}), "a").join(s.withColumnsRenamed({"id": "b", "s": "s_b"}), "b")
    return joined.select("a", "b", "s_a", "s_b").mapInArrow(verified, "src bigint, dst bigint")


def text_key(text: Column) -> Column:
    """16 bytes that equal texts have in common; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are of different components."""
    of = lambda side: hinted(comp.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}")))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select(pairs.columns)


def _nearest_each(pairs: DataFrame) -> DataFrame:
    """Of (a, b, apart), each text's nearest partner: at most as many pairs as texts."""
    ends = pairs.select("a", "b", "apart", F.explode(F.array("a", "b")).alias("id"))
    best = F.min(F.struct("apart", F.xxhash64("a", "b").alias("h"), "a", "b")).alias("p")
    return ends.groupBy("id").agg(best).select("p.a", "p.b").distinct()


def linked_candidates(texts: DataFrame, pairs: DataFrame, similarity: float, words: int) -> DataFrame:
    """Components (node, component) of the candidate pairs that are similar.

    Each of `ROUNDS` rounds looks at each text's nearest partner of another component, so groups of many near copies grow
    together without all their pairs being asked for; pairs looked at or within a component are left out of the next.
    What is still left then is mostly of texts that are not similar enough, and is left to the exact path.
    """
    comp = texts.sparkSession.range(0).select(F.col("id").alias("node"), F.col("id").alias("component"))  # not createDataFrame, whose rows come from Python workers
    for k in range(ROUNDS):
        some = cut(_nearest_each(pairs))
        comp = joined(comp, alike(texts, some, similarity, words))
        if k + 1 < ROUNDS:
            pairs = cut(_apart(pairs.join(hinted(some), ["a", "b"], "left_anti"), comp))
    return comp


def joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links, of which only those between components are worked through."""
    of = lambda side: hinted(comp.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}")))
    ends = links.join(of("src"), "src", "left").join(of("dst"), "dst", "left").select(F.coalesce("c_src", "src").alias("src"), F.coalesce("c_dst", "dst").alias("dst"))
    roots = cut(ends.where("src <> dst").distinct())
    if roots.isEmpty():
        return comp
    top = cut(connected_components(roots))
    moved = comp.join(hinted(top.select(F.col("node").alias("component"), F.col("component").alias("root"))), "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    return cut(moved.unionByName(top.join(comp.select("node"), "node", "left_anti")))


def near_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, words: int = 5) -> DataFrame:
    """`docs` → (id, key, component, first_key): equal texts and, through links, texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

    Ball hashing of several word-set fingerprints links most near texts (see `linked_candidates`).  Every other
    pair is reached by the rare shingles that two similar texts must
    share: first each text with a few others of each shingle's, in turn, then all pairs of
    different components.  Every link is verified on the whole shingle sets of
    both texts.

    A row is known by its id and `key` (`text_key`), so rows that repeat an id with
    another text are judged by their own; rows that repeat both are one here.  A
    group's document is the row with the smallest (id, key), null ids last:
    `component` and `first_key`.  Texts without words are all equal to one another
    if they are equal as strings, and similar to nothing else.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    # Distinct texts are numbered once; later reads of the texts find the numbers by key.
    known = cut(rows.select("id", "key").distinct())
    node = cut(cut(known.select("key").distinct()).select("key", F.monotonically_increasing_id().alias("node")))
    # One row of each text, by its smallest id, so that copies are not worked through again.
    own = known.groupBy("key").agg(F.min("id").alias("id")).join(node, "key")
    named = hinted(cut(own))
    texts = rows.join(named.withColumnRenamed("id", "own"), (rows["key"] == named["key"]) & rows["id"].eqNullSafe(F.col("own"))).select(F.col("node").alias("id"), "text")
    pairs = cut(candidates(cut(sketches(texts, words).dropDuplicates(["id"]))))
    comp = linked_candidates(texts, pairs, similarity, words)
    met = meetings_of(cut(prefixes(texts, similarity, words).dropDuplicates(["id"])), comp, similarity)
    for turn in range(STARS):
        comp = joined(comp, alike(texts, cut(star_pairs(placed(met, comp), similarity, turn)), similarity, words))
    comp = joined(comp, alike(texts, cut(all_pairs(placed(met, comp), similarity)), similarity, words))
    of = node.join(hinted(comp), "node", "left").select("key", F.coalesce("component", "node").alias("root"))
    grouped = cut(known.join(of, "key"))
    first = grouped.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key")).alias("first"))
    return grouped.join(first, "root").select("id", "key", F.col("first.id").alias("component"), F.col("first.key").alias("first_key"))

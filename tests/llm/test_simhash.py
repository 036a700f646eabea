import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from recallum.llm import simhash as H


def brute(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    h = [xxhash.xxh64(" ".join(w[k : k + 4]).encode(), seed=42).intdigest() for k in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, bits=4):
    ids, values = [i for i, _ in fps], [v for _, v in fps]
    up = list(range(len(ids)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in range(len(ids)):
        for b in range(a):
            if (values[a] ^ values[b]).bit_count() <= bits:
                up[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(i, least.get(find(k), i))
    return {i: least[find(k)] for k, i in enumerate(ids)}


def test_query_against_brute_force(spark, sf, docs):
    from recallum.llm.queries import op1_simhash

    texts = [(r.doc_id, r.text) for r in docs.collect()]
    fps = [(i, brute(t)) for i, t in texts]
    got = op1_simhash(spark, sf).collect()
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == dict(fps) and all(len(r.fingerprint) == 16 for r in got)
    assert {r.doc_id: r.component_id for r in got} == components(fps)


def test_odd_rows(odd, none):
    got = H.near_groups(odd)
    rows = got.collect()
    assert len(rows) == 18 and {r.id: r.fp & (1 << 64) - 1 for r in rows} == {r.doc_id: brute(r.text) for r in odd.collect()}
    assert {r.component for r in rows if r.fp == 0} == {3}
    assert H.near_groups(none).count() == 0


@pytest.mark.parametrize("bits,share", [(8, None), (3, None), (12, 1)])
def test_links_reach_all_within_four_bits(spark, bits, share, monkeypatch):
    r = np.random.default_rng(bits)
    base = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = [np.bitwise_xor.reduce(np.uint64(1) << r.choice(64, n, replace=False).astype(np.uint64)) for n in r.integers(1, 8, 300)]
    fps = sorted({int(x) for x in base} | {int(base[k % 40] ^ f) for k, f in enumerate(flips)})
    if share:
        monkeypatch.setattr(H, "AT_ONCE", 1 << 12)  # work through buckets in slices
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp bigint")
    from recallum.operators.components import connected_components

    got = {r.node & (1 << 64) - 1: r.component for r in connected_components(H.links(df, bits=bits)).collect()}
    want = components([(x, x) for x in fps])
    groups = {}
    for x in fps:
        groups.setdefault(want[x], set()).add(x)
    mine = {}
    for x in fps:
        mine.setdefault(got.get(x, ("own", x)), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_hot_buckets_are_split(spark):
    center = np.uint64(0x0123456789ABCDEF)
    some = [int(center ^ m) for m in H.masks(64, 2)]
    fps = np.array(some, np.uint64)
    hot = np.array([(int(center) >> 56) | 1 << 8], np.uint64)
    keys, owners = H._buckets(fps, 8, 8, hot, 2)
    assert not np.isin(keys, hot).any() and set(owners.tolist()) == set(some) and keys.max() >= 1 << 16


def test_near_texts(spark):
    words = [f"w{k}" for k in range(400)]
    edit = lambda at: " ".join(w if k not in at else "changed" for k, w in enumerate(words))
    rows = [(1, edit([])), (2, edit([])), (3, edit([7])), (4, edit([7, 300])), (5, edit(range(0, 400, 5))), (6, " ".join(reversed(words))), (7, ""), (8, None), (9, "one"), (10, "two")]
    got = {r.id: r.component for r in H.near_texts(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 7, 8: 7, 9: 9, 10: 10}


def test_near_texts_against_brute_force(docs):
    got = {r.id: r.component for r in H.near_texts(docs).collect()}
    rows = docs.orderBy("doc_id").collect()
    sets = {r.doc_id: set(H.shingles(r.text).tolist()) for r in rows}
    text = {r.doc_id: r.text for r in rows}
    ids = sorted(sets)
    alike = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if text[a] == text[b] or len(sets[a] & sets[b]) >= 0.8 * max(1, len(sets[a] | sets[b]))]
    assert sum(got[a] == got[b] for a, b in alike) >= 0.95 * len(alike)
    assert set(got) == set(ids) and all(got[i] <= i for i in ids)
    linked = {i for pair in alike for i in pair}
    assert all(got[i] == i for i in ids if i not in linked)


def test_odd_near_texts(odd, none):
    got = H.near_texts(odd)
    assert got.select("id").distinct().count() == 16 and got.where(F.col("id").isin(0, 1)).select("component").distinct().first()[0] == 0
    assert H.near_texts(none).count() == 0


def brute_force(texts):
    """Component by place in the list, over all pairs."""
    sets = [set(H.shingles(t).tolist()) for t in texts]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    return H.forest(len(sets), np.array([a for a, _ in pairs], int), np.array([b for _, b in pairs], int)).tolist(), len(pairs)


def near(spark, texts):
    got = {r.id: r.component for r in H.near_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    return [got[k] for k in range(len(texts))]


def test_near_texts_with_replaced_blocks(spark):
    r, texts = random.Random(4), []
    for k in range(120):
        n = r.choice((60, 100, 300, 1000))
        words = [f"w{k}x{i}" for i in range(n)]
        at, size = r.randrange(n), int(n * r.uniform(0.02, 0.14))
        texts += [" ".join(words), " ".join(words[:at] + [f"new{k}x{i}" for i in range(size)] + words[at + size :])]
    want, n = brute_force(texts)
    assert 60 < n < 120 and near(spark, texts) == want


def test_near_texts_of_one_template(spark, monkeypatch):
    # All texts have one set of words and share most of their shingles, a few pairs share enough.
    monkeypatch.setattr(H, "ASKING", 16)
    monkeypatch.setattr(H, "ASKED", 32)
    r, head, tail, texts = random.Random(5), " ".join(f"h{k}" for k in range(170)), [f"t{k}" for k in range(30)], []
    for k in range(400):
        r.shuffle(tail)
        texts.append(f"{head} {' '.join(tail)}")
        if k % 8 == 0:
            other = tail[14:]
            r.shuffle(other)
            texts.append(f"{head} {' '.join(tail[:14] + other)}")
    r.shuffle(texts)
    want, n = brute_force(texts)
    assert 30 < n < 100 and near(spark, texts) == want


def test_rows_wait_only_for_texts_that_can_be_similar(spark):
    """Every pair within the bounds of length and place keeps both its rows, and texts of other lengths that share a shingle keep none."""
    r = np.random.default_rng(9)
    words = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    apart = [(k, f"a b c d e {words(k, n)}") for k, n in enumerate((20, 60, 200, 700))]
    none = spark.range(0).selectExpr("id AS node", "id AS component")
    rare = H.prefixes(spark.createDataFrame(apart, "id bigint, text string"), 0.8, 5)
    shared = {int(x) for x in H.shingles("a b c d e").view(np.int64)}
    rare = rare.withColumn("toks", F.array(F.lit(next(iter(shared)))))
    assert H.meetings_of(rare, none, 0.8).count() == 0
    rows = [(k, int(n), [0] * (H.PARITIES // 64), [int(t) for t in r.permutation(30)[: max(1, int(n) // 5)]]) for k, n in enumerate(r.integers(4, 90, 150))]
    got = {(x.tok, x.id) for x in H.meetings_of(spark.createDataFrame(rows, "id bigint, n int, bits array<bigint>, toks array<bigint>"), none, 0.8).collect()}
    want = set()
    for tok in range(30):
        here = [(k, n, n - toks.index(tok)) for k, n, _, toks in rows if tok in toks]
        want |= {(tok, k) for k, n, left in here for j, m, rest in here if j != k and min(n, m) >= 0.8 * max(n, m) and min(left, rest) >= 0.8 / 1.8 * (n + m)}
    assert want and want <= got and len(got) < sum(len(x[3]) for x in rows)


def test_a_pair_counts_in_the_bucket_of_its_own_prefix():
    a = np.array([5 << 56, 5 << 56, (5 << 56) | 1, 4 << 56], np.uint64)
    fp = np.zeros(4, np.uint64)
    assert {tuple(p) for p in H._neighbours(a, fp, 5, 8, 1).tolist()} >= {(0, 1), (0, 2)}
    assert {tuple(p) for p in H._neighbours(a, fp, 4, 8, 1).tolist()} <= {(0, 3), (1, 3), (2, 3)} != set()

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
from pyspark.sql import functions as F

from recallum.llm import divergence, queries

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, least=3, top=200):
    docs = [(l or "", s or "", [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(x or "")]) for l, s, x in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = {t for t, n in df.items() if n >= least}
        counts = defaultdict(Counter)
        for _, s, ts in mine:
            counts[s].update(t for t in ts if t in kept)
        total = sum(counts.values(), Counter())
        p = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))
        for s, c in counts.items():
            pair = [(sum((p(c, t) - p(o, t)) ** 2 // p(o, t) for t in kept), x) for x, o in counts.items() if x != s]
            term = [((p(c, t) - p(total, t)) ** 2 // p(total, t), t) for t in c if p(c, t) > p(total, t)]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                out += [(lang, s, part, x, v, k) for k, (v, x) in enumerate(sorted(found, key=lambda r: (-r[0], r[1].encode()))[:most], 1)]
    return sorted(out)


def values(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_against_plain_counts_in_small_blocks(spark, docs):
    rows = [(r.lang, r.source, r.text) for r in docs.collect()]
    want = plain(rows)
    assert values(divergence.audit(docs)) == want
    assert values(divergence.audit(docs, block=16)) == want


def test_the_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = con.execute(f"SELECT lang, source, part, item, value, rank FROM ({queries.OP12_SQL})").fetchall()
    assert values(queries.op12_divergence(spark, sf)) == sorted(got)


def test_odd_rows(spark, odd, none):
    rows = [(r.lang, r.source, r.text) for r in odd.collect()]
    assert values(divergence.audit(odd)) == plain(rows)
    mixed = odd.withColumn("source", F.when(F.col("doc_id") % 3 == 1, None).otherwise(F.concat(F.lit("s"), F.col("doc_id") % 5))).withColumn("lang", F.when(F.col("doc_id") > 12, "xx").otherwise(F.col("lang")))
    assert values(divergence.audit(mixed)) == plain([(r.lang, r.source, r.text) for r in mixed.collect()])  # xx has no terms
    assert values(divergence.audit(none)) == []


def test_counts_that_a_task_passes_on_early(spark, docs, monkeypatch):
    whole = sorted(map(tuple, divergence.counted(docs).collect()))
    held, size = divergence.HELD, divergence.BYTES
    try:
        divergence.HELD, divergence.BYTES = 50, 2000
        assert sorted(map(tuple, divergence.counted(docs).collect())) == whole
    finally:
        divergence.HELD, divergence.BYTES = held, size


def test_large_counts_are_exact(spark):
    n, size = 3 * 10**12, 7 * 10**12 + 1
    want = 1 + 10**9 * (n + 1) // size
    assert divergence._smoothed(np.array([n]), size).tolist() == [want]
    assert spark.range(1).select(divergence.smoothed(F.lit(n), F.lit(size))).first()[0] == want


def test_intersected_runs_equal_single_places():
    rng = np.random.default_rng(0)
    length = rng.integers(1, 5, 60)
    a, b = rng.integers(0, 3, 60) * 10 + 1, rng.integers(0, 3, 60) * 7 + 2
    ends = np.cumsum(length)
    p, q = np.repeat(a, length), np.repeat(b, length)
    assert divergence.intersected(divergence.runs(a, ends), divergence.runs(b, ends)) == (((p - q) ** 2 // q).sum(), ((p - q) ** 2 // p).sum())

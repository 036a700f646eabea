import re
from collections import defaultdict
from random import Random

from pyspark.sql import functions as F

from recallum.llm import mixing, queries


def levels(sizes: dict, weights=(5, 2, 1), share=1.5, most=2.0) -> dict:
    """Plain form: deal by weight, stop at `most` times, deal the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    budget, stopped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in stopped]
        left = budget - sum(stopped.values())
        level = left / sum(weight[s] for s in free) if free else 0
        over = {s: most * sizes[s] for s in free if level * weight[s] > most * sizes[s]}
        if not over:
            return stopped | {s: level * weight[s] for s in free}
        stopped |= over


def whole(docs, rows):
    """Hold the rows of op11's columns against the texts."""
    size = defaultdict(int)
    texts = docs.select("source", "text").collect()
    for r in texts:
        size[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    target = levels(size)
    assert len(rows) == len(texts)
    taken, cut = defaultdict(int), defaultdict(int)
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == size[s] and abs(r.target - target[s]) <= 1e-9 * (1 + target[s])
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size + r.part
        taken[s] += r.taken
        cut[s] += r.part > 0
    for s in size:
        assert abs(taken[s] - target[s]) <= 1.5 and cut[s] <= 1, s
    return taken, target


def test_all_documents_near_their_targets_and_reruns_agree(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = queries.op11_mixing(spark, sf).collect()
    whole(docs, first)
    with_other_files = mixing.copies(docs.repartition(7).orderBy(F.desc("n_chars")))
    assert sorted((r.doc_id, r.taken) for r in first) == sorted((r.id, r.taken) for r in with_other_files.collect())


def test_levels_of_groups_and_a_hot_source(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 40}", "w " * (1 + i * 37 % 90)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id int, source string, text string")
    got = mixing.copies(docs, group=8).withColumnRenamed("id", "doc_id").collect()
    whole(docs, got)


def test_expectations_stay():
    """Each document is taken as often as its fraction says, over many draws."""
    full, share = [50, 30, 20, 9, 5, 3], [0.5, 0.25, 0.75, 0.1, 0.9, 0.4]
    total, mass = [0.0] * 6, [int(f * s * 1000) for f, s in zip(full, share, strict=True)]
    for k in range(20000):
        now = list(mass)
        taken, held = mixing.paired([f * 1000 for f in full], now, Random(k))
        assert sum(t * f * 1000 for t, f in zip(taken, full, strict=True)) + (now[held] if held >= 0 else 0) == sum(mass)
        for j in range(6):
            total[j] += now[held] / full[held] / 1000 if j == held else taken[j]
    assert all(abs(t / 20000 - s) < 0.015 for t, s in zip(total, share, strict=True))


def test_odd_rows(spark, odd, none):
    rows = mixing.copies(odd).collect()
    assert len(rows) == odd.count() and all(r.copies <= 2 for r in rows)
    sources = odd.withColumn("source", F.when(F.col("doc_id") % 4 == 0, None).when(F.col("doc_id") % 4 == 1, "").otherwise("ß"))
    got = mixing.copies(sources)
    rows = got.collect()
    assert {r.source for r in rows} == {None, "", "ß"}
    want = levels({r["source"]: r["n"] for r in sources.groupBy("source").agg(F.sum(mixing.words(F.col("text"))).alias("n")).collect()})
    assert all(abs(r.target - want[r.source]) < 1e-6 for r in rows)
    mixed = mixing.mixture(sources, got)
    assert mixed.columns == sources.columns and mixed.count() == sum(r.copies + (r.part > 0) for r in rows)
    assert mixed.agg(F.sum(mixing.words(F.col("text")))).first()[0] == sum(r.taken for r in rows)
    assert mixing.copies(none).count() == 0
    silent = spark.createDataFrame([(1, None, "a"), (2, "  ", "b")], "doc_id int, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.copies(silent).collect()] == [(0, 0.0, 0)] * 2

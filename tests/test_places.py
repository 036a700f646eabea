"""Cover density and windows of concepts against plain enumerations."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallum.operators import places as P
from recallum.sources import tables as S


def plain_covers(places):
    every = sorted(itertools.chain(*places))
    whole = lambda a, b: all(any(a <= p <= b for p in of) for of in places)
    full = [(a, b) for a in every for b in every if a <= b and whole(a, b)]
    return sorted(x for x in full if not any(y != x and x[0] <= y[0] and y[1] <= x[1] for y in full))


@pytest.mark.parametrize("seed", range(40))
def test_covers_and_windows(seed):
    r = random.Random(seed)
    at = r.sample(range(40), r.randint(3, 14))
    groups = [[] for _ in range(r.randint(1, 3))]
    for p in at:
        r.choice(groups).append(p)
    groups = [sorted(g) for g in groups if g]
    want = plain_covers(groups)
    assert P.covers(groups) == want
    every = sorted(itertools.chain(*groups))
    assert P.density(groups) == pytest.approx(sum(0.1 / (1 + b - a - (sum(a <= p <= b for p in every) - 1)) for a, b in want))
    sided = [[(p, p + r.randint(1, 5)) for p in g] for g in groups]
    got = P.smallest_window([(np.array([s for s, _ in g]), np.array([e for _, e in g])) for g in sided])
    span = min(max(e for _, e in pick) - min(s for s, _ in pick) for pick in itertools.product(*sided))
    assert got[1] - got[0] == span


def test_stems_and_cover_ranks(spark):
    words = {"guardado": "guard", "guardar": "guard", "guardando": "guard", "memorias": "memori", "sol": "sol", "casas": "cas", "rápidamente": "rápida"}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r.w: r.s for r in df.select("w", P.stemmed(F.col("w")).alias("s")).collect()} == words
    docs = spark.createDataFrame([(1, "El archivo guardado en memoria"), (2, "guardar aquí y allá una larga memoria"), (3, "sin nada"), (4, None), (5, "memorias guardadas, memoria guardada")], "id bigint, content string")
    q = spark.createDataFrame([(1, ["guardar", "memoria"]), (2, ["guardar"]), (3, []), (4, None)], "qid bigint, terms array<string>")
    got = {(r.qid, r.id): r.rank for r in P.cover_ranks(q, "terms", docs, 10).collect()}
    assert got == pytest.approx({(1, 1): 0.1 / 2, (1, 2): 0.1 / 6, (1, 5): 0.3, (2, 1): 0.1, (2, 2): 0.1, (2, 5): 0.2}, abs=1e-6)
    any_of = {(r.qid, r.id): r.rank for r in P.cover_ranks(q, "terms", docs, 1, every=False).collect()}
    assert any_of[1, 5] == pytest.approx(0.4)
    assert P.cover_ranks(q.limit(0), "terms", docs, 10).count() == 0 and P.cover_ranks(q, "terms", docs.limit(0), 10).count() == 0


def test_concepts_near_and_far(spark):
    q = spark.createDataFrame([(1, ["transcript", "temporal", "eliminado"]), (2, ["transcript"])], "qid bigint, terms array<string>").select("qid", P.concepts(F.col("terms")).alias("concepts"))
    texts = ["Mejor extraer un transcript temporal y borrarlo al terminar.", "transcript " + "x" * 900 + " temporal eliminado", "transcript", None, "transcript " + "x" * 900 + " transcript temporal, borrado"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id bigint, content string")
    got = {r.id: r for r in P.concept_windows(q, docs).collect()}
    assert set(got) == {0, 4} and all(r.qid == 1 and r.bonus == 30 and r.found == 3 for r in got.values())
    assert got[0].span <= 60 and got[0].passage == texts[0] and got[4].span <= 40


def test_concept_windows_against_plain_places(spark, sf):
    q = S.query_table(spark, sf).select("qid", P.concepts(F.slice("strong", 1, 4)).alias("concepts")).limit(12)
    docs = S.memory(spark, sf).select("id", "content")
    want = {}
    texts = {r.id: r.content for r in docs.collect()}
    for r in q.collect():
        for i, text in texts.items():
            low = text.lower()
            places = [sorted({(p, p + len(v)) for v in g for p in range(len(low)) if low.startswith(v, p)}) for g in r.concepts]
            found = [p for p in places if p]
            if len(r.concepts) >= 2 and len(found) >= 2:
                spans = []
                for s in {s for g in found for s, _ in g}:
                    ends = [min((e for a, e in g if a >= s), default=None) for g in found]
                    if None not in ends:
                        spans.append(max(ends) - s)
                if up := P.bonus(len(found), len(r.concepts), min(spans)):
                    want[r.qid, i] = (len(found), min(spans), up)
    assert {(r.qid, r.id): (r.found, r.span, r.bonus) for r in P.concept_windows(q, docs).collect()} == want and want


def test_smallest_windows_near_the_rarest_group():
    """With a bound, places far from the rarest group are left out, and what is within the bound is the same."""
    r = np.random.default_rng(8)
    for k in range(200):
        groups = [(s := np.unique(r.integers(0, 20_000, n)), s + r.integers(3, 9, len(s))) for n in (1 + k % 3, 150, 90)]
        start, end = P.smallest_window(groups)
        for most in (150, 700):
            got = P._smallest([P._sides(*g) for g in groups], most)
            assert got == (start, end) if end - start <= most else got[1] - got[0] > most


def test_concepts_that_queries_share(spark):
    """A concept of several queries, one that a query names twice, and one without variants count as each query's own."""
    q = spark.createDataFrame([(1, [["aaa", "bbb"], ["ccc"]]), (2, [["ccc"], ["aaa", "bbb"], ["zzz"]]), (3, [["ccc"], ["ccc"]]), (4, [["ccc"], []]), (5, None)], "qid bigint, concepts array<array<string>>")
    docs = spark.createDataFrame([(1, "x bbb and ccc"), (2, "ccc alone"), (3, None), (4, "aaa " + "y" * 800 + " ccc")], "id bigint, content string")
    got = {(x.qid, x.id): (x.found, x.bonus) for x in P.concept_windows(q, docs).collect()}
    assert got == {(1, 1): (2, 30), (2, 1): (2, 10), **{(3, k): (2, 30) for k in (1, 2, 4)}}

"""Classifiers: held-out accuracy, odd rows, and models against plain arithmetic."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallum.llm import queries, quality, toxicity


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (1 - y).sum())


def held(spark, sf, query, label, parts, at):
    got = query(spark, sf)
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    rows = got.collect()
    assert len(rows) == n and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == at) for r in rows)
    j = got.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select(label, "score").collect()
    return np.array([r[0] for r in j]), np.array([r.score for r in j])


@pytest.mark.parametrize("query,label,parts,at,size,least", [(queries.op6_quality, "quality", 4, 2, "sf0.01", 0.95), (queries.op9_toxicity, "toxic", 3, 1, "sf0.1", 0.95)])
def test_held_out_accuracy(spark, sf, query, label, parts, at, size, least):
    y, s = held(spark, sf.replace("sf0.001", size), query, label, parts, at)
    assert auc(y, s) >= least


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_odd_rows(spark, odd, none, module, label):
    labels = spark.createDataFrame([(i, int(i % 2), int(i % 2)) for i in range(16)] + [(0, None, None), (99, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = module.scored(odd, labels).collect()
    assert len(got) == 18 and all(0 <= r.score <= 1 for r in got)
    assert module.scored(none, labels).count() == 0
    one = module.scored(odd, labels.where(F.col(label) == 1)).collect()
    assert {r.score for r in one} == {1.0}
    nothing = module.scored(odd, labels.limit(0)).collect()
    assert len(nothing) == 18 and len({r.score for r in nothing}) == 1


def test_labels_of_held_out_rows_are_not_read(spark, docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for module, label, parts, at in ((quality, "quality", 4, 2), (toxicity, "toxic", 3, 1)):
        turned = labels.withColumn(label, F.when(module.held_out(F.col("doc_id"), parts, at), 1 - F.col(label)).otherwise(F.col(label)))
        a, b = ({r.id: r.score for r in module.scored(docs, x).collect()} for x in (labels, turned))
        assert a == pytest.approx(b, abs=1e-6)


def test_discriminant_against_plain_densities():
    r = np.random.default_rng(5)
    d = len(quality.NAMES)
    x = {0: r.normal(0, 1, (400, d)), 1: r.normal(0.5, 2, (800, d))}
    m = quality.Discriminant(0, 0).fit({k: (len(v), v.sum(0), v.T @ v) for k, v in x.items()})
    pooled = sum(np.cov(v.T, bias=True) * len(v) for v in x.values()) / 1200
    logs = []
    for k, v in x.items():
        own = d / (d + len(v))
        c = (1 - own) * np.cov(v.T, bias=True) + own * pooled
        z = x[1][:20] - v.mean(0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(c), z) - 0.5 * np.linalg.slogdet(c)[1] + np.log(len(v) / 1200))
    assert m.score(x[1][:20]) == pytest.approx(1 / (1 + np.exp(logs[0] - logs[1])), abs=1e-9)


def plain_kneser_ney(texts):
    """Word → (log ratio of the classes) by dictionaries and recursion, from (text, toxic) rows."""
    n, d = toxicity.ORDER, toxicity.DISCOUNT
    split = lambda w, n: [(b"\x02" * (n - 1) + w.encode() + b"\x03")[k : k + n] for k in range(len(w.encode()) + 1)]
    top = [Counter(), Counter()]
    for text, y in texts:
        for w in set(toxicity.WORD.findall((text or "").lower())):
            top[y].update(split(w, n))
    levels, at = [], set(top[0]) | set(top[1])
    for _ in range(n - 1):
        levels.append(Counter(g[1:] for g in at))
        at = set(levels[-1])

    def after(c):
        """Uses and kinds of what follows each context."""
        total, kinds = Counter(), Counter()
        for x, v in c.items():
            total[x[:-1]] += v
            kinds[x[:-1]] += 1
        return total, kinds

    of_levels, of_top = [after(c) for c in levels], [after(c) for c in top]

    def shared(s, k):
        if not s:
            return 1 / 256
        total, kinds = of_levels[k]
        return (max(levels[k][s] - d, 0) + d * kinds[s[:-1]] * shared(s[1:], k + 1)) / total[s[:-1]]

    def probability(y, g, p):
        total, kinds = of_top[y]
        return (max(top[y][g] - d, 0) + d * kinds[g[:-1]] * p) / total[g[:-1]] if total[g[:-1]] else p

    def ratio(word):
        out = 0.0
        for g in split(word, n):
            if top[0][g] + top[1][g] > 0:
                p = shared(g[1:], 0)
                out += np.log(probability(1, g, p) / probability(0, g, p))
            elif any(total[g[:-1]] for total, _ in of_top):
                out += np.log(probability(1, g, 1.0) / probability(0, g, 1.0))  # the shared probability cancels
        return out

    return ratio


TEXTS = [("you scum bad scum the", 1), ("the bad idiot é scum", 1), ("idiots", 1), ("the good the good sad", 0), ("sad and the ordinary été", 0), (None, 0), ("good idea of the", 0), ("", 1)]


def plain_evidence(ratio, text):
    words = toxicity.WORD.findall((text or "").lower())
    return float(np.mean([np.log1p(toxicity.MIX * np.expm1(min(ratio(w), toxicity.CAP))) for w in words])) if words else 0.0


def test_evidence_against_plain_kneser_ney(spark):
    rows = spark.createDataFrame([(*r, k % 3 == 0) for k, r in enumerate(TEXTS)], "text string, toxic int, tune boolean")
    ratio = toxicity.ratios(toxicity.gram_counts(rows)).cache()
    asked = [t for t, _ in TEXTS] + ["Scums idioten goods", "xyz q", "12 !?"]
    docs = spark.createDataFrame([(k, 0, t) for k, t in enumerate(asked)], "id bigint, h bigint, text string")
    by = plain_kneser_ney(TEXTS)
    # The two ways, with a table on every worker and by joins, give the same.
    for most in (toxicity.MODEL, 0):
        got = {r.id: r for r in toxicity.evidence(docs, ratio, most).collect()}
        assert len(got) == len(asked)
        for k, text in enumerate(asked):
            assert got[k].x1 == pytest.approx(plain_evidence(by, text), abs=1e-9)
    # x0 has learnt from the rows that don't tune; the shared orders are from all.
    assert got[0].x0 != got[0].x1


def test_scores_against_plain_kneser_ney(spark, sf):
    """The query's scores: evidence by dictionaries, then the same logistic function."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    few = [(i, " ".join((t or "").split()[:40])) for i, t in docs][:60]
    df = spark.createDataFrame(few, "doc_id bigint, text string")
    labels = [(i, int(len(t or "") % 3 == 0)) for i, t in few]
    label = {i: y for i, y in labels if zlib.crc32(str(i).encode()) % 3 != 1}
    got = {r.id: r.score for r in toxicity.scored(df, spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()}
    ratio = plain_kneser_ney([(t, label[i]) for i, t in few if i in label])
    x = np.array([plain_evidence(ratio, t) for _, t in few])
    order, s = np.argsort(x), np.array([got[i] for i, _ in few])
    assert len(got) == 60 and (np.diff(s[order]) >= -1e-9).all() and len(set(np.round(s, 9))) > 20
    z, logit = np.log(x + 2 * toxicity.MIX), np.log(s / (1 - s))
    assert np.allclose(np.polyval(np.polyfit(z, logit, 1), z), logit, atol=1e-6)


def test_quality_against_plain_statistics(spark, sf):
    """The query's scores: statistics in plain loops, Gaussians by numpy's own covariance."""
    import math
    import re

    def plain(text):
        text = text or ""
        words, lines = re.findall(r"\S+", text), [x for x in text.split("\n") if x.strip()]
        n, m, c = len(words), max(1, len(words)), max(1, len(text))
        mean = sum(map(len, words)) / m
        alpha = sum(len(x) for x in re.findall(r"[^\W\d_]+", text))
        squeezed = zlib.compressobj(1)
        raw = text.encode()
        packed = len(b"".join([*(squeezed.compress(raw[k : k + quality.PIECE]) for k in range(0, len(raw), quality.PIECE)), squeezed.flush()]))
        count = Counter(words)
        of = lambda s: math.sqrt(sum(x in s for x in text) / m)
        return [
            math.log1p(n), math.log1p(mean), math.log1p(math.sqrt(sum((len(w) - mean) ** 2 for w in words) / m)), len(set(words)) / m * math.log1p(m), math.sqrt(sum(a == b for a, b in zip(words, words[1:], strict=False)) / m), math.sqrt(max(count.values(), default=0) / m), of("|"), of("$%&#*<>{}[]\\^~=+"), of("!?"),
            math.sqrt(sum(x.isdigit() for x in text) / c), math.sqrt(sum(x.isupper() for x in text) / max(1, alpha)), of(".;:"), of(","), math.log1p(n / max(1, len(lines))), math.sqrt(1 - len(set(lines)) / max(1, len(lines))), sum(x.rstrip()[-1] in ".!?\"'" for x in lines) / max(1, len(lines)), math.log((packed + 8) / (len(raw) + 8)),
            math.sqrt(1 - alpha / max(1, len(text) - text.count(" ") - text.count("\n"))), math.sqrt(sum(len(w) > 15 for w in words) / m), math.sqrt(sum(v for w, v in count.items() if v > 3 and len(w) > 6) / m),
        ]

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    x = {i: np.array(plain(t)) for i, t in docs}
    own = {k: np.array([x[i] for i, _ in docs if label.get(i) == k]) for k in (0, 1)}
    total, d, model = sum(map(len, own.values())), len(quality.NAMES), quality.Discriminant()
    pooled = sum(np.cov(v.T, bias=True) * len(v) for v in own.values()) / total
    logs = []
    for v in own.values():
        lean = model.shrink + (1 - model.shrink) * d / (d + len(v))
        cov = (1 - lean) * np.cov(v.T, bias=True) + lean * pooled
        cov = (1 - model.diagonal) * cov + model.diagonal * np.diag(np.diag(pooled) + 1e-9)
        z = np.array([x[i] for i, _ in docs]) - v.mean(0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z) - 0.5 * np.linalg.slogdet(cov)[1] + np.log(len(v) / total))
    want = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))
    got = {r.doc_id: r.score for r in queries.op6_quality(spark, sf).collect()}
    assert [got[i] for i, _ in docs] == pytest.approx(want.tolist(), abs=1e-6)

import time

import corpus_pipeline as p
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recallum.llm import packing, quality, simhash, toxicity
from recallum.sources.shared import BATCH, cut, shuffles_removed, small_batches, written


def groups(texts):
    """Place of the first text of each one's group, over all pairs: equal, or five-word Jaccard similarity of 0.8 or more."""
    sets = [set(simhash.shingles(t).tolist()) for t in texts]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if (texts[a] or "") == (texts[b] or "") or sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    return simhash.forest(len(texts), np.array([a for a, _ in pairs], int), np.array([b for _, b in pairs], int)).tolist()


def test_rows_are_told_apart_by_id_and_text(spark, sf, tmp_path):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(3, long), (5, long), (5, "another text of this id"), (1, "twice"), (1, "twice"), (None, "no id"), (None, long), (None, None), (8, ""), (9, None), (7, long + " more")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = sorted(((r.doc_id, r.text) for r in p.one_of_each(spark, docs, sf).collect()), key=str)
    assert got == sorted([(3, long), (5, "another text of this id"), (1, "twice"), (None, "no id"), (8, "")], key=str)
    scored = spark.createDataFrame([(5, "another text of this id", 0.9), (None, "no id", 0.9), (3, long, 0.1)], "id bigint, text string, score double").withColumn("h", F.xxhash64("text"))
    left = p._without(docs, scored, F.col("score") >= 0.7)
    assert left.columns == docs.columns and left.count() == len(rows) - 2 and left.where("text IN ('no id', 'another text of this id')").count() == 0
    # Empty tables go through all stages.
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_through_all_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(None, None, None, None, None), (2, "", "en", "s", 0), (2, "x " * 4000, None, "s", 8000), (2, "", "en", "s", 0)], docs.schema)
    docs.unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    got = p.run(spark, str(tmp_path))
    assert got.where("length < 1 OR offset < 0").count() == 0 and got.count() > 0


def test_stages_take_effect(spark, sf, docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = docs
    for k, (name, stage) in enumerate(p.STAGES):
        out = written(stage(spark, kept, sf), f"t-{name}")
        if k < len(p.STAGES) - 1:
            assert out.columns == docs.columns
            assert out.join(kept.select("doc_id"), "doc_id", "left_anti").count() == 0
        if name == "toxicity":
            bad = {r.id for r in toxicity.scored(kept, labels).where("score >= 0.7").collect()}
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in kept.collect()} - bad and bad
        if name == "quality":
            bad = {r.id for r in quality.scored(kept, labels).where("score < 0.3").collect()}
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in kept.collect()} - bad and bad
        if name == "near_duplicates":
            rows = kept.orderBy("doc_id").collect()
            root = groups([r.text for r in rows])
            assert {r.doc_id for r in out.collect()} == {r.doc_id for k, r in enumerate(rows) if root[k] == k} and out.count() < kept.count()
        if name == "pii":
            assert out.count() == kept.count() and out.where(F.length("text") != F.col("n_chars")).count() == 0
        if name == "packing":
            assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r.doc_id for r in kept.collect()}
            assert out.agg(F.sum("length")).first()[0] == out.where("start = 0").agg(F.sum("doc_tokens")).first()[0]
        kept = out


def test_run_gives_the_last_stage(spark, sf):
    assert p.run(spark, sf).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_stages_work_on_small_batches(spark, sf, docs, monkeypatch):
    """Texts go to Python workers in batches of bounded bytes, and the session's setting comes back, after errors too."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    most = lambda: spark.range(3000).select(F.repeat(F.lit("x"), 10_000).alias("t")).coalesce(1).mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]
    before = most()
    with small_batches(spark):
        assert most() < 2 * BATCH < before
    assert most() == before
    spark.conf.set(name, "1m")
    with small_batches(spark):
        assert spark.conf.get(name) == "1m"
    spark.conf.unset(name)
    for stage, module, operator in ((p.drop_toxic, toxicity, "scored"), (p.keep_quality, quality, "scored"), (p.one_of_each, simhash, "near_texts"), (p.pack, packing, "pack")):
        def asked(*args, **named):
            raise KeyError(spark.conf.get(name))

        monkeypatch.setattr(module, operator, asked)
        with pytest.raises(KeyError, match=str(BATCH)):
            stage(spark, docs, sf)
        assert spark.conf.get(name, None) is None


def test_shuffles_go_with_their_action(spark, sf, docs, monkeypatch):
    files = lambda: {f.getName() for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    set_before = spark.conf.get(name, None)
    before = files()
    with shuffles_removed(spark):
        sums = cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
        for _ in range(50):
            if not files() - before:
                break
            time.sleep(0.2)
    assert not files() - before and sums.agg(F.sum("count")).first()[0] == 1000

    def asked(*args, **named):
        raise KeyError(spark.conf.get(name))

    monkeypatch.setattr(simhash, "near_texts", asked)
    with pytest.raises(KeyError, match="true"):
        p.one_of_each(spark, docs, sf)
    assert spark.conf.get(name, None) == set_before


def test_workers_hand_over_bounded_batches(spark, monkeypatch):
    """Neither long lists nor crowded buckets are held at once, and what comes of them is the same."""
    lists = pa.array([list(range(n)) for n in (0, 3, 900, 0, 7, 7, 7, 50, 1)], pa.list_(pa.int64()))
    b = pa.RecordBatch.from_arrays([pa.array(range(9)), lists], names=["id", "toks"])
    for whole in (b, b.slice(2), b.slice(9)):
        parts = list(simhash.by_length(whole, 1, 10))
        assert pa.Table.from_batches(parts, whole.schema).equals(pa.Table.from_batches([whole]))
        assert all(len(x.slice(1).column(1).flatten()) < 10 for x in parts)
    rng = np.random.default_rng(5)
    a = np.repeat(rng.integers(0, 1 << 63, 60, dtype=np.uint64) >> np.uint64(8), 20) ^ (np.uint64(1) << rng.integers(0, 50, 1200, dtype=np.uint64))
    fp = np.repeat(rng.integers(0, 1 << 63, 60, dtype=np.uint64), 20) ^ (np.uint64(1) << np.arange(1200, dtype=np.uint64) % np.uint64(60))
    once = simhash._neighbours(a, fp, 0, 8, 1)
    monkeypatch.setattr(simhash, "SPELLED", 1 << 9)
    assert len(once) and {x for p in once.tolist() for x in p} == {x for p in simhash._neighbours(a, fp, 0, 8, 1).tolist() for x in p}
    words = [f"w{k}" for k in range(400)]
    texts = cut(spark.createDataFrame([(k, " ".join(words[k : k + 90])) for k in range(40)], "id bigint, text string"))
    comp = spark.range(0).selectExpr("id AS node", "id AS component")
    rare = cut(simhash.prefixes(texts, 0.8, 5))
    rows = lambda: sorted(simhash.meetings_of(rare, comp).collect())
    whole = rows()
    monkeypatch.setattr(simhash, "HANDED", 16)
    assert whole and rows() == whole


def test_near_texts_start_without_rows_from_python(spark, monkeypatch):
    """A table made by createDataFrame starts further Python workers beside those that hold texts."""
    long = " ".join(f"w{k}" for k in range(60))
    docs = cut(spark.createDataFrame([(1, long), (2, long + " more"), (3, "other words")], "doc_id bigint, text string"))

    def refused(*args, **named):
        raise AssertionError("createDataFrame")

    monkeypatch.setattr(type(spark), "createDataFrame", refused)
    assert sorted((r.id, r.component) for r in simhash.near_texts(docs).collect()) == [(1, 1), (2, 1), (3, 3)]

"""Streams replayed in micro-batches give what the batch gives."""

import pytest
from pyspark.sql import functions as F

from recallum.sources import tables as S
from recallum.streaming import jobs as J


def replay(spark, tmp_path, df, make, mode="append", parts=4):
    """Write `df` in order of time as several files, run `make` over them as a stream, and give the rows of its sink."""
    src = str(tmp_path / "in")
    n = df.count()
    rows = df.orderBy("ts").coalesce(1).withColumn("k", F.floor(F.monotonically_increasing_id() * parts / n)).cache()
    for k in range(parts):
        rows.where(F.col("k") == k).drop("k").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    name = "t" + tmp_path.name.replace("-", "_")
    q = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return spark.table(name)


@pytest.fixture
def events(spark, sf):
    return S.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def test_hourly_metrics(spark, sf, tmp_path, events):
    shape = lambda e: e.select(F.floor(F.col("value") * 10).cast("int").alias("latency_ms"), F.col("event_type").alias("method"), F.col("ts").alias("created_at"))
    got = replay(spark, tmp_path, events, lambda s: J.hourly_metrics(shape(s)), "append")
    want = J.hourly_metrics(shape(events))
    extra = got.exceptAll(want).count()
    assert extra == 0 and got.count() > 0.8 * want.count()  # the last windows stay open behind the watermark


def test_admission(spark, sf, tmp_path, events):
    shape = lambda e: e.select("user_id", "event_id", "ts")
    got = replay(spark, tmp_path, events, lambda s: J.admit(shape(s), 2, 86400.0), "append")
    want = J.admit(shape(events), 2, 86400.0)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_latest_ignores_late_writes(spark):
    rows = spark.createDataFrame([(1, "new", 5), (1, "old", 3), (2, "x", 1)], "id int, content string, t int").withColumn("ts", F.timestamp_seconds("t"))
    assert {r.id: r.content for r in J.latest(rows, "ts").collect()} == {1: "new", 2: "x"}


def test_ingest(spark, sf, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    S.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")).write.parquet(src)
    J.ingest(spark.readStream.schema("id bigint, content string").parquet(src), out, str(tmp_path / "cp"), spark).awaitTermination(120)
    got = spark.read.parquet(out)
    assert got.count() == S.table(spark, sf, "documents").count() and got.where("signature IS NULL").count() == 0


def test_access_windows(spark, sf, tmp_path, events):
    shape = lambda e: e.select(F.concat(F.lit("v"), F.col("user_id") % 20).alias("memory_id"), F.col("ts").alias("accessed_at"))
    got = replay(spark, tmp_path, events, lambda s: J.access_windows(shape(s)), "append")
    want = J.access_windows(shape(events))
    assert got.exceptAll(want).count() == 0 and got.count() > 0.5 * want.count()


def test_alerts(spark, sf, tmp_path, events):
    subs = spark.createDataFrame([(1, "CLICK"), (2, "u"), (3, "zzz")], "sub_id int, pattern string")
    shape = lambda e: e.select(F.col("event_id").alias("id"), F.col("event_type").alias("content"))
    got, want = replay(spark, tmp_path, events, lambda s: J.alerts(shape(s), subs), "append"), J.alerts(shape(events), subs)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count() > 0


def test_judgments(spark, sf, tmp_path, events):
    shape = lambda e: e.select(F.concat_ws("-", F.col("user_id") % 7, "event_type").alias("key"), F.col("value").alias("verdict"), F.col("ts").alias("created_at"))
    got, want = replay(spark, tmp_path, events, lambda s: J.judgments(shape(s)), "complete"), J.judgments(shape(events))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_incremental_index(spark, tmp_path):
    out, code = str(tmp_path / "out"), "def a():\n    return 'some text here'\n\ndef b():\n    x = 1\n    return 'more text here'\n"
    schema = "path string, hash string, content string, modified int"

    def run(n, rows):
        spark.createDataFrame([(*r, n) if len(r) == 3 else r for r in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "src"))
        J.index_files(spark.readStream.schema(schema).parquet(str(tmp_path / "src")), out, str(tmp_path / "cp"), spark).awaitTermination(120)
        return {(r.path, r.hash, r.batch) for r in J.indexed(spark, out).collect()}, J.indexed(spark, out).count()

    state, n = run(0, [("a.py", "1", code), ("b.py", "1", code)])
    assert state == {("a.py", "1", 0), ("b.py", "1", 0)} and n == 4
    state, n = run(1, [("a.py", "1", code), ("b.py", "2", code + "def c():\n    y = 2\n    return 'third piece of text'\n"), ("b.py", "0", "older state", -1), ("c.py", "1", "")])
    assert state == {("a.py", "1", 0), ("b.py", "2", 1), ("c.py", "1", 1)} and n == 2 + 3 + 1
    assert {(r.path, r.hash) for r in J.manifest(spark, out).collect()} == {("a.py", "1"), ("b.py", "2"), ("c.py", "1")}

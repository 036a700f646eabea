"""State machines on streams: the same as their tables, also after a restart."""

import os

import pytest
from pyspark.sql import functions as F

from recallum.sources import tables as S
from recallum.streaming import jobs as J, state as ST


class Feed:
    """A stream of files; each `add` runs it to the end of what is there and stops it, so the next one restarts from the checkpoint."""

    def __init__(self, spark, tmp_path, schema, make, name):
        self.spark, self.tmp, self.schema, self.make, self.name = spark, tmp_path, schema, make, name

    def add(self, *parts):
        for p in parts:
            p.coalesce(1).write.mode("append").parquet(str(self.tmp / "in"))
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(str(self.tmp / "in"))
        q = self.make(stream).writeStream.format("parquet").option("path", str(self.tmp / "out")).outputMode("append").option("checkpointLocation", str(self.tmp / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None
        return self.spark.read.parquet(str(self.tmp / "out"))


@pytest.fixture
def events(spark, sf):
    return S.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def flaky(folder):
    """Fails as many times for a text as it says."""

    def embed(texts):
        out = []
        for t in texts:
            name, fails = t.split(":")
            tries = len(os.listdir(folder)) and len([x for x in os.listdir(folder) if x.startswith(f"{name}-")])
            open(f"{folder}/{name}-{tries}", "w").close()
            out.append([float(tries)] if tries >= int(fails) else None)
        return out

    return embed


def test_repairs_with_a_clock_and_restarts(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    schema = "id bigint, content string, sec bigint"
    feed = Feed(spark, tmp_path, schema, lambda s: ST.repairs(s.withColumn("ts", F.timestamp_seconds("sec")), flaky(str(tmp_path / "calls"))), "repairs")
    tick = lambda sec: spark.createDataFrame([(0, f"t{sec}:0", sec)], schema)
    feed.add(spark.createDataFrame([(1, "a:0", 100), (2, "b:2", 100), (3, "c:9", 100), (4, "old:9", 100)], schema))
    feed.add(tick(104), tick(105), tick(106))  # a run of its own: restarts from the checkpoint
    feed.add(spark.createDataFrame([(4, "new:0", 107)], schema), tick(136), tick(137))
    got = feed.add(*[tick(s) for s in (200, 300, 400, 500)])
    rows = sorted((r.id, r.tries, r.status, r.at // 1000) for r in got.where("id > 0").collect())
    assert rows == [
        (1, 1, "repaired", 100), (2, 1, "waiting", 100), (2, 2, "waiting", 105), (2, 3, "repaired", 135), (3, 1, "waiting", 100), (3, 2, "waiting", 105), (3, 3, "waiting", 135), (3, 4, "given up", 255),
        (4, 1, "repaired", 107), (4, 1, "waiting", 100), (4, 2, "waiting", 105),
    ]
    tried = got.where("id in (1, 2, 3)").select("id", F.timestamp_millis("at").alias("ts"), (F.col("status") == "repaired").alias("ok"))
    assert {r.id: (r.failures, r.status) for r in ST.repair_state(tried).collect()} == {1: (0, "repaired"), 2: (0, "repaired"), 3: (4, "given up")}
    some = ST.repair_state(tried.where("id = 3 and ts < timestamp_seconds(200)")).first()
    assert (some.failures, some.status, some.next_at.timestamp()) == (3, "waiting", 255)


def dealt(df, parts=5):
    """Tables of equal numbers of rows in order of time."""
    n = df.count()
    rows = df.orderBy("ts").coalesce(1).withColumn("k", F.floor(F.monotonically_increasing_id() * parts / n)).cache()
    return [rows.where(F.col("k") == k).drop("k") for k in range(parts)]


def test_blocks_as_in_the_table(spark, tmp_path, events):
    rows = events.select(F.concat(F.lit("s"), F.col("user_id") % 5).alias("session_id"), F.col("event_id").alias("seq"), F.col("props").alias("text"), "ts")
    ordered = rows.withColumn("seq", F.unix_millis("ts") * 1000 + F.col("seq") % 1000)
    feed = Feed(spark, tmp_path, ordered.schema, lambda s: ST.blocks(s, every=20), "blocks")
    a, b, c, d, e = dealt(ordered)
    feed.add(a, b)
    got = feed.add(c, d, e)
    want = J.session_rollup(ordered.select("session_id", "seq", "text"))
    key = lambda df: sorted((r.session_id, r.block, r.n, r.digest) for r in df.collect())
    assert key(got) == key(want) and want.count() > 5


def test_late_records_go_to_the_next_block(spark, tmp_path):
    schema = "session_id string, seq bigint, text string, ts timestamp"
    row = lambda i: spark.createDataFrame([("s", i, f"t{i}")], "session_id string, seq bigint, text string").withColumn("ts", F.timestamp_seconds(F.lit(1000 + i)))
    feed = Feed(spark, tmp_path, schema, lambda s: ST.blocks(s, every=3, late="1 hour"), "late")
    got = feed.add(*[row(i) for i in (1, 2, 5, 3, 4, 6, 7)])
    assert sorted((r.block, r.heads) for r in got.collect()) == [(0, "t1|t2|t5"), (1, "t3|t4|t6")]


def test_triggers_as_in_the_table(spark, tmp_path, events):
    rows = events.select("event_id", "ts")
    feed = Feed(spark, tmp_path, rows.schema, lambda s: ST.triggers(s, every=70, seconds=86_400), "triggers")
    parts = dealt(rows)
    feed.add(*parts[:3])
    last = rows.agg((F.max("ts") + F.expr("interval 3 minutes")).alias("ts")).select(F.lit(-1).cast("bigint").alias("event_id"), "ts")
    got = feed.add(*parts[3:], last)
    want = ST.triggers(rows.unionByName(last), every=70, seconds=86_400)
    key = lambda df: sorted((r.reason, r.k) for r in df.collect())
    assert key(got) == key(want) and {r for r, _ in key(want)} == {"saves", "time"}
    assert ST.saves_due(rows, every=70).count() == rows.count() // 70
    assert ST.triggers(rows.limit(0)).count() == 0


def test_judgments_expire(spark, tmp_path, events):
    rows = events.select(F.concat(F.lit("k"), F.col("user_id") % 13).alias("key"), F.col("event_id").alias("seq"), (F.col("event_type") == "purchase").alias("put"), F.col("value").alias("verdict"), "ts")
    ttl = 6 * 3600 * 1000
    feed = Feed(spark, tmp_path, rows.schema, lambda s: ST.answers(s, ttl=ttl), "judged")
    parts = dealt(rows)
    feed.add(*parts[:2])
    got = feed.add(*parts[2:])
    want = ST.answers(rows, ttl=ttl)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    assert want.where("hit").count() > 20 and want.where("not hit").count() > 20 and want.agg(F.max("hits")).first()[0] > 2
    state = spark.read.format("statestore").option("stateVarName", "entry").load(str(tmp_path / "cp"))
    held, last = state.select("value.made").collect(), rows.agg(F.max(ST.millis("ts"))).first()[0]
    assert held and all(r.made + ttl > last - 120_000 for r in held)  # expired keys have left the state

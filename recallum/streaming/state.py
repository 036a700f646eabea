"""State machines by key on streams, with timers of event time, and the same results from tables.

Timers fire as the watermark passes them, so a replay gives what the stream gave, and a clock can be
moved by rows.  State is kept in RocksDB, which `stateful` sets for the queries started after it, and leaves with its key:
repaired rows, given-up rows, full blocks and expired judgments hold none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor

from recallum.operators.numbering import numbered

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Seconds before each further try of a row whose embedder failed.
DELAYS = (5, 30, 120)
#: Saves, or seconds, after which maintenance is due.
SAVES, SECONDS = 50, 86_400
#: Milliseconds for which a judgment stands.
TTL = 30 * 86_400_000


def stateful(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, ts: str, late: str) -> DataFrame:
    """`rows` of a stream through one processor a key, with `at` (milliseconds) beside its columns."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    timed = rows.withWatermark(ts, late).withColumn("at", millis(ts))
    return timed.groupBy(key).transformWithStateInPandas(processor, schema, "Append", "EventTime")


def millis(ts: str) -> Column:
    return F.unix_millis(F.col(ts).cast("timestamp"))


def _sorted(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(by, kind="stable")


# Repair of rows without a vector.

REPAIRED = "id bigint, status string, tries int, at bigint, next_at bigint, signature string, embedding array<double>"


class Repair(StatefulProcessor):
    """Try a row's embedder at once and, while it fails, again after each of the delays; then give the row up.

    A newer text of a row takes the older one's place, whose vector can no longer be written.
    """

    def __init__(self, embed: Callable[[list[str]], list[list[float] | None]], delays: tuple[int, ...]) -> None:
        self.embed, self.delays = embed, delays

    def init(self, handle) -> None:
        self.handle = handle
        self.row = handle.getValueState("row", "content string, tries int, due bigint")

    def _try(self, key: int, content: str, tries: int, at: int) -> pd.DataFrame:
        from hashlib import md5

        vector, due = self.embed([content])[0], None
        if vector is None and tries <= len(self.delays):
            due = at + 1000 * self.delays[tries - 1]
            self.row.update((content, tries, due))
            self.handle.registerTimer(due)
        else:
            self.row.clear()
        status = "repaired" if vector is not None else "waiting" if due else "given up"
        return pd.DataFrame({"id": [key], "status": [status], "tries": pd.Series([tries], dtype="int32"), "at": [at], "next_at": pd.Series([due], dtype="Int64"), "signature": [md5(content[:28000].encode()).hexdigest()], "embedding": [vector]})

    def handleInputRows(self, key, rows, timerValues):
        now = _sorted(rows, ["at"]).iloc[-1]
        if self.row.exists():
            self.handle.deleteTimer(self.row.get()[2])
        yield self._try(key[0], now["content"], 1, int(now["at"]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.row.exists():
            content, tries, due = self.row.get()
            if due == expiredTimerInfo.getExpiryTimeInMs():
                yield self._try(key[0], content, tries + 1, due)

    def close(self) -> None:
        pass


def repairs(rows: DataFrame, embed: Callable[[list[str]], list[list[float] | None]], ts: str = "ts", delays: tuple[int, ...] = DELAYS, late: str = "0 seconds") -> DataFrame:
    """A stream of rows to be embedded (id, content, ts) → a row for each try (see `REPAIRED`); `embed` gives None for a text that failed."""
    return stateful(rows.select("id", "content", ts), "id", Repair(embed, delays), REPAIRED, ts, late)


def repair_state(tries: DataFrame, delays: tuple[int, ...] = DELAYS) -> DataFrame:
    """A table of tries (id, ts, ok) → (id, failures, status, next_at): failures since the last success, and when the next try is due."""
    last = tries.groupBy("id").agg(F.max(F.when(F.col("ok"), F.col("ts"))).alias("good"))
    since = tries.join(last, "id").where(~F.col("ok") & (F.col("good").isNull() | (F.col("ts") > F.col("good"))))
    failed = since.groupBy("id").agg(F.count("*").alias("failures"), F.max("ts").alias("failed_at"))
    n = F.coalesce("failures", F.lit(0))
    wait = F.get(F.array(*map(F.lit, delays)), (n - 1).cast("int"))
    status = F.when(n == 0, "repaired").when(n > len(delays), "given up").otherwise("waiting")
    return last.join(failed, "id", "left").select("id", n.alias("failures"), status.alias("status"), F.when(n > 0, F.timestamp_add("SECOND", wait, "failed_at")).alias("next_at"))


# Blocks of a session's records.

BLOCKS = "session_id string, block bigint, n bigint, digest string, heads string"


class Block(StatefulProcessor):
    """Hold a session's records until there are enough for a block; what comes late goes to the next one."""

    def __init__(self, every: int) -> None:
        self.every = every

    def init(self, handle) -> None:
        self.held = handle.getListState("held", "head string")
        self.done = handle.getValueState("done", "blocks bigint")

    def handleInputRows(self, key, rows, timerValues):
        from hashlib import md5

        heads = [x[0] for x in self.held.get()] if self.held.exists() else []
        heads += _sorted(rows, ["at", "seq"])["text"].fillna("").tolist()
        done = self.done.get()[0] if self.done.exists() else 0
        full = [heads[k : k + self.every] for k in range(0, len(heads) - self.every + 1, self.every)]
        left = heads[len(full) * self.every :]
        self.held.put([(x,) for x in left]) if left else self.held.clear()
        self.done.update((done + len(full),))
        if full:
            texts = ["|".join(b) for b in full]
            yield pd.DataFrame({"session_id": key[0], "block": range(done, done + len(full)), "n": self.every, "digest": [md5(t.encode()).hexdigest() for t in texts], "heads": texts})

    def close(self) -> None:
        pass


def blocks(records: DataFrame, every: int = 20, heads: int = 200, ts: str = "ts", late: str = "1 minute") -> DataFrame:
    """A stream of (session_id, seq, text, ts) → a row for each full `every` records of a session, as `jobs.session_rollup` gives it for a table."""
    rows = records.select("session_id", "seq", F.substring("text", 1, heads).alias("text"), ts)
    return stateful(rows, "session_id", Block(every), BLOCKS, ts, late)


# When maintenance is due.

TRIGGERED = "reason string, k bigint"


class Trigger(StatefulProcessor):
    """Count saves, fire at each `every`th; and fire whenever `seconds` have gone by since the first save."""

    def __init__(self, every: int, seconds: int) -> None:
        self.every, self.seconds = every, seconds

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "saves bigint, rounds bigint, due bigint")

    def handleInputRows(self, key, rows, timerValues):
        got = pd.concat(list(rows))
        if self.state.exists():
            saves, rounds, due = self.state.get()
        else:
            saves, rounds, due = 0, 0, int(got["first"].min()) + 1000 * self.seconds
            self.handle.registerTimer(due)
        after = saves + int(got["n"].sum())
        self.state.update((after, rounds, due))
        fired = range(saves // self.every + 1, after // self.every + 1)
        if len(fired):
            yield pd.DataFrame({"reason": "saves", "k": fired})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        saves, rounds, due = self.state.get()
        n = max(0, timerValues.getCurrentWatermarkInMs() - due) // (1000 * self.seconds) + 1  # a watermark may go past several
        self.state.update((saves, rounds + n, due + 1000 * self.seconds * n))
        self.handle.registerTimer(due + 1000 * self.seconds * n)
        yield pd.DataFrame({"reason": "time", "k": range(rounds + 1, rounds + n + 1)})

    def close(self) -> None:
        pass


def triggers(log: DataFrame, ts: str = "ts", every: int = SAVES, seconds: int = SECONDS, late: str = "1 minute") -> DataFrame:
    """Saves → (reason, k): the k-th time that maintenance is due by saves or by time.

    On a stream each task counts its own saves first, so the one state gets a row from each task; on a
    table the saves are counted and the times follow from the first and the last one.
    """
    if not log.isStreaming:
        span = log.agg(F.count("*").alias("n"), F.min(millis(ts)).alias("low"), F.max(millis(ts)).alias("high"))
        rounds = lambda reason, n: span.select(F.lit(reason).alias("reason"), n.cast("bigint").alias("most")).where("most > 0").select("reason", F.explode(F.sequence(F.lit(1).cast("bigint"), "most")).alias("k"))
        return rounds("saves", F.floor(F.col("n") / every)).unionByName(rounds("time", F.floor((F.col("high") - F.col("low")) / (1000 * seconds))))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = 0, None, None
        for b in batches:
            if b.num_rows:
                at = b.column(0).to_numpy()
                n += len(at)
                low, high = min(at.min(), at.min() if low is None else low), max(at.max(), at.max() if high is None else high)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(["all"]), pa.array([n], pa.int64()), pa.array([low], pa.int64()), pa.array([high], pa.int64())], names=["one", "n", "first", "last"])

    each = log.select(millis(ts).alias("at")).mapInArrow(counted, "one string, n bigint, first bigint, last bigint")
    return stateful(each.withColumn("seen", F.timestamp_millis("last")), "one", Trigger(every, seconds), TRIGGERED, "seen", late)


# Judgments that stand for a while.

ANSWERED = "key string, seq bigint, verdict double, hit boolean, hits bigint"


class Judged(StatefulProcessor):
    """A verdict by key, which answers questions until it is `ttl` old; then it leaves the state."""

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def init(self, handle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "verdict double, made bigint, hits bigint")

    def handleInputRows(self, key, rows, timerValues):
        entry = self.entry.get() if self.entry.exists() else None
        before = entry[1] if entry else None
        asked = []
        for r in _sorted(rows, ["at", "seq"]).itertuples():
            if entry and r.at >= entry[1] + self.ttl:
                entry = None
            if r.put:
                entry = (float(r.verdict), int(r.at), entry[2] if entry else 0)
            else:
                entry = (entry[0], entry[1], entry[2] + 1) if entry else None
                asked.append((key[0], int(r.seq), entry[0] if entry else None, entry is not None, entry[2] if entry else 0))
        if before is not None and (entry is None or entry[1] != before):
            self.handle.deleteTimer(before + self.ttl)
        if entry is None:
            self.entry.clear()
        else:
            self.entry.update(entry)
            if entry[1] != before:
                self.handle.registerTimer(entry[1] + self.ttl)
        if asked:
            yield pd.DataFrame(asked, columns=["key", "seq", "verdict", "hit", "hits"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.entry.exists() and self.entry.get()[1] + self.ttl <= expiredTimerInfo.getExpiryTimeInMs():
            self.entry.clear()
        yield pd.DataFrame({"key": [], "seq": [], "verdict": [], "hit": [], "hits": []}).astype({"key": str, "seq": "int64", "verdict": float, "hit": bool, "hits": "int64"})

    def close(self) -> None:
        pass


def answers(log: DataFrame, ts: str = "ts", ttl: int = TTL, late: str = "1 minute") -> DataFrame:
    """(key, seq, put, verdict, ts), verdicts put in and questions asked → an answer to each question: the verdict that stands, and how many questions it and its forerunners have answered.

    A verdict put in while another stands replaces it and keeps its count.  On a table, a key's log is walked by windows.
    """
    rows = log.select("key", "seq", "put", F.col("verdict").cast("double").alias("verdict"), ts)
    if rows.isStreaming:
        return stateful(rows, "key", Judged(ttl), ANSWERED, ts, late)
    w = Window.partitionBy("key").orderBy("at", "seq")
    sofar = w.rowsBetween(Window.unboundedPreceding, 0)
    made = rows.withColumn("at", millis(ts)).withColumn("last", F.last(F.when(F.col("put"), F.struct("at", "verdict")), True).over(sofar))
    stands = F.col("last").isNotNull() & (F.col("at") < F.col("last.at") + ttl)
    before = F.lag("last").over(w)
    new = F.col("put") & (before.isNull() | (F.col("at") >= before["at"] + ttl))
    walked = made.withColumn("hit", stands & ~F.col("put")).withColumn("life", F.sum(new.cast("int")).over(sofar))
    hits = F.sum(F.col("hit").cast("bigint")).over(Window.partitionBy("key", "life").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, 0))
    return walked.withColumn("hits", F.when(F.col("hit"), hits).otherwise(0)).where(~F.col("put")).select("key", "seq", F.when(F.col("hit"), F.col("last.verdict")).alias("verdict"), "hit", F.col("hits").cast("bigint").alias("hits"))


def saves_due(log: DataFrame, ts: str = "ts", seq: str = "event_id", every: int = SAVES) -> DataFrame:
    """The saves at which maintenance is due: each `every`th in order of time, (k, seq)."""
    rows = numbered(log.select(F.lit(0).alias("one"), F.col(ts).alias("ts"), F.col(seq).alias("seq")), "one", ["ts", "seq"])
    return rows.where(F.col("n") % every == 0).select((F.col("n") / every).cast("bigint").alias("k"), "seq")

"""Structured Streaming jobs; each works on a stream and, where that is the same, on a table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recallum.operators.numbering import numbered
from recallum.sources.shared import against


def access_windows(log: DataFrame, ts: str = "accessed_at", width: str = "7 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """Uses of each row in sliding windows; rows later than the watermark are dropped on a stream."""
    rows = log.withWatermark(ts, late) if log.isStreaming else log
    return rows.groupBy(F.window(ts, width, slide).alias("w"), "memory_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "memory_id", "n")


def hourly_metrics(log: DataFrame, ts: str = "created_at", late: str = "1 hour") -> DataFrame:
    """Tumbling one-hour metrics by method."""
    rows = log.withWatermark(ts, late) if log.isStreaming else log
    return rows.groupBy(F.window(ts, "1 hour").alias("w"), "method").agg(F.count("*").alias("n"), F.round(F.avg("latency_ms"), 4).alias("avg_ms"), F.max("latency_ms").alias("max_ms")).select(F.col("w.start").alias("start"), "method", "n", "avg_ms", "max_ms")


def sessions(log: DataFrame, ts: str = "accessed_at", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a user that end after `gap` without an access."""
    rows = log.withWatermark(ts, late) if log.isStreaming else log
    return rows.groupBy(F.session_window(ts, gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def alerts(rows: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Rows that contain a standing pattern; the subscription table is the bounded side.

    Of changes (with a column `event`: save, update or delete) the event is told, too; a deleted row comes with the content that it had.
    """
    told = ["event"] if "event" in rows.columns else []
    return against(rows, subscriptions, F.contains(F.lower("content"), F.lower("pattern")), "sub_id").select("sub_id", "id", *told)


def calls_before(log: DataFrame, seconds: int = 60) -> DataFrame:
    """(user_id, event_id, ts) → how many calls each user has made in the `seconds` up to each call, itself included."""
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-1_000_000 * seconds + 1, 0)
    return log.select("user_id", "event_id", F.count("*").over(w).alias("calls"))


ADMITTED = "user_id bigint, event_id bigint, at double, admitted boolean"


def _admitted(at: float, recent: list[float], most: int, width: float) -> bool:
    """Whether a call is admitted; `recent` holds the admitted ones of the window and is kept up to date."""
    while recent and recent[0] <= at - width:
        recent.pop(0)
    if len(recent) < most:
        recent.append(at)
        return True
    return False


def _admit(rows: pd.DataFrame, recent: list[float], most: int, width: float) -> tuple[pd.DataFrame, list[float]]:
    rows = rows.sort_values(["at", "event_id"])
    rows["admitted"] = [_admitted(at, recent, most, width) for at in rows["at"]]
    return rows[["user_id", "event_id", "at", "admitted"]], recent


def admit(log: DataFrame, most: int = 3, width: float = 3600.0, late: str = "1 hour") -> DataFrame:
    """(user_id, event_id, ts) → whether each call is admitted: at most `most` admitted ones in the `width` seconds up to it.

    The state of a user is the times of calls admitted in the last `width`
    seconds, so at most `most` numbers.  On a table a user's calls stream by in
    order of time, so there too only these are held.
    """
    rows = log.withColumn("at", F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast(log.schema["ts"].dataType), F.col("ts")) / 1e6)
    if not log.isStreaming:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, recent = None, []
            for b in batches:
                ok = []
                for user, at in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                    if (user,) != now:
                        now, recent = (user,), []
                    ok.append(_admitted(at, recent, most, width))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ok, pa.bool_())], names=["user_id", "event_id", "at", "admitted"])

        dealt = rows.select("user_id", "event_id", "at").repartition("user_id").sortWithinPartitions("user_id", "at", "event_id")
        return dealt.mapInArrow(run, ADMITTED)

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        out, recent = _admit(pd.concat(list(pdfs)), list(state.get[0]) if state.exists else [], most, width)
        state.update((recent,))
        state.setTimeoutTimestamp(int((max(out["at"]) + width) * 1000) + 1)
        yield out

    return rows.withWatermark("ts", late).select("user_id", "event_id", "at", "ts").groupBy("user_id").applyInPandasWithState(step, ADMITTED, "recent array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def session_rollup(records: DataFrame, every: int = 20, heads: int = 200) -> DataFrame:
    """(session_id, seq, text) → a row for each full `every` records of a session: their count and the digest of their heads in order.

    Records are numbered by session and grouped by block, so a group has `every` rows however long the session is.
    """
    rows = numbered(records.withColumn("text", F.substring("text", 1, heads)), "session_id", ["seq"]).withColumn("block", F.floor((F.col("n") - 1) / every))
    g = rows.groupBy("session_id", "block").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("n", F.substring("text", 1, heads).alias("h")))).alias("hs"))
    return g.where(F.col("n") == every).select("session_id", "block", "n", F.md5(F.array_join(F.transform("hs", lambda x: x["h"]), "|")).alias("digest"))


def latest(stream: DataFrame, ts: str, late: str = "1 day") -> DataFrame:
    """The newest content of each id by event time: writes that come late never replace newer ones."""
    rows = stream.withWatermark(ts, late) if stream.isStreaming else stream
    return rows.groupBy("id").agg(F.max_by("content", ts).alias("content"), F.max(ts).alias(ts))


def judgments(log: DataFrame, ts: str = "created_at") -> DataFrame:
    """(key, verdict, ts) → the newest verdict of each key, when it was made, and how often it was asked for; an upsert on a stream."""
    return log.groupBy("key").agg(F.max_by("verdict", ts).alias("verdict"), F.max(ts).alias(ts), F.count("*").alias("hits"))


def index_files(stream: DataFrame, target: str, checkpoint: str, spark: SparkSession):
    """(path, hash, content, modified) listings as a stream → the code chunks of new and changed files, a folder for each batch.

    Of a path's states in one batch the last by modification counts.  A batch that is run again replaces itself; `indexed` reads the state.
    """
    from recallum.functions.text import code_chunks
    from recallum.sources.files import language_of

    def write(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("path").agg(F.max_by(F.struct("hash", "content"), F.struct("modified", "hash")).alias("f")).select("path", "f.hash", "f.content")
        known = manifest(spark, target, number)
        fresh = newest.join(known.select("path", F.col("hash").alias("was")), "path", "left").where(~F.col("hash").eqNullSafe(F.col("was")))
        chunks = code_chunks(fresh, "path", "content", language_of(F.col("path"))).withColumnRenamed("id", "path")
        fresh.select("path", "hash").join(chunks, "path", "left").withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/n={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


INDEXED = "path string, hash string, chunk_index int, line_start int, line_end int, content string, digest string, batch int"


def indexed(spark: SparkSession, target: str, before: int | None = None) -> DataFrame:
    """The chunks of each file as its last indexed state has them (of batches before a number)."""
    try:
        rows = spark.read.schema(INDEXED).parquet(f"{target}/n=*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], INDEXED)  # nothing has been indexed yet
    rows = rows if before is None else rows.where(F.col("batch") < before)
    last = rows.groupBy("path").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["path", "batch"], "left_semi")


def manifest(spark: SparkSession, target: str, before: int | None = None) -> DataFrame:
    """(path, hash) of all files as they are indexed."""
    return indexed(spark, target, before).select("path", "hash").distinct()


def ingest(stream: DataFrame, target: str, checkpoint: str, spark: SparkSession):
    """Append new rows with signature, tags and screening; a batch that is run again replaces itself."""
    from recallum.functions import rules as R

    def write(batch: DataFrame, number: int) -> None:
        done = batch.select("id", "content", F.md5(F.substring("content", 1, 28000)).alias("signature"), R.tags(F.col("content")).alias("tags"), R.screened(F.col("content")).alias("rule"))
        done.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

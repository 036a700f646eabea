"""Audit of new rows against the table: vectors, nearest rows, verdicts, links, tags and screening, a batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from recallum.functions import rules
from recallum.operators import intake, knn
from recallum.plans.versions import signature
from recallum.sources.shared import cut

AUDITED = "id bigint, signature string, tags array<string>, rule int, neighbour bigint, similarity double, rel string, batch bigint"


def audit(rows: DataFrame, table: DataFrame, verdicts: DataFrame | Callable[[DataFrame], DataFrame], k: int = 3, related: float = 0.6, same: float = 0.92) -> DataFrame:
    """New rows (id, content), the indexed table (id, embedding) and verdicts (id, neighbour, veto) → a row for each new row and link.

    A row's k nearest of cosine `related` or more are its links: `similar` from `same` on, else `related`; none to itself, and none that
    a verdict vetoes.  A row without links has one row, with a null neighbour.  `rule` is the screening rule that its text meets.
    Verdicts that are many are given as a function of the links (id, neighbour), which returns those on them.
    """
    own = rows.dropDuplicates(["id"])
    vectors = cut(intake.embed(own, "id", "content").withColumnRenamed("id", "qid"))
    near = cut(knn.knn(vectors, table, k, lo=related - 1e-6, other=True).where(F.col("similarity") >= related))
    said = verdicts(near.select(F.col("qid").alias("id"), F.col("id").alias("neighbour"))) if callable(verdicts) else verdicts
    no = said.where("veto").select(F.col("id").alias("qid"), F.col("neighbour").alias("id"))
    links = near.join(no, ["qid", "id"], "left_anti").select(F.col("qid").alias("id"), F.col("id").alias("neighbour"), "similarity", F.when(F.col("similarity") >= same, "similar").otherwise("related").alias("rel"))
    seen = own.select("id", signature().alias("signature"), rules.tags(F.col("content")).alias("tags"), rules.screened(F.col("content")).cast("int").alias("rule"))
    return seen.join(links, "id", "left").select("id", "signature", "tags", "rule", "neighbour", "similarity", "rel")


def auditing(stream: DataFrame, table: DataFrame, verdicts: DataFrame | Callable[[DataFrame], DataFrame], target: str, checkpoint: str, **options: float) -> StreamingQuery:
    """Audit every micro-batch of a stream of new rows; a batch that is run again replaces itself, so its state is there once."""

    def write(batch: DataFrame, number: int) -> None:
        audit(batch.select("id", "content"), table, verdicts, **options).withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{target}/n={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def audited(spark: SparkSession, target: str) -> DataFrame:
    """The newest audit of each row; empty where none has been made."""
    try:
        rows = spark.read.schema(AUDITED).parquet(f"{target}/n=*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], AUDITED)
    last = rows.groupBy("id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["id", "batch"], "left_semi")

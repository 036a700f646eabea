"""Numbers of rows within groups of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from recallum.sources.shared import cut, hinted


def numbered(df: DataFrame, by: str, order: list[str], name: str = "n") -> DataFrame:
    """`df` with each row's number within its group, from 1, in order.

    Rows are dealt by ranges of (group, order), so a group may span many tasks;
    each task counts its own rows, and what earlier tasks have of a group is added.
    `order` must tell rows of a group apart.
    """
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "__part int", "__at bigint"])
    names = [*df.columns, "__part", "__at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, count = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column(b.schema.names.index(by))
            code = pc.fill_null(key.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
            start = np.concatenate(([True], code[1:] != code[:-1]))
            first = np.maximum.accumulate(np.where(start, np.arange(len(code)), 0))
            at = np.arange(len(code)) - first + 1
            value = (key[0].as_py(),)
            if value == last:
                at[: int(np.flatnonzero(start)[1]) if start.sum() > 1 else len(at)] += count
            last, count = (key[len(key) - 1].as_py(),), int(at[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(at.astype(np.int64))], names=names)

    done = cut(df.repartitionByRange(by, *order).sortWithinPartitions(by, *order).mapInArrow(run, schema))
    # One row for each task and group that meet: about as many as groups and tasks together.
    counts = done.groupBy("__part", F.col(by).alias("__by")).agg(F.max("__at").alias("c"))
    before = F.sum("c").over(Window.partitionBy("__by").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offset = hinted(cut(counts.select(F.col("__part").alias("__p"), "__by", F.coalesce(before, F.lit(0)).alias("__before"))))
    joined = done.join(offset, (F.col("__part") == F.col("__p")) & F.col(by).eqNullSafe(F.col("__by")))
    return joined.select(*df.columns, (F.col("__at") + F.col("__before")).alias(name))

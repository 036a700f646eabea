"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the expected number of copies of each of its
documents.  Its whole part is taken; the rest, a fraction, is rounded dependently: two documents' fractions
are paired and words are moved at random from one to the other until one of the two is taken whole or not at
all, with the chances that leave both expectations as they are.  The other one goes on to the next pair.  What
moves is words, so the words taken stay at the target, whatever the lengths.

Documents of a source are numbered by falling size and dealt in turn to groups of `GROUP`, so each
group spans all sizes and no source sits in one task.  A group leaves one document with a fraction; these
residuals meet in groups of `GROUP` again, level by level, until a source has one left.  Of that one document the
mix takes the first words, as many as its fraction says, so a source misses its target by less than a word or two at any size.

Defined results: a null text has no words and is taken zero times; a null source is a source like any other,
the last; an empty string is a source, too; a repeated row counts and is taken by itself; other columns are
ignored; sources without words have target zero; an empty table gives no rows.  The random numbers depend on `seed` and on
the table's rows alone, not on their order or partitions, so reruns agree; rows that share id,
size, source and text hash may swap their copies.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from random import Random

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from recallum.operators.numbering import numbered
from recallum.sources.shared import cut, hinted

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
#: Documents paired in one group.
GROUP = 1024
#: Parts of a word in which fractions are counted, so that no word is lost to rounding errors.
UNIT = 1 << 20


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, ...) → the same rows with `rank` (from 1, by code point, null last) and `target`.

    All targets stop at `most` times the source's size and share `share` times all sizes
    by weight: each is the smaller of that stop and of one level times its weight.  The level rises
    until what the stops leave over is dealt; every round is one aggregate.
    """
    ranked = numbered(sizes.withColumn("all", F.lit(0)).withColumn("last", F.col("source").isNull()), "all", ["last", "source"], "rank").drop("all", "last")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = cut(ranked.withColumn("weight", weight).withColumn("stop", F.col("source_size") * F.lit(float(most))))
    budget = share * (rows.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = 0.0, -1
    while True:
        full = F.col("stop") <= F.lit(level) * F.col("weight")
        n, held, free = rows.agg(F.count(F.when(full, 1)), F.coalesce(F.sum(F.when(full, F.col("stop"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if n == stopped or not free:
            break
        level, stopped = max(level, (budget - held) / free), n
    return rows.withColumn("target", F.least(F.col("stop"), F.lit(level) * F.col("weight")).cast("double")).drop("stop")


def paired(full: list[int], mass: list[int], draw: Random) -> tuple[list[int], int]:
    """Round `mass` of `full`, pair after pair → (1 for each taken, index of the one that keeps a fraction or -1); its mass is in `mass`."""
    taken, held = [0] * len(full), -1
    for j, m in enumerate(mass):
        if not m:
            continue
        if held < 0:
            held = j
            continue
        up, down = min(full[held] - mass[held], m), min(mass[held], full[j] - m)
        move = up if draw.randrange(up + down) < down else -down
        mass[held] += move
        mass[j] -= move
        one, other = (held, j) if mass[held] in (0, full[held]) else (j, held)
        taken[one] = int(mass[one] == full[one])
        if mass[other] in (0, full[other]):
            taken[other], other = int(mass[other] == full[other]), -1
        held = other
    return taken, held


def copies(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 42, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """`docs` → a row for each: (id, key, source, size, source_size, target, copies, part, taken), `key` a hash of the text.

    The mix takes `copies` whole copies and, of one document a source, the first `part` words once more: `taken` words in all.
    """
    rows = cut(docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size")))
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    per = cut(targets(sums, weights, share, most).withColumn("groups", F.ceil(F.col("rows") / group)))
    groups = per.agg(F.max("groups")).first()[0] or 1

    of = hinted(per.select(F.col("source").alias("__source"), "rank", "groups", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("ratio")))
    fraction = F.col("ratio") - F.floor("ratio")
    known = rows.join(of, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    known = known.select("id", "key", "rank", "size", "groups", F.floor("ratio").alias("whole"), F.floor(fraction * F.col("size") * F.lit(UNIT)).alias("mass"), (-F.col("size")).alias("falling"))
    dealt = numbered(known, "rank", ["falling", "id", "key"], "n").select("id", "key", "rank", "size", "whole", "mass", "n", F.pmod("n", "groups").alias("group"), F.lit(0).cast("bigint").alias("part"))

    schema = f"id {rows.schema['id'].dataType.simpleString()}, key bigint, rank bigint, size bigint, whole bigint, mass bigint, n bigint, group bigint, part bigint"

    def rounding(level: int, last: bool):
        def run(t: pa.Table) -> pa.Table:
            t = t.sort_by([("size", "descending"), ("n", "ascending")])
            draw = Random(f"{seed}/{level}/{t['rank'][0]}/{t['group'][0]}")
            full, mass = [s * UNIT for s in t["size"].to_pylist()], t["mass"].to_pylist()
            taken, held = paired(full, mass, draw)
            left, part = [0] * len(full), [0] * len(full)
            if held >= 0 and last:
                part[held] = (mass[held] + UNIT // 2) // UNIT
            elif held >= 0:
                left[held] = mass[held]
            whole = pa.array([w + x for w, x in zip(t["whole"].to_pylist(), taken, strict=True)], pa.int64())
            done = t.set_column(t.schema.get_field_index("whole"), "whole", whole).set_column(t.schema.get_field_index("mass"), "mass", pa.array(left, pa.int64()))
            return done.set_column(t.schema.get_field_index("part"), "part", pa.array(part, pa.int64()))

        return run

    settled: list[DataFrame] = []
    level = 0
    while True:
        done = cut(dealt.groupBy("rank", "group").applyInArrow(rounding(level, groups == 1), schema))
        settled.append(done.where("mass = 0"))
        if groups == 1:
            break
        groups, level = -(-groups // group), level + 1
        dealt = done.where("mass > 0").withColumn("group", F.floor(F.col("group") / group))
    found = reduce(DataFrame.unionByName, settled).select("id", "key", F.col("rank").alias("__rank"), "size", F.col("whole").alias("copies"), "part")
    names = hinted(per.select("rank", "source", "source_size", "target"))
    return found.join(names, F.col("__rank") == F.col("rank")).select("id", "key", "source", "size", "source_size", "target", "copies", "part", (F.col("copies") * F.col("size") + F.col("part")).alias("taken"))


def mixture(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mixed corpus: every row of `docs` as many times as `copies` says, and once more with the first `part` words; of rows that repeat id and text one stands for all."""
    taken = plan.groupBy(F.col("id").alias("__id"), F.col("key").alias("__key")).agg(F.sum("copies").alias("__copies"), F.max("part").alias("__part"), F.count("*").alias("__rows"))
    one = docs if taken.where("__rows > 1").isEmpty() else docs.dropDuplicates([id_col, text_col])
    joined = one.join(taken, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__key"))).where("__copies > 0 or __part > 0")
    each = joined.withColumn("__n", F.explode(F.sequence(F.when(F.col("__part") > 0, 0).otherwise(1), F.col("__copies").cast("int"))))
    first = F.array_join(F.slice(F.regexp_extract_all(text_col, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), 1, F.col("__part").cast("int")), "")
    return each.withColumn(text_col, F.when(F.col("__n") == 0, first).otherwise(F.col(text_col))).drop("__id", "__key", "__copies", "__part", "__rows", "__n")

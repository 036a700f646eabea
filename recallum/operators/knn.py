"""Nearest neighbours by cosine: exact in blocks for a query table, and through an inverted-file index.

The vectors of a query table go to the executors in blocks of counted size, every
Arrow batch of the corpus is multiplied by a block at once, and only each batch's
best rows leave it.  Links among all rows of a table are found by random
hyperplanes instead, in buckets that are split while they are large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from recallum.operators.components import connected_components, forest
from recallum.sources.shared import cut, hinted, query_blocks

SCORED = "qid bigint, id bigint, similarity double"


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


#: What sums in single precision may be off by, and more than places that are rounded away.
SLACK = 2e-5


class Best:
    """Of the rows that a task has seen, each query's k nearest and all within SLACK of the last of them; what can no longer be one is dropped."""

    def __init__(self, queries: np.ndarray, k: int, lo: float, hi: float) -> None:
        self.q, self.k, self.lo, self.hi = queries, k, lo, hi
        self.small = queries.astype(np.float32)
        self.top = np.full((len(queries), k), -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def look(self, at: np.ndarray, x: np.ndarray, own: np.ndarray) -> None:
        """Compare the queries at places `at` with the unit vectors x of the ids `own`: all in single precision, and what may be near once more."""
        s = self.small[at] @ x.T.astype(np.float32)
        least = np.maximum(self.top[at, 0], self.lo)
        first = s[:, :512]
        if s.shape[1] > 512 >= self.k and (self.top[at, 0] == -np.inf).any():
            first = np.where(first <= self.hi - SLACK, first, -np.inf)
            least = np.maximum(least, np.partition(first, -self.k, axis=1)[:, -self.k])
        keep = s >= (least - SLACK).astype(np.float32)[:, None]
        i, j = np.divmod(np.flatnonzero(keep), s.shape[1])
        if self.hi < 1:
            under = s[i, j] <= self.hi + SLACK
            i, j = i[under], j[under]
        i = at[i]
        for a in range(0, len(i), 1 << 16):
            self.add(i[a : a + (1 << 16)], own[j[a : a + (1 << 16)]], (self.q[i[a : a + (1 << 16)]] * x[j[a : a + (1 << 16)]]).sum(1))

    def add(self, i: np.ndarray, own: np.ndarray, s: np.ndarray) -> None:
        good = (s >= self.lo) & (s <= self.hi)
        i, own, s = i[good], own[good], s[good]
        order = np.lexsort((-s, i))
        i, own, s = i[order], own[order], s[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        some = place < self.k
        rows, to = np.unique(i[some], return_inverse=True)
        new = np.full((len(rows), self.k), -np.inf)
        new[to, place[some]] = s[some]
        self.top[rows] = np.sort(np.concatenate((self.top[rows], new), 1), 1)[:, -self.k :]
        self.held.append((i, own, s))
        if sum(len(h[0]) for h in self.held) > max(1 << 20, 4 * self.top.size):
            self.held = [self.found()]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, id, similarity) of what is left."""
        i, own, s = (np.concatenate([h[c] for h in self.held]) for c in range(3)) if self.held else (np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0))
        good = s >= self.top[i, 0] - SLACK
        return i[good], own[good], s[good]


def similarities(queries: DataFrame, corpus: DataFrame, lo: float = -2.0, hi: float = 2.0, k: int | None = None, block: int = 1024, several: bool = False) -> DataFrame:
    """(qid, id, similarity) with lo <= similarity <= hi; with k, at least each query's best k survive (see `knn`), of each task once.

    Vectors that are null, or of norm 0, are not compared.  With `several` vectors
    a row (an id's chunks), only an id's best one of a batch counts.  The query table goes out in blocks of counted size, each of which reads the corpus once.
    """
    rows, sc, out = corpus.select("id", "embedding").where("embedding IS NOT NULL"), queries.sparkSession.sparkContext, None
    for got in query_blocks(queries.select("qid", "embedding").where("embedding IS NOT NULL"), ["qid", "embedding"], 1 << 16):
        sent = sc.broadcast((got["qid"].to_numpy(), _unit(_matrix(got["embedding"].combine_chunks()))))

        def run(batches: Iterator[pa.RecordBatch], sent: object = sent) -> Iterator[pa.RecordBatch]:
            qid, q = sent.value
            as_rows = lambda i, own, s: pa.RecordBatch.from_arrays([pa.array(qid[i]), pa.array(own), pa.array(s)], names=["qid", "id", "similarity"])
            best = Best(q, k, lo, hi) if k is not None else None
            for b in batches:
                x = _unit(_matrix(b.column(1)))
                own, starts = b.column(0).to_numpy(zero_copy_only=False), None
                if several and len(own):
                    order = np.argsort(own, kind="stable")
                    x, own = x[order], own[order]
                    starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                    own = own[starts]
                for at in range(0, len(qid) if len(x) else 0, block):
                    if best is not None and starts is None:
                        best.look(np.arange(at, min(at + block, len(qid))), x, own)
                        continue
                    s = q[at : at + block] @ x.T
                    if starts is not None:
                        s = np.maximum.reduceat(s, starts, axis=1)
                    keep = (s >= lo) & (s <= hi)
                    if best is not None and s.shape[1] > k:
                        masked = np.where(keep, s, -np.inf)
                        keep &= masked >= np.partition(masked, -k, axis=1)[:, -k][:, None] - SLACK  # ties stay for the exact order
                    i, j = np.nonzero(keep)
                    if best is None:
                        yield as_rows(i + at, own[j], s[i, j])
                    else:
                        best.add(i + at, own[j], s[i, j])
            if best is not None:
                yield as_rows(*best.found())

        part = rows.mapInArrow(run, SCORED)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else rows.limit(0).mapInArrow(lambda batches: iter(()), SCORED)


def knn(queries: DataFrame, corpus: DataFrame, k: int, lo: float = -2.0, hi: float = 2.0, other: bool = False, places: int = 6) -> DataFrame:
    """The k nearest rows of each query by rounded similarity, then id; `other` leaves out a row's own id."""
    near = similarities(queries, corpus, lo, hi, k + 1 if other else k).withColumn("similarity", F.round("similarity", places))
    near = near.where("qid <> id") if other else near
    order = Window.partitionBy("qid").orderBy(F.desc("similarity"), "id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def knn_of_several(queries: DataFrame, children: DataFrame, k: int, places: int = 6) -> DataFrame:
    """(qid, embedding) and vectors of chunks (id of the row, embedding) → the k rows of each query whose best chunk is nearest."""
    near = similarities(queries, children, k=k, several=True).groupBy("qid", "id").agg(F.round(F.max("similarity"), places).alias("similarity"))
    order = Window.partitionBy("qid").orderBy(F.desc("similarity"), "id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Share of the pairs at the threshold that bands find, rows of a bucket from which it is split, cosine from which vectors of one sketch are one, and rows of a bucket that are compared with all others.
RECALL, CROWDED, SAME, HELD = 0.99, 4096, 0.9999, 8192
#: Hyperplanes of a sketch.
SKETCH = 256


def bands_for(bits: int, least: float, recall: float = RECALL) -> int:
    """How many sets of `bits` hyperplanes it takes for two vectors of cosine `least` to agree on a whole set with probability `recall`."""
    agree = (1 - np.arccos(min(1.0, least)) / np.pi) ** bits
    return 1 if agree >= recall else int(np.ceil(np.log(1 - recall) / np.log(1 - agree)))


def _spanned(x: np.ndarray, least: float) -> np.ndarray:
    """The smallest row that each row of unit vectors reaches over cosines of `least` or more."""
    root = np.arange(len(x))
    for a in range(0, len(x), 1024):
        i, j = np.nonzero(x[a : a + 1024] @ x.T >= least - 1e-12)
        later = j > i + a
        root = forest(root, i[later] + a, j[later])
    return root


def near_links(corpus: DataFrame, least: float, recall: float = RECALL, bits: int | None = None, crowded: int = CROWDED, held: int = HELD) -> DataFrame:
    """(id, embedding) of different vectors → links (src, dst) that join those of cosine `least` or more; verified exactly.

    Vectors with the same sketch (the sides of `SKETCH` random hyperplanes) and a cosine of `SAME` or more to the one
    of the smallest id are linked to it and stand behind it from there on, however many they are.  What then may be missed
    are links of such a vector within 0.01 of `least` that its representative hasn't.

    The rest are hashed by bands of `bits` hyperplanes each (by the table's size); those that agree on a whole band meet
    in a bucket, where a spanning forest of the pairs near enough is made.  There are as many bands as find a
    pair of cosine `least` with probability `recall`: 19 at 10 hyperplanes and cosine 0.9, 139 at 22.  A bucket above `crowded` rows
    is dealt once more, by several sets of 8 or 16 of the sketch's hyperplanes.  In a bucket that is still larger than `held`,
    each next `held` rows are compared with each other and with one row of each of the latest `held` trees.
    """
    rows = corpus.select("id", "embedding").where("embedding IS NOT NULL")
    kind = corpus.schema["id"].dataType.simpleString()
    width = rows.select(F.size("embedding").alias("n")).first()
    dims = width.n if width else 1
    sketching = np.random.default_rng(21).standard_normal((SKETCH, dims))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(a, 4096) for whole in batches for a in range(0, whole.num_rows, 4096)):
            x = _unit(_matrix(b.column(1)))
            sides = np.packbits(x @ sketching.T > 0, axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.tobytes() for v in x], pa.binary()), pa.array([v.tobytes() for v in sides], pa.binary())], names=["id", "v", "sketch"])

    made = cut(rows.mapInArrow(sketched, f"id {kind}, v binary, sketch binary"))
    several = made.groupBy("sketch").agg(F.min(F.struct("id", "v")).alias("first"), F.count("*").alias("n")).where("n > 1").select("sketch", F.col("first.id").alias("src"), F.col("first.v").alias("w"))

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist())).reshape(b.num_rows, -1) for c in (1, 3))
            good = pa.array((x * y).sum(1) >= max(SAME, least))
            yield pa.RecordBatch.from_arrays([b.column(2).filter(good), b.column(0).filter(good)], names=["src", "dst"])

    merged = cut(made.join(several, "sketch").where("src <> id").select("id", "v", "src", "w").mapInArrow(same, f"src {kind}, dst {kind}"))
    left = made.join(merged.select(F.col("dst").alias("id")), "id", "left_anti")
    left = left if merged.isEmpty() else cut(left)

    n = left.count()
    bits = bits or int(min(30, max(4, (n // 512).bit_length())))
    bands = bands_for(bits, least, recall)

    def spread(batches: Iterator[pa.RecordBatch], whole: bool = True) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.frombuffer(b"".join(b.column(1).to_pylist())).reshape(b.num_rows, -1)
            for band in range(bands):  # a band's hyperplanes are made anew from its number
                side = (x @ np.random.default_rng((20, band)).standard_normal((bits, dims)).T > 0).astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))
                bucket = pa.array(band << 40 | side)
                yield pa.RecordBatch.from_arrays([bucket, *b.columns] if whole else [bucket], names=["bucket", "id", "v", "sketch"] if whole else ["bucket"])

    sent = left.mapInArrow(spread, f"bucket bigint, id {kind}, v binary, sketch binary")
    sizes = left.mapInArrow(lambda batches: spread(batches, False), "bucket bigint").groupBy("bucket").count().where(F.col("count") > crowded)
    deep = F.when(F.col("count") / crowded <= 64, 1).otherwise(2)
    sets = F.when(deep == 1, min(SKETCH // 8, bands_for(8, least, 0.95))).otherwise(min(SKETCH // 16, bands_for(16, least, 0.95)))
    dealt = sent.join(hinted(cut(sizes.select("bucket", deep.alias("deep"), sets.alias("sets")))), "bucket", "left")
    dealt = dealt.withColumn("set", F.explode(F.sequence(F.lit(1), F.coalesce("sets", F.lit(1)))))
    split = dealt.withColumn("part", F.when(F.col("deep").isNotNull(), F.expr("substring(sketch, 1 + (set - 1) * deep, deep)"))).select("bucket", "set", "part", "id", "v")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        like = None

        def solve(ids: list, vectors: list[bytes]) -> tuple[pa.RecordBatch, list, list[bytes]]:
            root = _spanned(np.frombuffer(b"".join(vectors)).reshape(len(ids), -1), least)
            own = root == np.arange(len(root))
            linked, roots = np.flatnonzero(~own), np.flatnonzero(own)
            found = pa.RecordBatch.from_arrays([pa.array([ids[k] for k in root[linked]], like), pa.array([ids[k] for k in linked], like)], names=["src", "dst"])
            return found, [ids[k] for k in roots], [vectors[k] for k in roots]

        now, ids, vectors, most = None, [], [], held
        for b in batches:
            like = b.column(3).type
            for *key, i, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != now:
                    if len(ids) > 1:
                        yield solve(ids, vectors)[0]
                    now, ids, vectors, most = key, [], [], held
                elif len(ids) >= most:
                    found, ids, vectors = solve(ids, vectors)
                    ids, vectors = ids[-held:], vectors[-held:]
                    most = len(ids) + held
                    yield found
                ids.append(i)
                vectors.append(v)
        if len(ids) > 1:
            yield solve(ids, vectors)[0]

    links = split.repartition("bucket", "set", "part").sortWithinPartitions("bucket", "set", "part", "id").mapInArrow(meet, f"src {kind}, dst {kind}")
    return links.unionByName(merged).distinct()


def near_classes(corpus: DataFrame, least: float, recall: float = RECALL) -> DataFrame:
    """(id, embedding) → (id, component): the smallest id that each row reaches over links of cosine `least` or more; rows without a vector are alone."""
    rows = corpus.select("id", "embedding")
    # Equal vectors are one from here on.
    own = cut(rows.where("embedding IS NOT NULL").groupBy("embedding").agg(F.min("id").alias("id")))
    comp = connected_components(near_links(own, least, recall))
    of = own.join(comp.withColumnRenamed("node", "id"), "id", "left").select("embedding", F.coalesce("component", "id").alias("component"))
    return rows.join(of, "embedding", "left").select("id", F.coalesce("component", "id").alias("component"))


class Cells:
    """An inverted-file index: unit centroids fitted on a bounded sample; every row is put in its nearest cell."""

    def __init__(self, cells: int | None = None, sample: int = 20_000, rounds: int = 10) -> None:
        self.cells, self.sample, self.rounds = cells, sample, rounds  # by default the square root of the number of rows
        self.centroids = np.zeros((0, 1))

    def fit(self, corpus: DataFrame) -> Cells:
        rows = corpus.select("id", "embedding").where("embedding IS NOT NULL")
        n = rows.count()
        some = rows.where(F.pmod(F.xxhash64("id"), F.lit(max(1, n))) < self.sample).orderBy(F.xxhash64("id"), "id").limit(2 * self.sample).toArrow()
        x = _unit(_matrix(some["embedding"].combine_chunks()))
        cells = self.cells or max(1, min(4096, round(n**0.5)))
        c = x[:: max(1, len(x) // cells)][:cells]
        for _ in range(self.rounds):
            at = (x @ c.T).argmax(1)
            c = _unit(np.stack([x[at == k].sum(0) if (at == k).any() else c[k] for k in range(len(c))]))
        self.centroids = c
        return self

    def _nearest(self, df: DataFrame, id_name: str, n: int) -> DataFrame:
        c = self.centroids

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _unit(_matrix(b.column(1)))
                s = x @ c.T if len(x) else np.zeros((0, len(c)))
                best = s.argmax(1)[:, None] if n == 1 and s.size else np.argsort(-s, axis=1, kind="stable")[:, :n]
                at = np.repeat(np.arange(b.num_rows), best.shape[1])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(best.ravel().astype(np.int32))], names=[id_name, "embedding", "cell"])

        return df.select(id_name, "embedding").where("embedding IS NOT NULL").mapInArrow(run, f"{id_name} bigint, embedding array<double>, cell int")

    def index(self, corpus: DataFrame) -> DataFrame:
        return self._nearest(corpus, "id", 1)

    def probes(self, queries: DataFrame, corpus: DataFrame, indexed: DataFrame, k: int, least: float = 0.95, sample: int = 200) -> int:
        """How many cells a query has to look into to find a share `least` of its k nearest rows, measured exactly on a bounded sample of queries."""
        some = queries.select("qid", "embedding").where("embedding IS NOT NULL").orderBy(F.xxhash64("qid"), "qid").limit(sample)
        at = knn(some, corpus, k).select("qid", "id").join(indexed.select("id", "cell"), "id").toArrow()  # sample * k rows
        got = some.toArrow()
        if not at.num_rows:
            return 1
        order = np.argsort(-(_unit(_matrix(got["embedding"].combine_chunks())) @ self.centroids.T), axis=1, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :].repeat(len(order), 0), 1)
        row = {q: i for i, q in enumerate(got["qid"].to_pylist())}
        need = place[[row[q] for q in at["qid"].to_pylist()], at["cell"].to_numpy()]
        return int(np.quantile(need, least, method="higher")) + 1

    def search(self, queries: DataFrame, indexed: DataFrame, k: int, probes: int, places: int = 6) -> DataFrame:
        """Each query looks into its `probes` nearest cells, scored exactly: the rows of a cell meet all queries that probe it as one product of matrices.

        Queries go out in blocks of counted size with their cells, so a vector is not sent once for each cell that is probed.
        """
        c, sc, out = self.centroids, queries.sparkSession.sparkContext, None
        for got in query_blocks(queries.select("qid", "embedding").where("embedding IS NOT NULL"), ["qid", "embedding"]):
            sent = sc.broadcast((got["qid"].to_numpy(), _unit(_matrix(got["embedding"].combine_chunks()))))

            def run(batches: Iterator[pa.RecordBatch], sent: object = sent) -> Iterator[pa.RecordBatch]:
                qid, q = sent.value
                best, probed = Best(q, k, -2.0, 2.0), np.zeros((len(c), len(qid)), bool)
                near = np.argsort(-(q @ c.T), axis=1, kind="stable")[:, :probes]
                probed[near.ravel(), np.repeat(np.arange(len(qid)), near.shape[1])] = True
                for b in batches:
                    x, own, cell = _unit(_matrix(b.column(1))), b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
                    order = np.argsort(cell, kind="stable")
                    for some in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1) if len(order) else []:
                        if len(at := np.flatnonzero(probed[cell[some[0]]])):
                            best.look(at, x[some], own[some])
                i, own, s = best.found()
                yield pa.RecordBatch.from_arrays([pa.array(qid[i]), pa.array(own), pa.array(s)], names=["qid", "id", "similarity"])

            part = indexed.select("id", "embedding", "cell").mapInArrow(run, SCORED)
            out = part if out is None else out.unionByName(part)
        near = out if out is not None else indexed.select("id", "embedding", "cell").limit(0).mapInArrow(lambda batches: iter(()), SCORED)
        order = Window.partitionBy("qid").orderBy(F.desc("similarity"), "id")
        return near.withColumn("similarity", F.round("similarity", places)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

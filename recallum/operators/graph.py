"""The link graph: decay, exploration, paths, validation and plans for new links."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from recallum.sources.shared import cut, shuffles_removed


def effective_weight(weight: Column, last: Column, now: Column, half_life: float = 90.0) -> Column:
    """Half of the weight after each `half_life` days without use; unchanged if never used."""
    days = F.datediff(now, last)
    return F.when(last.isNull(), weight).otherwise(F.round(weight * F.pow(F.lit(0.5), days / half_life), 4))


def decay_plan(links: DataFrame, now: Column, half_life: float = 90.0) -> DataFrame:
    """(id, before, after, action): links whose weight falls below 99 % are updated, below 0.01 deleted."""
    new = links.select("id", F.col("weight").alias("before"), effective_weight(F.col("weight"), F.col("last_accessed"), now, half_life).alias("after"))
    return new.withColumn("action", F.when(F.col("after") < 0.01, "delete").when(F.col("after") < 0.99 * F.col("before"), "update")).where("action IS NOT NULL")


def bfs(links: DataFrame, roots: DataFrame, depth: int = 5) -> DataFrame:
    """(root, node, level): nodes that each root reaches over outgoing links, with the least number of hops.

    One equi-join and one anti-join a level; lineage is cut at every level.
    """
    edges = links.select("src", "dst").distinct()
    seen = roots.select(F.col("node").alias("root"), "node").distinct().withColumn("level", F.lit(0))
    front = seen
    for level in range(1, depth + 1):
        step = front.join(edges, front.node == edges.src).select("root", F.col("dst").alias("node")).distinct()
        front = cut(step.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("level", F.lit(level)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


#: Directed links of a slice of the graph that a task holds at once, and blocks of starts that each slice goes to at most.
SLICE, BLOCKS = 1 << 22, 4


def _slot(nodes: np.ndarray, slices: int) -> np.ndarray:
    """Which slice of the graph a node's links are in."""
    if nodes.dtype.kind in "iu":
        h = nodes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ h >> np.uint64(32)) % np.uint64(slices)).astype(np.int32)
    return np.array([crc32(str(v).encode()) % slices for v in nodes.tolist()], np.int32)


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


class _Slice:
    """The links of some nodes: their neighbours as places in a sorted list, one run after another."""

    def __init__(self, rows: list[tuple[object, np.ndarray]]) -> None:
        nodes = np.array([r[0] for r in rows])
        order = np.argsort(nodes, kind="stable")
        self.nodes, size = nodes[order], np.array([len(rows[k][1]) for k in order], np.int64)
        self.ends = np.concatenate(([0], np.cumsum(size)))
        self.known, at = np.unique(np.concatenate([rows[k][1] for k in order]), return_inverse=True)
        self.at = at.astype(np.int32)
        self.mark = np.zeros(len(self.known), bool)

    def places(self, nodes: np.ndarray) -> np.ndarray:
        """Places of those nodes that are neighbours here."""
        at = np.minimum(np.searchsorted(self.known, nodes), len(self.known) - 1)
        return at[self.known[at] == nodes]

    def neighbours(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the nodes, place of the neighbour) of all links of the nodes."""
        low, high = self.ends[np.searchsorted(self.nodes, nodes)], self.ends[np.searchsorted(self.nodes, nodes, "right")]
        many = high - low
        first = np.cumsum(many) - many
        return np.repeat(np.arange(len(nodes)), many), self.at[np.repeat(low - first, many) + np.arange(many.sum())]


class Meeting:
    """Levels around starts and goals, kept as lists of nodes by slice of the graph, and where two levels touch.

    A slice of the links meets a block of starts in a task.  What a level's nodes lead to is gathered there, without a row for each
    link, and a start's level meets the levels of all its goals at once, so the last and widest level is never made.
    """

    def __init__(self, steps: DataFrame) -> None:
        self.kind = steps.schema["parent"].dataType.simpleString()
        self.slices = max(1, -(-steps.count() // SLICE))
        self.blocks = min(BLOCKS, -(-24 // self.slices))
        slices = self.slices

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                parent, node = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                at = np.flatnonzero(np.append(True, parent[1:] != parent[:-1])) if len(parent) else np.zeros(0, int)
                lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(parent)).astype(np.int32)), b.column(1))
                yield pa.RecordBatch.from_arrays([pa.array(_slot(parent[at], slices)), b.column(0).take(pa.array(at)), lists], names=["r", "node", "nodes"])

        rows = steps.select("parent", "node").repartition("parent").sortWithinPartitions("parent", "node")
        self.links = cut(rows.mapInArrow(packed, f"r int, node {self.kind}, nodes array<{self.kind}>"))

    def level(self, keys: DataFrame) -> DataFrame:
        """(key) → level 0 (key, r, nodes) of each key: itself."""
        slices = self.slices

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32)), b.column(0))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_slot(b.column(0).to_numpy(zero_copy_only=False), slices)), lists], names=["key", "r", "nodes"])

        return cut(keys.select("key").distinct().mapInArrow(run, f"key {self.kind}, r int, nodes array<{self.kind}>"))

    def _met(self, rows: DataFrame, solve: Callable, schema: str) -> DataFrame:
        """`solve(slice, key, rows)` for each key of (block, r, key, kind, goal, nodes) in each slice, whose links come first."""
        blocks = F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1)))
        none = F.lit(None).cast(self.kind)
        links = self.links.select(blocks.alias("block"), "r", none.alias("key"), F.lit(0).alias("kind"), F.col("node").alias("goal"), "nodes")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            group, held, part, key, own = None, [], None, None, []
            for b in batches:
                nodes, ends = _flat(b.column(5)), np.concatenate(([0], np.cumsum(b.column(5).value_lengths().to_numpy(zero_copy_only=False))))
                for k, (block, r, of, kind, goal) in enumerate(zip(*(b.column(c).to_pylist() for c in range(5)), strict=True)):
                    if own and ((block, r) != group or of != key):
                        yield from solve(part, key, own)
                        own = []
                    if (block, r) != group:
                        group, held, part = (block, r), [], None
                    some = nodes[ends[k] : ends[k + 1]]
                    if kind == 0:
                        held.append((goal, some))
                        continue
                    if held:
                        part, held = _Slice(held), []
                    if part is not None:  # a slice without links
                        key = of
                        own.append((kind, goal, some))
            if own:
                yield from solve(part, key, own)

        dealt = links.unionByName(rows.select("block", "r", "key", "kind", "goal", "nodes")).repartition("block", "r")
        return dealt.sortWithinPartitions("block", "r", F.asc_nulls_first("key"), "kind").mapInArrow(run, schema)

    def _block(self) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.blocks)).cast("int")

    def grown(self, level: DataFrame, seen: list[DataFrame]) -> DataFrame:
        """The next level: neighbours of a level's nodes that no level of `seen` has."""
        kind, slices = self.kind, self.slices
        schema = f"key {kind}, r int, nodes array<{kind}>"

        def by_slice(key: object, nodes: np.ndarray) -> pa.RecordBatch:
            slot = _slot(nodes, slices)
            order = np.argsort(slot, kind="stable")
            at = np.flatnonzero(np.append(True, np.diff(slot[order]) != 0))
            like = pa.array(nodes[order])
            return pa.RecordBatch.from_arrays([pa.array([key] * len(at), like.type), pa.array(slot[order][at]), pa.ListArray.from_arrays(pa.array(np.append(at, len(nodes)).astype(np.int32)), like)], names=["key", "r", "nodes"])

        def solve(part: _Slice, key: object, own: list) -> Iterator[pa.RecordBatch]:
            _, at = part.neighbours(np.concatenate([nodes for _, _, nodes in own]))
            part.mark[at] = True
            if len(found := np.flatnonzero(part.mark)):
                part.mark[found] = False
                yield by_slice(key, part.known[found])

        def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, old, new = None, [], []

            def out() -> Iterator[pa.RecordBatch]:
                fresh = np.unique(np.concatenate(new)) if new else []
                fresh = np.setdiff1d(fresh, np.concatenate(old), assume_unique=False) if old and len(fresh) else fresh
                if len(fresh):
                    like = pa.array(fresh)
                    yield pa.RecordBatch.from_arrays([pa.array([now[0]], like.type), pa.array([now[1]], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(fresh)], pa.int32()), like)], names=["key", "r", "nodes"])

            for b in batches:
                nodes, ends = _flat(b.column(2)), np.concatenate(([0], np.cumsum(b.column(2).value_lengths().to_numpy(zero_copy_only=False))))
                for k, (key, r, fresh) in enumerate(zip(*(b.column(c).to_pylist() for c in (0, 1, 3)), strict=True)):
                    if (key, r) != now:
                        yield from out()
                        now, old, new = (key, r), [], []
                    (new if fresh else old).append(nodes[ends[k] : ends[k + 1]])
            yield from out()

        rows = level.select(self._block().alias("block"), "r", "key", F.lit(1).alias("kind"), F.lit(None).cast(kind).alias("goal"), "nodes")
        found = self._met(rows, solve, schema).withColumn("fresh", F.lit(True))
        keys = level.select("key").distinct()
        for s in seen:
            found = found.unionByName(s.join(keys, "key", "left_semi").withColumn("fresh", F.lit(False)))
        with shuffles_removed(level.sparkSession):
            return cut(found.repartition("key", "r").sortWithinPartitions("key", "r").mapInArrow(merged, schema))

    def touching(self, left: DataFrame, starts: DataFrame, goals: DataFrame) -> DataFrame:
        """(src, dst) whose levels have a link between them → with the smallest end `m` at the start's level, and `b` at the goal's."""
        kind = self.kind

        def solve(part: _Slice, key: object, own: list) -> Iterator[pa.RecordBatch]:
            asked = [(goal, nodes) for k, goal, nodes in own if k == 2]
            if not asked or len(asked) == len(own):
                return
            here = part.places(np.concatenate([nodes for k, _, nodes in own if k == 1]))
            part.mark[here] = True
            b = np.concatenate([nodes for _, nodes in asked])
            goal = np.repeat(np.arange(len(asked)), [len(nodes) for _, nodes in asked])
            of, at = part.neighbours(b)
            hit = np.flatnonzero(part.mark[at])
            part.mark[here] = False
            if len(hit):
                to, ends, m = goal[of[hit]], b[of[hit]], part.known[at[hit]]
                first = lambda x: x[np.lexsort((x, to))][np.unique(np.sort(to), return_index=True)[1]]
                like = pa.array(m)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(np.unique(to)), like.type), pa.array([asked[k][0] for k in np.unique(to)], like.type), pa.array(first(m)), pa.array(first(ends))], names=["src", "dst", "m", "b"])

        block, every = self._block().alias("block"), F.explode(F.sequence(F.lit(0), F.lit(self.slices - 1)))
        near = starts.join(left.select(F.col("src").alias("key")).distinct(), "key", "left_semi").select(block, every.alias("r"), "key", F.lit(1).alias("kind"), F.lit(None).cast(kind).alias("goal"), "nodes")
        far = left.select(F.col("src").alias("key"), F.col("dst").alias("goal")).join(goals.withColumnRenamed("key", "goal"), "goal").select(block, "r", "key", F.lit(2).alias("kind"), "goal", "nodes")
        met = self._met(near.unionByName(far), solve, f"src {kind}, dst {kind}, m {kind}, b {kind}")
        with shuffles_removed(left.sparkSession):
            return cut(met.groupBy("src", "dst").agg(F.min("m").alias("m"), F.min("b").alias("b")))


def _both_ways(links: DataFrame) -> DataFrame:
    way = lambda a, b: links.select(F.col(a).alias("parent"), F.col(b).alias("node"))
    return cut(way("src", "dst").unionByName(way("dst", "src")).where("parent <> node").distinct())


def _entries(level: DataFrame) -> int:
    return level.agg(F.coalesce(F.sum(F.size("nodes")), F.lit(0))).first()[0]


def shortest_paths(links: DataFrame, pairs: DataFrame, max_hops: int = 10) -> DataFrame:
    """(src, dst) pairs → (src, dst, hops) over links in both directions; pairs without a path within `max_hops` are missing.

    Levels grow from both ends, the smaller one first, and none is made beyond those between which a link closes a path (`Meeting`);
    ends whose pairs are all settled grow no further.
    """
    goals = pairs.select("src", "dst").distinct()
    found, left = goals.where("src = dst").withColumn("hops", F.lit(0)), cut(goals.where("src <> dst"))
    graph = Meeting(_both_ways(links))
    levels = {k: [graph.level(left.select(F.col(k).alias("key")))] for k in ("src", "dst")}
    for hops in range(1, max_hops + 1):
        hit = graph.touching(left, levels["src"][-1], levels["dst"][-1])
        found = found.unionByName(hit.select("src", "dst", F.lit(hops).alias("hops")))
        left = cut(left.join(hit, ["src", "dst"], "left_anti"))
        if hops == max_hops or left.isEmpty():
            break
        live = {k: levels[k][-1].join(left.select(F.col(k).alias("key")).distinct(), "key", "left_semi") for k in levels}
        k = min(live, key=lambda k: _entries(live[k]))
        levels[k].append(graph.grown(live[k], levels[k]))
        if levels[k][-1].isEmpty():
            break  # ends that lead nowhere new have met all that they can
    return found


def paths(links: DataFrame, pairs: DataFrame, max_hops: int = 10) -> DataFrame:
    """(src, dst) pairs → (src, dst, hops, nodes, links): a shortest path over links in both directions, if there is one within `max_hops`.

    Trees grow from both ends in turn, a level each time, so none is deeper than half a path, and the last level is not made at all
    (`Meeting`); ends whose pairs are all settled grow no further.  A node hangs on its tree by the smallest link that reaches it, and a
    path goes through the smallest node in which the trees meet, so it is the same each time.  Only then
    are paths rebuilt, from the meeting node to both ends, by one join with the links a hop.
    """
    kind = links.schema["src"].dataType.simpleString()
    way = lambda a, b: links.select(F.col(a).alias("parent"), F.col(b).alias("node"), F.col("id").alias("link"))
    steps = cut(way("src", "dst").unionByName(way("dst", "src")).where("parent <> node").groupBy("parent", "node").agg(F.min("link").alias("link")))
    goals = pairs.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    known = steps.select(F.col("parent").alias("src")).distinct()
    met = goals.where("src = dst").join(known, "src", "left_semi").withColumn("node", F.col("src")).withColumn("hops", F.lit(0))
    left = cut(goals.where("src <> dst"))
    graph = Meeting(steps)
    levels = {k: [graph.level(left.select(F.col(k).alias("key")))] for k in ("src", "dst")}
    for hops in range(1, max_hops + 1):
        hit = graph.touching(left, levels["src"][-1], levels["dst"][-1]).select("src", "dst", F.col("b" if hops % 2 else "m").alias("node"), F.lit(hops).alias("hops"))
        met = met.unionByName(hit)
        left = cut(left.join(hit, ["src", "dst"], "left_anti"))
        if hops == max_hops or left.isEmpty():
            break
        k = "src" if hops % 2 else "dst"
        live = levels[k][-1].join(left.select(F.col(k).alias("key")).distinct(), "key", "left_semi")
        levels[k].append(graph.grown(live, levels[k]))
        if levels[k][-1].isEmpty():
            break  # a tree that grows no more has met all that it can
    grown = cut(met.select("src", "dst", "hops", F.col("node").alias("a"), F.col("node").alias("b"), F.array("node").alias("nodes"), F.array().cast("array<bigint>").alias("links")))
    for key, end, before in (("src", "a", True), ("dst", "b", False)):
        for depth in range((max_hops + 1) // 2, 0, -1):
            # From level `depth` of the tree to the one above, for the paths that have so many hops on this side.
            own = (F.col("hops") + 1) / 2 if before else F.col("hops") / 2
            due = grown.where(F.floor(own) >= depth)
            if len(levels[key]) < depth or due.isEmpty():
                continue
            above = levels[key][depth - 1].select(F.col("key").alias(key), F.explode("nodes").alias("parent"))
            ways = due.select("src", "dst", F.col(end).alias("node")).join(steps, "node").join(above, [key, "parent"], "left_semi")
            by = ways.groupBy("src", "dst").agg(F.min(F.struct("link", "parent")).alias("by"))
            j = grown.join(by, ["src", "dst"], "left")
            more = lambda old, new, before=before: F.when(F.col("by").isNotNull(), F.concat(F.array(new), F.col(old)) if before else F.concat(F.col(old), F.array(new))).otherwise(F.col(old))
            grown = cut(j.select("src", "dst", "hops", *[F.coalesce("by.parent", end).alias(end) if c == end else F.col(c) for c in ("a", "b")], more("nodes", "by.parent").alias("nodes"), more("links", "by.link").alias("links")))
    return grown.select("src", "dst", "hops", F.col("nodes").cast(f"array<{kind}>").alias("nodes"), "links")


def reinforced(links: DataFrame, used: DataFrame, now: Column) -> DataFrame:
    """Links with `last_accessed` and `reinforced_at` set to now where they are part of a path of `used`; each once, however many paths use it."""
    ids = used.select(F.explode("links").alias("id")).distinct().withColumn("hit", F.lit(True))
    before = F.col("reinforced_at") if "reinforced_at" in links.columns else F.lit(None).cast("timestamp")
    set_to = lambda old: F.when(F.col("hit"), now.cast("timestamp")).otherwise(old)
    return links.join(ids, "id", "left").withColumn("reinforced_at", set_to(before)).withColumn("last_accessed", set_to(F.col("last_accessed"))).drop("hit")


def explore(links: DataFrame, roots: DataFrame, depth: int = 2, most: int = 50) -> DataFrame:
    """(node) → (root, node, level, parent, link, weight): what each root reaches over its heaviest outgoing links, `most` nodes at most, itself included.

    Level by level; a root takes the nodes of the heaviest links (then the smallest link) while it has room.  Of a node's targets only the
    heaviest 2 * `most` can be taken, as `most` at best are taken already; the others don't enter the join, so a hub costs no more than that.
    """
    target = links.where("src <> dst").groupBy("src", "dst").agg(F.max(F.struct("weight", (-F.col("id")).alias("k"))).alias("b")).select("src", F.col("dst").alias("node"), F.col("b.weight").alias("weight"), (-F.col("b.k")).alias("link"))
    order = Window.partitionBy("src").orderBy(F.desc("weight"), "link")
    edges = cut(target.withColumn("r", F.row_number().over(order)).where(F.col("r") <= 2 * most).drop("r"))
    seen = roots.select(F.col("node").alias("root"), "node").distinct().withColumn("level", F.lit(0)).withColumn("parent", F.lit(None).cast(links.schema["src"].dataType)).withColumn("link", F.lit(None).cast("bigint")).withColumn("weight", F.lit(None).cast("double"))
    front = seen
    for level in range(1, depth + 1):
        room = seen.groupBy("root").agg((most - F.count("*")).alias("room"))
        step = front.select("root", F.col("node").alias("src")).join(edges, "src").groupBy("root", "node").agg(F.max(F.struct("weight", (-F.col("link")).alias("k"), F.col("src").alias("parent"))).alias("b"))
        fresh = step.join(seen.select("root", "node"), ["root", "node"], "left_anti").select("root", "node", F.lit(level).alias("level"), "b.parent", (-F.col("b.k")).alias("link"), "b.weight")
        first = Window.partitionBy("root").orderBy(F.desc("weight"), "link")
        front = cut(fresh.withColumn("r", F.row_number().over(first)).where(F.col("r") < most).join(room, "root").where("r <= room").drop("r", "room"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def overview(links: DataFrame) -> DataFrame:
    return links.agg(F.count_distinct("src").alias("sources"), F.count("*").alias("edges"), F.count_distinct("rel").alias("types"))


def degrees(links: DataFrame) -> DataFrame:
    """(node, out, in) of every node."""
    out = links.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out"))
    into = links.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in"))
    return out.join(into, "node", "full").select("node", F.coalesce("out", F.lit(0)).alias("out"), F.coalesce("in", F.lit(0)).alias("in"))


def orphans(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links with an end that no table knows, and which one: a pair of anti-joins on the ids."""
    known = nodes.select(F.col("id").alias("node")).distinct()
    no_src = links.join(known, links.src == known.node, "left_anti").select("id", F.lit("src").alias("side"))
    return no_src.union(links.join(known, links.dst == known.node, "left_anti").select("id", F.lit("dst").alias("side")))


def validate(new: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(src, dst, rel) → with a verdict: self, missing, duplicate or ok."""
    known = nodes.select(F.col("id").alias("node")).distinct()
    a = new.join(known.withColumn("s", F.lit(True)), new.src == F.col("node"), "left").drop("node")
    b = a.join(known.withColumn("t", F.lit(True)), a.dst == F.col("node"), "left").drop("node")
    c = b.join(links.select("src", "dst", "rel").distinct().withColumn("dup", F.lit(True)), ["src", "dst", "rel"], "left")
    return c.withColumn("verdict", F.when(F.col("src") == F.col("dst"), "self").when(F.col("s").isNull() | F.col("t").isNull(), "missing").when(F.col("dup"), "duplicate").otherwise("ok")).drop("s", "t", "dup")


def link_plan(near: DataFrame, links: DataFrame, rel: str, per_row: int) -> DataFrame:
    """(qid, id, similarity) → new links of the best `per_row` neighbours that don't exist yet; weight 1 - distance."""
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("similarity"), "id"))).where(F.col("r") <= per_row)
    plan = best.select(F.col("qid").alias("src"), F.col("id").alias("dst"), F.lit(rel).alias("rel"), F.col("similarity").alias("weight"))
    return plan.join(links.select("src", "dst", "rel"), ["src", "dst", "rel"], "left_anti")

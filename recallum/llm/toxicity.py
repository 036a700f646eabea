"""Toxicity by class-conditional Kneser-Ney models over the bytes of words.

A class (toxic, ordinary) has an interpolated Kneser-Ney model of the bytes of a
word: its own counts of N-grams, each word counted once for each text, so that a
text that repeats itself weighs no more than others.  What discounting takes from
the counts goes to the next shorter order, and on to single bytes and the uniform
distribution; these backoff orders are made from the continuation counts of both
classes together.  So spellings and compounds never seen as whole words are
judged by their parts, and rare ones are smoothed alike in both classes.

A toxic text is mostly ordinary words, so its model is the mixture of the toxic
class's model, by a share of MIX, with the ordinary one.  The evidence of a text
is the difference of its two log-likelihoods, toxic and ordinary, divided by its
number of words; a logistic function of this one number, fitted on labelled rows
that the model behind it has not seen, is the score.

Only ratios of the two class models matter, one for each N-gram and one for each
context after which an unseen byte may come (the shared backoff cancels).  An
N-gram is its ORDER bytes as a bigint, without hashing.  All orders above two of
an N-gram depend on N-grams with the same middle bytes alone, so counts are
shuffled by those and estimated where they meet.  The table of ratios grows with
the corpus: up to MODEL rows it goes to the workers, beyond that the distinct
words are joined with it, then the words of each text with those; both give the
same scores.

Defined results: a null, empty or wordless text has no evidence, and a score by
the logistic function's value there; very long texts are read whole; a repeated or
null id keeps a row each; of several labels of an id the largest counts; other
columns are ignored; an empty table gives no rows; labels other than 0 and 1 are
left out; without labels of both classes every score is the share of toxic labels.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from recallum.sources.shared import cut, hinted, written

WORD = re.compile(r"[^\W\d_]+")
#: Bytes of an N-gram and the discount of all orders.
ORDER, DISCOUNT = 5, 0.75
#: Share of the toxic class's own words in a toxic text.
MIX = 0.005
#: One labelled row in FOLD tunes the logistic function, at most CALIBRATE in all.
FOLD, CALIBRATE = 4, 200_000
#: Rows of the table of ratios up to which it is sent to the workers (20 bytes each), and words that a worker remembers.
MODEL, REMEMBERED = 1 << 21, 1 << 17
#: Marks the ratio of a context rather than of an N-gram; log ratios of words are capped before exponentials.
CONTEXT, CAP = 1 << 8 * ORDER, 30.0


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of grams of each word, the grams): the ORDER bytes up to each byte and up to the end of a word."""
    raw = [w.encode() for w in words]
    pad = b"\x02" * (ORDER - 1)
    code = np.frombuffer(b"".join([pad + w + b"\x03" for w in raw]), np.uint8).astype(np.int64)
    size = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    end = np.arange(size.sum()) + np.repeat((np.arange(len(raw)) + 1) * (ORDER - 1), size)
    g = np.zeros(len(end), np.int64)
    for k in range(ORDER - 1, -1, -1):
        g = g << 8 | code[end - k]
    return size, g


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(text, toxic, tune) → (g, t, o, tt, ot): uses of each N-gram in the distinct words of toxic and ordinary rows, and of the tuning ones among them."""
    names = ["g", "t", "o", "tt", "ot"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(k, 1024) for whole in batches for k in range(0, whole.num_rows, 1024)):
            by = [Counter() for _ in range(4)]
            for text, toxic, tune in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = set(WORD.findall((text or "").lower()))
                by[1 - toxic].update(words)
                if tune:
                    by[3 - toxic].update(words)
            words = list(by[0] | by[1])
            if words:
                size, g = grams(words)
                g, inverse = np.unique(g, return_inverse=True)
                sums = [np.bincount(inverse, np.repeat(np.fromiter((c[w] for w in words), np.int64, len(words)), size), len(g)).astype(np.int64) for c in by]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (g, *sums)], names=names)

    found = labelled.select("text", "toxic", "tune").mapInArrow(run, ", ".join(f"{n} bigint" for n in names))
    return found.groupBy("g").agg(*[F.sum(c).alias(c) for c in names[1:]])


def _low_orders(counts: DataFrame) -> np.ndarray:
    """The shared probabilities of a byte after one byte: 65,536 of them, from at most as many rows at the driver."""
    last = lambda n: F.col("g").bitwiseAND(F.lit((1 << 8 * n) - 1))
    rows = counts.select(last(3).alias("g")).distinct().groupBy(last(2).alias("s")).agg(F.count("*").alias("n")).collect()
    two = np.zeros((256, 256))
    for r in rows:
        two[r.s >> 8, r.s & 255] = r.n
    one = (two > 0).sum(0)
    p1 = (np.maximum(one - DISCOUNT, 0) + DISCOUNT * (one > 0).sum() / 256) / max(1, one.sum())
    total, kinds = two.sum(1, keepdims=True), (two > 0).sum(1, keepdims=True)
    return ((np.maximum(two - DISCOUNT, 0) + DISCOUNT * kinds * p1) / np.maximum(total, 1)).ravel()


def estimated(g: np.ndarray, uses: list[tuple[np.ndarray, np.ndarray]], p2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All distinct N-grams of some middle bytes, their (toxic, ordinary) counts by variant, and the probabilities of order two → (keys, log ratios by variant)."""
    # Shared orders: each from the distinct N-grams of the order above, which extend it to the left.
    chain, at = [], g
    for n in range(ORDER - 1, 2, -1):
        s, up, cont = np.unique(at & (1 << 8 * n) - 1, return_inverse=True, return_counts=True)
        _, ctx = np.unique(s >> 8, return_inverse=True)
        chain.append((s, up, cont, ctx))
        at = s
    p = p2[at & 0xFFFF]
    for s, up, cont, ctx in reversed(chain):
        left = DISCOUNT * np.bincount(ctx)[ctx] / np.bincount(ctx, cont)[ctx]
        p = (np.maximum(cont - DISCOUNT, 0) / np.bincount(ctx, cont)[ctx] + left * p)[up]
    ctxs, ctx = np.unique(g >> 8, return_inverse=True)
    out = []
    for variant in uses:
        probability, rest = [], []
        for n in variant:
            total = np.bincount(ctx, n, len(ctxs))
            # The mass that a class leaves to the shared probability; all of it after a context that it has not seen.
            left = np.where(total > 0, DISCOUNT * np.bincount(ctx, n > 0, len(ctxs)) / np.maximum(total, 1), 1.0)
            probability.append(np.maximum(n - DISCOUNT, 0) / np.maximum(total, 1)[ctx] + left[ctx] * p)
            rest.append(left)
        out.append(np.concatenate((np.log(probability[0] / probability[1]), np.log(rest[0] / rest[1]))))
    return np.concatenate((g, ctxs | CONTEXT)), np.stack(out)


def ratios(counts: DataFrame) -> DataFrame:
    """`gram_counts` → (h, r0, r1): log ratios of N-grams and contexts without the tuning rows and with them.

    What is held at once are the N-grams of some middle bytes, at most 2^24 for
    each two.
    """
    p2 = _low_orders(counts)
    names = ["h", "r0", "r1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            g, t, o, tt, ot = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in parts]) for k in range(1, 6))
            h, r = estimated(g, [(t - tt, o - ot), (t, o)], p2)
            return pa.RecordBatch.from_arrays([pa.array(h), *map(pa.array, r)], names=names)

        held, rows = [], 0
        for b in batches:
            key = b.column(0).to_numpy(zero_copy_only=False)
            if rows >= 1 << 18 and (edges := np.flatnonzero(np.diff(key, prepend=held[-1].column(0)[-1].as_py()))).size:
                yield solve([*held, b.slice(0, int(edges[0]))])
                held, rows = [b.slice(int(edges[0]))], b.num_rows - int(edges[0])
            elif b.num_rows:
                held, rows = [*held, b], rows + b.num_rows
        if rows:
            yield solve(held)

    middle = F.shiftright("g", 8).bitwiseAND(F.lit(0xFFFF)).alias("middle")
    spread = counts.select(middle, "g", "t", "o", "tt", "ot").repartition("middle").sortWithinPartitions("middle")
    return spread.mapInArrow(run, "h bigint, r0 double, r1 double")


class Model:
    """Log ratios of words from a sorted table; `evidence` gives a column for each variant."""

    def __init__(self, h: np.ndarray, r: np.ndarray) -> None:
        order = np.argsort(h)
        self.h, self.r = h[order], r[order]
        #: Place of each remembered word's evidence in `values`.
        self.known: dict[str, int] = {}
        self.values = np.zeros((0, r.shape[1]))

    def _found(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.h, keys), len(self.h) - 1)
        return self.r[at], self.h[at] == keys

    def words(self, words: list[str]) -> np.ndarray:
        """N-grams not seen count by their context, others not at all."""
        size, g = grams(words)
        r, seen = self._found(g)
        c, near = self._found(g >> 8 | CONTEXT)
        r = np.where(seen[:, None], r, np.where(near[:, None], c, 0.0))
        return np.add.reduceat(r, np.concatenate(([0], np.cumsum(size)[:-1])))

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        found = [WORD.findall((t or "").lower()) for t in texts]
        new = list({w for words in found for w in words}.difference(self.known))
        if len(new) + len(self.known) > REMEMBERED:
            self.known.clear()
            self.values = self.values[:0]
            new = list({w for words in found for w in words})
        if new:
            value = np.log1p(MIX * np.expm1(np.minimum(self.words(new), CAP)))
            self.known.update(zip(new, range(len(self.values), len(self.values) + len(new)), strict=True))
            self.values = np.concatenate((self.values, value))
        out = np.zeros((len(texts), self.r.shape[1]))
        for k, words in enumerate(found):
            if words:
                out[k] = self.values[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))].mean(0)
        return out


def evidence_of(docs: DataFrame, model: Model) -> DataFrame:
    """(id, h, text) → (id, h, x0, x1), by a model that every worker holds."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(k, 256) for whole in batches for k in range(0, whole.num_rows, 256)):
            x = sent.value.evidence(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x[:, 0]), pa.array(x[:, 1])], names=["id", "h", "x0", "x1"])

    got = cut(docs.select("id", "h", "text").mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, h bigint, x0 double, x1 double"))
    sent.destroy()  # the rows lie in the shared folder
    return got


def evidence_by_joins(docs: DataFrame, ratio: DataFrame) -> DataFrame:
    """(id, h, text) → (id, h, x0, x1), for a table of ratios of any size: its distinct words meet it, then the words of each row those."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(k, 256) for whole in batches for k in range(0, whole.num_rows, 256)):
            words, many, sizes = [], [], []
            for text in b.column(3).to_pylist():
                c = Counter(WORD.findall((text or "").lower())) or {None: 0}
                words += c
                many += c.values()
                sizes.append(len(c))
            at = pa.array(np.repeat(np.arange(b.num_rows), sizes))
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in range(3)), pa.array(words, pa.string()), pa.array(many, pa.int64())], names=["row", "id", "h", "word", "n"])

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(k, 4096) for whole in batches for k in range(0, whole.num_rows, 4096)):
            words = b.column(0).to_pylist()
            if words:
                size, g = grams(words)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(len(words)), size))), pa.array(g), pa.array(g >> 8 | CONTEXT)], names=["word", "g", "ctx"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "id", "h", "text")
    used = rows.mapInArrow(each, f"row bigint, id {docs.schema['id'].dataType.simpleString()}, h bigint, word string, n bigint")
    asked = used.where("word IS NOT NULL").select("word").distinct().mapInArrow(spelled, "word string, g bigint, ctx bigint")
    own, near = ratio.select(F.col("h").alias("g"), F.col("r0").alias("a0"), F.col("r1").alias("a1")), ratio.select(F.col("h").alias("ctx"), F.col("r0").alias("b0"), F.col("r1").alias("b1"))
    found = asked.join(own, "g", "left").join(near, "ctx", "left")
    by_word = found.groupBy("word").agg(*[F.sum(F.coalesce(f"a{k}", f"b{k}", F.lit(0.0))).alias(f"r{k}") for k in (0, 1)])
    value = lambda k: F.log1p(F.lit(MIX) * F.expm1(F.least(F.col(f"r{k}"), F.lit(CAP))))
    mean = lambda k: F.coalesce(F.sum(value(k) * F.col("n")) / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias(f"x{k}")
    return cut(used.join(hinted(cut(by_word)), "word", "left").groupBy("row", "id", "h").agg(mean(0), mean(1)).drop("row"))


def evidence(docs: DataFrame, ratio: DataFrame, most: int = MODEL) -> DataFrame:
    """(id, h, text) and `ratios` → (id, h, x0, x1): difference of the log-likelihoods a word, by variant."""
    if ratio.count() > most:
        return evidence_by_joins(docs, ratio)
    got = ratio.toArrow()
    h, r = got["h"].to_numpy(), np.stack([got["r0"].to_numpy(), got["r1"].to_numpy()], 1)
    if not len(h):
        h, r = np.full(1, -1, np.int64), np.zeros((1, 2))
    return evidence_of(docs, Model(h, r))


def _scale(x: np.ndarray) -> np.ndarray:
    """The evidence on a logarithmic scale, so that few very toxic rows don't rule the fit; it is at least log(1 - MIX)."""
    return np.log(x + 2 * MIX)


class Logistic:
    """Regularised logistic regression on one number, by Newton's steps; both classes weigh the same, as likelihoods are compared without a prior."""

    def __init__(self, ridge: float = 1e-4) -> None:
        self.ridge = ridge
        self.mean = self.scale = self.w = None

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        x = _scale(x)
        self.mean, self.scale = float(x.mean()), float(x.std() + 1e-9)
        z = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        self.w, share = np.zeros(2), np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            h = (z * (share * p * (1 - p))[:, None]).T @ z + self.ridge * np.eye(2)
            self.w -= np.linalg.solve(h, z.T @ (share * (p - y)) + self.ridge * self.w)
        return self

    def score(self, x: Column) -> Column:
        z = (F.log(x + 2 * MIX) - self.mean) / self.scale * float(self.w[0]) + float(self.w[1])
        return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))


def held_out(id_col: Column, parts: int, held: int) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % parts == held


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", parts: int = 3, held: int = 1) -> DataFrame:
    """`docs` and `labels` → (id, h, held_out, score), h a hash of the text that tells rows of one id apart: labels of held-out rows are never read."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    key = F.col(id_col)
    known = labels.where(~held_out(key, parts, held)).where(F.col(label_col).isin(0, 1))
    learn = hinted(cut(known.groupBy(key.alias("id")).agg(F.max(label_col).cast("int").alias("toxic"))))
    tune = F.pmod(F.xxhash64(F.col("id"), F.lit(9)), F.lit(FOLD)) == 0
    # r0 and x0 have not seen the tuning rows, r1 and x1 have.
    ratio = cut(ratios(written(gram_counts(rows.join(learn, "id").withColumn("tune", tune)), "grams")))
    x = evidence(rows, ratio)
    got = x.join(_sample(learn.where(tune)), "id", "left_semi").join(learn, "id").select("x0", "toxic").toArrow()  # about CALIBRATE rows at most
    split = F.coalesce(held_out(F.col("id"), parts, held), F.lit(False)).alias("held_out")
    seen, y = got["x0"].to_numpy(), got["toxic"].to_numpy().astype(float)
    if len(set(y.tolist())) < 2:
        share = known.agg(F.coalesce(F.avg(label_col), F.lit(0.0))).first()[0]
        return x.select("id", "h", split, F.lit(float(share)).alias("score"))
    return x.select("id", "h", split, Logistic().fit(seen, y).score(F.col("x1")).alias("score"))


def _sample(ids: DataFrame, most: int = CALIBRATE) -> DataFrame:
    """At most about `most` ids, by hash: the bounded sample that tunes the logistic function."""
    n = ids.count()
    return F.broadcast((ids if n <= most else ids.where(F.pmod(F.xxhash64(F.col("id"), F.lit(17)), F.lit(n)) < most)).select("id"))

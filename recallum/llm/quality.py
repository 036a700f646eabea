"""Document quality by a regularised quadratic discriminant.

Each class has a Gaussian over transformed document statistics; its covariance
is shrunk towards the pooled one and towards a diagonal, so that it always has a
Cholesky factor.  A score is the logistic of the difference of the two
log-densities (Mahalanobis terms by the cached factors) plus the log prior.

Moments are summed by task and then by Spark, so all labelled rows take part and
only two small matrices reach the driver.  Defined results: a null text counts
as empty and has statistics (and so a score) like any other, and very long texts
are read whole; equal texts score alike; a repeated or null id keeps a row each; other
columns are ignored; an empty table gives no rows; labels other than 0 and 1 are left
out, and of several labels of an id the largest counts; without two labelled classes
every score is the share of 1.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from recallum.sources.shared import cut

WORD = re.compile(r"\S+")
LETTERS = re.compile(r"[^\W\d_]+")
PIECE = 1 << 16

NAMES = ["log_words", "word_length", "word_spread", "distinct", "repeats", "top_share", "pipes", "symbols", "exclaims", "digits", "upper", "stops", "commas", "line_words", "line_repeats", "ended", "squeezed", "letters", "long_words", "title_repeats"]


def statistics(text: str | None) -> np.ndarray:
    """Transformed statistics of a whole text."""
    text = text or ""
    words = WORD.findall(text)
    n, chars = len(words), len(text)
    lines = [x for x in text.split("\n") if x.strip()]
    count = Counter(words)
    sizes = np.fromiter(map(len, words), np.float64, n) if n else np.zeros(1)
    of = Counter(text)
    share = lambda symbols: sum(of.get(c, 0) for c in symbols)
    letters = LETTERS.findall(text)
    alpha = sum(map(len, letters))
    upper = sum(v for c, v in of.items() if c.isupper())
    digits = sum(v for c, v in of.items() if c.isdigit())
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    raw = text.encode()
    packer = zlib.compressobj(1)
    squeezed = sum(len(packer.compress(raw[k : k + PIECE])) for k in range(0, len(raw), PIECE)) + len(packer.flush())
    m, c = max(1, n), max(1, chars)
    return np.array(
        [
            np.log1p(n), np.log1p(sizes.mean()), np.log1p(sizes.std()), len(count) / m * np.log1p(m), np.sqrt(repeats / m), np.sqrt(max(count.values(), default=0) / m), np.sqrt(share("|") / m), np.sqrt(share("$%&#*<>{}[]\\^~=+") / m), np.sqrt(share("!?") / m), np.sqrt(digits / c),
            np.sqrt(upper / max(1, alpha)), np.sqrt(share(".;:") / m), np.sqrt(share(",") / m), np.log1p(n / max(1, len(lines))), np.sqrt(1 - len(set(lines)) / max(1, len(lines))), sum(x.rstrip()[-1] in ".!?\"'" for x in lines) / max(1, len(lines)), np.log((squeezed + 8) / (len(raw) + 8)),
            np.sqrt(1 - alpha / max(1, chars - text.count(" ") - text.count("\n"))), np.sqrt((sizes > 15).mean()), np.sqrt(sum(v for w, v in count.items() if v > 3 and len(w) > 6) / m),
        ]
    )


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` → (id, h, x array<double>); h tells rows that repeat an id from one another by a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([statistics(t.as_py()) for t in b.column(2)]) if b.num_rows else np.zeros((0, len(NAMES)))
            at = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(at, pa.array(x.ravel()))], names=["id", "h", "x"])

    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text")).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, h bigint, x array<double>")


class Discriminant:
    """Two Gaussians; `fit` takes the count, sum and sum of squares of each class."""

    def __init__(self, shrink: float = 0.1, diagonal: float = 0.02, temper: float = 1.0) -> None:
        self.shrink, self.diagonal, self.temper = shrink, diagonal, temper
        self.share, self.parts = 0.5, []

    def fit(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> Discriminant:
        n = {k: m[0] for k, m in moments.items()}
        self.share = n.get(1, 0) / max(1, sum(n.values()))
        if not all(n.get(k, 0) > 1 for k in (0, 1)):
            self.parts = []
            return self
        mean = {k: m[1] / m[0] for k, m in moments.items()}
        scatter = {k: m[2] - m[0] * np.outer(mean[k], mean[k]) for k, m in moments.items()}
        pooled = sum(scatter.values()) / sum(n.values())
        scale = np.diag(np.diag(pooled) + 1e-9)
        self.parts = []
        for k in (0, 1):
            own = self.shrink + (1 - self.shrink) * len(NAMES) / (len(NAMES) + n[k])  # small classes lean on the pool
            cov = (1 - own) * scatter[k] / n[k] + own * pooled
            cov = (1 - self.diagonal) * cov + self.diagonal * scale
            factor = np.linalg.cholesky(cov)
            self.parts.append((mean[k], np.linalg.inv(factor), float(np.log(np.diag(factor)).sum()), float(np.log(n[k] / sum(n.values())))))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of statistics."""
        if not self.parts:
            return np.full(len(x), self.share)
        logs = []
        for mean, inverse, half_log_det, prior in self.parts:
            z = (x - mean) @ inverse.T
            logs.append((-0.5 * (z * z).sum(1) - half_log_det) * self.temper + prior)
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """(x, label) → count, sum and sum of outer products of each class, summed by task and then by Spark."""
    d = len(NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            y = b.column(1).to_numpy(zero_copy_only=False)
            for k in (0, 1):
                z = x[y == k]
                total[k] += np.concatenate(([len(z)], z.sum(0), (z.T @ z).ravel()))
        k = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(k // total.shape[1]), pa.array(k % total.shape[1]), pa.array(total.ravel())], names=["label", "k", "v"])

    rows = labelled.where("label IN (0, 1)").select("x", F.col("label").cast("int").alias("label")).mapInArrow(run, "label bigint, k bigint, v double").groupBy("label", "k").agg(F.sum("v").alias("v")).collect()
    out = {}
    for label in {r.label for r in rows}:
        v = np.zeros(1 + d + d * d)
        for r in rows:
            if r.label == label:
                v[r.k] = r.v
        out[label] = (v[0], v[1 : 1 + d], v[1 + d :].reshape(d, d))
    return out


def held_out(id_col: Column, parts: int, held: int) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % parts == held


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", parts: int = 4, held: int = 2, model: Discriminant | None = None) -> DataFrame:
    """`docs` and `labels` → (id, h, held_out, score), h a hash of the text: labels of held-out rows are never read."""
    x = cut(features(docs, id_col, text_col))
    learn = labels.where(~held_out(F.col(id_col), parts, held)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    fitted = (model or Discriminant()).fit(moments(x.join(learn, "id").select("x", "label")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fitted.score(rows))], names=["id", "h", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return x.mapInArrow(run, f"id {kind}, h bigint, score double").select("id", "h", F.coalesce(held_out(F.col("id"), parts, held), F.lit(False)).alias("held_out"), "score")

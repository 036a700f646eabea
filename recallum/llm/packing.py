"""Harmonic packing of tokenised documents into fixed-length sequences.

Class k holds pieces of at most capacity / k tokens, and a bin of class k takes
exactly k of them.  A document is cut greedily: while laying the rest whole into
its class k would waste more than `slack` tokens a bin (and it is no short tail), a piece of exactly
capacity // (k + 1) tokens goes to class k + 1, which it fills without loss.  The
rest shrinks about quadratically, so a document has few pieces.

Each task fills its own bins; nothing is shuffled.  When a task ends, the pieces
of its unfilled bins are laid end to end into full sequences, cut at their
borders, and the last one is cut into lengths that are powers of two, which need
no padding.  So padding is less than 2 * `slack` tokens a sequence at any input size.

Words of plain Latin texts are tokenised once each and remembered; other texts, and
those that hold an added token's content, go through the tokenizer as they are.

Defined results: a null or empty text is the end token alone; a repeated id is
packed once for each row; other columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

VOCABULARY, END, CAPACITY, SLACK = "word_bpe_49k.json", 2, 4096, 32
#: Words remembered by a worker, and the most characters of one.
REMEMBERED, LONGEST = 1 << 18, 48
#: Texts of these characters alone are composed and have one-to-one lower case in any Unicode version.
PLAIN = re.compile(r"[\x00-\x1b -įı-ſ‐-‧€]*")
#: The vocabulary's own split of normalised text into words, for texts of those characters.
SPLIT = re.compile(r"[^\W\d_²³¹¼½¾]+|'(?:s|t|re|ve|m|ll|d)|[\d²³¹¼½¾]|(?:[^\s\w]|_)+")

#: Byte-level spelling: printable bytes stand for themselves, the rest for characters from U+0100 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
SPELLED = {b: chr(b) for b in _PLAIN} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PLAIN)}


class Remembering(dict):
    """Values by key, each made once; a full dictionary becomes the old one, which frequent keys return from."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Words:
    """The tokenizer; its model is asked once for each word, and texts outside plain Latin go through it as they are."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = Remembering(self._word)

    def _word(self, word: str) -> bytes:
        spelled = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(SPELLED)
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit integers."""
        if not PLAIN.fullmatch(text) or any(t in text for t in self.added):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.words.__getitem__, SPLIT.findall(text.lower())))


@cache
def load(path: str) -> Words:
    return Words(path)


def cuts(length: int, capacity: int = CAPACITY, slack: int = SLACK) -> list[tuple[int, int]]:
    """(piece length, class) for a document, front to back."""
    out = [(capacity, 1)] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        if rest <= 2 * slack or capacity - k * rest <= slack:
            out.append((rest, k))
            break
        piece = capacity // (k + 1)
        out.append((piece, k + 1))
        rest -= piece
    return out


class Bins:
    """The bins of one task: `put` and `close` give finished rows (doc number, start, ids, sequence, offset)."""

    def __init__(self, worker: int, capacity: int, slack: int) -> None:
        self.capacity, self.slack, self.next = capacity, slack, worker << 36
        self.open: dict[int, list[tuple]] = {}

    def _laid(self, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for tag, start, ids in pieces:
            yield tag, start, ids, self.next, at
            at += len(ids) // 4
        self.next += 1

    def put(self, tag: object, ids: bytes) -> Iterator[tuple]:
        at = 0
        for size, k in cuts(len(ids) // 4, self.capacity, self.slack):
            held = self.open.setdefault(k, [])
            held.append((tag, at, ids[4 * at : 4 * (at + size)]))
            at += size
            if len(held) == k:
                yield from self._laid(self.open.pop(k))

    def close(self) -> Iterator[tuple]:
        left = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        total = sum(len(ids) // 4 for _, _, ids in left)
        sizes = [self.capacity] * (total // self.capacity)
        sizes += [1 << b for b in range(self.capacity.bit_length(), -1, -1) if (total % self.capacity) >> b & 1]
        queue = iter(left)
        tag, start, ids = next(queue, (None, 0, b""))
        for size in sizes:
            laid: list[tuple] = []
            while size:
                if not ids:
                    tag, start, ids = next(queue)
                laid.append((tag, start, ids[: 4 * size]))
                taken = len(laid[-1][2]) // 4
                start, ids, size = start + taken, ids[4 * taken :], size - taken
            yield from self._laid(laid)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end: int = END, capacity: int = CAPACITY, slack: int = SLACK) -> DataFrame:
    """`docs` → a row for each piece: (id, start, length, doc_tokens, sequence_id, offset, ids binary).

    `ids` are little-endian unsigned 32-bit; `start` counts the document's tokens
    before the piece; `offset` is its place in the sequence.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = load(public_tokenizers.path(vocabulary))
        last = end.to_bytes(4, "little")
        bins = Bins(TaskContext.get().partitionId(), capacity, slack)

        def batch(rows: list[tuple], like: pa.DataType) -> pa.RecordBatch:
            tag, start, ids, seq, at = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array([t[0] for t in tag], like), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([t[1] for t in tag], pa.int64()), pa.array(seq, pa.int64()), pa.array(at, pa.int64()), pa.array(ids, pa.binary())],
                names=["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

        rows: list[tuple] = []
        like = None
        for b in batches:
            like = b.column(0).type
            for i, text in zip(b.column(0), b.column(1), strict=True):
                ids = words.ids(text.as_py() or "") + last
                rows.extend(bins.put((i.as_py(), len(ids) // 4), ids))
                if len(rows) > 2048:
                    yield batch(rows, like)
                    rows = []
        rows.extend(bins.close())
        if rows:
            yield batch(rows, like)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")

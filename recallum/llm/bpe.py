"""Byte-level BPE encoding and decoding with an Aho-Corasick automaton.

The bytes of a piece are mapped to Latin-1 characters, so the automaton over the
vocabulary finds the longest token at each place.  Encoding goes left to right
by longest matches and backtracks where the next token is incompatible with the
last one: two adjacent tokens are compatible when merging their joined bytes by
rank gives just those two tokens.  That test is memoised, and each place is left
at most once for good, so time is linear in the piece and the result is that of
the merges.

Defined results: a null or empty text has no tokens; ids that the vocabulary
lacks raise KeyError on decoding; repeated rows keep a row each; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Pieces remembered by a worker, and the most characters of one.
REMEMBERED, LONGEST = 1 << 18, 48


class Pieces(dict):
    """Ids of pieces as bytes, each made once; a full dictionary becomes the old one, which frequent pieces return from."""

    def __init__(self, make: Callable[[bytes], list[int]]) -> None:
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.pop(piece, None)
        if ids is None:
            ids = array("I", self.make(piece.encode())).tobytes()
        if len(piece) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class BytePairs:
    """Encoder and decoder for a rank file."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN) -> None:
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {i: t for t, i in self.rank.items()}
        self.pattern = regex.compile(pattern)
        auto = ahocorasick.Automaton()
        for token, i in self.rank.items():
            auto.add_word(token.decode("latin-1"), i)
        auto.make_automaton()
        self.auto = auto
        self.longest = max(map(len, self.rank))
        #: The next shorter token that is a prefix of a token, or None.
        self.shorter: dict[int, int | None] = {}
        self.fits: dict[int, bool] = {}
        self.pieces = Pieces(self.piece)
        self.halves = {i: h for t, i in self.rank.items() if len(t) > 1 and (h := self._merged(t))}

    def _merged(self, token: bytes) -> tuple[int, int] | None:
        """The two tokens whose merge makes `token`; None if merges don't reach it."""
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 2:
            ranks = [self.rank.get(a + b, 1 << 40) for a, b in zip(parts, parts[1:], strict=False)]
            k = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[k] >= self.rank[token]:
                return None
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return self.rank[parts[0]], self.rank[parts[1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging by rank keeps the border between two adjacent tokens."""
        pair = left << 32 | right
        if (known := self.fits.get(pair)) is None:
            if len(self.fits) > 4 * REMEMBERED:
                self.fits.clear()
            known = self.fits[pair] = self._border(left, right)
        return known

    def _border(self, left: int, right: int) -> bool:
        # Undo the merges of the two sides, latest first, and see if a merge across comes earlier.
        # Of equal ranks the leftmost merges first: one across precedes its like on the right, not on the left.
        limit = 1 << 40
        a, b = left, right
        while True:
            across = self.rank.get(self.bytes_of[a] + self.bytes_of[b])
            if across is not None and across < limit:
                return False
            if a > b and a in self.halves:
                limit = a
                a = self.halves[a][1]
            elif b in self.halves:
                limit = b + 1
                b = self.halves[b][0]
            elif a in self.halves:
                limit = a
                a = self.halves[a][1]
            else:
                return True

    def _longest(self, data: bytes, latin: str, at: int) -> int:
        """The longest token at a place; the automaton tells how far any token can reach."""
        for k in range(self.auto.longest_prefix(latin[at : at + self.longest]), 1, -1):
            if (token := self.rank.get(data[at : at + k])) is not None:
                return token
        return self.rank[data[at : at + 1]]

    def _prefix(self, token: int) -> int | None:
        if token not in self.shorter:
            t = self.bytes_of[token]
            self.shorter[token] = next((self.rank[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.rank), None)
        return self.shorter[token]

    def piece(self, data: bytes) -> list[int]:
        whole = self.rank.get(data)
        if whole is not None:
            return [whole]
        latin, fits = data.decode("latin-1"), self.fits
        # The longest match at each place in turn is the answer where all neighbours are compatible.
        out: list[int] = []
        last = -1
        for _, token in self.auto.iter_long(latin):
            if last >= 0:
                known = fits.get(last << 32 | token)
                if not (self.compatible(last, token) if known is None else known):
                    break
            out.append(token)
            last = token
        else:
            return out
        return self._backtracked(data, latin, out)

    def _backtracked(self, data: bytes, latin: str, out: list[int]) -> list[int]:
        """Go on after the tokens `out`, which are the first longest matches and compatible."""
        n = len(data)
        dead = bytearray(n + 1)
        at = sum(len(self.bytes_of[t]) for t in out)
        token = self._longest(data, latin, at)
        while True:
            while token is not None:
                end = at + len(self.bytes_of[token])
                if not dead[end] and (not out or self.compatible(out[-1], token)):
                    break
                token = self._prefix(token)
            if token is None:
                # Nothing fits at this place after the last token: take that one back and shorten it.
                dead[at] = 1
                last = out.pop()
                at -= len(self.bytes_of[last])
                token = self._prefix(last)
                continue
            out.append(token)
            at = end
            if at == n:
                return out
            token = self._longest(data, latin, at)

    def ids(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers, each match of the pattern encoded separately."""
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.ids(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@cache
def load(path: str) -> BytePairs:
    return BytePairs(path)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS) -> DataFrame:
    """`docs` → (id, ids binary): the tokens of every whole text as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = load(public_tokenizers.path(ranks))
        for b in (whole.slice(k, 256) for whole in batches for k in range(0, whole.num_rows, 256)):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pairs.ids(t or "") for t in b.column(1).to_pylist()], pa.binary())], names=["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids binary")


def decode(encoded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(id, ids) → (id, ids, decoded binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = load(public_tokenizers.path(ranks))
        for b in (whole.slice(k, 256) for whole in batches for k in range(0, whole.num_rows, 256)):
            decoded = [pairs.decode(np.frombuffer(x, "<u4").tolist()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(decoded, pa.binary())], names=["id", "ids", "decoded"])

    return encoded.select("id", "ids").mapInArrow(run, f"id {encoded.schema['id'].dataType.simpleString()}, ids binary, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """(id, ids, decoded) → (id, n_tokens, ids_sha256, decoded_sha256)."""
    return decoded.select("id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

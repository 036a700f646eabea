import hashlib
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from recallum.llm import alignment, queries

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
SPELLED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {chr(k): k for k in SPELLED} | {chr(256 + i): k for i, k in enumerate(k for k in range(256) if k not in SPELLED)}
NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def spans(tokens):
    at, out = 0, []
    for i, b in tokens:
        out.append((i, at, at + len(b)))
        at += len(b)
    return out


def plain(text):
    """Tokens by whole texts, links and groups by ranges."""
    if not text:
        return [], "", 0, 0
    e = A.encode(f" {text}", add_special_tokens=False)
    a = [(i, bytes(BYTES[c] for c in t)) for i, t in zip(e.ids, e.tokens, strict=True)]
    b = [(i, bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode()) for i in B.encode(text) for p in [B.id_to_piece(i)]]
    if not b"".join(x for _, x in a) == b"".join(x for _, x in b) == f" {text}".encode():
        return [], "", 0, 0
    a, b = spans(a), spans(b)
    links, low = [], 0
    for i, s, t in a:
        while b[low][2] <= s:
            low += 1
        k = low
        while k < len(b) and b[k][1] < t:
            links.append((i, b[k][0]))
            k += 1
    ends = sorted({t for _, _, t in a} & {t for _, _, t in b})

    def by_end(x):
        out = [[] for _ in ends]
        for i, _, t in x:
            out[bisect_left(ends, t)].append(i)
        return out

    groups = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in zip(by_end(a), by_end(b), strict=True))
    return links, groups, len(a), len(b)


def expected(texts):
    done = [plain(t) for t in texts]
    count = Counter(x for d in done for x in set(d[0]))
    best = defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    return [(n_a, n_b, groups.count(";") + 1 if groups else 0, len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links), hashlib.sha256(groups.encode()).hexdigest() if groups else "") for links, groups, n_a, n_b in done]


def values(df):
    return sorted((r.id, *(r[n] for n in NAMES)) for r in df.collect())


def test_whole_table_against_plain_ranges(spark, sf, docs):
    rows = docs.select("doc_id", "text").collect()
    want = sorted((r.doc_id, *x) for r, x in zip(rows, expected([r.text for r in rows]), strict=True))
    got = queries.op13_alignment(spark, sf).collect()
    assert sorted((r.doc_id, *(r[n] for n in NAMES)) for r in got) == want
    assert values(alignment.aligned(docs, hot=50)) == want  # most links are joined by shuffle


def test_odd_rows(spark, odd, none):
    rows = odd.select("doc_id", "text").collect()
    want = sorted((r.doc_id, *x) for r, x in zip(rows, expected([r.text for r in rows]), strict=True))
    assert values(alignment.aligned(odd)) == want
    assert values(alignment.aligned(odd, hot=3)) == want
    assert alignment.aligned(none).count() == 0
    nulls = spark.createDataFrame([(None, None), (None, "")], "doc_id bigint, text string")
    assert values(alignment.aligned(nulls))[0][1:] == (0, 0, 0, 0, 0, 0, "")


TEXT = st.lists(st.sampled_from([" ", "  ", "\n", "\r\n", "\t", "\u00a0", "\u3000", "\u2028", "\x1c", "\x85", "▁", "it's", "don't", "12,5", "…", "字", "😀", "é", "é", "<s>", "<|endoftext|>", "<0x0A>", "\0", "Hello", "foo_bar", "();\r", "  x"]), max_size=14).map("".join)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_segments_are_independent(text):
    aligner = alignment.load(public_tokenizers.path(alignment.A), public_tokenizers.path(alignment.B))
    ids = aligner.encode([text, "x", text])
    m = alignment.matched(aligner, *ids)
    links, groups, n_a, n_b = plain(text)
    n_groups, n_shared, texts = alignment.group_texts(aligner, m, 3)
    assert texts[0] == texts[2] == groups and n_groups[0] == (groups.count(";") + 1 if groups else 0)
    assert (len(ids[0][0]) // 2, len(ids[1][0]) // 2) == (n_a, n_b)
    first = m.doc_a[m.row] == 0
    assert sorted(zip(m.a[m.row[first]].tolist(), m.b[m.col[first]].tolist(), strict=True)) == sorted(links)
    assert n_shared[2] == (sum(len(g.split("|")[0].split(",")) * len(g.split("|")[1].split(",")) for g in groups.split(";")) if groups else 0)


def test_products_in_small_blocks(docs, monkeypatch):
    aligner = alignment.load(public_tokenizers.path(alignment.A), public_tokenizers.path(alignment.B))
    ids = aligner.encode([r.text for r in docs.select("text").limit(40).collect()] + [None, ""])
    whole = alignment.matched(aligner, *ids)
    monkeypatch.setattr(alignment, "AT_ONCE", 1)
    for x, y in zip(whole, alignment.matched(aligner, *ids), strict=True):
        assert (x == y).all()


def test_remembered_segments_of_two_generations(docs, monkeypatch):
    texts = [r.text for r in docs.select("text").limit(60).collect()]
    aligner = alignment.Aligner(public_tokenizers.path(alignment.A), public_tokenizers.path(alignment.B))
    want = aligner.encode(texts)
    monkeypatch.setattr(alignment, "REMEMBERED", 20)
    assert [aligner.encode([t]) for t in texts] == [([a], [b]) for a, b in zip(*want, strict=True)]


def test_vocabularies_keep_the_borders():
    """No piece goes on past a space or holds a line feed, on which cutting texts into segments rests."""
    pieces = [B.id_to_piece(i) for i in range(B.get_piece_size())]
    assert not [p for p in pieces if "▁" in p.lstrip("▁") or "\n" in p]


def test_product_equals_dense():
    rng = np.random.default_rng(1)
    a, b = (rng.random((9, 7)) < 0.4).astype(int), (rng.random((7, 8)) < 0.4).astype(int)
    sparse = lambda m: alignment.incidence(m.shape[0], m.shape[1], *np.nonzero(m))
    got = alignment.product(sparse(a), sparse(b))
    dense = np.zeros((9, 8), int)
    dense[got.rows, got.cols] = got.values
    assert (dense == a @ b).all() and (np.nonzero(a @ b)[0] == got.rows).all()
    assert (alignment.transposed(sparse(a)).rows == np.nonzero(a.T)[0]).all()

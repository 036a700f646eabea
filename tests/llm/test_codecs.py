"""Exact forms: piecewise hashes, MPEG audio, byte pairs, WARC, packing, URLs."""

import base64
import gzip
import hashlib
import io
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from oracle import connect, same
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from recallum.llm import bpe, ctph, mpeg, packing, queries, urls, warc


def test_piecewise_hash_of_edits():
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    a = " ".join(word() for _ in range(600)).encode()
    b = a[:2000] + b" inserted " + a[2000:]
    c = " ".join(word() for _ in range(600)).encode()
    f = ctph.fingerprint
    assert f(a) == f(bytes(a)) and ctph.likeness(f(a), f(a)) == 1.0
    assert ctph.likeness(f(a), f(b)) > 0.9 and ctph.likeness(f(a), f(c)) < 0.2
    assert f(b"") == "1::" and ctph.likeness("1::", "1::") == 1.0 and ctph.likeness("1::", f(a)) == 0.0
    assert len(f(b"x" * 300_000)) < 20_000 and 0 <= ctph.likeness(f(b"ab" * 5000), f(b"ab" * 4000 + b"zz" * 500)) <= 1


def test_common_subsequence():
    r = random.Random(2)
    for _ in range(200):
        s, t = ("".join(r.choice("abcd") for _ in range(r.randint(0, 12))) for _ in range(2))
        d = [[0] * (len(t) + 1) for _ in range(len(s) + 1)]
        for i, x in enumerate(s):
            for j, y in enumerate(t):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        assert ctph.common(s, t) == d[-1][-1]


def test_op3_against_brute_force(spark, sf, docs, odd, none):
    def check(rows, got):
        rows = sorted(rows, key=lambda r: -r[0])
        for k, (i, t) in enumerate(rows):
            t, n = t or "", len(t or "") // 3
            e = (t[: len(t) - n] + (rows[(k + 1) % len(rows)][1] or "")[:n]).encode()
            assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(e).hexdigest()
            assert got[i].fingerprint == ctph.fingerprint(t.encode()) and got[i].edited_fingerprint == ctph.fingerprint(e)

    check([(r.doc_id, r.text) for r in docs.collect()], {r.doc_id: r for r in queries.op3_ctph(spark, sf).collect()})
    plain = odd.where("doc_id NOT IN (0, 3)")
    for parts in (1, 3, 7):
        check([(r.doc_id, r.text) for r in plain.collect()], {r.id: r for r in ctph.edited_pairs(plain, parts=parts).collect()})
    assert ctph.edited_pairs(odd).count() == 18 and ctph.edited_pairs(none).count() == 0
    one = plain.where("doc_id = 8")
    assert ctph.edited_pairs(one).first().near_next == 1.0


def test_mpeg_round_trip_and_resync():
    payload = bytes(range(256)) * 9
    media = mpeg.write(payload)
    got = mpeg.read(media)
    assert got["payload"] == payload and got["bad"] == got["skipped"] == 0 and got["good"] == 5 and got["table"]["frames"] == got["frames"] == 4
    assert got["samples"] == 4 * 576 and all(media[o : o + 4] == mpeg.HEAD for o in got["offsets"])
    hurt = media[: got["offsets"][1]] + b"\xff\xfbjunk\xff\xf2" + media[got["offsets"][1] :]
    again = mpeg.read(hurt)
    assert again["payload"] == payload and again["skipped"] == 8
    wrong = bytearray(media)
    wrong[got["offsets"][2] + 10] ^= 1
    assert mpeg.read(bytes(wrong))["bad"] == 1
    assert mpeg.read(b"")["frames"] == 0 and mpeg.read(b"\xff" * 3000)["frames"] == 0
    full = mpeg.write(b"\xff" * 576 * 3)
    assert mpeg.read(full)["payload"] == b"\xff" * 576 * 3
    assert mpeg.header(bytes((0xFF, 0xFB, 0x90, 0x00)))[:3] == (417, 1152, 44100)


def test_mpeg_payload_that_looks_like_a_tag(spark):
    payload = b"a" * 576 * 2 + b"b" * 505 + b"TAG" + b"c" * 68
    assert mpeg.write(payload)[-128:-125] == b"TAG"
    for text in (payload, payload[576:], payload[-576:]):
        media = mpeg.write(text)
        got, tagged = mpeg.read(media), mpeg.read(media + b"TAG" + bytes(125))
        assert got["payload"] == text and got["skipped"] == 0 and got["tags"] == ["ID3v2.4"]
        assert tagged | {"tags": 0} == got | {"tags": 0} and tagged["tags"] == ["ID3v2.4", "ID3v1"]
    docs = spark.createDataFrame([(1, payload.decode())], "doc_id bigint, text string")
    assert bytes(mpeg.decode(mpeg.encode(docs)).first().payload) == payload


def crc_by_division(bits):
    c = 0xFFFF
    for b in bits:
        c = (c << 1) ^ (0x8005 if (c >> 15) ^ b else 0) & 0xFFFF
        c &= 0xFFFF
    return c


def bits_of(data):
    return [x >> k & 1 for x in data for k in range(7, -1, -1)]


def stored(payload):
    """The stored form of a payload, frame by frame: 24-bit silence, as the format's fields are laid out."""
    head = bytes.fromhex("fff2d8c0")
    check = crc_by_division(bits_of(head[2:] + bytes(9))).to_bytes(2, "big")
    n = len(payload) // 576
    frame = lambda body: (head + check + bytes(9) + body).ljust(648, b"\0")
    toc = bytes(min(255, 256 * (p * (n + 1) // 100) // (n + 1)) for p in range(100))
    xing = b"Xing" + (7).to_bytes(4, "big") + n.to_bytes(4, "big") + (648 * (n + 1)).to_bytes(4, "big") + toc
    return b"ID3\x04\0\0\0\0\0\x13TSSE\0\0\0\x09\0\0\x03recallum" + frame(xing) + b"".join(frame(payload[k : k + 576]) for k in range(0, len(payload), 576))


def test_mpeg_checksums_of_layers_one_and_two():
    r = random.Random(7)
    # (header, bits that the checksum covers after the header, by the standard's tables)
    one = lambda mode: bytes((0xFF, 0xFE, 9 << 4, mode << 6))
    for head, covered in ((one(3), 128), (one(0), 256), (bytes((0xFF, 0xFE, 9 << 4, 1 << 6 | 1 << 4)), 4 * (16 + 24))):
        size = mpeg.header(head)[0]
        frames = b""
        for k in range(3):
            body = bytes(r.randrange(256) for _ in range(size - 6))
            good = crc_by_division(bits_of(head[2:]) + bits_of(body)[:covered])
            frames += head + (good ^ (k == 1)).to_bytes(2, "big") + body
        got = mpeg.read(frames)
        assert (got["frames"], got["good"], got["bad"], got["samples"]) == (3, 2, 1, 3 * 384)
    # Layer II, 44.1 kHz, mono, 32 kbit/s: 8 subbands of 4, 4, 3, … bits; two of them allocated.
    head = bytes((0xFF, 0xFC, 1 << 4, 3 << 6))
    size = mpeg.header(head)[0]
    allocation = [0, 1, 0, 0] + [0] * 4 + [1, 1, 0] + [0] * 15
    body = int("".join(map(str, allocation + [1, 0, 0, 1] + [0] * 2)), 2).to_bytes(4, "big") + bytes(size - 10)
    good = crc_by_division(bits_of(head[2:]) + bits_of(body)[: 26 + 4])
    got = mpeg.read((head + good.to_bytes(2, "big") + body) * 2 + head + (good ^ 3).to_bytes(2, "big") + body)
    assert (got["frames"], got["good"], got["bad"]) == (3, 2, 1)


def test_mpeg_tags_and_tables():
    payload = bytes(range(250)) * 9 + bytes(54)
    media = mpeg.write(payload)
    frames = media[29:]
    safe = lambda n: bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))
    title, art = b"TIT2" + (7).to_bytes(4, "big") + b"\0\0\x01\xff\xfeh\0i\0", b"APIC" + (300).to_bytes(4, "big") + b"\0\0" + bytes(300)
    tag = b"ID3\x03\0\0" + safe(len(title + art)) + title + art
    old = b"ID3\x02\0\0" + safe(9) + b"TT2\0\0\x03\0ab"
    ape = b"APETAGEX" + (2000).to_bytes(4, "little") + (32).to_bytes(4, "little") + bytes(4) + bytes(12)
    for before, tags, texts in ((tag, ["ID3v2.3"], {"TIT2": "hi", "APIC": ""}), (old, ["ID3v2.2"], {"TT2": "ab"}), (old + tag, ["ID3v2.2", "ID3v2.3"], {"TT2": "ab", "TIT2": "hi", "APIC": ""}), (b"", [], {})):
        for after, more in ((b"", []), (b"TAG" + bytes(125), ["ID3v1"]), (ape, ["APE"]), (ape + b"TAG" + bytes(125), ["ID3v1", "APE"])):
            got = mpeg.read(before + frames + after)
            assert got["payload"] == payload and got["tags"] == tags + more and got["texts"] == texts and got["skipped"] == 0
    # A table with encoder delay and padding makes the duration exact.
    at = mpeg.START + 8 + 4 + 4 + 100
    lame = bytearray(frames)
    lame[mpeg.START + 4 : mpeg.START + 8] = (7).to_bytes(4, "big")
    lame[at : at + 24] = b"LAME3.100".ljust(21, b"\0") + (576 << 12 | 1000).to_bytes(3, "big")
    got = mpeg.read(bytes(lame))
    assert got["table"]["encoder"] == "LAME3.100" and got["seconds"] == pytest.approx((4 * 576 - 1576) / 16000)
    # VBRI: a frame of MPEG-1 Layer III, 128 kbit/s, with counts and a seek table.
    head = bytes((0xFF, 0xFB, 0x90, 0x00))
    body = bytearray(417)
    body[:4] = head
    body[36:62] = b"VBRI" + bytes((0, 1, 0, 0, 0, 75)) + (5000).to_bytes(4, "big") + (9).to_bytes(4, "big") + (3).to_bytes(2, "big") + (2).to_bytes(2, "big") + (2).to_bytes(2, "big") + bytes(2)
    body[62:68] = b"".join(x.to_bytes(2, "big") for x in (100, 200, 300))
    plain = bytes(head) + bytes(413)
    got = mpeg.read(bytes(body) + plain * 2)
    assert got["table"] == {"kind": "VBRI", "frames": 9, "bytes": 5000, "toc": [200, 400, 600]} and got["frames"] == 2


def test_op4_against_brute_force(spark, sf, docs, odd, none):
    for r, t in zip(queries.op4_mpeg(spark, sf).orderBy("doc_id").collect(), [r.text for r in docs.orderBy("doc_id").collect()], strict=True):
        raw = (t or "").encode()
        p = raw + b"\xff" * (-len(raw) % 576 or (576 if not raw else 0))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        media = stored(p)
        assert (r.media_sha256, r.media_bytes) == (hashlib.sha256(media).hexdigest(), len(media))
        n = len(p) // 576
        seek = hashlib.sha256(",".join(str(29 + 648 * k) for k in range(1, n + 1)).encode()).hexdigest()[:16]
        assert r.feature == f"ID3v2.4:Xing:{n}:{n}:{576 * n}:16000:144:{n + 1}:0:0:{seek}" and r.duration_s == pytest.approx(576 * n / 16000)
    assert mpeg.decode(mpeg.encode(odd)).count() == 18 and mpeg.decode(mpeg.encode(none)).count() == 0


def reference():
    with open(P.path(bpe.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_pairs_against_tiktoken(spark, sf, docs, odd, none):
    enc, own = reference(), bpe.load(P.path(bpe.RANKS))
    r = random.Random(3)
    parts = ["a", "b", "e", "th", "ing", " ", " ", "  ", "é", "ß", "字", "😀", "\n", "\x1c", "\x85", "\xa0", "'s", "1", "23", "_", "the", "aaaa", "ababab", "́"]
    for _ in range(6000):
        s = "".join(r.choice(parts) for _ in range(r.randint(0, 25)))
        assert own.encode(s) == enc.encode_ordinary(s) and own.decode(own.encode(s)) == s.encode()
    s = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000))
    assert own.encode(s) == enc.encode_ordinary(s) and own.encode("a" * 50_000) == enc.encode_ordinary("a" * 50_000)
    text = {x.doc_id: x.text for x in docs.collect()}
    for x in queries.op5_bpe(spark, sf).collect():
        ids = enc.encode_ordinary(text[x.doc_id] or "")
        assert (x.n_tokens, x.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert x.decoded_sha256 == hashlib.sha256((text[x.doc_id] or "").encode()).hexdigest()
    assert bpe.decode(bpe.encode(odd)).count() == 18 and bpe.encode(none).count() == 0


def test_urls(spark, sf, none):
    same(queries.op7_urls(spark, sf), queries.OP7_SQL, connect(sf))
    rows = ["http://a.EXAMPLE.net/en/x?y", "http://example.net/e", "https://b.example.com/de/#t", "x.org/fr/", None, "", "http://org/fr/1", "http://forg/fr/1", "ftp://net", "http://net/", "http://a.b.net/en/"]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(rows)] + [(0, rows[0], "h", "p")], "page_id int, url string, host string, path string")
    rules = spark.createDataFrame(queries.RULES, "host string, path string, verdict string")
    got = urls.judge(pages, rules)
    by = {r.row.page_id: (r.host, r.rule, r.verdict) for r in got.collect()}
    assert got.count() == 12
    assert by[0] == ("a.example.net", "example.net/en/", "allow") and by[1][1:] == ("net/", "block") and by[2][1:] == ("example.com/de/", "block")
    assert by[3] == by[4] == by[5] == ("", None, "allow") and by[6][1] == "org/fr/" and by[7][1] is None and by[8][1] is None and by[9][1] == "net/" and by[10][1] == "net/"
    assert urls.judge(pages.limit(0), rules).count() == 0 and urls.judge(pages, rules.limit(0)).where("rule IS NOT NULL").count() == 0


def test_bloom_has_no_false_negatives_and_few_positives(spark):
    keys = [f"host{k}.example/{k}" for k in range(5000)]
    bloom = urls.build(spark.createDataFrame([(k,) for k in keys], "key string"))
    assert urls.contains(bloom, keys).all() and urls.contains(bloom, [f"other{k}" for k in range(5000)]).mean() < 0.02


def test_warc_payload_that_differs_from_its_headers(spark):
    """What is read is hashed and counted: a payload other than the one noted is no record."""
    good = warc.record(1, "http://x", b"abc", warc.base32(hashlib.sha1(b"abc").hexdigest()), 1, True)
    wrong = good.replace(b"abc\r\n\r\n", b"abd\r\n\r\n")
    for r, fails in ((good, False), (wrong, True)):
        gz = gzip.compress(r)
        rows = warc.read(spark.createDataFrame([("a", 0, bytearray(gz), [0], [len(gz)])], "archive string, start bigint, gz binary, offsets array<bigint>, lengths array<bigint>"))
        if fails:
            with pytest.raises(Exception, match="another payload than its headers say"):
                rows.collect()
        else:
            assert [(x.payload_bytes, bytes(x.payload)) for x in rows.collect()] == [(3, b"abc")]


def test_warc(spark, sf):
    same(queries.op8_warc(spark, sf), queries.OP8_SQL, connect(sf))
    rows = [(5, "http://a/", "same"), (3, None, "same"), (9, "http://b/\r\nX: y", None), (7, "http://c/", ""), (1, "http://d/", "é" * 9000), (1, "http://d/", "é" * 9000), (11, "u", "\r\n\r\nWARC/1.1\r\n"), (None, "n", "same"), (None, "n", "alone")]
    pages = spark.createDataFrame([(*r, "resp") for r in rows], "page_id bigint, url string, html string, record_type string")
    made = warc.archive(pages)
    got = {r.row: r for r in warc.read(made).collect()}
    assert (got["3"].record_type, got["5"].record_type, got["5"].refers_to) == ("response", "revisit", "3")
    assert (got["7"].record_type, got["9"].record_type, got["9"].payload_bytes, got["9"].refers_to) == ("response", "revisit", 0, "7")
    assert got["1"].payload_bytes == 18_000 and got["1"].payload.decode() == "é" * 9000 and got["11"].payload == b"\r\n\r\nWARC/1.1\r\n"
    assert warc.read(made).where("row = '1' AND record_type = 'response'").count() == 2
    for a in made.collect():
        for at, n in zip(a.offsets, a.lengths, strict=True):
            assert gzip.GzipFile(fileobj=io.BytesIO(a.gz[at - a.start : at - a.start + n])).read().startswith(b"WARC/1.1\r\n")
    assert warc.read(warc.archive(pages.limit(0))).count() == 0
    flagged = [r.asDict() for r in warc.flagged(pages).collect()]
    assert len(flagged) == 9
    assert sorted((r.record_type, r.refers_to) for r in warc.read(made).where("row = 'None'").collect()) == [("response", None), ("revisit", "3")]


def test_normaliser_keeps_every_record():
    records = [warc.record(k, f"http://x/{k}", b"p" * k, "D", k, True) for k in range(50)]
    records[7] = warc.record(7, "http://x/7", bytes(range(256)) * 9000, "D", 7, True)
    whole, three = gzip.compress(b"".join(records)), gzip.compress(b"".join(records[:20])) + gzip.compress(b"".join(records[20:21])) + bytes(9) + gzip.compress(b"".join(records[21:])) + bytes(600)
    for gz in (whole, three, b"".join(map(gzip.compress, records)), io.BytesIO(three)):
        assert [gzip.decompress(x) for x in warc.normalise(gz)] == records
    assert list(warc.normalise(b"")) == []
    for broken in (whole[:-2000], gzip.compress(b"".join(records)[:-60])):
        with pytest.raises(EOFError):
            list(warc.normalise(broken))


def test_archives_in_stretches(spark):
    records = [warc.record(k, f"http://x/{k}", f"payload {k} ".encode() * 40, "D", k, True) for k in range(90)]
    gz = gzip.compress(b"".join(records[:45])) + gzip.compress(b"".join(records[45:]))
    made = warc.normalised(spark.createDataFrame([("a", gz), ("b", gz)], "archive string, gz binary"), size=4000).cache()
    assert made.count() > 4 and warc.index(made).count() == 180
    file = b"".join(bytes(r.gz) for r in made.where("archive = 'b'").orderBy("start").collect())
    for r in warc.index(made.where("archive = 'b'")).collect():
        assert gzip.decompress(file[r.offset : r.offset + r.length]) in records
    assert sorted((r.archive, int(r.row)) for r in warc.read(made).collect()) == [(a, k) for a in "ab" for k in range(90)]


def packed_well(got, want, capacity=packing.CAPACITY):
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.length == len(r.ids) // 4 > 0
    for i, ids in want.items():
        assert sum((x for _, x in sorted(by_doc[i])), []) == ids
    padding = total = 0
    for pieces in by_seq.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= capacity
        total += at
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding / total


def test_packing(spark, sf, docs, odd, none):
    t = Tokenizer.from_file(P.path(packing.VOCABULARY))
    want = {r.doc_id: [*t.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    for r in queries.op10_packing(spark, sf).collect():
        ids = np.array(want[r.doc_id][r.start : r.start + r.length], "<u4")
        assert (r.ids_crc32, r.doc_tokens, len(ids)) == (zlib.crc32(ids.tobytes()), len(want[r.doc_id]), r.length)
    assert packed_well(packing.pack(docs).collect(), want) < 0.02
    plain = odd.dropDuplicates(["doc_id"])
    want = {r.doc_id: [*t.encode(r.text or "", add_special_tokens=False).ids, 2] for r in plain.collect()}
    assert packed_well(packing.pack(plain).collect(), want) < 0.02
    assert packing.pack(none).count() == 0
    assert packing.pack(odd).agg(F.sum("length")).first()[0] == packing.pack(odd).where("start = 0").agg(F.sum("doc_tokens")).first()[0]


def test_words_against_the_tokenizer():
    w, t = packing.load(P.path(packing.VOCABULARY)), Tokenizer.from_file(P.path(packing.VOCABULARY))
    r = random.Random(4)
    parts = ["a", "É", "ß", "’", "'S", "'ll", " ", "\n", "\t", "12", "½", "²", "ª", "Σ", "ΑΣ", "İ", "字", "😀", "--", "...", "_", "<|endoftext|>", "<|startoftext|>", "  ", "á", "ſ", "\x85", "\xa0", "\x1c", "Å"]
    for _ in range(3000):
        s = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        assert np.frombuffer(w.ids(s), "<u4").tolist() == t.encode(s, add_special_tokens=False).ids


def test_cuts_waste_little():
    for n in range(1, 9000, 7):
        got = packing.cuts(n)
        assert sum(size for size, _ in got) == n and all(size * k <= 4096 for size, k in got) and all(4096 - size * k <= 64 for size, k in got)
        assert len(got) <= n // 4096 + 6

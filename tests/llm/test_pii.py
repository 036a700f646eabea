import datetime
import hashlib
import re

from pyspark.sql import functions as F

from recallum.llm import pii


def run(spark, texts, **k):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    return [r for r in pii.pseudonyms(df, **{"key": "k", **k}).orderBy("doc_id").collect()]


def luhn(s):
    t = 0
    for k, c in enumerate(reversed(re.sub(r"\D", "", s))):
        d = int(c) * (1 + k % 2)
        t += d - 9 * (d > 9)
    return t % 10 == 0


def test_formats_and_validity(spark):
    texts = ["4111 1111 1111 1111", "4111-1111-1111-1111", "97.51.17.173", "2024-02-29", "14/3/2020", "123-45-6789", "+1 (017) 555-7713", "DE89 3704 0044 0532 0130 00", "Foo.Bar99@mail9.example.com", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"']
    got = run(spark, texts)
    shape = lambda s: re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", s)))
    for t, r in zip(texts, got, strict=True):
        assert r.text != t and len(r.pii_kinds) == 1
        if r.pii_kinds[0] not in ("ip", "date", "secret", "email"):
            assert shape(r.text) == shape(t)
    assert luhn(got[0].text) and re.sub(r"\D", "", got[0].text) == re.sub(r"\D", "", got[1].text)
    assert all(0 <= int(x) < 256 for x in got[2].text.split("."))
    iban = got[7].text.replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert re.fullmatch(r"[A-Z][a-z]{2}\.[A-Z][a-z]{2}\d\d@mail9\.example\.com", got[8].text)


def test_invalid_candidates_stay(spark):
    texts = ["4111111111111112", "2023-02-30", "300.1.1.1", "666-12-3456", "DE89370400440532013001", "1.2.3.4.5", "plain 12 words", None, ""]
    for t, r in zip(texts, run(spark, texts), strict=True):
        assert r.text == t and r.pii_kinds == []


def test_permutations_are_injective_and_linked(spark):
    addresses = [f"10.0.{a}.{b}" for a in range(16) for b in range(64)]
    got = run(spark, [f"see {x}, and {x}." for x in addresses])
    pairs = [re.findall(r"\d+\.\d+\.\d+\.\d+", r.text) for r in got]
    assert all(len(p) == 2 and p[0] == p[1] for p in pairs) and len({p[0] for p in pairs}) == len(addresses)
    days = [r.d for r in spark.sql("SELECT date_format(date_add(DATE '1999-01-01', CAST(id AS INT)), 'yyyy-MM-dd') AS d FROM range(800)").collect()]
    assert len({r.text for r in run(spark, days)}) == 800
    assert run(spark, ["10.0.0.1"])[0].text != run(spark, ["10.0.0.1"], key="other")[0].text


def test_a_domain_is_permuted_onto_itself(spark):
    two = [f"{k:02d}" for k in range(100)]
    got = spark.createDataFrame([(x,) for x in two], "s string").select(pii._permuted(F.col("s"), pii.DIGITS, "k", "t", F.lit(""), 18).alias("p"))
    assert sorted(r.p for r in got.collect()) == two


def test_against_a_plain_feistel(spark):
    def plain(s, key, what, tweak):
        left = len(s) // 2
        size = (10**left, 10 ** (len(s) - left))
        v = [int(s[:left] or 0), int(s[left:] or 0)]
        place = f"{tweak},0,{len(s)}"
        for i in range(pii.ROUNDS):
            k = i % 2
            f = int(hashlib.sha256(f"{key}|{what}|{place}|{i}|{v[1 - k]}".encode()).hexdigest()[:14], 16)
            v[k] = (v[k] + f) % size[k]
        return (str(v[0]).zfill(left) if left else "") + str(v[1]).zfill(len(s) - left)

    values = ["7", "42", "123", "0000", "98765", "12345678901234567"]
    got = spark.createDataFrame([(x,) for x in values], "s string").select("s", pii._permuted(F.col("s"), pii.DIGITS, "k", "w", F.lit("tw"), 18).alias("p")).collect()
    assert {r.s: r.p for r in got} == {x: plain(x, "k", "w", "tw") for x in values}


def test_odd_rows_and_plan(spark, odd, none, docs):
    got = pii.pseudonyms(odd, "k")
    assert got.columns == [*odd.columns, "pii_kinds"] and got.count() == 18 and got.where("text IS NULL").count() == 2
    assert pii.pseudonyms(none, "k").count() == 0
    plan = pii.pseudonyms(docs, "k")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    left = pii.pseudonyms(docs, "k").select(F.regexp_extract_all("text", F.lit(r"\+1 \(\d{3}\) 555-\d{4}"), F.lit(0)).alias("p")).where("size(p) > 0").count()
    assert left <= 1  # a pseudonym may hold 555 by chance


class Plain:
    """The same pseudonyms by plain Python, value by value."""

    def __init__(self, key):
        self.key = key

    def feistel(self, a, b, sizes, what, tweak):
        v = [a, b]
        for i in range(8):
            k = i % 2
            v[k] = (v[k] + int(hashlib.sha256(f"{self.key}|{what}|{tweak}|{i}|{v[1 - k]}".encode()).hexdigest()[:14], 16)) % sizes[k]
        return v

    def permuted(self, s, alphabet, what, tweak, block=18):
        out, n = "", len(alphabet)
        for at in range(0, len(s), block):
            part = s[at : at + block]
            left = len(part) // 2
            value = lambda x: sum(alphabet.index(c) * n**k for k, c in enumerate(reversed(x)))
            for x, width in zip(self.feistel(value(part[:left]), value(part[left:]), (n**left, n ** (len(part) - left)), what, f"{tweak},{at},{len(s)}"), (left, len(part) - left), strict=True):
                out += "".join(alphabet[x // n**k % n] for k in range(width - 1, -1, -1))
        return out

    def laid(self, m, symbols, keep):
        it = iter(symbols)
        return "".join((c2.upper() if c.isupper() else c2) if re.match(f"[{keep}]", c) and (c2 := next(it)) else c for c in m)

    def check(self, payload):
        t = sum(d - 9 * (d > 9) for d in (int(c) * (2 - k % 2) for k, c in enumerate(reversed(payload))))
        return str(-t % 10)

    def mod97(self, s):
        return int("".join(str(int(c, 36)) for c in s)) % 97

    def value(self, kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == "card":
            if self.check(digits[:-1]) != digits[-1]:
                return m
            n = 2 if digits[0] in "235" else 1
            payload = digits[:n] + self.permuted(digits[n:-1], pii.DIGITS, "card", digits[:n])
            return self.laid(m, payload + self.check(payload), "0-9")
        if kind == "iban":
            flat = m.replace(" ", "").upper()
            if self.mod97(flat[4:] + flat[:4]) != 1:
                return m
            new = self.laid(flat[4:], self.permuted(re.sub("[^0-9]", "", flat[4:]), pii.DIGITS, "iban", flat[:2]), "0-9")
            return self.laid(m, f"{98 - self.mod97(new + flat[:2] + '00'):02d}" + re.sub("[^0-9]", "", new), "0-9")
        if kind == "ip":
            o = [int(x) for x in m.split(".")]
            a, b = self.feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], (65536, 65536), "ip", "")
            return f"{a >> 8}.{a & 255}.{b >> 8}.{b & 255}"
        if kind == "ip6":
            return self.laid(m, self.permuted(re.sub("[^0-9a-f]", "", m.lower()), pii.HEX, "ip6", "", 24), "0-9A-Fa-f")
        if kind == "ssn":
            area, group, serial = (int(x) for x in m.split("-"))
            if not (1 <= area <= 899 and area != 666 and group and serial):
                return m
            a, b = self.feistel((area - 1 - (area > 666)) * 99 + group - 1, serial - 1, (898 * 99, 9999), "ssn", "")
            return f"{a // 99 + 1 + (a // 99 >= 665):03d}-{a % 99 + 1:02d}-{b + 1:04d}"
        if kind == "date":
            parts, day, first = [int(x) for x in re.split("[-/.]", m)], None, None
            iso = m[4] == "-"
            for order in (["ymd"] if iso else ["dmy", "mdy"]):
                try:
                    day, first = datetime.date(**{{"y": "year", "m": "month", "d": "day"}[c]: v for c, v in zip(order, parts, strict=True)}), order
                    break
                except ValueError:
                    pass
            n = (day - datetime.date(1900, 1, 1)).days if day else -1
            if not 0 <= n < 270 * 271:
                return m
            a, b = self.feistel(n // 271, n % 271, (270, 271), "date", "")
            new = datetime.date(1900, 1, 1) + datetime.timedelta(a * 271 + b)
            if iso:
                return new.isoformat()
            width = 2 if len(m) == 10 else 1
            return ("." if "." in m else "/").join(f"{ {'d': new.day, 'm': new.month}[c]:0{width}d}" for c in first[:2]) + ("." if "." in m else "/") + f"{new.year:04d}"
        if kind == "phone":
            code = (re.match(pii.CALLING, re.sub("[^0-9+]", "", m)) or [None, ""])[1]
            return self.laid(m, code + self.permuted(digits[len(code) :], pii.DIGITS, "phone", code), "0-9")
        if kind == "email":
            local, domain = m.split("@")
            low = local.lower()
            letters = self.permuted(re.sub("[^a-z]", "", low), pii.LETTERS, "letters", f"{re.sub('[^0-9]', '', low)}@{domain.lower()}", 20)
            numbers = self.permuted(re.sub("[^0-9]", "", low), pii.DIGITS, "digits", f"{letters}@{domain.lower()}")
            return self.laid(self.laid(local, letters, "A-Za-z"), numbers, "0-9") + "@" + domain
        return self.permuted(m, pii.HEX, "secret", "", 24)

    def text(self, text):
        kinds = []

        def put(m):
            kind = next(k for k in pii.KINDS if re.fullmatch(pii.ALONE.get(k, pii.PATTERNS[k]), m[0], re.A))
            new = self.value(kind, m[0])
            kinds.extend([kind] * (new != m[0]))
            return new

        return (re.sub(pii.ALL, put, text, flags=re.A), kinds) if text is not None else (None, [])


def test_query_against_plain_python(spark, sf, docs):
    from recallum.llm.queries import op2_pii

    text, plain = {r.doc_id: r.text for r in docs.collect()}, Plain(pii.TEST_KEY)
    changed = 0
    for r in op2_pii(spark, sf).collect():
        want, kinds = plain.text(text[r.doc_id])
        assert (r.text, r.kinds, r.n_changed) == (want, ",".join(kinds), len(kinds))
        changed += bool(kinds)
    assert changed > 5


def test_all_kinds_against_plain_python(spark):
    texts = [
        "Pay 4111 1111 1111 1111 or 378282246310005, 5555-5555-5555-4444; not 4111 1111 1111 1112.", "IBAN DE89370400440532013000, de89370400440532013000 and GB82 WEST 1234 5698 7654 32.", "From 10.1.2.3:80 and 2001:db8:0:1:1:1:1:1, fe80::1ff:fe23:4567:890a; C::scope a::b 12:30:45.",
        "On 1999-12-31T10:00 and 2024-02-29, 31/12/1999, 12/31/1999, 1.2.2003, 31.02.2003; v1.2.3.", "SSN 123-45-6789, 666-12-3456, 899-99-9999.", "Call +4917612345678, +1 (017) 555-7713, (212) 555-0100, 212-555-0100, +351 21 123 4567.", "Mail Foo.Bar99@mail9.example.com, a@b.co; token 'deadbeef00112233445566778899aabb'.", "", None, "no data", "7" * 500,
    ]
    plain = Plain("k")
    for t, r in zip(texts, run(spark, texts), strict=True):
        assert (r.text, r.pii_kinds) == plain.text(t)
    kinds = {k for t in texts for k in plain.text(t)[1]}
    assert kinds == set(pii.KINDS)


def test_clashing_names_and_keys(spark):
    df = spark.createDataFrame([("10.0.0.1", "mine", "own")], "text string, PII_kinds string, pii_found string")
    got = pii.pseudonyms(df, "k")
    assert got.columns == ["text", "PII_kinds", "pii_found", "pii_kinds_"] and got.first()[1:] == ("mine", "own", ["ip"])
    both = pii.pseudonyms(df, "k", out="clean").first()
    assert both.text == "10.0.0.1" and both.clean != both.text
    assert pii.key_of(spark) == pii.TEST_KEY
    spark.conf.set(pii.KEY, "secret")
    assert pii.key_of(spark) == "secret"
    spark.conf.unset(pii.KEY)

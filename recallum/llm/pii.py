"""Personal data replaced by format-preserving Feistel pseudonyms, in built-in functions only.

One regular expression finds candidates; a candidate that validates (Luhn, IBAN
check digits, octets, calendar) is permuted within its own format by a keyed
Feistel network, so that equal values have equal pseudonyms in every document and
different ones differ:

* card: first digit kept, or the first two where the first is 2, 3 or 5 (those tell the kind of card), the others but the check digit permuted, Luhn recomputed
* iban: country and letters kept, digits of the account permuted, check digits recomputed
* ip: a permutation of all 2^32 addresses; ip6: its hexadecimal digits permuted in base 16
* date: a permutation of the 270 * 271 days from 1900-01-01 in the same notation; `dd/mm` is tried before `mm/dd`
* phone: the country calling code kept, the other digits permuted; ssn: area, group and serial permuted within their valid ranges
* email: letters and digits before the @ permuted among letters and digits
* secret: hexadecimal tokens in quotes, their digits permuted in base 16

Punctuation, spaces, upper case and lengths stay.  The key is a parameter: whoever
has it can invert the pseudonyms, so take it from `key_of`, and not from a text.

Defined results: a null text stays null with no kinds; a text without candidates is
unchanged; candidates that don't validate (16 digits that fail Luhn, 31 February) are
unchanged; texts of any length are read whole; repeated rows and other columns are
kept; of clashing names the column of kinds gets underscores until it is new; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ROUNDS = 8
#: Setting with the key, and the published key that test tables take where it is not set.
KEY, TEST_KEY = "spark.recallum.pii.key", "recallum"
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: Candidate patterns by kind; the first alternative that matches at a place counts.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]*+)@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "secret": r"(?<=[\"'])[0-9a-f]{32,64}(?=[\"'])",
    "iban": r"(?<![A-Za-z0-9])(?:[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)|[a-z]{2}\d{2}(?:[a-z0-9]{11,30}|(?: [a-z0-9]{4}){2,7}(?: [a-z0-9]{1,4})?))(?![A-Za-z0-9])",
    "ip": rf"(?<![\w.])(?:{OCTET}\.){{3}}{OCTET}(?![\w]|\.\d)",
    "ip6": r"(?<![\w:.])(?=[0-9A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5}|(?:[0-9A-Fa-f]{1,4}:){1}(?::[0-9A-Fa-f]{1,4}){2,6})(?![\w:]|\.\d)",
    "date": r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}(?:(?=T\d)|(?![\w/-]|\.\d))|(?:\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\w/-]|\.\d))",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w-])",
    "card": r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])",
}
#: The pattern of a match by itself, where that differs.
ALONE = {"secret": "[0-9a-f]{32,64}", "date": r"\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}"}
#: Country calling codes: the two-digit ones by first and second digit, 1 and 7, else three digits (fixed values).
CALLING = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
ALL = "|".join(f"(?:{p})" for p in PATTERNS.values())
DIGITS, LETTERS, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
EPOCH, DAYS = "1900-01-01", (270, 271)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often it is used there."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _prf(key: str, what: str, tweak: Column, i: Column, x: Column) -> Column:
    """59 pseudorandom bits of a half, as a bigint."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(what), tweak, i.cast("string"), x.cast("string")), 256), 1, 14), 16, 10).cast("bigint")


def _feistel(a: Column, b: Column, size_a: Column, size_b: Column, key: str, what: str, tweak: Column) -> Column:
    """Permute the pair (a, b) of [0, size_a) x [0, size_b); a struct of the two."""

    def step(s: Column, i: Column) -> Column:
        x, y = s["a"], s["b"]
        even = i % 2 == 0
        # 2^56 plus a half stays below 2^63: no overflow
        return F.struct(F.when(even, (x + _prf(key, what, tweak, i, y)) % size_a).otherwise(x).alias("a"), F.when(even, y).otherwise((y + _prf(key, what, tweak, i, x)) % size_b).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b")), step)


def _number(s: Column, alphabet: str) -> Column:
    """Value of a string of symbols; 0 for the empty one."""
    symbols = F.regexp_extract_all(s, F.lit("(?s)(.)"), F.lit(1))
    return F.aggregate(symbols, F.lit(0).cast("bigint"), lambda acc, c: acc * len(alphabet) + F.instr(F.lit(alphabet), c) - 1)


def _spelled(n: Column, width: Column, alphabet: str) -> Column:
    base = len(alphabet)
    digits = F.aggregate(
        F.sequence(F.lit(1), F.greatest(width, F.lit(1))),
        F.struct(n.alias("n"), F.lit("").alias("s")),
        lambda acc, _: F.struct(_div(acc["n"], base).alias("n"), F.concat(F.substring(F.lit(alphabet), (acc["n"] % base + 1).cast("int"), F.lit(1)), acc["s"]).alias("s")),
    )
    return F.when(width > 0, digits["s"]).otherwise(F.lit(""))


def _div(n: Column, base: int) -> Column:
    """Whole quotient of bigints, without a detour by doubles."""
    return F.call_function("div", n, F.lit(base).cast("bigint"))


def _permuted(s: Column, alphabet: str, key: str, what: str, tweak: Column, block: int) -> Column:
    """A string of symbols permuted, in blocks of at most `block` symbols; each block is tweaked by its place and the length."""

    def one(s: Column, k: Column) -> Column:
        return _let(F.substring(s, k + 1, F.lit(block)), lambda part: halves(part, F.concat_ws(",", tweak, k.cast("string"), F.length(s).cast("string"))))

    def halves(part: Column, place: Column) -> Column:
        n = F.length(part)
        left = F.floor(n / 2).cast("int")
        right = n - left
        size = lambda w: F.pow(F.lit(float(len(alphabet))), w).cast("bigint")  # noqa: E731  exact: below 2^53
        ab = _feistel(_number(F.substring(part, F.lit(1), left), alphabet), _number(F.substring(part, left + 1, right), alphabet), size(left), size(right), key, what, place)
        return _let(ab, lambda x: F.concat(_spelled(x["a"], left, alphabet), _spelled(x["b"], right, alphabet)))

    return _let(s, lambda s: F.when(s == "", s).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(F.length(s) - 1, F.lit(0)), F.lit(block)), lambda k: one(s, k)), "")))


def _laid(m: Column, symbols: Column, pattern: str) -> Column:
    """`m` with its characters that match `pattern` replaced by `symbols`, one by one; upper case stays."""

    def put(symbols: Column, c: Column, i: Column) -> Column:
        new = F.substring(symbols, F.length(F.regexp_replace(F.substring(m, F.lit(1), i + 1), f"[^{pattern}]", "")), F.lit(1))
        return F.when(c.rlike(f"[{pattern}]"), F.when(c.rlike("[A-Z]"), F.upper(new)).otherwise(new)).otherwise(c)

    return _let(symbols, lambda new: F.array_join(F.transform(F.regexp_extract_all(m, F.lit("(?s)(.)"), F.lit(1)), lambda c, i: put(new, c, i)), ""))


def _only(m: Column, pattern: str) -> Column:
    return F.regexp_replace(m, f"[^{pattern}]", "")


def _luhn(payload: Column) -> Column:
    """Check digit of a string of digits."""
    digits = F.regexp_extract_all(F.reverse(payload), F.lit("(.)"), F.lit(1))
    twice = F.transform(digits, lambda c, i: F.when(i % 2 == 0, F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int") + 1)).otherwise(c.cast("int")))
    return ((10 - F.aggregate(twice, F.lit(0), lambda acc, v: acc + v) % 10) % 10).cast("string")


def _mod97(s: Column) -> Column:
    """Remainder of an IBAN's rearranged digits and letters."""
    symbols = F.regexp_extract_all(s, F.lit("(.)"), F.lit(1))
    return F.aggregate(symbols, F.lit(0), lambda acc, c: F.when(c.rlike("[0-9]"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97))


def _card(m: Column, key: str) -> Column:
    def valid(d: Column) -> Column:
        n = F.length(d)
        kept = F.when(d.rlike("^[235]"), 2).otherwise(1)
        head, body = F.substring(d, F.lit(1), kept), F.substring(d, kept + 1, n - 1 - kept)
        payload = F.concat(head, _permuted(body, DIGITS, key, "card", head, 18))
        new = _let(payload, lambda p: F.concat(p, _luhn(p)))
        return F.when(F.substring(d, n, F.lit(1)) == _luhn(F.substring(d, F.lit(1), n - 1)), _laid(m, new, "0-9")).otherwise(m)

    return _let(_only(m, "0-9"), valid)


def _iban(m: Column, key: str) -> Column:
    def valid(flat: Column) -> Column:
        land, account = F.substring(flat, 1, 2), F.substring(flat, F.lit(5), F.length(flat))
        new = _laid(account, _permuted(_only(account, "0-9"), DIGITS, key, "iban", land, 18), "0-9")
        digits = _let(new, lambda x: F.concat(F.lpad((98 - _mod97(F.concat(x, land, F.lit("00")))).cast("string"), 2, "0"), _only(x, "0-9")))
        return F.when(_mod97(F.concat(account, F.substring(flat, 1, 4))) == 1, _laid(m, digits, "0-9")).otherwise(m)

    return _let(F.upper(F.regexp_replace(m, " ", "")), valid)


def _ip(m: Column, key: str) -> Column:
    ab = lambda o: _feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, "ip", F.lit(""))
    spelled = lambda x: F.concat_ws(".", _div(x["a"], 256).cast("string"), (x["a"] % 256).cast("string"), _div(x["b"], 256).cast("string"), (x["b"] % 256).cast("string"))
    return _let(_let(F.transform(F.split(m, r"\."), lambda c: c.cast("bigint")), ab), spelled)


def _ssn(m: Column, key: str) -> Column:
    def valid(p: Column) -> Column:
        area, group, serial = p[0], p[1], p[2]
        # 898 areas: 1 to 899 without 666
        index = (area - 1 - (area > 666).cast("int")) * 99 + group - 1
        ab = _feistel(index, serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn", F.lit(""))
        return F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), _let(ab, spelled)).otherwise(m)

    def spelled(x: Column) -> Column:
        place = _div(x["a"], 99)
        return F.concat_ws("-", F.lpad((place + 1 + (place >= 665).cast("int")).cast("string"), 3, "0"), F.lpad((x["a"] % 99 + 1).cast("string"), 2, "0"), F.lpad((x["b"] + 1).cast("string"), 4, "0"))

    return _let(F.transform(F.split(m, "-"), lambda c: c.cast("bigint")), valid)


def _date(m: Column, key: str) -> Column:
    """The notation is read as year-month-day, else day first if that is a date, else month first."""
    made = lambda y, mo, d: F.try_to_date(F.concat_ws("-", y, F.lpad(mo, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    iso = m.rlike("^[0-9]{4}-")
    sep = F.when(F.contains(m, F.lit(".")), F.lit(".")).otherwise(F.lit("/"))
    two = lambda x: F.when(F.length(m) == 10, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))

    def read(parts: Column) -> Column:
        day_first = made(parts[2], parts[1], parts[0])
        return _let(F.struct(F.when(iso, made(parts[0], parts[1], parts[2])).otherwise(F.coalesce(day_first, made(parts[2], parts[0], parts[1]))).alias("day"), day_first.isNotNull().alias("day_first")), moved)

    def moved(r: Column) -> Column:
        n = F.date_diff(r["day"], F.lit(EPOCH).cast("date")).cast("bigint")
        ab = _feistel(_div(n, DAYS[1]), n % DAYS[1], F.lit(DAYS[0]), F.lit(DAYS[1]), key, "date", F.lit(""))
        new = _let(ab, lambda x: F.date_add(F.lit(EPOCH).cast("date"), (x["a"] * DAYS[1] + x["b"]).cast("int")))
        return F.when(n.between(0, DAYS[0] * DAYS[1] - 1), _let(new, lambda d: spelled(d, r["day_first"]))).otherwise(m)

    def spelled(d: Column, day_first: Column) -> Column:
        a, b = two(F.day(d)), two(F.month(d))
        return F.when(iso, F.date_format(d, "yyyy-MM-dd")).otherwise(F.concat(F.when(day_first, a).otherwise(b), sep, F.when(day_first, b).otherwise(a), sep, F.date_format(d, "yyyy")))

    return _let(F.split(m, "[-/.]"), read)


def _phone(m: Column, key: str) -> Column:
    code = F.regexp_extract(_only(m, "0-9+"), CALLING, 1)
    digits = lambda d: F.concat(code, _permuted(F.substring(d, F.length(code) + 1, F.length(d)), DIGITS, key, "phone", code, 18))
    return _laid(m, _let(_only(m, "0-9"), digits), "0-9")


def _email(m: Column, key: str) -> Column:
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    low, place = F.lower(local), F.lower(domain)

    def named(letters: Column) -> Column:
        digits = _permuted(_only(low, "0-9"), DIGITS, key, "digits", F.concat_ws("@", letters, place), 18)
        return F.concat(_let(_laid(local, letters, "A-Za-z"), lambda x: _laid(x, digits, "0-9")), F.lit("@"), domain)

    return _let(_permuted(_only(low, "a-z"), LETTERS, key, "letters", F.concat_ws("@", _only(low, "0-9"), place), 20), named)


def _ip6(m: Column, key: str) -> Column:
    return _laid(m, _permuted(F.lower(_only(m, "0-9A-Fa-f")), HEX, key, "ip6", F.lit(""), 24), "0-9A-Fa-f")


def _secret(m: Column, key: str) -> Column:
    return _permuted(m, HEX, key, "secret", F.lit(""), 24)


KINDS: dict[str, Callable[[Column, str], Column]] = {"email": _email, "secret": _secret, "iban": _iban, "ip": _ip, "ip6": _ip6, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def key_of(spark: SparkSession) -> str:
    """The key in the session's settings; the published one serves tests only."""
    return spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY, TEST_KEY)


def _new(name: str, taken: list[str]) -> str:
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def pseudonyms(docs: DataFrame, key: str, text_col: str = "text", out: str | None = None, kinds_col: str = "pii_kinds") -> DataFrame:
    """`docs` with the values in `text_col` (or a copy of it in `out`) replaced, and the kinds of those that changed, in order, in `kinds_col` (or the next new name)."""
    kinds_col = _new(kinds_col, [*docs.columns, *([out] if out else [])])
    found_col = _new("pii_found", [*docs.columns, kinds_col, *([out] if out else [])])

    def one(m: Column) -> Column:
        kind = None
        for name in KINDS:
            test = m.rlike(f"^(?:{ALONE.get(name, PATTERNS[name])})$")
            kind = F.when(test, F.lit(name)) if kind is None else kind.when(test, F.lit(name))
        return _let(kind, lambda k: F.struct(F.coalesce(made(m, k), m).alias("new"), k.alias("kind"), m.alias("old")))

    def made(m: Column, k: Column) -> Column:
        new = None
        for name, make in KINDS.items():
            new = F.when(k == name, make(m, key)) if new is None else new.when(k == name, make(m, key))
        return new

    text = F.col(text_col)
    some = text.rlike("[0-9@]")
    found = F.when(some, F.transform(F.regexp_extract_all(text, F.lit(f"({ALL})"), F.lit(1)), one))
    rows = docs.withColumn(found_col, found)
    between = F.split(text, ALL, -1)
    spelled = F.array_join(F.transform(between, lambda gap, i: F.concat(gap, F.coalesce(F.get(F.col(f"{found_col}.new"), i), F.lit("")))), "")
    changed = F.filter(found_col, lambda x: x["new"] != x["old"])
    return rows.withColumns({out or text_col: F.when(F.size(found_col) > 0, spelled).otherwise(text), kinds_col: F.coalesce(F.transform(changed, lambda x: x["kind"]), F.array().cast("array<string>"))}).drop(found_col)

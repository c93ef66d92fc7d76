"""Format-preserving pseudonyms for personal data, in DataFrame operations only.

Mail addresses, card numbers (Luhn), IBANs (mod 97), IPv4 addresses, calendar
dates from 1900 to 2099 (also before the T of a time), US social security numbers and phone numbers are found
and validated, and each value is replaced by a keyed permutation of its own
format: a Feistel network over two residues whose moduli multiply to the number
of valid values, or over the two halves of a string, character class by character
class. Check digits are computed anew. The permutation is a bijection for a given
kind and key, so equal values get equal pseudonyms in all documents and different
ones stay different; a card number written with and without blanks is one value.
Of a mail address the part before the @ is permuted. Numbers that fail their
check are left alone. A very short local part (one or two letters) may map to
itself, as in any permutation of so few values.

Null texts stay null, empty ones empty. Every row is handled by itself, so ties,
repeated rows, null ids and extra columns need no care; other columns are kept
(columns named like a count are replaced). Pass a secret ``key`` in production.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.llm.common import fresh

KEY = "pseudonym-key-1"
ROUNDS = 8
KINDS = ("email", "ip", "date", "ssn", "iban", "phone", "intl", "card")

# What a value of each kind looks like.
_EDGE, _STOP = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_DAY, _MONTH, _YEAR = r"(?:0[1-9]|[12][0-9]|3[01])", r"(?:0[1-9]|1[0-2])", r"(?:19|20)[0-9]{2}"
_DATE_STOP = r"(?!(?![Tt][0-2][0-9])[0-9A-Za-z])"  # a time may follow
#: the countries whose IBANs have so many characters
IBANS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_ACCOUNTS = "|".join(
    rf"(?:{'|'.join(of.split())})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
    for n, of in IBANS.items()
)
PATTERNS = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@"
    # 32 labels at most, for the matcher's stack; of a longer address the part before the @ is found all the same
    r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,32}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    rf"(?<![0-9A-Za-z.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9A-Za-z]|\.[0-9])",
    *(rf"{_EDGE}{_YEAR}{s}{_MONTH}{s}{_DAY}{_DATE_STOP}" for s in ("-", "/", r"\.")),
    rf"{_EDGE}{_MONTH}/{_DAY}/{_YEAR}{_DATE_STOP}",
    rf"{_EDGE}{_DAY}\.{_MONTH}\.{_YEAR}{_DATE_STOP}",
    r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])",
    # the length of the country, so that the next word stays outside; other runs without blanks only
    rf"{_EDGE}(?=[A-Z]{{2}}[0-9]{{2}})(?:(?:{_ACCOUNTS})|[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{8,31}}){_STOP}",
    rf"{_EDGE}(?:\+?1[ .-]?)?(?:\([2-9][0-9]{{2}}\) ?|[2-9][0-9]{{2}}[ .-])[2-9][0-9]{{2}}[ .-][0-9]{{4}}{_STOP}",
    rf"(?<![0-9A-Za-z])\+[1-9][0-9]{{7,14}}{_STOP}",
    rf"{_EDGE}(?:[0-9]{{13,19}}|[0-9]{{4}}(?:[ -][0-9]{{4}}){{2}}[ -][0-9]{{1,7}}"
    rf"|3[47][0-9]{{2}}[ -][0-9]{{6}}[ -][0-9]{{5}}){_STOP}",
)
ANY = "|".join(f"(?:{p})" for p in PATTERNS)
FIRST_DAY, DAYS = "1900-01-01", (17, 4297)  # 17 * 4297 days, to 2099-12-31


def _digest(key: str, kind: str, r: Column, value: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), value), 256)


def _rounds() -> Column:
    return F.sequence(F.lit(1), F.lit(ROUNDS))


def feistel(key: str, kind: str, x: Column, y: Column, mx: Column, my: Column) -> Column:
    """A permutation of the pairs below (mx, my), as a struct of x and y."""

    def turn(s: Column, r: Column) -> Column:
        drawn = F.conv(F.substring(_digest(key, kind, r, s["y"].cast("string")), 1, 12), 16, 10)
        moved = F.pmod(s["x"] + drawn.cast("long"), s["mx"])
        return F.struct(s["y"].alias("x"), moved.alias("y"), s["my"].alias("mx"), s["mx"].alias("my"))

    long = lambda c, n: c.cast("long").alias(n)
    return F.aggregate(_rounds(), F.struct(long(x, "x"), long(y, "y"), long(mx, "mx"), long(my, "my")), turn)


def _shifted(text: Column, digest: Column) -> Column:
    """Each letter and digit moved within its class by a byte of the digest."""

    def char(i: Column) -> Column:
        c = F.substring(text, i, F.lit(1))
        by = F.conv(F.substring(digest, 2 * i - 1, F.lit(2)), 16, 10).cast("int")
        move = lambda first, n: F.chr(F.lit(first) + F.pmod(F.ascii(c) - first + by, F.lit(n)))
        return (
            F.when(c.rlike("[a-z]"), move(97, 26)).when(c.rlike("[A-Z]"), move(65, 26))
            .when(c.rlike("[0-9]"), move(48, 10)).otherwise(c)
        )

    places = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(places, char), "")


def text_feistel(key: str, kind: str, text: Column) -> Column:
    """A permutation of the strings with the classes of ``text`` (at most 64 characters)."""
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(
        F.substring(text, F.lit(1), half).alias("a"), F.substring(text, half + 1, F.length(text)).alias("b")
    )
    turn = lambda s, r: F.struct(
        s["b"].alias("a"), _shifted(s["a"], _digest(key, kind, r, s["b"])).alias("b")
    )
    done = F.aggregate(_rounds(), start, turn)
    return F.concat(done["a"], done["b"])


def _refilled(shape: Column, chars: str, new: Column) -> Column:
    """``shape`` with its characters of class ``chars`` taken from ``new`` in order."""

    def char(i: Column) -> Column:
        c = F.substring(shape, i, F.lit(1))
        at = F.length(F.regexp_replace(F.substring(shape, F.lit(1), i), f"[^{chars}]", ""))
        return F.when(c.rlike(f"[{chars}]"), F.substring(new, at, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), char), "")


def _padded(n: Column, width: Column | int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def _luhn(digits: Column, ends: int) -> Column:
    """The Luhn sum; ``ends`` is 1 if the check digit is there, 0 if it is still missing."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.pmod(n - i, F.lit(2)) == ends
        return F.when(twice, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), value), F.lit(0), lambda a, b: a + b)


def _mod97(text: Column) -> Column:
    """The remainder by 97 of a string whose letters count 10 to 35."""

    def step(acc: Column, i: Column) -> Column:
        c = F.substring(text, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), F.pmod(acc * 10 + F.ascii(c) - 48, F.lit(97))).otherwise(
            F.pmod(acc * 100 + F.ascii(c) - 55, F.lit(97))
        )

    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), step)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _email(m: Column, key: str) -> Column:
    local = F.substring_index(m, "@", 1)
    return F.concat(text_feistel(key, "email", local), F.lit("@"), F.substring_index(m, "@", -1))


def _ip(m: Column, key: str) -> Column:
    part = lambda i: F.get(F.split(m, r"\."), F.lit(i)).cast("long")
    new = feistel(key, "ip", part(0) * 256 + part(1), part(2) * 256 + part(3), F.lit(65536), F.lit(65536))
    octets = [f(new[c] / 256) if f is F.floor else F.pmod(new[c], F.lit(256)) for c in "xy" for f in (F.floor, None)]
    return F.concat_ws(".", *(o.cast("string") for o in octets))


def _day(m: Column) -> Column:
    """The date of a match, null if there is no such day."""
    d = lambda a, n: F.substring(m, a, n)
    iso = (
        F.when(m.rlike("^[0-9]{4}"), F.concat_ws("-", d(1, 4), d(6, 2), d(9, 2)))
        .when(m.contains("/"), F.concat_ws("-", d(7, 4), d(1, 2), d(4, 2)))
        .otherwise(F.concat_ws("-", d(7, 4), d(4, 2), d(1, 2)))
    )
    return iso.try_cast("date")


def _date(m: Column, key: str) -> Column:
    n = F.datediff(_day(m), F.lit(FIRST_DAY).cast("date")).cast("long")
    a, b = DAYS
    new = feistel(key, "date", F.floor(n / b), F.pmod(n, F.lit(b)), F.lit(a), F.lit(b))
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), (new["x"] * b + new["y"]).cast("int"))
    s = F.substring(m, 5, 1)
    form = lambda f: F.date_format(day, f)
    return (
        F.when(m.rlike("^[0-9]{4}"), F.concat(form("yyyy"), s, form("MM"), s, form("dd")))
        .when(m.contains("/"), form("MM/dd/yyyy"))
        .otherwise(form("dd.MM.yyyy"))
    )


def _ssn(m: Column, key: str) -> Column:
    part = lambda i: F.get(F.split(m, "-"), F.lit(i)).cast("long")
    area = part(0) - 1 - F.when(part(0) > 666, 1).otherwise(0)
    new = feistel(key, "ssn", area, (part(1) - 1) * 9999 + part(2) - 1, F.lit(898), F.lit(99 * 9999))
    back = new["x"] + 1 + F.when(new["x"] >= 665, 1).otherwise(0)
    return F.concat_ws(
        "-", _padded(back, 3), _padded(F.floor(new["y"] / 9999) + 1, 2), _padded(F.pmod(new["y"], F.lit(9999)) + 1, 4)
    )


def _iban_moved(m: Column) -> Column:
    """The account, the country and the check digits, as the check reads them."""
    plain = F.regexp_replace(m, " ", "")
    return F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))


def _iban(m: Column, key: str) -> Column:
    plain = F.regexp_replace(m, " ", "")
    account = text_feistel(key, "iban", F.substring(plain, F.lit(5), F.length(plain)))
    country = F.substring(plain, 1, 2)
    check = 98 - _mod97(F.concat(account, country, F.lit("00")))
    return _refilled(m, "A-Z0-9", F.concat(country, _padded(check, 2), account))


def _phone(m: Column, key: str) -> Column:
    all_digits = _digits(m)
    d = F.substring(all_digits, F.length(all_digits) - 9, F.lit(10))
    code = lambda a: F.substring(d, a, 3).cast("long") - 200
    n = (code(1) * 800 + code(4)) * 10000 + F.substring(d, 7, 4).cast("long")
    new = feistel(key, "phone", F.floor(n / 80000), F.pmod(n, F.lit(80000)), F.lit(80000), F.lit(80000))
    back = new["x"] * 80000 + new["y"]
    codes = F.floor(back / 10000)
    ten = F.concat(
        _padded(F.floor(codes / 800) + 200, 3), _padded(F.pmod(codes, F.lit(800)) + 200, 3),
        _padded(F.pmod(back, F.lit(10000)), 4),
    )
    return _refilled(m, "0-9", F.concat(F.substring(all_digits, F.lit(1), F.length(all_digits) - 10), ten))


def _number(digits: Column, key: str, kind: str) -> Column:
    """A permutation of the digit strings of one length."""
    n = F.length(digits)
    left = F.ceil(n / 2).cast("int")
    new = feistel(
        key, kind, F.substring(digits, F.lit(1), left).cast("long"), F.substring(digits, left + 1, n).cast("long"),
        _power(left), _power(n - left),
    )
    return F.concat(_padded(new["x"], left), _padded(new["y"], n - left))


def _intl(m: Column, key: str) -> Column:
    return F.concat(F.substring(m, 1, 2), _number(F.substring(m, F.lit(3), F.length(m)), key, "intl"))


def _card(m: Column, key: str) -> Column:
    digits = _digits(m)
    payload = _number(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
    check = F.pmod(-_luhn(payload, 0), F.lit(10))
    return _refilled(m, "0-9", F.concat(payload, check.cast("string")))


LOOKS: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: m.contains("@"),
    "ip": lambda m: m.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"),
    "date": lambda m: m.rlike(r"^([0-9]{4}([-/.])[0-9]{2}\2[0-9]{2}|[0-9]{2}([/.])[0-9]{2}\3[0-9]{4})$"),
    "ssn": lambda m: m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"),
    "iban": lambda m: m.rlike("^[A-Z]"),
    "phone": lambda m: m.rlike(r"^(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}$"),
    "intl": lambda m: m.startswith("+"),
    "card": lambda m: F.lit(True),
}
VALID: dict[str, Callable[[Column], Column]] = {
    "date": lambda m: _day(m).isNotNull(),
    "iban": lambda m: _mod97(_iban_moved(m)) == 1,
    "card": lambda m: F.pmod(_luhn(_digits(m), 1), F.lit(10)) == 0,
}
MAKE = dict(zip(KINDS, (_email, _ip, _date, _ssn, _iban, _phone, _intl, _card), strict=True))


def pseudonymise(docs: DataFrame, text_col: str = "text", key: str = KEY) -> DataFrame:
    """``docs`` with the new text, and counts ``n_<kind>`` of the values replaced."""
    text, held = F.col(text_col), fresh(docs.columns, "_found")
    hits = F.when(text.rlike(ANY), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))

    def kind_of(m: Column) -> Column:
        kind = F.lit(None).cast("string")
        for k in reversed(KINDS):
            valid = VALID[k](m) if k in VALID else F.lit(True)
            kind = F.when(LOOKS[k](m), F.when(valid, F.lit(k))).otherwise(kind)
        return kind

    def made(h: Column) -> Column:
        new = h["m"]
        for k in KINDS:
            new = F.when(h["kind"] == k, MAKE[k](h["m"], key)).otherwise(new)
        return new

    found = F.transform(hits, lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind")))
    pieces = F.arrays_zip(
        F.split(text, ANY, -1).alias("gap"), F.transform(held, made).alias("new")
    )
    joined = F.array_join(
        F.flatten(F.transform(pieces, lambda p: F.array(p["gap"], F.coalesce(p["new"], F.lit(""))))), ""
    )
    count = lambda k: F.coalesce(
        F.size(F.filter(held, lambda h: h["kind"] == k)), F.lit(0)
    ).cast("long")
    return (
        docs.withColumn(held, found)
        .withColumns({text_col: F.when(F.col(held).isNull(), text).otherwise(joined)} | {f"n_{k}": count(k) for k in KINDS})
        .drop(held)
    )


def op10_pseudonyms(spark, sf_dir: str) -> DataFrame:
    """doc_id, the pseudonymised text and the number of values replaced of each kind."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymise(docs)

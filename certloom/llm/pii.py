"""Format-preserving pseudonyms for personal numbers, dates and mail names.

Each validated value is permuted within its own format by a keyed Feistel network, so equal values have equal
pseudonyms in every document, and different values different ones. SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

ROUNDS = 8
KINDS = ("email", "ip", "date", "ssn", "phone", "card")
#: Fixed patterns, in the order in which they are tried. None begins or ends within a longer run of digits.
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,6}\.[A-Za-z]{2,24}",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9]|[./-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?!-?[0-9])",
    "phone": r"(?<![0-9+])(?:\+1[ .-]?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}|(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2})[ .-][0-9]{4}(?!-?[0-9])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])",
}
ANY = "|".join(PATTERNS[k] for k in KINDS)
#: Days of the Gregorian cycle of 400 years from 1800-01-01: 189 * 773.
FIRST_DAY, DATE_A, DATE_B = "1800-01-01", 189, 773


def _prf(key: Column, *parts: Column) -> Column:
    """A keyed 60-bit number."""
    text = F.concat_ws("|", key, *[p.cast("string") for p in parts], key)
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("bigint")


def permute(a: Column, size_a: Column, b: Column, size_b: Column, key: Column, tag: str) -> Column:
    """A keyed permutation of pairs (a, b) with 0 <= a < size_a, 0 <= b < size_b, as struct<a, b>."""

    def step(s: Column, r: Column) -> Column:
        even = r % 2 == 0
        fa = F.pmod(s["a"] + F.pmod(_prf(key, F.lit(tag), r, s["b"]), size_a), size_a)
        fb = F.pmod(s["b"] + F.pmod(_prf(key, F.lit(tag), r, s["a"]), size_b), size_b)
        return F.struct(F.when(even, fa).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise(fb).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b")), step)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn_sum(digits: Column, check_missing: bool) -> Column:
    """Luhn sum of a digit string; check_missing: as if a check digit 0 came after it."""
    n = F.length(digits)
    parity = 1 if check_missing else 0

    def step(total: Column, i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when((i + parity) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step)


def _refill(form: Column, digits: Column) -> Column:
    """form with its digits replaced, in order, by those of digits."""
    return F.array_join(
        F.transform(
            F.sequence(F.lit(1), F.length(form)),
            lambda i: F.when(F.substr(form, i, F.lit(1)).rlike("[0-9]"), F.substr(digits, F.length(_digits(F.substr(form, F.lit(1), i))), F.lit(1))).otherwise(F.substr(form, i, F.lit(1))),
        ),
        "",
    )


def _pad(x: Column, n: Column | int) -> Column:
    return F.lpad(x.cast("string"), F.lit(n) if isinstance(n, int) else n, F.lit("0"))


def _card(x: Column, key: Column) -> Column:
    d = _digits(x)
    n = F.length(d) - 1  # without the check digit
    half = F.floor(n / 2).cast("int")
    s = permute(F.substr(d, F.lit(1), half).cast("bigint"), F.pow(F.lit(10.0), half).cast("bigint"), F.substr(d, half + 1, n - half).cast("bigint"), F.pow(F.lit(10.0), n - half).cast("bigint"), key, "card")
    body = F.transform(F.array(s), lambda s: F.concat(_pad(s["a"], half), _pad(s["b"], n - half)))
    whole = F.element_at(F.transform(body, lambda b: F.concat(b, F.pmod(10 - F.pmod(_luhn_sum(b, True), F.lit(10)), F.lit(10)).cast("string"))), 1)
    return F.when(F.pmod(_luhn_sum(d, False), F.lit(10)) == 0, F.element_at(F.transform(F.array(whole), lambda w: _refill(x, w)), 1))


def _phone(x: Column, key: Column) -> Column:
    """After +1 any area and exchange; those that begin with 0 or 1, that is under 200, stay so."""
    d = F.right(_digits(x), F.lit(10))
    area, exchange = (F.substr(d, F.lit(i), F.lit(3)).cast("bigint") for i in (1, 4))
    low_a, low_b = (F.when(c < 200, 0).otherwise(200) for c in (area, exchange))
    size_a, size_b = (F.when(c < 200, 200).otherwise(800) for c in (area, exchange))
    s = permute(area - low_a, size_a, (exchange - low_b) * 10000 + F.substr(d, F.lit(7), F.lit(4)).cast("bigint"), size_b * 10000, key, "phone")
    code = F.when(F.length(_digits(x)) == 11, "1").otherwise("")
    return F.element_at(F.transform(F.array(s), lambda s: _refill(x, F.concat(code, _pad(s["a"] + low_a, 3), _pad(F.floor(s["b"] / 10000) + low_b, 3), _pad(s["b"] % 10000, 4)))), 1)


def _ssn(x: Column, key: Column) -> Column:
    area, group, serial = (F.substr(x, F.lit(i), F.lit(n)).cast("bigint") for i, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    a = area - 1 - F.when(area > 666, 1).otherwise(0)
    s = permute(a, F.lit(898), (group - 1) * 9999 + serial - 1, F.lit(99 * 9999), key, "ssn")
    out = F.transform(F.array(s), lambda s: F.concat_ws("-", _pad(s["a"] + 1 + F.when(s["a"] >= 665, 1).otherwise(0), 3), _pad(F.floor(s["b"] / 9999) + 1, 2), _pad(s["b"] % 9999 + 1, 4)))
    return F.when(valid, F.element_at(out, 1))


def _ip(x: Column, key: Column) -> Column:
    o = F.transform(F.split(x, "[.]"), lambda p: p.cast("bigint"))
    s = permute(o[0] * 256 + o[1], F.lit(65536), o[2] * 256 + o[3], F.lit(65536), key, "ip")
    out = F.transform(F.array(s), lambda s: F.concat_ws(".", F.floor(s["a"] / 256).cast("string"), (s["a"] % 256).cast("string"), F.floor(s["b"] / 256).cast("string"), (s["b"] % 256).cast("string")))
    return F.when(F.forall(o, lambda p: p < 256), F.element_at(out, 1))


def _date(x: Column, key: Column) -> Column:
    """yyyy-MM-dd, dd.MM.yyyy or dd/MM/yyyy; what with slashes only MM/dd/yyyy can be (a day over 12) is a format of its own."""
    iso = F.when(x.rlike("^[0-9]{4}"), x).otherwise(F.concat_ws("-", F.substr(x, F.lit(7), F.lit(4)), F.substr(x, F.lit(4), F.lit(2)), F.substr(x, F.lit(1), F.lit(2))))
    day = F.datediff(F.to_date(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd"))), F.lit(FIRST_DAY).cast("date")).cast("bigint")
    s = permute(F.floor(day / DATE_B), F.lit(DATE_A), day % DATE_B, F.lit(DATE_B), key, "date")
    new = F.transform(F.array(s), lambda s: F.date_add(F.lit(FIRST_DAY).cast("date"), (s["a"] * DATE_B + s["b"]).cast("int")))
    sep = F.substr(x, F.lit(3), F.lit(1))
    out = F.transform(new, lambda d: F.when(x.rlike("^[0-9]{4}"), F.date_format(d, "yyyy-MM-dd")).otherwise(F.concat(F.date_format(d, "dd"), sep, F.date_format(d, "MM"), sep, F.date_format(d, "yyyy"))))
    return F.when(day.between(0, DATE_A * DATE_B - 1), F.element_at(out, 1)).when(x.rlike("^(0[1-9]|1[0-2])/(1[3-9]|2[0-9]|3[01])/(1[89]|2[01])[0-9]{2}$"), _month_first(x, key))


MONTHS, DAYS, STEPS = 4800, 19, 24


def _month_first(x: Column, key: Column) -> Column:
    """MM/dd/yyyy with a day of 13 to 31 among all such dates of 400 years: pairs of month and day are permuted until they are a date (97 of 100 are; after STEPS all but 1 of 10^36). Null if x is no date."""

    def dated(a: Column, b: Column) -> Column:
        first = F.make_date(F.lit(1800) + F.floor(a / 12).cast("int"), (a % 12 + 1).cast("int"), F.lit(1))
        return F.dayofmonth(F.last_day(first)) >= b + 13

    def step(s: Column, _: Column) -> Column:
        moved = permute(s["a"], F.lit(MONTHS), s["b"], F.lit(DAYS), key, "month")
        fresh = F.element_at(F.transform(F.array(moved), lambda m: F.struct(m["a"].alias("a"), m["b"].alias("b"), dated(m["a"], m["b"]).alias("done"))), 1)
        return F.when(s["done"], s).otherwise(fresh)

    a = (F.substr(x, F.lit(7), F.lit(4)).cast("bigint") - 1800) * 12 + F.substr(x, F.lit(1), F.lit(2)).cast("bigint") - 1
    b = F.substr(x, F.lit(4), F.lit(2)).cast("bigint") - 13
    s = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(a.alias("a"), b.alias("b"), F.lit(False).alias("done")), step)
    out = F.transform(F.array(s), lambda s: F.when(s["done"], F.concat_ws("/", _pad(s["a"] % 12 + 1, 2), _pad(s["b"] + 13, 2), _pad(F.floor(s["a"] / 12) + 1800, 4))))
    return F.when(dated(a, b), F.element_at(out, 1))


_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _shift(c: Column, by: Column) -> Column:
    """A digit or letter moved on within its class; other characters stay."""
    out = c
    for chars in _CLASSES:
        at = F.instr(F.lit(chars), c)
        out = F.when((at > 0) & (c != ""), F.substr(F.lit(chars), (F.pmod(at - 1 + by, F.lit(len(chars))) + 1).cast("int"), F.lit(1))).otherwise(out)
    return out


def _email(x: Column, key: Column) -> Column:
    """The name before the @, character by character: each half shifts by a keyed stream that the other half gives."""
    name, host = F.substring_index(x, "@", 1), F.substring_index(x, "@", -1)
    half = F.floor(F.length(name) / 2).cast("int")

    def moved(half_: Column, other: Column, r: Column) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(half_), F.lit(1))), lambda i: _shift(F.substr(half_, i, F.lit(1)), F.pmod(_prf(key, F.lit("email"), r, i, F.length(half_), other), F.lit(10 * 26)))), "")

    def step(s: Column, r: Column) -> Column:
        even = r % 2 == 0
        return F.struct(F.when(even, moved(s["a"], s["b"], r)).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise(moved(s["b"], s["a"], r)).alias("b"))

    s = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(F.substr(name, F.lit(1), half).alias("a"), F.substr(name, half + 1, F.length(name)).alias("b")), step)
    return F.element_at(F.transform(F.array(s), lambda s: F.concat(s["a"], s["b"], F.lit("@"), host)), 1)


_NEW = {"email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def _kind(x: Column) -> Column:
    out = F.lit(None).cast("string")
    for k in reversed(KINDS):
        out = F.when(x.rlike(f"^(?:{PATTERNS[k]})$"), k).otherwise(out)
    return out


def pseudonym(x: Column, key: Column) -> Column:
    """struct<kind, new> of a string that ANY matches; both are null if it does not validate (calendar, Luhn, octets, areas)."""
    kind = _kind(x)
    found = F.struct(kind.alias("kind"))
    new = F.lit(None).cast("string")
    for k in KINDS:
        new = F.when(found["kind"] == k, _NEW[k](x, key)).otherwise(new)
    return F.element_at(F.transform(F.array(new), lambda n: F.struct(F.when(n.isNotNull(), kind).alias("kind"), n.alias("new"))), 1)


def pseudonymise(docs: DataFrame, key: str, text: str = "text", names: tuple[str, str] = ("text", "found")) -> DataFrame:
    """docs, with every validated value in text replaced (column names[0]) and the kinds found, in order (names[1]).

    A null text stays null and has none. Values that do not validate stay. Texts of any length are taken whole; other columns
    stay, unless they have a name in names.
    """
    secret = F.lit(key)
    t = F.col(text)
    hit = t.rlike("[0-9@]")
    matches = F.when(hit, F.regexp_extract_all(t, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    (found,) = common.fresh(docs, "found")
    out = docs.withColumn(found, F.transform(matches, lambda m: F.struct(m.alias("old"), pseudonym(m, secret).alias("got"))))
    pieces = F.split(t, ANY, -1)
    parts = F.zip_with(pieces, F.col(found), lambda p, f: F.concat(p, F.coalesce(f["got"]["new"], f["old"], F.lit(""))))
    new = F.when(F.size(found) > 0, F.array_join(parts, "")).otherwise(t)
    kinds = F.coalesce(F.filter(F.transform(found, lambda f: f["got"]["kind"]), lambda k: k.isNotNull()), F.array().cast("array<string>"))
    return out.withColumns({names[0]: new, names[1]: kinds}).drop(found)


def _count(kind: str) -> Column:
    return F.size(F.filter("found", lambda k: k == kind)).cast("bigint")


def digest(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, the text with pseudonyms, and how many of each kind it has."""
    out = pseudonymise(docs.select("doc_id", "text"), key)
    return out.select("doc_id", "text", F.size("found").cast("bigint").alias("n_found"), *[_count(n).alias(f"n_{n}") for n in KINDS])

"""Domain names as column expressions: normal form, validity, labels, registrable part, tokens, look-alike skeleton."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unicode white space, which the normal form strips at both ends.
_SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
LABEL = "[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?"
#: A name that is its own normal form.
_NORMAL = rf"^({LABEL}[.])+{LABEL}\z"
#: Suffixes of more than one label that name registries; a last label alone is always one.
MULTI_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "co.nz", "com.br", "com.cn", "co.in", "co.za", "com.mx", "com.tr", "github.io", "herokuapp.com")


def trimmed(raw: Column) -> Column:
    return F.regexp_replace(raw, f"^{_SPACE}+|{_SPACE}+$", "")


def _stripped(raw: Column) -> Column:
    return F.regexp_replace(trimmed(raw), "[.]+$", "")


def is_wildcard(raw: Column) -> Column:
    return raw.rlike(rf"^{_SPACE}*[*][.]")


def is_ascii(raw: Column) -> Column:
    return raw.rlike(r"^[\x00-\x7F]*$")


def unchecked(raw: Column) -> Column:
    """The normal form, valid or not: no outer white space, no dots at the end, no leading '*.', lower case."""
    return F.lower(F.regexp_replace(_stripped(raw), r"^(\*\.)+", ""))


def bound(value: Column, make: Callable[[Column], Column]) -> Column:
    """make(value) with the value computed once, however often make uses it."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def is_normal(raw: Column) -> Column:
    """Whether a name is valid and its own normal form: the usual case, told by one look."""
    return raw.rlike(_NORMAL) & (F.octet_length(raw) <= 253)


def problem(raw: Column) -> Column:
    """Why a raw name is not a domain, null if it is one. The first reason counts."""
    return F.when(is_normal(raw), F.lit(None).cast("string")).otherwise(_looked_at(raw, lambda reason, _: reason))


def looked_at(raw: Column) -> Column:
    """struct<problem, form> of a raw name, what problem and normalize tell of it by one look; form is the domain only where problem is null."""
    both = lambda reason, form: F.struct(reason.alias("problem"), form.alias("form"))
    return F.when(is_normal(raw), both(F.lit(None).cast("string"), raw)).otherwise(_looked_at(raw, both))


def _looked_at(raw: Column, make: Callable[[Column, Column], Column]) -> Column:
    """make(problem, normal form) of a raw name; each form of it is computed once."""
    bare = lambda plain: F.regexp_replace(plain, r"^(\*\.)+", "")
    return bound(_stripped(raw), lambda plain: bound(bare(plain), lambda rest: bound(F.lower(rest), lambda name: make(_reason(raw, plain, rest, name), name))))


def _reason(raw: Column, plain: Column, rest: Column, name: Column) -> Column:
    labels = F.split(name, "[.]")
    bad_label = F.try_element_at(
        F.filter(
            F.transform(
                labels,
                lambda x: F.when(x == "", "empty label").when(F.octet_length(x) > 63, "label too long").when(~x.rlike("^[A-Za-z0-9-]+$"), "invalid characters in label").when(F.startswith(x, F.lit("-")) | F.endswith(x, F.lit("-")), "hyphen at the edge of label"),
            ),
            lambda r: r.isNotNull(),
        ),
        F.lit(1),
    )
    return (
        F.when(raw.isNull(), "null")
        .when(plain == "", "empty")
        .when(F.contains(rest, F.lit("*")), "wildcard inside")
        .when(name == "", "empty")
        .when(F.octet_length(name) > 253, "too long")
        .when(~F.contains(name, F.lit(".")), "no dot")
        .when(name.rlike(r"[\s\p{Cntrl}]"), "white space or control character")
        .when(name.rlike(r"[/\\:@#?]"), "forbidden character")
        .otherwise(bad_label)
    )


def normalize(raw: Column) -> Column:
    """The domain of an ASCII name, null if it is not valid. Names with other letters or xn-- labels: see with_idn."""
    return F.when(is_normal(raw), raw).otherwise(_looked_at(raw, lambda reason, name: F.when(reason.isNull(), name)))


def has_idn(domain: Column) -> Column:
    return F.startswith(domain, F.lit("xn--")) | F.contains(domain, F.lit(".xn--"))


def labels(domain: Column) -> Column:
    return F.split(domain, "[.]")


def suffix_size(domain: Column, multi: tuple[str, ...] = MULTI_SUFFIXES) -> Column:
    """Labels of the public suffix: two if multi has the last two, else one."""
    last_two = F.substring_index(domain, ".", -2)
    return F.when(last_two.isin(*multi), 2).otherwise(1) if multi else F.lit(1)


def registrable(domain: Column, multi: tuple[str, ...] = MULTI_SUFFIXES) -> Column:
    """The public suffix and one label more; the whole name if it is itself a suffix."""
    return F.when(suffix_size(domain, multi) == 2, F.substring_index(domain, ".", -3)).otherwise(F.substring_index(domain, ".", -2))


def registrable_label(domain: Column, multi: tuple[str, ...] = MULTI_SUFFIXES) -> Column:
    return F.substring_index(registrable(domain, multi), ".", 1)


def registrable_by_join(df: DataFrame, rules: DataFrame, domain: str = "domain", broadcast_below: int = 200_000) -> DataFrame:
    """df with a column registrable, by the rules (suffix, kind: rule, wildcard or exception) of a public suffix list.

    Each distinct name is tried with all its endings, at most as many as it has labels, in an equi-join; the rules are
    broadcast if there are fewer than broadcast_below, else joined by shuffle.
    """
    names = df.select(F.col(domain).alias("__name")).where("__name is not null").distinct()
    parts = F.split("__name", "[.]")
    n = F.size(parts)
    ends = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("n"), F.array_join(F.slice(parts, n - i + 1, i), ".").alias("suffix")))
    tried = names.select("__name", F.explode(ends).alias("e")).select("__name", "e.n", F.col("e.suffix").alias("suffix"))
    small = rules.limit(broadcast_below + 1).count() <= broadcast_below
    hit = tried.join(F.broadcast(rules) if small else rules, "suffix")
    depth = F.max(F.when(F.col("kind") == "exception", 1000 + F.col("n") - 1).when(F.col("kind") == "wildcard", F.col("n") + 1).otherwise(F.col("n")))
    depth = hit.groupBy("__name").agg(depth.alias("__depth"))
    own = F.split(F.col(domain), "[.]")
    size = F.coalesce(F.pmod("__depth", F.lit(1000)), F.lit(1))
    joined = df.join(depth, df[domain] == depth["__name"], "left")
    return joined.withColumn("registrable", F.array_join(F.slice(own, F.greatest(F.size(own) - size, F.lit(1)), F.least(size + 1, F.size(own))), ".")).drop("__name", "__depth")


def public_suffix_rules(lines: list[str]) -> list[tuple[str, str]]:
    """(suffix, kind) of the lines of a public suffix list."""
    out = []
    for line in lines:
        rule = line.split("//")[0].strip().lower()
        if rule.startswith("*."):
            out.append((rule[2:], "wildcard"))
        elif rule.startswith("!"):
            out.append((rule[1:], "exception"))
        elif rule:
            out.append((rule, "rule"))
    return out


def tokens(domain: Column) -> Column:
    """Each label and its alphanumeric parts, without repeats, in order."""
    parts = F.transform(F.split(F.lower(domain), "[.]"), lambda x: F.concat(F.array(x), F.split(x, "[^a-z0-9]")))
    return F.array_distinct(F.filter(F.flatten(parts), lambda x: x != ""))


def skeleton(name: Column) -> Column:
    """The look-alike skeleton of an ASCII name: characters that are drawn alike become one."""
    return F.replace(F.translate(F.lower(name), "10", "lo"), F.lit("m"), F.lit("rn"))


def skeleton_labels(skeleton_: Column) -> Column:
    return F.filter(tokens(skeleton_), lambda x: F.octet_length(x) >= 3)


#: Letters that look like ASCII ones.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "і": "i", "ӏ": "l", "ɑ": "a", "α": "a", "℮": "e", "ℯ": "e", "ο": "o", "օ": "o",
    "ρ": "p", "ϲ": "c", "×": "x", "Ⅰ": "i", "ⅼ": "l", "Ι": "l", "у": "y", "ԁ": "d", "ԍ": "g", "һ": "h", "ո": "n", "ԛ": "q", "ѕ": "s", "ᴠ": "v",
}


#: Of these the ones that count where a list of one's own cannot be read.
FEW_LOOKALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "і": "i", "ӏ": "l"}


def lookalikes_of(text: str) -> dict[str, str]:
    """Look-alikes of a JSON object of single characters; FEW_LOOKALIKES if it is none, or has anything else in it."""
    try:
        found = json.loads(text)
    except ValueError:
        return FEW_LOOKALIKES
    ok = isinstance(found, dict) and all(isinstance(v, str) and len(k) == len(v) == 1 for k, v in found.items())
    return dict(sorted(found.items())) if ok else FEW_LOOKALIKES


def glyphs(name: Column, table: dict[str, str] = LOOKALIKES) -> Column:
    """array<struct<glyph, letter>> of look-alike letters, in order, with repeats."""
    keys, values = "".join(table), "".join(table.values())
    found = F.filter(F.split(name, ""), lambda c: F.contains(F.lit(keys), c) & (c != ""))
    return F.transform(found, lambda c: F.struct(c.alias("glyph"), F.translate(c, keys, values).alias("letter")))


def mixes_scripts(name: Column) -> Column:
    return name.rlike("[A-Za-z]") & name.rlike(r"[\p{IsAlphabetic}&&[^\x00-\x7F]]")


def undo_digits(x: Column) -> Column:
    """Digits that stand for letters, as letters."""
    return F.translate(x, "013457", "oleast")


def edit_distance(a: Column, b: Column, most: int | None = None) -> Column:
    """Insertions, deletions and changes from a to b; with most, -1 beyond it, which is found out early."""
    return F.levenshtein(a, b) if most is None else F.levenshtein(a, b, most)


def osa_distance(a: Column, b: Column) -> Column:
    """Optimal string alignment distance: insertions, deletions, changes, and swaps of neighbours that are not edited again.

    Without a pair of neighbours of b the other way round in a, nothing can be swapped, and the plain distance is the same.
    """
    n, m = F.length(a), F.length(b)
    at = lambda s, i: F.substr(s, i, F.lit(1))

    def row(s: Column, i: Column) -> Column:
        def cell(cells: Column, j: Column) -> Column:
            cost = F.when(at(a, i) == at(b, j), 0).otherwise(1)
            swap = F.when((i > 1) & (j > 1) & (at(a, i) == at(b, j - 1)) & (at(a, i - 1) == at(b, j)), F.get(s["before"], j - 2) + 1)
            return F.concat(cells, F.array(F.least(F.get(s["last"], j) + 1, F.get(cells, j - 1) + 1, F.get(s["last"], j - 1) + cost, swap)))

        return F.struct(s["last"].alias("before"), F.aggregate(F.sequence(F.lit(1), m), F.array(i), cell).alias("last"))

    start = F.struct(F.sequence(F.lit(0), m).alias("before"), F.sequence(F.lit(0), m).alias("last"))
    full = F.aggregate(F.sequence(F.lit(1), n), start, row, lambda s: F.get(s["last"], m))
    plain = F.levenshtein(a, b)
    swaps = F.exists(F.sequence(F.lit(1), F.greatest(m - 1, F.lit(1))), lambda i: F.contains(a, F.concat(at(b, i + 1), at(b, i))))
    return F.when(n == 0, m).when(m == 0, n).when((plain <= 1) | ~swaps, plain).otherwise(full)


def squat_candidates(label: Column, keywords: list[str]) -> Column:
    """The label, its parts, and what is left of it without each keyword and the hyphen beside it; three letters or more."""
    found = F.concat(F.array(label), F.split(label, "[^A-Za-z0-9]"))
    variants = [v for k in keywords for v in (f"-{k}", f"{k}-", f"_{k}", f"{k}_")]
    if variants:
        stripped = F.transform(F.array(*map(F.lit, variants)), lambda v: F.when(F.contains(label, v), F.replace(label, v, F.lit(""))).otherwise(""))
        found = F.when(label.rlike("[-_]"), F.concat(found, stripped)).otherwise(found)
    return F.array_distinct(F.filter(F.transform(found, F.lower), lambda x: F.octet_length(x) >= 3))


def matches_suffix(domain: Column, suffix: str) -> Column:
    s = suffix.strip(".").lower()
    d = F.lower(F.regexp_replace(domain, r"^[.]+|[.]+$", ""))
    return (d == s) | F.endswith(d, F.lit(f".{s}"))


def dns_name(x: Column) -> Column:
    return F.lower(F.regexp_replace(trimmed(x), "[.]+$", ""))


def severity(score: Column) -> Column:
    return F.when(score <= 19, "info").when(score <= 39, "low").when(score <= 69, "medium").when(score <= 89, "high").otherwise("critical")


SEVERITIES = ("info", "low", "medium", "high", "critical")


def severity_rank(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), name).cast("int") - 1


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), rank + 1)


def redact_url(url: Column) -> Column:
    scheme, host = F.try_parse_url(url, F.lit("PROTOCOL")), F.try_parse_url(url, F.lit("HOST"))
    return F.when(scheme.isNotNull(), F.concat(F.lower(scheme), F.lit("://"), F.coalesce(F.lower(host), F.lit("host")), F.lit("/[redacted]"))).otherwise("[redacted]")


def rfc3339(millis: Column) -> Column:
    """UTC time of milliseconds since 1970, fractions without trailing zeros; the epoch if there is no such time."""
    whole = F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd'T'HH:mm:ss")
    part = F.pmod(millis, F.lit(1000))
    digits = F.regexp_replace(F.lpad(part.cast("string"), 3, "0"), "0+$", "")
    ok = millis.between(-62167219200000, 253402300799999)
    return F.when(ok, F.concat(whole, F.when(part != 0, F.concat(F.lit("."), digits)).otherwise(""), F.lit("Z"))).otherwise("1970-01-01T00:00:00Z")


def classify_dns_error(message: Column) -> Column:
    m = F.lower(message)
    has = lambda *words: F.greatest(*[F.contains(m, F.lit(w)) for w in words], F.lit(False), F.lit(False))
    return (
        F.when(has("nxdomain", "name does not exist", "non-existent domain", "non existent domain"), "nx_domain")
        .when(has("no records found", "no error", "not found"), "no_data")
        .when(has("servfail", "server failure"), "serv_fail")
        .when(has("refused"), "refused")
        .when(has("timed out", "timeout"), "timeout")
        .otherwise("transport_error")
    )

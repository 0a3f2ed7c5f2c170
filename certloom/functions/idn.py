"""Internationalised names: the few rows that need Unicode rules go through Arrow, all others stay in the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ship import ship
from . import domains as D


#: Letters that IDNA keeps though case folding or compatibility would change or drop them.
KEPT = "ß\u03c2\u200c\u200d"


def mapped(name: str) -> str:
    """Case and compatibility forms as UTS 46 maps them for lookup: what is ignorable goes, full stops of all scripts are dots."""
    out = []
    for c in name.replace("\u1e9e", "ß"):
        if c in KEPT:
            out.append(c)
        elif unicodedata.category(c) != "Cf" and not 0xFE00 <= ord(c) <= 0xFE0F and c != "\u034f":
            out.append(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", c).casefold()))
    return unicodedata.normalize("NFC", "".join(out)).replace("\u3002", ".")


def _allowed(label: str) -> bool:
    """No leading mark, and no code points that a label cannot have: unassigned, control, private, blank, the sign for what could not be read."""
    return bool(label) and "\ufffd" not in label and unicodedata.category(label[0])[0] != "M" and not any(unicodedata.category(c)[0] in "CZ" and c not in KEPT for c in label)


def to_ascii(name: str) -> str | None:
    """The ASCII form of a name, None if a label cannot have one."""
    out = []
    for label in mapped(name).split("."):
        try:
            if label.isascii():
                if label.startswith("xn--"):
                    decoded = label[4:].encode().decode("punycode")
                    if decoded.isascii() or mapped(decoded) != decoded or not _allowed(decoded) or "xn--" + decoded.encode("punycode").decode() != label:
                        return None
                out.append(label)
            elif _allowed(label):
                out.append("xn--" + label.encode("punycode").decode())
            else:
                return None
        except UnicodeError:
            return None
    return ".".join(out)


def to_unicode(domain: str) -> str:
    """The readable form; a name that has none stays as it is."""
    try:
        return ".".join(x[4:].encode().decode("punycode") if x.startswith("xn--") else x for x in domain.lower().split("."))
    except UnicodeError:
        return domain.lower()


_confusables: dict[str, dict[str, str]] = {}


def confusables(spark: SparkSession) -> dict[str, str]:
    """What each non-ASCII character that is like others becomes in a UTS 39 skeleton: asked of ICU, which Spark brings, in one call."""
    app = spark.sparkContext.applicationId
    if app not in _confusables:
        chars = [chr(i) for i in range(0x80, 0x30000) if unicodedata.category(chr(i))[0] in "LNSP" and unicodedata.normalize("NFD", chr(i)) == chr(i)]
        shapes = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton("\n".join(chars)).split("\n")
        _confusables[app] = {c: x for c, x in zip(chars, shapes, strict=True) if c != x}
    return _confusables[app]


#: What lower-case ASCII characters become in a skeleton.
ASCII_SHAPES = {"0": "O", "1": "l", "m": "rn"}


def skeleton_of(name: str, table: dict[str, str]) -> str:
    """The UTS 39 skeleton of a Unicode name, in lower case. table: of confusables()."""
    shapes = "".join(table.get(c) or ASCII_SHAPES.get(c, c) for c in unicodedata.normalize("NFD", name))
    return unicodedata.normalize("NFD", shapes).lower()


def _mapped(names: pd.Series, make: Callable[[str], str | None]) -> pd.Series:
    return pd.Series([None if x is None or x != x else make(x) for x in names.tolist()], dtype=object)


@F.pandas_udf(T.StringType())
def _ascii(names: pd.Series) -> pd.Series:
    return _mapped(names, to_ascii)


@F.pandas_udf(T.StringType())
def _unicode(names: pd.Series) -> pd.Series:
    return _mapped(names, to_unicode)


def _skeletons(table: dict[str, str]):
    @F.pandas_udf(T.StringType())
    def skeletons(names: pd.Series) -> pd.Series:
        return _mapped(names, lambda x: skeleton_of(x, table))

    return skeletons


def is_plain(c: Column) -> Column:
    """ASCII without labels in punycode: nothing that needs Unicode rules."""
    return D.is_ascii(c) & ~F.contains(F.lower(c), F.lit("xn--"))


def normalize(df: DataFrame, raw: str = "raw", domain: str = "domain") -> DataFrame:
    """df with the domain of each raw name, null if it has none. Plain ASCII rows never leave the JVM: the two kinds are parted by a filter."""
    ship(df.sparkSession)
    plain = df.where(F.col(raw).isNull() | is_plain(F.col(raw))).withColumn(domain, D.normalize(F.col(raw)))
    rest = df.where(F.col(raw).isNotNull() & ~is_plain(F.col(raw))).withColumn(domain, _ascii(D.unchecked(F.col(raw)))).withColumn(domain, D.normalize(F.col(domain)))
    return plain.unionByName(rest)


def forms(names: pd.Series) -> pd.Series:
    """Of arrays of raw names: a map with the ASCII form of each name that needs Unicode rules, null if it has none."""
    return pd.Series([None if x is None else ascii_forms(x) for x in names.tolist()], dtype=object)


def ascii_forms(names) -> dict[str, str | None]:  # noqa: ANN001
    out = {}
    for name in names:
        if name is not None and not (name.isascii() and "xn--" not in name.lower()):
            plain = name.strip().rstrip(".")
            while plain.startswith("*."):
                plain = plain[2:]
            out[name] = to_ascii(plain)
    return out


FORMS = T.MapType(T.StringType(), T.StringType())
_forms = F.pandas_udf(forms, FORMS)


def with_forms(df: DataFrame, names: str = "san_dns_names", out: str = "forms") -> DataFrame:
    """df with ascii_forms of an array of names; rows of plain names only never leave the JVM."""
    ship(df.sparkSession)
    odd = F.coalesce(F.exists(names, lambda x: ~is_plain(x)), F.lit(False))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return df.where(~odd).withColumn(out, none).unionByName(df.where(odd).withColumn(out, _forms(names)))


def readable(features: DataFrame, idn: Column | None = None) -> DataFrame:
    """features with unicode and skeleton of IDN rows by Unicode rules. idn: tells which rows these are, by the domain if it is not given."""
    ship(features.sparkSession)
    idn = D.has_idn(F.col("domain")) if idn is None else idn
    rest = features.where(idn).withColumn("unicode", _unicode("domain"))
    return features.where(~idn).unionByName(rest.withColumn("skeleton", _skeletons(confusables(features.sparkSession))("unicode")))

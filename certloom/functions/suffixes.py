"""Public suffixes: which labels at the end of a name belong to a registry, by a whole list of rules.

Rules are those of publicsuffix.org: plain ones, wildcards ("*.ck") and exceptions ("!www.ck"), of registries and of
private owners alike. They are a table (suffix, kind) that tasks look endings up in, the longest first; the list comes
from a file of the configuration, or else from the one that Spark's own HTTP client brings.
"""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import domains as D
from . import idn

#: The list among the resources of a jar that comes with Spark.
BUNDLED = "mozilla/public-suffix-list.txt"
#: Rules that are broadcast at most: a rule has under 100 bytes.
MAX_BROADCAST = 200_000
RULE, WILDCARD, EXCEPTION = 1, 2, 4

Rules = dict[str, int]
_loaded: dict[str, Rules] = {}


def parsed(lines: Iterable[str]) -> Rules:
    """Kinds of each suffix, added up: a name may be a rule and the base of a wildcard. Rules of other scripts get their ASCII form."""
    kinds, out = {"rule": RULE, "wildcard": WILDCARD, "exception": EXCEPTION}, {}
    for suffix, kind in D.public_suffix_rules(list(lines)):
        name = suffix if suffix.isascii() else idn.to_ascii(suffix)
        if name:
            out[name] = out.get(name, 0) | kinds[kind]
    return out


def _bundled() -> list[str]:
    spark = SparkSession.getActiveSession()
    jvm = spark._jvm if spark else None
    found = jvm and jvm.org.apache.spark.util.Utils.getContextOrSparkClassLoader().getResourceAsStream(BUNDLED)
    if not found:
        return []
    try:
        return bytes(found.readAllBytes()).decode().splitlines()
    finally:
        found.close()


def rules(path: str | None = None) -> Rules:
    """The rules of a file, read once; without one those that Spark brings, or a short list of suffixes where it brings none."""
    key = path or ""
    if key not in _loaded:
        own = parsed(Path(path).read_text(encoding="utf-8").splitlines() if path else _bundled())
        if not own and (path or SparkSession.getActiveSession() is None):
            if path:
                raise ValueError(f"{path} has no rules")
            return parsed(D.MULTI_SUFFIXES)  # no session yet: not kept
        _loaded[key] = own or parsed(D.MULTI_SUFFIXES)
    return _loaded[key]


def refresh(path: str | None = None) -> None:
    """Read the file anew when it is asked for next."""
    _loaded.pop(path or "", None)


def suffix_labels(name: str, known: Rules) -> int:
    """How many labels of a name are its public suffix; one for an ending that no rule has."""
    parts, size = name.split("."), 1
    for i in range(len(parts), 0, -1):
        kind = known.get(".".join(parts[-i:]), 0)
        if kind & EXCEPTION:
            return i - 1
        if kind:
            size = max(size, i + 1 if kind & WILDCARD and i < len(parts) else i)
    return size


def registrable(name: str, known: Rules) -> str:
    """The public suffix and a label more; the whole name if it is a suffix itself."""
    return ".".join(name.split(".")[-suffix_labels(name, known) - 1 :])


def table(spark: SparkSession, known: Rules) -> DataFrame:
    """(suffix, kind)"""
    return spark.createDataFrame(list(known.items()), "suffix string, kind int")


def with_registrable(df: DataFrame, known: Rules, domain: str = "domain", out: str = "registrable") -> DataFrame:
    """df with the registrable part of each domain.

    The table of rules is broadcast once and met once for each number of labels that a rule has: hash joins, no
    shuffle. A list of over MAX_BROADCAST rules goes by registrable_by_join. A null domain has none.
    """
    if not known:
        return df.withColumn(out, D.registrable(F.col(domain), ()))
    if len(known) > MAX_BROADCAST:
        names = {RULE: "rule", WILDCARD: "wildcard", EXCEPTION: "exception"}
        rows = df.sparkSession.createDataFrame([(s, n) for s, k in known.items() for b, n in names.items() if k & b], "suffix string, kind string")
        return D.registrable_by_join(df, rows, domain, MAX_BROADCAST).withColumnRenamed("registrable", out)
    side = F.broadcast(table(df.sparkSession, known))
    labels, rows, sizes = F.size(F.split(F.col(domain), "[.]")), df, []
    deepest = max(s.count(".") for s in known) + 1
    for i in range(1, deepest + 1):
        own = side.select(F.col("suffix").alias(f"__suffix{i}"), F.col("kind").alias(f"__kind{i}"))
        rows = rows.join(own, F.when(labels >= i, F.substring_index(F.col(domain), ".", -i)) == F.col(f"__suffix{i}"), "left")
        kind = F.col(f"__kind{i}")
        sizes.append(F.when(kind.bitwiseAND(WILDCARD).cast("boolean") & (labels > i), i + 1).when(kind.isNotNull(), i))
    except_ = F.coalesce(*[F.when(F.col(f"__kind{i}").bitwiseAND(EXCEPTION).cast("boolean"), i - 1) for i in range(deepest, 0, -1)])
    size = F.coalesce(except_, F.greatest(*sizes, F.lit(1)))
    part = F.array_join(F.slice(F.split(F.col(domain), "[.]"), F.greatest(labels - size, F.lit(1)), F.least(size + 1, labels)), ".")
    return rows.withColumn(out, part).drop(*[f"__{c}{i}" for c in ("suffix", "kind") for i in range(1, deepest + 1)])

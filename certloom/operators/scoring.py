"""Merging findings, and grouping them into alerts. The order of arrays is that of what was found first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import domains as D


def _packed(evidence: Column) -> Column:
    """Evidence as strings: Spark drops repeats of strings by a hash table, of structs by comparing all with all."""
    return F.transform(evidence, lambda e: F.concat(F.coalesce(e["kind"], F.lit("")), F.lit("\x00"), F.coalesce(F.concat(F.lit("="), e["value"]), F.lit(""))))


def _unpacked(packed: Column) -> Column:
    def one(x: Column) -> Column:
        kind = F.substring_index(x, "\x00", 1)
        value = F.substr(x, F.length(kind) + 2)
        return F.struct(kind.alias("kind"), F.when(F.startswith(value, F.lit("=")), F.substr(value, F.lit(2))).alias("value"))

    return F.transform(packed, one)


def _later(lists: Column) -> Column:
    """The first array of strings as it is, then what the others add, without repeats."""
    first = F.get(lists, F.lit(0))
    rest = F.flatten(F.slice(lists, 2, F.greatest(F.size(lists) - 1, F.lit(1))))
    return F.concat(first, F.array_except(rest, first))


def merge_findings(findings: DataFrame, order: list[str], within: list[str] = ()) -> DataFrame:
    """One finding per domain and detector (and per `within`): the highest score, the severity that first had it, reasons and evidence without repeats.

    order: columns that say which finding came first.
    """
    ordinal = F.struct(*order)
    group = [*within, "domain", "detector"]
    one = F.struct(ordinal.alias("at"), "score", "severity", "reasons", _packed(F.col("evidence")).alias("evidence"))
    rows = findings.select(*group, "score", "severity", ordinal.alias("at"), one.alias("f")).groupBy(*group)
    # the highest score is summed beside the rows: asked of the gathered array it would be looked for again for each of its elements
    gathered = rows.agg(F.array_sort(F.collect_list("f")).alias("fs"), F.max("score").alias("score"), F.min(F.struct((-F.col("score")).alias("score"), "at", "severity")).alias("first"))
    reasons, evidence = F.transform("fs", lambda f: f["reasons"]), F.transform("fs", lambda f: f["evidence"])
    return gathered.select(*group, F.col("first.severity").alias("severity"), "score", _later(reasons).alias("reasons"), _unpacked(_later(evidence)).alias("evidence"))


def merged_of_names(found: DataFrame) -> DataFrame:
    """(domain, detector, severity, score, reasons, own, more) of findings (domain, position, f): those of one name and detector are one.

    own is the evidence of the first, more what the others have, which comes after that of the observation.
    """
    rows = found.groupBy("domain", F.col("f.detector").alias("detector")).agg(F.array_sort(F.collect_list(F.struct("position", "f"))).alias("fs"))
    return _merged(rows.select("domain", "detector", F.transform("fs", lambda x: x["f"]).alias("fs")))


def _merged(rows: DataFrame) -> DataFrame:
    """merged_of_names of (domain, detector, fs), fs in order."""
    score, evidence = F.array_max(F.transform("fs", lambda f: f["score"])), F.transform("fs", lambda f: f["evidence"])
    one = F.size("fs") == 1
    reasons = F.when(one, F.get("fs", F.lit(0))["reasons"]).otherwise(_later(F.transform("fs", lambda f: f["reasons"])))
    more = F.flatten(F.slice(evidence, 2, F.greatest(F.size("fs") - 1, F.lit(1))))
    return rows.select("domain", "detector", D.severity(score).alias("severity"), score.alias("score"), reasons.alias("reasons"), F.get(evidence, F.lit(0)).alias("own"), more.alias("more"))


def of_observations(merged: DataFrame, seen: DataFrame) -> DataFrame:
    """Findings of merged_of_names for each (certificate_index, domain, seen), seen being the evidence of its observations in order."""
    rows = seen.join(merged, "domain")
    first = F.concat("own", F.get("seen", F.lit(0)))
    plain = (F.size("seen") == 1) & (F.size("more") == 0)
    rest = F.concat("more", F.flatten(F.slice("seen", 2, F.greatest(F.size("seen") - 1, F.lit(1)))))
    evidence = F.when(plain, first).otherwise(_unpacked(_later(F.array(_packed(first), _packed(rest)))))
    return rows.select("certificate_index", "domain", "detector", "severity", "score", "reasons", evidence.alias("evidence"))


def evidence_counts(observations: DataFrame, seen_at: Column) -> DataFrame:
    """(domain, n): how much different evidence seen_at, an array, gives over all observations of a domain.

    Counted item by item: a domain of many certificates is spread over all tasks and meets in no row.
    """
    items = observations.select("domain", F.explode(_packed(seen_at)).alias("item"))
    return items.distinct().groupBy("domain").agg(F.count("*").alias("n"))


def heads(merged: DataFrame, *more: str) -> DataFrame:
    """Alerts of merged_of_names without the evidence of observations: (domain, severity, score, detectors, reasons, n_own, findings).

    What a detector says of a name is the same in each of its observations, so a domain of many certificates is no more
    work than one of a single certificate. n_own: how much different evidence the detectors have; more: columns of merged
    that findings are to keep.
    """
    own = _packed(F.concat("own", "more"))
    f = F.struct("detector", "domain", "severity", "score", "reasons", *more)
    grouped = merged.groupBy("domain").agg(F.array_sort(F.collect_list(f)).alias("findings"), F.size(F.array_distinct(F.flatten(F.collect_list(own)))).cast("bigint").alias("n_own"))
    score = combined_score(F.array_max(F.transform("findings", lambda f: f["score"])), F.size("findings"))
    worst = F.array_max(F.transform("findings", lambda f: D.severity_rank(f["severity"])))
    reasons = F.array_distinct(F.flatten(F.transform("findings", lambda f: f["reasons"])))
    rows = grouped.select("domain", score.alias("score"), worst.alias("worst"), F.transform("findings", lambda f: f["detector"]).alias("detectors"), reasons.alias("reasons"), "n_own", "findings")
    return rows.select("domain", D.severity_name(F.greatest(D.severity_rank(D.severity(F.col("score"))), "worst")).alias("severity"), "score", "detectors", "reasons", "n_own", "findings")


def seen_of_domains(seen: DataFrame) -> DataFrame:
    """(domain, first, rest) of (certificate_index, domain, seen): packed evidence of the first observation of a domain, and what others have, each once."""
    rows = seen.groupBy("domain").agg(F.array_sort(F.collect_list(F.struct("certificate_index", "seen"))).alias("all"))
    rows = rows.select("domain", F.flatten(F.transform("all", lambda x: x["seen"])).alias("all"))
    return rows.select("domain", _packed(F.get("all", F.lit(0))).alias("first"), F.array_distinct(_packed(F.flatten(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(1)))))).alias("rest"))


def alerts_of_names(heads: DataFrame, seen: DataFrame) -> DataFrame:
    """group_alerts of the findings of all observations, from heads that keep own and more and from seen_of_domains.

    Findings are not made for each observation, and the domains of seen are joined to the left: Spark leaves them out
    where no evidence is asked for.
    """
    rows = heads.join(seen, "domain", "left")

    def whole(f: Column) -> Column:
        evidence = D.bound(F.concat(_packed(f["own"]), F.col("first")), lambda first: F.concat(first, F.array_except(F.concat(_packed(f["more"]), F.col("rest")), first)))
        return F.struct(f["domain"].alias("domain"), f["detector"].alias("detector"), f["severity"].alias("severity"), f["score"].alias("score"), f["reasons"].alias("reasons"), evidence.alias("evidence"))

    rows = rows.select("domain", "severity", "score", "detectors", "reasons", F.transform("findings", whole).alias("fs"))
    findings = F.transform("fs", lambda f: f.withField("evidence", _unpacked(f["evidence"])))
    return rows.select("domain", "severity", "score", "detectors", "reasons", _unpacked(F.array_distinct(F.flatten(F.transform("fs", lambda f: f["evidence"])))).alias("evidence"), findings.alias("findings"))


def combined_score(top: Column, n_detectors: Column) -> Column:
    return F.least(F.lit(100), top + 10 * (n_detectors - 1)).cast("int")


def group_alerts(findings: DataFrame, within: list[str] = ()) -> DataFrame:
    """One alert per domain, of merged findings in the order of their detectors; takeover comes last."""
    f = F.struct("domain", "detector", "severity", "score", "reasons", "evidence")
    at = F.struct((F.col("detector") == "takeover").alias("late"), F.col("detector").alias("detector"), F.xxhash64(f).alias("tie"))
    grouped = findings.select(*within, "domain", F.struct(at.alias("at"), f.alias("f")).alias("x")).groupBy(*within, "domain").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["f"]).alias("findings"))
    names = F.array_distinct(F.transform("findings", lambda f: f["detector"]))
    score = combined_score(F.array_max(F.transform("findings", lambda f: f["score"])), F.size(names))
    worst = F.array_max(F.transform("findings", lambda f: D.severity_rank(f["severity"])))
    return grouped.select(
        *within, "domain", D.severity_name(F.greatest(D.severity_rank(D.severity(score)), worst)).alias("severity"), score.alias("score"), names.alias("detectors"),
        F.array_distinct(F.flatten(F.transform("findings", lambda f: f["reasons"]))).alias("reasons"), _unpacked(F.array_distinct(_packed(F.flatten(F.transform("findings", lambda f: f["evidence"]))))).alias("evidence"), "findings",
    )


def ranked(alerts: DataFrame) -> DataFrame:
    return alerts.orderBy(F.desc("score"), "domain")

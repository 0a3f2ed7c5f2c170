"""Whole scans: from names, events or tiles to ranked alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import domains as D
from ..functions import idn
from ..operators import decode, detection, detectors, dns, scoring

#: Says which finding of a domain came first.
ORDER = ["certificate_index", "pos", "position"]
META = ("certificate_sha256", "serial_number", "issuer", "not_before", "not_after")


def manual_observations(spark: SparkSession, names: list[str] | DataFrame) -> DataFrame:
    """Observations of names that a user gives, a list or a table (raw); ValueError if one is not a domain. Names of other scripts count by their ASCII form."""
    given = names.withColumn("pos", F.monotonically_increasing_id()) if isinstance(names, DataFrame) else spark.createDataFrame(list(enumerate(names)), "pos bigint, raw string")
    rows = idn.normalize(given)
    bad = rows.where("domain is null").select("raw", F.when(idn.is_plain(F.col("raw")), D.problem(F.col("raw"))).otherwise("no valid internationalised name").alias("problem")).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0][0]!r}: {bad[0][1]}")
    return with_metadata(rows.select("domain", "pos"), "manual", "manual")


def with_metadata(rows: DataFrame, source_log: str, source_type: str) -> DataFrame:
    """rows (domain, and what else there is of an observation) with all columns of one."""
    have = set(rows.columns)
    null = {c: F.lit(None).cast("string") for c in META if c not in have}
    more = {"source_log": F.lit(source_log), "source_type": F.lit(source_type), "observed_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"), "certificate_index": F.lit(None).cast("bigint"), "san_dns_names": F.array().cast("array<string>"), "pos": F.lit(0)}
    return rows.withColumns(null | {k: v for k, v in more.items() if k not in have})


def findings(observations: DataFrame, cfg: Config) -> DataFrame:
    """Merged findings of each observation that reach the score, per certificate and domain."""
    parts = int(observations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    merged = detection.merged(observations, cfg).repartition(parts, "domain")  # an exchange of its own, so that plans with several uses detect once
    return scoring.of_observations(merged, detection.seen(observations))


def heads(observations: DataFrame, cfg: Config, *more: str) -> DataFrame:
    """alerts() of findings() without the evidence of observations: told by the names alone, whatever the number of their certificates."""
    return scoring.heads(detection.merged(observations, cfg), *more).where(F.col("score") >= cfg.rules.min_alert_score)


def counted_heads(observations: DataFrame, cfg: Config) -> DataFrame:
    """heads() with n_evidence, how much different evidence each alert has: its detectors' and that of where it was seen (kinds ct.*, which no detector has)."""
    counts = scoring.evidence_counts(observations, detectors.ct_evidence())
    return heads(observations, cfg).join(counts, "domain").withColumn("n_evidence", F.col("n_own") + F.col("n")).drop("n_own", "n")


def enriched(found: DataFrame, observed: DataFrame, cfg: Config, answers: DataFrame | None = None) -> DataFrame:
    """Findings with DNS evidence, and takeover findings, as the configuration asks. answers: a table to use instead of live lookups."""
    if not (cfg.dns.enabled or cfg.dns.takeover):
        return found
    names = dns.lookup_domains(found, detection.kept(observed, cfg) if cfg.dns.takeover else None)
    answers = names.join(answers, "domain") if answers is not None else dns.answered(names, cfg.dns)
    out = dns.apply_dns(found, answers)
    if cfg.dns.takeover:
        extra = dns.takeover_findings(dns.takeover_candidates(answers, dns.fingerprints(found.sparkSession)))
        out = out.unionByName(extra, allowMissingColumns=True)
    return out.where(F.col("score") >= cfg.rules.min_score)


def alerts(found: DataFrame, cfg: Config) -> DataFrame:
    """One alert per domain over all its certificates."""
    order = [c for c in ("certificate_index",) if c in found.columns]
    late = found.withColumn("__late", (F.col("detector") == "takeover").cast("int"))
    merged = scoring.merge_findings(late, ["__late", *order, "severity"])
    return scoring.group_alerts(merged).where(F.col("score") >= cfg.rules.min_alert_score)


def observed_alerts(observations: DataFrame, cfg: Config, answers: DataFrame | None = None) -> DataFrame:
    """alerts() of the enriched findings of observations. Without DNS they are told by names, and evidence joins them domain by domain."""
    if cfg.dns.enabled or cfg.dns.takeover:
        return alerts(enriched(findings(observations, cfg), observations, cfg, answers), cfg)
    found = heads(observations, cfg, "own", "more")
    wanted = observations.join(found.select("domain"), "domain", "left_semi")  # no domain's evidence is gathered for nothing
    return scoring.alerts_of_names(found, scoring.seen_of_domains(detection.seen(wanted)))


def scan_domains(spark: SparkSession, names: list[str] | DataFrame, cfg: Config, answers: DataFrame | None = None) -> DataFrame:
    """Ranked alerts for names that a user gives."""
    observed = manual_observations(spark, names)
    return scoring.ranked(observed_alerts(observed, cfg, answers))


def scan_tiles(tiles: DataFrame, source_log: str, cfg: Config, first_entry: int = 0, answers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(ranked alerts, parse errors) of data tiles (index, width, bytes)."""
    entries = decode.decode_tiles(tiles)
    events, errors = decode.events_and_errors(entries.where(F.col("index") >= first_entry), source_log)
    observed = decode.observations(events)
    return scoring.ranked(observed_alerts(observed, cfg, answers)), errors


def first_entries(rows: DataFrame, n: int, index: str = "index") -> DataFrame:
    """The first n rows by entry: a sort that stops after n, in each task."""
    return rows.orderBy(index).limit(n)

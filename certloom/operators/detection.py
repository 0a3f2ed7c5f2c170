"""Detection over observations: each distinct name is looked at once, and what is found joins its observations.

Names with labels of other scripts get their readable form and their skeleton by Unicode rules in an Arrow branch; all
other names stay in the JVM. The lists of the configuration are literals of the plan as long as they are short; longer
ones are tables, broadcast or joined by shuffle as their counts say. Either way the findings are the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import domains as D
from ..functions import idn
from . import detectors, list_detectors, scoring

#: Values of a list of the configuration that are literals of the plan at most.
LITERALS = 200


def by_tables(cfg: Config) -> bool:
    """Whether a list is too long for literals."""
    return max(map(len, (cfg.brands, cfg.official_domains, cfg.keywords))) > LITERALS


def kept(df: DataFrame, cfg: Config, domain: str = "domain") -> DataFrame:
    """Rows of df whose domain is not allowed: not on the allowlist, no official domain itself, under no allowed suffix."""
    exact = detectors.exactly_allowed(cfg)
    if max(len(exact), len(cfg.rules.allowlist_suffixes)) <= LITERALS:
        return df.where(~detectors.allowed(F.col(domain), cfg))
    spark = df.sparkSession
    on_list = spark.createDataFrame([(d,) for d in exact], "allowed string")
    suffix = spark.createDataFrame([(s.strip(".").lower(),) for s in cfg.rules.allowlist_suffixes], "suffix string")
    return detectors.not_allowed_by_join(df.where(F.col(domain).isNotNull()).join(on_list, F.col(domain) == F.col("allowed"), "left_anti"), suffix, domain)


def names_of(observations: DataFrame, cfg: Config) -> DataFrame:
    """The features of each distinct domain that is not allowed, spread over all tasks: names are short, and detectors take their time."""
    parts = int(observations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the kind of a name is summed with it: a filter by it stays above the sum, so that both branches read one exchange
    names = kept(observations.select("domain"), cfg).groupBy("domain").agg(F.max(D.has_idn(F.col("domain"))).alias("__idn"))
    # by a hash of their own: by the domain they lie already, in as few partitions as their few bytes are put together to
    return idn.readable(detectors.features(names.repartition(parts, F.xxhash64("domain")), cfg), F.col("__idn")).drop("__idn")


def findings_of(names: DataFrame, cfg: Config, only: list[str] | None = None) -> DataFrame:
    """(domain, position, f) of names with their features, position being the order in which detectors find."""
    if by_tables(cfg):
        return list_detectors.findings(names, list_detectors.Lists.of(names.sparkSession, cfg), only)
    built = [build(cfg) for name, build in detectors.DETECTORS.items() if only is None or name in only]
    found = F.concat(*[F.coalesce(c, F.array()) for c in built])
    return names.select("domain", F.posexplode(found).alias("position", "f")).withColumn("position", F.col("position").cast("bigint"))


def detect(observations: DataFrame, cfg: Config, only: list[str] | None = None) -> DataFrame:
    """One row per finding of each observation that is not allowed: (observation columns, position, detector, severity, score, reasons, evidence).

    observations has domain and the columns of schemas.OBSERVATIONS; only: names of detectors.
    """
    return joined(observations, findings_of(names_of(observations, cfg), cfg, only))


def merged(observations: DataFrame, cfg: Config) -> DataFrame:
    """What is found in each name, one finding for each detector that reaches the score; see scoring.merged_of_names."""
    names = names_of(observations, cfg)
    if by_tables(cfg):
        rows = scoring.merged_of_names(findings_of(names, cfg))
    else:  # a detector's findings are an array of the row: nothing has to meet
        made = F.array(*[F.struct(F.lit(name).alias("detector"), F.filter(F.coalesce(build(cfg), F.array()), lambda f: f.isNotNull()).alias("fs")) for name, build in detectors.DETECTORS.items()])
        rows = scoring._merged(names.select("domain", F.inline(made)).where(F.size("fs") > 0))
    return rows.where(F.col("score") >= cfg.rules.min_score)


def seen(observations: DataFrame) -> DataFrame:
    """(certificate_index, domain, seen): where each certificate has a domain, as arrays of evidence in order of pos, equal ones once.

    Observations meet by certificate and domain before they meet findings, so that rows are short and no domain is one task's.
    """
    rows = observations.where("domain is not null").select("certificate_index", "domain", "pos", detectors.ct_evidence().alias("seen_at"))
    once = rows.groupBy("certificate_index", "domain", "seen_at").agg(F.min("pos").alias("pos"))
    return once.groupBy("certificate_index", "domain").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "seen_at"))), lambda x: x["seen_at"]).alias("seen"))


def joined(observations: DataFrame, found: DataFrame) -> DataFrame:
    """Findings (domain, position, f) with the observations of their domain."""
    rows = observations.withColumn("seen_at", detectors.ct_evidence()).join(found, "domain")
    return rows.select(*observations.columns, "position", "f.detector", D.severity(F.col("f.score")).alias("severity"), "f.score", "f.reasons", F.concat("f.evidence", "seen_at").alias("evidence"))

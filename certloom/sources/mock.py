"""Fixed events, for demonstrations and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decode

_DEMO = ((1, ("paypa1-login.com", "github.com", "micr0soft-support.net"), "2026-05-28T00:00:00Z"), (2, ("secure-wallet-example.net",), "2026-05-28T00:00:05Z"))


def events_of(spark: SparkSession, rows: list[tuple[int, list[str], str]], source_log: str = "mock", source_type: str = "mock") -> DataFrame:
    """schemas.EVENTS of (index, names, observed_at)."""
    return events_from(spark.createDataFrame([(i, list(n), t) for i, n, t in rows], "index bigint, san_dns_names array<string>, observed_at string"), source_log, source_type)


def events_from(raw: DataFrame, source_log: str = "mock", source_type: str = "mock") -> DataFrame:
    """schemas.EVENTS of a table (index, san_dns_names, observed_at)."""
    null = F.lit(None).cast("string")
    raw = raw.withColumns({"source_log": F.lit(source_log), "source_type": F.lit(source_type)} | dict.fromkeys(("certificate_sha256", "serial_number", "issuer", "not_before", "not_after"), null))
    return decode.certificate_events(raw).drop("rejected_domains")


def demo_events(spark: SparkSession) -> DataFrame:
    return events_of(spark, list(_DEMO))

"""What has been alerted already: identities, expiry, dead letters, outbox. All as tables; streaming keeps them between batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import domains as D

TTL_SECONDS = 90 * 24 * 3600
DEAD_LETTERS = 1024


def evidence_value(evidence: Column, kind: str) -> Column:
    """The first value of a kind, or null."""
    return F.get(F.filter(evidence, lambda e: e["kind"] == kind), F.lit(0))["value"]


def evidence_fingerprint(reasons: Column, evidence: Column) -> Column:
    """Hash of all reasons and evidence but the time of observation, without order or repeats."""
    parts = F.concat(F.transform(reasons, lambda r: F.concat(F.lit("reason="), r)), F.transform(F.filter(evidence, lambda e: e["kind"] != "ct.observed_at"), lambda e: F.concat(e["kind"], F.lit("="), e["value"])))
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(parts)), "\n").cast("binary"), 256)


def identity(findings: DataFrame) -> DataFrame:
    """findings with key: hash of the JSON of the fields that make two findings the same one, nulls written out."""
    e = F.col("evidence")
    fields = F.struct(
        F.coalesce(evidence_value(e, "ct.source_log"), F.lit("unknown")).alias("log_id"),
        evidence_value(e, "ct.certificate_index").cast("bigint").alias("certificate_index"),
        evidence_value(e, "ct.certificate_sha256").alias("certificate_fingerprint"),
        F.lower("domain").alias("normalized_domain"),
        F.col("detector"),
        evidence_fingerprint(F.col("reasons"), e).alias("evidence_fingerprint"),
    )
    return findings.withColumn("key", F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}).cast("binary"), 256))


def unseen(keyed: DataFrame, records: DataFrame, now: int | Column) -> DataFrame:
    """Findings (with key) that no unexpired record of the same or a higher severity holds. A batch is judged as a whole: equal keys in it all pass."""
    now = F.lit(now) if isinstance(now, int) else now
    live = records.where(F.col("expires_at_unix") > now).select("key", D.severity_rank(F.col("highest_severity")).alias("__seen"))
    return keyed.join(live, "key", "left").where(F.col("__seen").isNull() | (D.severity_rank(F.col("severity")) > F.col("__seen"))).drop("__seen")


def remember(records: DataFrame, emitted: DataFrame, now: int) -> DataFrame:
    """records after emitted findings (with key): first seen stays, severity rises, expiry starts anew."""
    new = emitted.groupBy("key").agg(F.max(D.severity_rank(F.col("severity"))).alias("rank"))
    old = records.select("key", D.severity_rank(F.col("highest_severity")).alias("old_rank"), "first_seen_unix", "last_seen_unix", "expires_at_unix")
    both = old.join(new, "key", "full_outer")
    hit = F.col("rank").isNotNull()
    return both.select(
        "key",
        D.severity_name(F.greatest("rank", "old_rank")).alias("highest_severity"),
        F.coalesce("first_seen_unix", F.lit(now)).cast("bigint").alias("first_seen_unix"),
        F.when(hit, F.lit(now)).otherwise(F.col("last_seen_unix")).cast("bigint").alias("last_seen_unix"),
        F.when(hit, F.lit(now + TTL_SECONDS)).otherwise(F.col("expires_at_unix")).cast("bigint").alias("expires_at_unix"),
    )


def changed(records: DataFrame, emitted: DataFrame, now: int) -> DataFrame:
    """Of remember(), the records of what was emitted now: what a step adds, where newest_records() puts the steps together."""
    keys = emitted.select("key").distinct()
    return remember(records.join(keys, "key", "left_semi"), emitted, now)


def newest_records(parts: DataFrame) -> DataFrame:
    """Of the records of several steps the last of each key."""
    rest = [c for c in parts.columns if c not in ("key", "last_seen_unix")]
    return parts.groupBy("key").agg(F.max(F.struct("last_seen_unix", "expires_at_unix", D.severity_rank(F.col("highest_severity")).alias("rank"), *[c for c in rest if c != "expires_at_unix"])).alias("last")).select("key", "last.highest_severity", "last.first_seen_unix", "last.last_seen_unix", "last.expires_at_unix")


def prune(records: DataFrame, now: int) -> DataFrame:
    return records.where(F.col("expires_at_unix") > now)


def new_alerts(alerts: DataFrame, fresh_domains: DataFrame, min_alert_score: int = 0) -> DataFrame:
    """Alerts of which a finding is new (its domain is in fresh_domains), and that reach the score."""
    return alerts.join(fresh_domains.select("domain").distinct(), "domain", "left_semi").where(F.col("score") >= min_alert_score)


def alerted_domains(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(domain) of rows in lower case, once each, without those already known (domain)."""
    names = rows.select(F.lower("domain").alias("domain")).dropDuplicates()
    return names if known is None else names.join(known.select(F.lower("domain").alias("domain")), "domain", "left_anti")


def first_of_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key: one sum by key, aggregated before it moves."""
    rest = [c for c in rows.columns if c not in (key, order)]
    first = rows.groupBy(key).agg(F.min(F.struct(order, *rest)).alias("first"))
    return first.select(key, "first.*")


def newest(letters: DataFrame, most: int = DEAD_LETTERS) -> DataFrame:
    """The last dead letters by index: a sort that stops after `most`, no window over all rows."""
    return letters.orderBy(F.desc("index")).limit(most)


def outbox_id(sink: Column, payload: Column) -> Column:
    return F.sha2(F.concat(sink.cast("binary"), F.lit(b"\x00"), payload.cast("binary")), 256)


def enqueue(outbox: DataFrame, events: DataFrame, now: int) -> DataFrame:
    """outbox and those of the events (sink, payload) that it does not hold, once each."""
    made = events.withColumn("id", outbox_id(F.col("sink"), F.col("payload"))).dropDuplicates(["id"]).join(outbox.select("id"), "id", "left_anti")
    return outbox.unionByName(made.select("id", "sink", "payload", F.lit(now).cast("bigint").alias("created_at_unix"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("last_error")))


def delivered(outbox: DataFrame, ids: DataFrame) -> DataFrame:
    return outbox.join(ids.select("id"), "id", "left_anti")


def failed(outbox: DataFrame, errors: DataFrame) -> DataFrame:
    """outbox with attempts and last_error of (id, error)."""
    e = errors.select("id", F.col("error").alias("__error"))
    out = outbox.join(e, "id", "left")
    bad = F.col("__error").isNotNull()
    return out.withColumns({"attempts": F.col("attempts") + bad.cast("int"), "last_error": F.coalesce("__error", "last_error")}).drop("__error").select(outbox.columns)


def rollbacks(history: DataFrame) -> DataFrame:
    """history of checkpoints (log_url, at, size, root_hash) with what is wrong with each against the one before: rollback, conflict or null."""
    w = Window.partitionBy("log_url").orderBy("at")
    size, root = F.lag("size").over(w), F.lag("root_hash").over(w)
    return history.withColumn("problem", F.when(F.col("size") < size, "rollback").when((F.col("size") == size) & (F.col("root_hash") != root), "conflict"))

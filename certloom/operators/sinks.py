"""Payloads for sinks, as columns, and their delivery from the driver."""

from __future__ import annotations

import hashlib
import hmac
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import domains as D

NULLS = {"ignoreNullFields": "false"}
RETRIES, FIRST_DELAY = 2, 0.25
FINDING_FIELDS = ("domain", "detector", "severity", "score", "reasons", "evidence")
ALERT_FIELDS = ("domain", "severity", "score", "detectors", "reasons", "evidence", "findings")


def json_lines(findings: DataFrame) -> DataFrame:
    """(value): a JSON object for each finding, for write.text."""
    return findings.select(F.to_json(F.struct(*FINDING_FIELDS), NULLS).alias("value"))


def payload(rows: DataFrame, kind: str, batch: int = 1000) -> DataFrame:
    """(sink payload): envelopes {kind, count, <kind>: [...]} of at most `batch` rows each, by ranked domain; none for no rows.

    A bounded envelope keeps a big result from meeting in one row; batch=0 makes a single one, for small results.
    """
    part = F.pmod(F.xxhash64("domain"), F.greatest(F.lit(1), F.ceil(F.lit(rows.count() / batch)).cast("bigint"))) if batch else F.lit(0)
    return envelopes(rows, kind, part).select("payload")


def envelopes(rows: DataFrame, kind: str, part: Column) -> DataFrame:
    """(part, count, payload): an envelope for each value of part."""
    body = F.struct(*(FINDING_FIELDS if kind == "findings" else ALERT_FIELDS))
    made = rows.groupBy(part.alias("part")).agg(F.count("*").alias("count"), F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("rank"), "domain", body.alias("body")))).alias("all"))
    return made.select("part", "count", F.to_json(F.struct(F.lit(kind).alias("kind"), "count", F.transform("all", lambda x: x["body"]).alias(kind)), NULLS).alias("payload"))


def idempotency_key(payload_: Column) -> Column:
    return F.sha2(payload_.cast("binary"), 256)


def signature(secret: str, timestamp: str, body: bytes) -> str:
    return "sha256=" + hmac.new(secret.encode(), timestamp.encode() + b"." + body, hashlib.sha256).hexdigest()


def chat_text(prefix: str = "Certloom") -> Column:
    """One line for a chat message about a finding."""
    return F.concat(F.lit(f"{prefix} alert: "), "domain", F.lit(" severity="), F.initcap("severity"), F.lit(" score="), F.col("score").cast("string"), F.lit(" detector="), "detector")


def alert_findings(alerts: DataFrame) -> DataFrame:
    """The findings of alerts, a row each."""
    return alerts.select(F.inline("findings"))


def redacted(url: Column) -> Column:
    return D.redact_url(url)


class DeliveryError(RuntimeError):
    pass


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args, **kwargs):  # noqa: ANN002, ANN003
        return None


def post(url: str, body: bytes, headers: dict[str, str], timeout: float = 20.0, sleep: Callable[[float], None] = time.sleep, opener=None) -> None:
    """POST, with two more tries after 429, 5xx, a timeout or a lost connection. Redirects are errors."""
    opener = opener or urllib.request.build_opener(_NoRedirect)
    for attempt in range(RETRIES + 1):
        try:
            with opener.open(urllib.request.Request(url, body, headers, method="POST"), timeout=timeout) as reply:
                if reply.status < 300:
                    return
                raise DeliveryError(f"status {reply.status}")
        except urllib.error.HTTPError as e:
            if (e.code != 429 and e.code < 500) or attempt == RETRIES:
                raise DeliveryError(f"status {e.code}") from None
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            if attempt == RETRIES:
                raise DeliveryError(type(e).__name__) from None
        sleep(FIRST_DELAY * 2**attempt)


def deliver_webhook(url: str, payload_: str, secret: str | None = None, header: str = "X-Certloom", send: Callable = post) -> None:
    body = payload_.encode()
    headers = {"Content-Type": "application/json", "Idempotency-Key": hashlib.sha256(body).hexdigest()}
    if secret:
        now = str(int(time.time()))
        headers |= {f"{header}-Timestamp": now, f"{header}-Signature": signature(secret, now, body)}
    send(url, body, headers)


def deliver_chat(url: str, text: str, send: Callable = post) -> None:
    send(url, json.dumps({"text": text}).encode(), {"Content-Type": "application/json"})


def summary(count: Column, grouped: bool = True) -> Column:
    """One sentence about a scan's result."""
    one, many = ("grouped alert", "grouped alerts") if grouped else ("finding", "findings")
    return F.when(count == 0, f"No matching {'alerts' if grouped else 'findings'} for current rules").when(count == 1, f"1 {one} produced").otherwise(F.concat(count.cast("string"), F.lit(f" {many} produced")))


def watch_summary(alerts: Column, findings: Column, repeated: Column) -> Column:
    return (
        F.when(alerts > 0, F.concat(alerts.cast("string"), F.lit(" new grouped alerts produced")))
        .when(findings > 0, F.concat(findings.cast("string"), F.lit(" new findings produced")))
        .when(repeated > 0, F.concat(F.lit("No new output because "), repeated.cast("string"), F.lit(" results were already alerted")))
        .otherwise("No matching alerts for current rules")
    )

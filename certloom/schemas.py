"""Schemas of the tables that operators exchange."""

from __future__ import annotations

EVIDENCE = "struct<kind: string, value: string>"
FINDING = f"struct<domain: string, detector: string, severity: string, score: int, reasons: array<string>, evidence: array<{EVIDENCE}>>"
DOMAIN_NAME = "struct<original: string, normalized: string, is_wildcard: boolean, is_idn: boolean>"
CERTIFICATE = "certificate_sha256 string, serial_number string, issuer string, not_before string, not_after string, san_dns_names array<string>"
EVENTS = f"source_log string, index bigint, domains array<{DOMAIN_NAME}>, {CERTIFICATE}, observed_at string, source_type string"
OBSERVATIONS = f"source_log string, certificate_index bigint, domain string, {CERTIFICATE}, observed_at string, source_type string"
FINDINGS = f"domain string, detector string, severity string, score int, reasons array<string>, evidence array<{EVIDENCE}>"
ALERTS = f"domain string, severity string, score int, detectors array<string>, reasons array<string>, evidence array<{EVIDENCE}>, findings array<{FINDING}>"
DNS = "domain string, resolved boolean, status string, ips array<string>, cname_chain array<string>, errors array<string>"
ENTRIES = "index bigint, timestamp_millis bigint, kind string, merkle_leaf_hash string, certificate_der binary, chain_fingerprints array<string>, extensions_len int"
ALERT_RECORDS = "key string, highest_severity string, first_seen_unix bigint, last_seen_unix bigint, expires_at_unix bigint"
OUTBOX = "id string, sink string, payload string, created_at_unix bigint, attempts int, last_error string"
DEAD_LETTERS = "log_url string, index bigint, error string, recorded_at_unix bigint"

"""Entries of data tiles, and certificates, from their bytes. Formats are sequential, so they are read by Arrow batches in Python."""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import domains as D
from ..functions import idn
from ..ship import ship


class DecodeError(ValueError):
    pass


class _Reader:
    """Big-endian fields of a byte string."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise DecodeError("truncated")
        out = self.data[self.at : self.at + n]
        self.at += n
        return out

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n), "big")

    def block(self, n: int, least: int = 0) -> bytes:
        """A field that n bytes of length precede."""
        size = self.number(n)
        if size < least:
            raise DecodeError("empty certificate")
        return self.take(size)


def read_entry(r: _Reader) -> dict:
    """One entry: the timestamped part is hashed, what follows it is not."""
    start = r.at
    millis = r.number(8)
    if millis >= 1 << 63:
        raise DecodeError("timestamp out of range")
    kind = r.number(2)
    if kind == 0:
        der = r.block(3, 1)
        extensions = r.block(2)
        signed = r.data[start : r.at]
    elif kind == 1:
        r.take(32)
        r.block(3, 1)
        extensions = r.block(2)
        signed = r.data[start : r.at]
        der = r.block(3, 1)
    else:
        raise DecodeError(f"entry type {kind}")
    chain = r.block(2)
    if len(chain) % 32:
        raise DecodeError("chain length")
    leaf = hashlib.sha256(b"\x00\x00\x00" + signed).hexdigest()
    return {"timestamp_millis": millis, "kind": ("x509", "precertificate")[kind], "merkle_leaf_hash": leaf, "certificate_der": der, "chain_fingerprints": [chain[i : i + 32].hex() for i in range(0, len(chain), 32)], "extensions_len": len(extensions)}


def read_tile(data: bytes, index: int, width: int | None) -> list[dict]:
    """All entries of a data tile; a tile that does not hold exactly its width is an error."""
    r, out = _Reader(data), []
    while r.at < len(data):
        out.append({"index": index * 256 + len(out)} | read_entry(r))
    if len(out) != (256 if width is None else width):
        raise DecodeError(f"{len(out)} entries in the tile")
    return out


_ENTRY = pa.schema([("index", pa.int64()), ("timestamp_millis", pa.int64()), ("kind", pa.string()), ("merkle_leaf_hash", pa.string()), ("certificate_der", pa.binary()), ("chain_fingerprints", pa.list_(pa.string())), ("extensions_len", pa.int32()), ("error", pa.string())])


def tile_entries(batches: Iterator[pa.RecordBatch], strict: bool) -> Iterator[pa.RecordBatch]:
    """A batch of entries for each tile: as objects they are of many times its bytes, so there are those of one at a time."""
    for batch in batches:
        for at in range(batch.num_rows):
            tile, width, data = (c[at].as_py() for c in batch.columns)
            try:
                rows = read_tile(data, tile, width)
            except DecodeError as e:
                if strict:
                    raise
                rows = [{"index": tile * 256, "error": str(e)}]
            yield pa.RecordBatch.from_pylist(rows, _ENTRY)


def decode_tiles(tiles: DataFrame, strict: bool = True) -> DataFrame:
    """(index bigint, width int, bytes binary) -> schemas.ENTRIES and error. strict: a bad tile fails the query; else it is a row with index of its first entry and error."""

    ship(tiles.sparkSession)
    types = dict(tiles.dtypes)
    # a column of the right type as it is: under a needless cast Spark does not see that two uses of the tiles are the same
    columns = [F.col(c) if types[c] == t else F.col(c).cast(t) for c, t in (("index", "bigint"), ("width", "int"), ("bytes", "binary"))]
    return tiles.select(*columns).mapInArrow(lambda batches: tile_entries(batches, strict), schemas.ENTRIES + ", error string")


def _tlv(data: bytes, at: int, end: int) -> tuple[int, int, int]:
    """(tag, first byte of the value, byte after it) of the DER element at `at`."""
    if at + 2 > end:
        raise DecodeError("truncated DER")
    tag, n = data[at], data[at + 1]
    at += 2
    if n & 0x80:
        k = n & 0x7F
        if k == 0 or k > 4 or at + k > end:
            raise DecodeError("DER length")
        n = int.from_bytes(data[at : at + k], "big")
        at += k
    if at + n > end:
        raise DecodeError("truncated DER")
    return tag, at, at + n


def _children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]]:
    out = []
    while at < end:
        tag, a, b = _tlv(data, at, end)
        out.append((tag, a, b))
        at = b
    return out


def _oid(data: bytes) -> str:
    parts, value = [], 0
    for byte in data:
        value = value << 7 | byte & 0x7F
        if not byte & 0x80:
            parts.append(value)
            value = 0
    if not parts:
        raise DecodeError("object identifier")
    first = min(parts[0] // 40, 2)
    return ".".join(map(str, [first, parts[0] - 40 * first, *parts[1:]]))


#: Attribute types of names.
_ATTRIBUTES = {"2.5.4.3": "CN", "2.5.4.6": "C", "2.5.4.7": "L", "2.5.4.8": "ST", "2.5.4.10": "O", "2.5.4.11": "OU", "2.5.4.5": "serialNumber", "1.2.840.113549.1.9.1": "emailAddress", "0.9.2342.19200300.100.1.25": "DC"}


def _name(data: bytes, a: int, b: int) -> str:
    out = []
    for _, sa, sb in _children(data, a, b):
        for _, pa_, pb in _children(data, sa, sb):
            (_, oa, ob), (tag, va, vb) = _children(data, pa_, pb)[:2]
            oid = _oid(data[oa:ob])
            value = data[va:vb].decode("utf-16-be" if tag == 0x1E else "utf-8", "replace")
            out.append(f"{_ATTRIBUTES.get(oid, oid)}={value}")
    return ", ".join(out)


def _time(tag: int, text: bytes) -> str:
    s = text.decode("ascii", "replace")
    full = s if tag == 0x18 else ("19" if s[:2] >= "50" else "20") + s
    return dt.datetime.strptime(full, "%Y%m%d%H%M%SZ").strftime("%Y-%m-%dT%H:%M:%SZ")


def read_certificate(der: bytes) -> dict:
    """Fields of an X.509 certificate in DER. Bytes after it are an error; of names only DNS ones of the SAN extension count."""
    try:
        tag, a, b = _tlv(der, 0, len(der))
        if tag != 0x30 or b != len(der):
            raise DecodeError("not one certificate")
        _, ta, tb = _children(der, a, b)[0]
        fields = _children(der, ta, tb)
        if fields[0][0] == 0xA0:
            fields = fields[1:]
        serial, _, issuer, validity = fields[:4]
        (t1, a1, b1), (t2, a2, b2) = _children(der, *validity[1:])[:2]
        sans: set[str] = set()
        for tag, xa, xb in fields[6:]:
            if tag != 0xA3:
                continue
            _, la, lb = _tlv(der, xa, xb)
            for _, ea, eb in _children(der, la, lb):
                parts = _children(der, ea, eb)
                if _oid(der[parts[0][1] : parts[0][2]]) != "2.5.29.17":
                    continue
                _, va, vb = parts[-1]
                _, na, nb = _tlv(der, va, vb)
                sans |= {der[x:y].decode("ascii", "replace") for t, x, y in _children(der, na, nb) if t == 0x82}
        number = der[serial[1] : serial[2]].hex()
        return {"certificate_sha256": hashlib.sha256(der).hexdigest(), "serial_number": ":".join(number[i : i + 2] for i in range(0, len(number), 2)), "issuer": _name(der, *issuer[1:]), "not_before": _time(t1, der[a1:b1]), "not_after": _time(t2, der[a2:b2]), "san_dns_names": list(sans), "forms": list(idn.ascii_forms(sans).items()), "error": None}
    except (DecodeError, IndexError, ValueError) as e:
        return {"error": str(e) or type(e).__name__}


_CERTIFICATE = pa.schema([("index", pa.int64()), ("timestamp_millis", pa.int64()), ("certificate_sha256", pa.string()), ("serial_number", pa.string()), ("issuer", pa.string()), ("not_before", pa.string()), ("not_after", pa.string()), ("san_dns_names", pa.list_(pa.string())), ("forms", pa.map_(pa.string(), pa.string())), ("error", pa.string())])


#: Certificates that are Python objects at a time.
CHUNK = 1024


def parse_certificates(entries: DataFrame) -> DataFrame:
    """(index, timestamp_millis, certificate_der) -> certificate fields, or error; forms as functions.idn.ascii_forms has them, made where Python reads the names anyway."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                rows = [{"index": i, "timestamp_millis": t} | read_certificate(der or b"") for i, t, der in zip(*[c.to_pylist() for c in part.columns], strict=True)]
                yield pa.RecordBatch.from_pylist(rows, _CERTIFICATE)

    ship(entries.sparkSession)
    parsed = entries.select("index", "timestamp_millis", "certificate_der").mapInArrow(run, f"index bigint, timestamp_millis bigint, {schemas.CERTIFICATE}, forms map<string, string>, error string")
    return parsed.withColumn("san_dns_names", sorted_names(F.col("san_dns_names")))


def sorted_names(names: Column) -> Column:
    """Each name once, in order."""
    return F.array_sort(F.array_distinct(names))


def events_and_errors(entries: DataFrame, source_log: str) -> tuple[DataFrame, DataFrame]:
    """(events, parse errors): a certificate that cannot be read is an error row, and the others go on."""
    parsed = parse_certificates(entries)
    events = certificate_events(parsed.where("error is null").withColumns({"source_log": F.lit(source_log), "observed_at": D.rfc3339(F.col("timestamp_millis")), "source_type": F.lit("ct")}))
    return events, parsed.where("error is not null").select("index", "error")


def certificate_events(parsed: DataFrame) -> DataFrame:
    """schemas.EVENTS and rejected_domains (struct<value, error>) of rows with san_dns_names: valid names, each normal form once, in order.

    Names in punycode or other scripts count by their ASCII form (forms, see functions.idn); those without one are rejected.
    """
    if "forms" not in parsed.columns:
        parsed = idn.with_forms(parsed)

    def one(s: Column) -> Column:
        odd = F.coalesce(F.map_contains_key("forms", s), F.lit(False))
        form = F.try_element_at("forms", s)
        return D.bound(
            D.looked_at(F.when(odd, form).otherwise(s)),
            lambda found: F.struct(s.alias("original"), F.when(found["problem"].isNull(), found["form"]).alias("normalized"), D.is_wildcard(s).alias("is_wildcard"), F.when(odd & form.isNull(), "no valid internationalised name").otherwise(found["problem"]).alias("error")),
        )

    names = F.transform("san_dns_names", one)
    # a column for each step: as one expression the names would be looked at again wherever they are used
    rows = parsed.withColumn("__names", names)
    rows = rows.withColumn("__valid", F.filter("__names", lambda n: n["normalized"].isNotNull()))
    forms = F.transform("__valid", lambda n: n["normalized"])
    first = D.bound(forms, lambda all_: F.filter("__valid", lambda n, i: F.array_position(all_, n["normalized"]) == i + 1))  # of equal forms
    domains = F.transform(first, lambda n: F.struct(n["original"].alias("original"), n["normalized"].alias("normalized"), n["is_wildcard"].alias("is_wildcard"), D.has_idn(n["normalized"]).alias("is_idn")))
    rejected = F.transform(F.filter("__names", lambda n: n["normalized"].isNull()), lambda n: F.struct(n["original"].alias("value"), n["error"].alias("error")))
    return rows.select("source_log", "index", domains.alias("domains"), "certificate_sha256", "serial_number", "issuer", "not_before", "not_after", "san_dns_names", "observed_at", "source_type", rejected.alias("rejected_domains"))


def observations(events: DataFrame) -> DataFrame:
    """schemas.OBSERVATIONS: a row for each domain of each event, with its place in pos."""
    # outer: of the other form Spark infers a filter by the size of the array, for which every name would be looked at once more
    rows = events.select("source_log", F.col("index").alias("certificate_index"), F.posexplode_outer("domains").alias("pos", "d"), "certificate_sha256", "serial_number", "issuer", "not_before", "not_after", "san_dns_names", "observed_at", "source_type").where("pos is not null")
    return rows.select("source_log", "certificate_index", F.col("d.normalized").alias("domain"), "pos", "certificate_sha256", "serial_number", "issuer", "not_before", "not_after", "san_dns_names", "observed_at", "source_type")

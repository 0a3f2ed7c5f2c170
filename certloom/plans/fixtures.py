"""Bytes of certificates, tiles and checkpoints for queries and tests."""

from __future__ import annotations

import base64
import struct


def _len(n: int) -> bytes:
    if n < 128:
        return bytes([n])
    raw = n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([0x80 | len(raw)]) + raw


def der(tag: int, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return bytes([tag]) + _len(len(body)) + body


def oid(text: str) -> bytes:
    a, b, *rest = map(int, text.split("."))
    out = bytes([40 * a + b])
    for n in rest:
        group = [n & 0x7F]
        while n := n >> 7:
            group.append(0x80 | n & 0x7F)
        out += bytes(reversed(group))
    return der(0x06, out)


def certificate(names: list[str], serial: int = 1, issuer: str = "Test CA") -> bytes:
    """An unsigned X.509 certificate with DNS names."""
    algorithm = der(0x30, oid("1.2.840.10045.4.3.2"))
    name = der(0x30, der(0x31, der(0x30, oid("2.5.4.3"), der(0x0C, issuer.encode()))))
    validity = der(0x30, der(0x17, b"260101000000Z"), der(0x17, b"270101000000Z"))
    key = der(0x30, der(0x30, oid("1.2.840.10045.2.1")), der(0x03, b"\x00\x04"))
    san = der(0x30, *[der(0x82, n.encode()) for n in names])
    extensions = der(0xA3, der(0x30, der(0x30, oid("2.5.29.17"), der(0x04, san))))
    number = der(0x02, serial.to_bytes(serial.bit_length() // 8 + 1, "big"))
    tbs = der(0x30, der(0xA0, der(0x02, b"\x02")), number, algorithm, name, validity, name, key, extensions)
    return der(0x30, tbs, algorithm, der(0x03, b"\x00" + b"\x01" * 8))


def entry(millis: int, cert: bytes, precertificate: bool = False, extensions: bytes = b"", chain: bytes = b"\x07" * 32) -> bytes:
    """One entry of a data tile."""
    head = struct.pack(">QH", millis, int(precertificate))
    block = lambda n, x: len(x).to_bytes(n, "big") + x
    if precertificate:
        return head + b"\x09" * 32 + block(3, b"tbs" + cert[:8]) + block(2, extensions) + block(3, cert) + block(2, chain)
    return head + block(3, cert) + block(2, extensions) + block(2, chain)


def tile(first: int, width: int) -> bytes:
    """A data tile of `width` entries; each seventh certificate cannot be read, each fifth is a precertificate."""
    out = b""
    for i in range(first, first + width):
        cert = b"\x30\x03bad" if i % 7 == 6 else certificate([f"www.host{i}.example.com", f"login-paypa1-{i}.net", "*.Wild.example.org", "bad_name.example"], i + 1)
        out += entry(1_700_000_000_000 + i, cert, i % 5 == 4)
    return out


def checkpoint(origin: str, size: int, root: bytes, signature: bytes = b"\x01\x02\x03\x04sig") -> str:
    return f"{origin}\n{size}\n{base64.b64encode(root).decode()}\n\n— {origin} {base64.b64encode(signature).decode()}\n"

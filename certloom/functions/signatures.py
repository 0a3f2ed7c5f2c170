"""Checking signatures without a JVM, for the processes of data sources: ECDSA on two NIST curves, and RSA with PKCS #1 v1.5."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass


class BadKey(ValueError):
    pass


@dataclass(frozen=True)
class Curve:
    """y^2 = x^3 - 3 x + b modulo p, of prime order n with the base point (x, y)."""

    p: int
    b: int
    n: int
    x: int
    y: int


#: P-256 and P-384 of FIPS 186, by the DER of their object identifiers.
CURVES = {
    bytes.fromhex("2a8648ce3d030107"): Curve(
        2**256 - 2**224 + 2**192 + 2**96 - 1,
        0x5AC635D8AA3A93E7B3EBBD55769886BC651D06B0CC53B0F63BCE3C3E27D2604B,
        0xFFFFFFFF00000000FFFFFFFFFFFFFFFFBCE6FAADA7179E84F3B9CAC2FC632551,
        0x6B17D1F2E12C4247F8BCE6E563A440F277037D812DEB33A0F4A13945D898C296,
        0x4FE342E2FE1A7F9B8EE7EB4A7C0F9E162BCE33576B315ECECBB6406837BF51F5,
    ),
    bytes.fromhex("2b81040022"): Curve(
        2**384 - 2**128 - 2**96 + 2**32 - 1,
        0xB3312FA7E23EE7E4988E056BE3F82D19181D9C6EFE8141120314088F5013875AC656398D8A2ED19D2A85C8EDD3EC2AEF,
        0xFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFC7634D81F4372DDF581A0DB248B0A77AECEC196ACCC52973,
        0xAA87CA22BE8B05378EB1C71EF320AD746E1D3B628BA79B9859F741E082542A385502F25DBF55296C3A545E3872760AB7,
        0x3617DE4A96262C6F5D9E98BF9292DC29F8F41DBD289A147CE9DA3113B5F0B8C00A60B1CE1D7E819D7A431D7C90EA0E5F,
    ),
}
EC, RSA = bytes.fromhex("2a8648ce3d0201"), bytes.fromhex("2a864886f70d010101")
#: What goes before a digest that RSA signs.
DIGEST_INFO = {
    "sha256": bytes.fromhex("3031300d060960864801650304020105000420"),
    "sha384": bytes.fromhex("3041300d060960864801650304020205000430"),
    "sha512": bytes.fromhex("3051300d060960864801650304020305000440"),
}

Point = tuple[int, int] | None


def _added(c: Curve, s: Point, t: Point) -> Point:
    if s is None or t is None:
        return t if s is None else s
    if s[0] == t[0]:
        if (s[1] + t[1]) % c.p == 0:
            return None
        slope = (3 * s[0] * s[0] - 3) * pow(2 * s[1], -1, c.p)
    else:
        slope = (t[1] - s[1]) * pow(t[0] - s[0], -1, c.p)
    x = (slope * slope - s[0] - t[0]) % c.p
    return x, (slope * (s[0] - x) - s[1]) % c.p


def _times(c: Curve, k: int, s: Point) -> Point:
    out: Point = None
    for bit in bin(k)[2:]:
        out = _added(c, out, out)
        if bit == "1":
            out = _added(c, out, s)
    return out


def _element(data: bytes, at: int) -> tuple[int, bytes, int]:
    """(tag, body, end) of a DER element."""
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
    if at + size > len(data):
        raise BadKey("cut short")
    return tag, data[at : at + size], at + size


def _parts(data: bytes) -> list[tuple[int, bytes]]:
    out, at = [], 0
    while at < len(data):
        tag, body, at = _element(data, at)
        out.append((tag, body))
    return out


def verified(spki: bytes, family: str, hash_: str, message: bytes, signature: bytes) -> bool:
    """Whether a signature ('EC' or 'RSA', over the named hash) by the key of a SubjectPublicKeyInfo is right. BadKey if the key is not of this family."""
    try:
        (_, whole), = _parts(spki)
        (_, algorithm), (_, bits) = _parts(whole)
        kind = _parts(algorithm)
        digest = hashlib.new(hash_, message).digest()
        if family == "EC":
            if kind[0][1] != EC or kind[1][1] not in CURVES:
                raise BadKey("no key on a known curve")
            return _ecdsa(CURVES[kind[1][1]], bits[1:], digest, signature)
        if kind[0][1] != RSA:
            raise BadKey("no RSA key")
        (_, numbers), = _parts(bits[1:])
        modulus, exponent = (int.from_bytes(x, "big") for _, x in _parts(numbers))
        size = (modulus.bit_length() + 7) // 8
        tail = b"\x00" + DIGEST_INFO[hash_] + digest
        return len(signature) == size and pow(int.from_bytes(signature, "big"), exponent, modulus).to_bytes(size, "big") == b"\x00\x01" + b"\xff" * (size - 2 - len(tail)) + tail
    except (IndexError, ValueError) as e:
        if isinstance(e, BadKey):
            raise
        raise BadKey(str(e)) from e


def _ecdsa(c: Curve, point: bytes, digest: bytes, signature: bytes) -> bool:
    size = (c.p.bit_length() + 7) // 8
    if len(point) != 2 * size + 1 or point[0] != 4:
        raise BadKey("no plain point")
    x, y = (int.from_bytes(point[i : i + size], "big") for i in (1, 1 + size))
    if max(x, y) >= c.p or (y * y - x**3 + 3 * x - c.b) % c.p:
        raise BadKey("not on the curve")
    try:
        (tag, body), = _parts(signature)
        (_, r_), (_, s_) = _parts(body)
    except (IndexError, ValueError):
        return False
    r, s = int.from_bytes(r_, "big"), int.from_bytes(s_, "big")
    if tag != 0x30 or not (0 < r < c.n and 0 < s < c.n):
        return False
    e = int.from_bytes(digest, "big") >> max(0, 8 * len(digest) - c.n.bit_length())
    w = pow(s, -1, c.n)
    at = _added(c, _times(c, e * w % c.n, (c.x, c.y)), _times(c, r * w % c.n, (x, y)))
    return at is not None and at[0] % c.n == r

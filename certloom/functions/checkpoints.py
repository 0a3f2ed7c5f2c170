"""Signed checkpoints of logs: parsing as columns, or of one text where signatures are checked."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .signatures import verified


def parse(text: Column) -> Column:
    """struct<origin, size, root_hash, signatures, error>. error says why a text is not a checkpoint; the other fields are then null."""
    cut = F.length(text) - F.instr(F.reverse(text), "\n\n")  # where the last blank line begins
    note = F.when(F.instr(text, "\n\n") > 0, F.substr(text, F.lit(1), cut))
    lines = F.split(note, "\n")
    signed = F.filter(F.split(F.substr(text, cut + 2, F.length(text)), "\n"), lambda x: x != "")
    origin, size, root = (F.get(lines, F.lit(i)) for i in range(3))
    error = (
        F.when(text.isNull(), "null")
        .when(text.rlike(r"[\x00-\x09\x0B-\x1F\x7F]"), "control character")
        .when(note.isNull(), "no signature block")
        .when(F.size(F.filter(lines, lambda x: x != "")) != 3, "not three lines")
        .when(~size.rlike("^(0|[1-9][0-9]{0,18})$") | F.try_to_number(size, F.lit("9" * 19)).isNull(), "bad size")
        .when(~root.rlike("^[A-Za-z0-9+/]{43}=$"), "bad root hash")
        .when(F.size(signed) == 0, "no signature")
        .when(F.exists(signed, lambda x: ~F.startswith(x, F.lit("— "))), "bad signature line")
    )
    ok = error.isNull()
    return F.struct(F.when(ok, origin).alias("origin"), F.when(ok, size.try_cast("bigint")).alias("size"), F.when(ok, root).alias("root_hash"), F.when(ok, signed).alias("signatures"), error.alias("error"))


def root_hex(root_hash: Column) -> Column:
    return F.lower(F.hex(F.unbase64(root_hash)))


def note_key_id(name: Column, log_id_hex: Column) -> Column:
    """The first four bytes, in hex, of the hash that names a log's key in notes."""
    return F.substring(F.sha2(F.concat(name.cast("binary"), F.lit(b"\n\x05"), F.unhex(log_id_hex)), 256), 1, 8)


class CheckpointError(ValueError):
    pass


@dataclass(frozen=True)
class Key:
    """A log's key: DER of a SubjectPublicKeyInfo, and the log's id."""

    origin: str
    spki: bytes
    log_id: bytes

    @classmethod
    def of(cls, origin: str, public_key: str, log_id: str | None = None) -> Key:
        body = "".join(x for x in public_key.strip().splitlines() if not x.startswith("-----"))
        spki = base64.b64decode(body)
        if log_id is None:
            own = hashlib.sha256(spki).digest()
        else:
            own = bytes.fromhex(log_id) if len(log_id) == 64 else base64.b64decode(log_id)
        if len(own) != 32:
            raise CheckpointError("a log id has 32 bytes")
        return cls(origin, spki, own)

    def key_id(self) -> bytes:
        return hashlib.sha256(self.origin.encode() + b"\n\x05" + self.log_id).digest()[:4]


def signature_parts(line: str) -> tuple[str, bytes, bytes]:
    """(name, key id, body) of a signature line."""
    if not line.startswith("— ") or len(parts := line[2:].split(" ")) != 2:
        raise CheckpointError("bad signature line")
    raw = base64.b64decode(parts[1], validate=True)
    if len(raw) < 5:
        raise CheckpointError("short signature")
    return parts[0], raw[:4], raw[4:]


#: TLS hash and signature algorithms.
_HASHES, _SIGNERS = {4: "sha256", 5: "sha384", 6: "sha512"}, {1: "RSA", 3: "EC"}


def tree_head(timestamp: int, size: int, root: bytes) -> bytes:
    return struct.pack(">BBQQ", 0, 1, timestamp, size) + root


def verify(origin: str, size: int, root_hash: str, signatures: list[str], key: Key) -> bool:
    """Whether the first signature by the key is right; without one by it, CheckpointError."""
    if origin != key.origin:
        raise CheckpointError("another log's checkpoint")
    for line in signatures:
        name, key_id, body = signature_parts(line)
        if name != key.origin or key_id != key.key_id():
            continue
        if len(body) < 12:
            raise CheckpointError("short signature")
        timestamp, hash_, signer, n = struct.unpack(">QBBH", body[:12])
        if len(body) != 12 + n:
            raise CheckpointError("bad signature length")
        if hash_ not in _HASHES or signer not in _SIGNERS or (signer == 3 and hash_ == 6):
            return False
        return verified(key.spki, _SIGNERS[signer], _HASHES[hash_], tree_head(timestamp, size, base64.b64decode(root_hash)), body[12:])
    raise CheckpointError("no signature by the trusted key")


_CONTROL = re.compile(r"[\x00-\x09\x0B-\x1F\x7F]")


@dataclass(frozen=True)
class Checkpoint:
    origin: str
    size: int
    root_hash: str
    signatures: list[str]

    @classmethod
    def of(cls, text: str) -> Checkpoint:
        """What parse() gives of one text, on the driver or in a data source; CheckpointError says why it is none."""
        note, blank, signed = text.rpartition("\n\n")
        lines = note.split("\n")
        signatures = [x for x in signed.split("\n") if x]
        for wrong, why in (
            (bool(_CONTROL.search(text)), "control character"),
            (not blank, "no signature block"),
            (len([x for x in lines if x]) != 3, "not three lines"),
            (not re.fullmatch("0|[1-9][0-9]{0,18}", lines[1] if len(lines) > 1 else "") or int(lines[1]) >= 1 << 63, "bad size"),
            (not re.fullmatch("[A-Za-z0-9+/]{43}=", lines[2] if len(lines) > 2 else ""), "bad root hash"),
            (not signatures, "no signature"),
            (not all(x.startswith("— ") for x in signatures), "bad signature line"),
        ):
            if wrong:
                raise CheckpointError(why)
        return cls(lines[0], int(lines[1]), lines[2], signatures)


def consistent(previous_size: int, previous_root: str | None, size: int, root: str, root_of: Callable[[int], str] | None = None) -> None:
    """CheckpointError if a log has shrunk, has another root for the same size, or no longer has the old root at the old size.

    Roots are base64. root_of(size) is the root that the log's tiles give now; without it the old tree is not recomputed.
    """
    if not previous_size:
        return
    if size < previous_size:
        raise CheckpointError(f"the log has rolled back from {previous_size} to {size}")
    if previous_root is None:
        return
    if root_of is not None and root_of(previous_size) != previous_root:
        raise CheckpointError(f"the tree of {previous_size} entries no longer has its root")
    if size == previous_size and root != previous_root:
        raise CheckpointError(f"two roots for {size} entries")

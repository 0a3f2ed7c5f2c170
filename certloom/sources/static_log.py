"""Static certificate logs: a client for the driver and tasks, mirrors on shared storage, and a streaming source.

The driver checks signatures and the tree before any tile is planned, so that data that is not verified never enters a
plan. Tasks fetch and decode tiles.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..config import ConfigError, ct_base_url
from ..functions import merkle
from ..functions.checkpoints import Checkpoint, CheckpointError, Key, consistent, verify
from ..operators import decode

MAX_CHECKPOINT, MAX_TILE = 64 << 10, 64 << 20
TILE = 256


class LogError(RuntimeError):
    pass


def fetch(url: str, most: int, kinds: tuple[str, ...], timeout: float = 30.0, retries: int = 2, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """The body of a URL, of at most `most` bytes and of one of the content types. 429, 5xx, timeouts and lost connections are tried again."""
    if not url.startswith(("http://", "https://")):
        raise ConfigError(f"not an http(s) URL: {url}")
    for attempt in range(retries + 1):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"Accept-Encoding": "gzip"}), timeout=timeout) as reply:
                kind = reply.headers.get_content_type()
                if kind not in kinds:
                    raise LogError(f"content type {kind}")
                body = reply.read(most + 1)
                if len(body) > most:
                    raise LogError("reply too long")
                if reply.headers.get("Content-Encoding") == "gzip":
                    body = gzip.decompress(body)
                    if len(body) > most:
                        raise LogError("reply too long")
                return body
        except urllib.error.HTTPError as e:
            if (e.code != 429 and e.code < 500) or attempt == retries:
                raise
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            if attempt == retries:
                raise
        sleep(0.25 * 2**attempt)
    raise LogError("unreachable")


def index_path(index: int) -> str:
    digits = f"{index:0{-(-len(str(index)) // 3) * 3}d}"
    parts = [digits[i : i + 3] for i in range(0, len(digits), 3)]
    return "/".join([*("x" + p for p in parts[:-1]), parts[-1]])


def tile_path(level: int | None, index: int, width: int | None = None) -> str:
    if level is not None and not 0 <= level <= 5 or width is not None and not 1 <= width <= 255:
        raise ValueError("no such tile")
    return f"tile/{'data' if level is None else level}/{index_path(index)}" + (f".p/{width}" if width else "")


def width_of(size: int, level: int, index: int) -> int | None:
    """Width of a tile in a tree of so many entries; None if full. ValueError if it is outside."""
    n = size >> (8 * level)
    if index * TILE >= n:
        raise ValueError("tile outside the tree")
    return min(n - index * TILE, TILE) % TILE or None


@dataclass
class Log:
    """A log by its base URL; get replaces the HTTP fetch in tests and mirrors."""

    base_url: str
    get: Callable[[str], bytes] | None = None

    def __post_init__(self):
        if self.get is None:
            self.base_url = ct_base_url(self.base_url)

    def _get(self, path: str) -> bytes:
        if self.get is not None:
            return self.get(path)
        text = path == "checkpoint"
        return fetch(f"{self.base_url}/{path}", MAX_CHECKPOINT if text else MAX_TILE, ("text/plain",) if text else ("application/octet-stream",))

    def checkpoint(self) -> str:
        return self._get("checkpoint").decode("utf-8")

    def tile(self, level: int | None, index: int, width: int | None = None) -> tuple[bytes, int | None]:
        """Bytes and the width that they have: where a partial tile is gone, the full one is there."""
        try:
            return self._get(tile_path(level, index, width)), width
        except (urllib.error.HTTPError, FileNotFoundError) as e:
            if width is None or getattr(e, "code", 404) != 404:
                raise
            return self._get(tile_path(level, index)), None

    def hashes(self, size: int, level: int, index: int) -> list[bytes]:
        width = width_of(size, level, index)
        data, real = self.tile(level, index, width)
        if len(data) != 32 * (real or TILE):
            raise LogError("bad hash tile")
        return [data[i : i + 32] for i in range(0, 32 * (width or TILE), 32)]

    def root(self, size: int) -> bytes:
        """Root of the tree of so many entries, from a hash tile for each perfect subtree."""
        return self.frontier(size).root()

    def subtree_root(self, size: int, start: int, n: int) -> bytes:
        """Root of the perfect subtree of n entries from start on, in a tree of size entries: of the hashes of one tile."""
        level, count = merkle.subtree(n)
        first = start >> (8 * level)
        part = self.hashes(size, level, first // TILE)[first % TILE : first % TILE + count]
        while len(part) > 1:
            part = [hashlib.sha256(b"\x01" + part[i] + part[i + 1]).digest() for i in range(0, len(part), 2)]
        return part[0]

    def frontier(self, size: int, after: merkle.Frontier | None = None) -> merkle.Frontier:
        """The frontier of the tree now; of entries before `after` no hash is read."""
        return (after or merkle.Frontier()).grown(size, lambda start, n: self.subtree_root(size, start, n))

    def root_hash(self, size: int) -> str:
        return base64.b64encode(self.root(size)).decode()

    def verified(self, key: Key | None, before: tuple[int, str | None] = (0, None)) -> Checkpoint:
        """The log's checkpoint now: signed by the key (if one is given), consistent with the (size, root hash) seen before, and the root of the tree."""
        now = Checkpoint.of(self.checkpoint())
        if key is not None and not verify(now.origin, now.size, now.root_hash, now.signatures, key):
            raise CheckpointError("bad signature")
        consistent(*before, now.size, now.root_hash, self.root_hash)
        if self.root_hash(now.size) != now.root_hash:
            raise LogError("the checkpoint's root is not the tree's")
        return now

    def followed(self, key: Key | None, before: merkle.Frontier) -> tuple[Checkpoint, merkle.Frontier]:
        """The log's checkpoint now, and the frontier of its tree: signed by the key (if one is given), and the root of a tree that goes on from `before`.

        Only hashes of new entries are read. A log that is smaller than before, that has another root for the same size, or
        whose root is not that of the old tree and the new entries, is a CheckpointError.
        """
        now = Checkpoint.of(self.checkpoint())
        if key is not None and not verify(now.origin, now.size, now.root_hash, now.signatures, key):
            raise CheckpointError("bad signature")
        consistent(before.size, base64.b64encode(before.root()).decode(), now.size, now.root_hash)
        grown = self.frontier(now.size, before)
        if base64.b64encode(grown.root()).decode() != now.root_hash:
            raise CheckpointError(f"the checkpoint's root is not that of the {before.size} entries seen before and those after them" if before.size else "the checkpoint's root is not the tree's")
        return now, grown

    def entries(self, size: int, index: int) -> list[dict]:
        """Entries of a data tile, each checked against the log's hash of it."""
        width = width_of(size, 0, index)
        data, real = self.tile(None, index, width)
        rows = decode.read_tile(data, index, real)[: width or TILE]
        for row, want in zip(rows, self.hashes(size, 0, index), strict=True):
            if row["merkle_leaf_hash"] != want.hex():
                raise LogError(f"entry {row['index']} is not the log's")
        return rows


def mirror(folder: str) -> Log:
    """A log mirrored under a folder that Python can open, on all machines."""
    folder = folder.removeprefix("file://")

    def get(path: str) -> bytes:
        with open(f"{folder}/{path}", "rb") as f:
            return f.read()

    return Log(folder, get)


def write_mirror(tiles: DataFrame, folder: str) -> int:
    """Write data tiles (index, width, bytes) and the hash tiles of their entries as a mirror; how many. Tasks write them; one that is tried again puts the same files in place."""
    top = Path(folder.removeprefix("file://"))

    def put(path: str, data: bytes) -> None:
        at = top / path
        at.parent.mkdir(parents=True, exist_ok=True)
        part = at.with_name(f".{at.name}-{uuid.uuid4().hex}")
        part.write_bytes(data)
        part.replace(at)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for index, width, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                put(tile_path(None, index, width), data)
                put(tile_path(0, index, width), b"".join(bytes.fromhex(row["merkle_leaf_hash"]) for row in decode.read_tile(data, index, width)))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return tiles.select("index", "width", "bytes").mapInArrow(written, "n bigint").agg(F.sum("n")).first()[0] or 0


def read_mirror(spark: SparkSession, folder: str, first: int = 0, last: int | None = None) -> DataFrame:
    """(index, width, bytes) of the data tiles under a folder of any file system that Spark reads; a full tile goes before partial ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder}/tile/data")
    path = F.regexp_extract("path", "tile/data/(.*)$", 1)
    number = F.regexp_replace(F.regexp_replace(path, "[.]p/.*$", ""), "[x/]", "").cast("bigint")
    width = F.nullif(F.regexp_extract(path, "[.]p/([0-9]+)$", 1), F.lit("")).cast("int")
    tiles = files.select(number.alias("index"), width.alias("width"), F.col("content").alias("bytes")).where(F.col("index") >= first)
    if last is not None:
        tiles = tiles.where(F.col("index") <= last)
    best = tiles.groupBy("index").agg(F.max(F.coalesce("width", F.lit(TILE))).alias("__best"))
    return tiles.join(best, "index").where(F.coalesce("width", F.lit(TILE)) == F.col("__best")).drop("__best")


#: Tiles that a task reads one after the other at most, and tasks that a read of many tiles has at least.
MOST_TILES, LEAST_TASKS = 64, 256


@dataclass
class _Tiles(InputPartition):
    """Tiles of a run: index is the first, read one after the other."""

    index: int
    count: int
    size: int
    first: int
    end: int


class _Reader:
    def __init__(self, options: dict):
        self.log = mirror(options["mirror"]) if options.get("mirror") else Log(options["url"])
        self.options = options
        self.key = Key.of(options["origin"], options["publickey"], options.get("logid")) if options.get("publickey") else None
        self.first = int(options.get("firstentry", 0))

    def tiles(self, first: int, end: int, size: int) -> list[_Tiles]:
        """The tiles of entries first to before end of a tree of size entries."""
        start, stop = first // TILE, -(-end // TILE)
        run = min(MOST_TILES, max(1, (stop - start) // LEAST_TASKS))
        return [_Tiles(i, min(run, stop - i), size, first, end) for i in range(start, stop, run)]

    def read(self, partition: _Tiles) -> Iterator[tuple]:
        for row in chain.from_iterable(self.log.entries(partition.size, i) for i in range(partition.index, partition.index + partition.count)):
            if partition.first <= row["index"] < partition.end:
                yield (row["index"], row["timestamp_millis"], row["kind"], row["merkle_leaf_hash"], row["certificate_der"], row["chain_fingerprints"], row["extensions_len"])


class _Batch(_Reader, DataSourceReader):
    def partitions(self) -> list[_Tiles]:
        """Of the tree that the checkpoint now tells of, or, with size, of one that the caller has verified."""
        size = int(self.options["size"]) if self.options.get("size") else self.log.verified(self.key).size
        return self.tiles(self.first, min(size, int(self.options.get("end", size))), size)


class _Stream(_Reader, DataSourceStreamReader):
    """Offsets are {"entry": next entry, "size": tree size, "root": root hash}; a step has at most maxTiles tiles.

    Each step verifies the checkpoint: its signature if a key is given, the tree, and that the tree of the step before is
    still part of it.
    """

    def __init__(self, options: dict):
        super().__init__(options)
        self.at = self.initialOffset()

    def initialOffset(self) -> dict:
        return {"entry": self.first, "size": 0, "root": None}

    def latestOffset(self) -> dict:
        now = self.log.verified(self.key, (self.at["size"], self.at["root"]))
        end = min(now.size, (self.at["entry"] // TILE + int(self.options.get("maxtiles", 1))) * TILE)
        self.at = {"entry": max(self.at["entry"], end), "size": now.size, "root": now.root_hash}
        return self.at

    def partitions(self, start: dict, end: dict) -> list[_Tiles]:
        if end["entry"] > self.at["entry"]:  # a stream that goes on after a restart
            self.at = end
        return self.tiles(start["entry"], end["entry"], end["size"])

    def commit(self, end: dict) -> None:
        if end["entry"] > self.at["entry"]:
            self.at = end


class StaticLogSource(DataSource):
    """spark.read / readStream .format("static_log") with url or mirror; firstEntry, end, size, maxTiles; origin, publicKey, logId of a key that must have signed."""

    @classmethod
    def name(cls) -> str:
        return "static_log"

    def schema(self) -> str:
        from .. import schemas

        return schemas.ENTRIES

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Batch({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001
        return _Stream({k.lower(): v for k, v in self.options.items()})


def read_json_events(spark: SparkSession, path: str) -> DataFrame:
    """schemas.EVENTS of JSON lines {source_log, domains: [name], observed_at}."""
    raw = spark.read.schema("source_log string, domains array<string>, observed_at string, index bigint, source_type string").json(path)
    null = F.lit(None).cast("string")
    raw = raw.withColumns({"san_dns_names": F.col("domains"), "source_type": F.coalesce("source_type", F.lit("ct"))} | dict.fromkeys(("certificate_sha256", "serial_number", "issuer", "not_before", "not_after"), null))
    return decode.certificate_events(raw).drop("rejected_domains")

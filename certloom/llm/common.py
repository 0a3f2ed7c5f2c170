"""Shared helpers of the corpus operators: reading text columns in bulk, hashing words, tables in the shared folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..ship import ship

#: Rows of a batch sent to a Python worker. Texts have no bound, so batches stay short.
BATCH_ROWS = "500"
#: Bytes of text whose 64-bit hashes are in memory at once.
PIECE = 1 << 20

U64 = np.uint64


def prepare(spark: SparkSession) -> None:
    """Lower the batch size of Arrow transfers, unless the session sets one itself, and see that tasks find this package."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, BATCH_ROWS)


_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where it is unset: a temporary one if all run on this machine, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^]]*\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir is unset: with master {master} it must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = tempfile.mkdtemp(prefix="certloom-")
        atexit.register(shutil.rmtree, _own_folders[app], True)
    return _own_folders[app]


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage and survives lost executors.

    The table goes when it is forgotten, or else when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def forget(table: DataFrame) -> None:
    """Delete a shared table, once all that reads it has been written or collected."""
    _remove(table.sparkSession, table.shared_path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended already
        pass


def cut_of(share: float) -> int:
    """The 64-bit hash at or below which this share of all hashes is."""
    return min(2**63 - 1, int(share * 2**64) - 2**63)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names for wanted that df does not have, so that no column of the user's is overwritten."""
    have = {c.lower() for c in df.columns}
    names = []
    for name in wanted:
        while f"__{name}".lower() in have:
            name = f"_{name}"
        names.append(f"__{name}")
    return names


def extended(df: DataFrame, **columns: str) -> T.StructType:
    """df's schema and after it the named columns, types as in DDL."""
    more = T.StructType.fromDDL(", ".join(f"`{k}` {v}" for k, v in columns.items()))
    return T.StructType([*df.schema.fields, *more.fields])


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string or binary array. A null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:  # a null may still own bytes
        null = np.asarray(column.is_null())
        if (np.diff(offsets)[null] > 0).any():
            return raw(column.fill_null(b"" if "binary" in str(column.type) else ""))
    return data, offsets


def separators(kept: str) -> np.ndarray:
    """Table of 256: True for bytes of words. kept: 'letters' ([^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after A-Z are lower-cased) or 'spaces' ([^\\x20\\x09-\\x0D])."""
    word = np.ones(256, bool)
    if kept == "letters":
        word[:128] = False
        word[0x30:0x3A] = word[0x61:0x7B] = word[0x41:0x5B] = True
    else:
        word[0x20] = word[0x09:0x0E] = False
    return word


LETTERS, SPACES = separators("letters"), separators("spaces")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_P = U64(0x9E3779B97F4A7C15 | 1)
_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1B54A32D192ED03))
_FOLD = np.arange(256)
_FOLD[0x41:0x5B] += 32
_BYTE = _BYTE[_FOLD]  # A-Z count as a-z
_powers = np.ones(1, U64)


def powers(n: int) -> np.ndarray:
    """At least n powers of a constant, from the zeroth on."""
    global _powers
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        _powers = np.cumprod(np.concatenate([[U64(1)], np.full(size - 1, _P, U64)]), dtype=U64)
    return _powers


class Words:
    """The words of consecutive texts: document index, first byte, byte after the last; hash64() has their hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word: np.ndarray):
        self.base, self.n_docs = int(offsets[0]), len(offsets) - 1
        self.data = data = data[self.base : int(offsets[-1])]
        self.offsets = offsets = offsets - self.base
        on = np.zeros(len(data) + 1, bool)
        on[:-1] = word[data]
        begin = on.copy()
        begin[1:] &= ~on[:-1]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        begin[inner] = on[inner]  # words end with their document
        self.start = np.flatnonzero(begin)
        end = ~on
        end[0] = False
        end[1:] &= on[:-1]
        end[inner] |= on[inner - 1]
        self.end = np.flatnonzero(end)
        if len(self.end) < len(self.start):
            self.end = np.append(self.end, len(data))
        self.doc = (np.searchsorted(offsets, self.start, "right") - 1).astype(np.int64)
        self.counts = np.bincount(self.doc, minlength=self.n_docs) if self.n_docs else np.zeros(0, np.int64)

    def hash64(self, most: int | None = None) -> np.ndarray:
        """64-bit hashes, A-Z taken as a-z. most: of the first bytes only."""
        out = np.zeros(len(self.start), U64)
        i = 0
        while i < len(self.start):
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + PIECE, "right")))
            lo, starts = int(self.start[i]), self.start[i:j] - self.start[i]
            n = int(self.end[j - 1]) - lo
            sizes = self.end[i:j] - self.start[i:j]
            if most is not None:
                sizes = np.minimum(sizes, most)
            gaps = np.diff(starts, append=n)
            at = np.arange(n) - np.repeat(starts, gaps)
            value = _BYTE[self.data[lo : lo + n]] * powers(int(gaps.max()) + 1)[at]
            value[at >= np.repeat(sizes, gaps)] = 0
            out[i:j] = mix(np.add.reduceat(value, starts) + sizes.astype(U64) * U64(0x2545F4914F6CDD1D))
            i = j
        return out


def chunks(offsets: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about so many bytes; a longer document comes alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


_STEP = mix(np.arange(11, 11 + 64, dtype=U64)) | U64(1)


def shingles(words: Words, hashes: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each run of width words; a document of fewer words, but not none, has one of all its words."""
    n = len(hashes)
    docs, out = [], []
    if n >= width:
        total = hashes[: n - width + 1] * _STEP[0]
        for k in range(1, width):
            total = total + hashes[k : n - width + 1 + k] * _STEP[k]
        whole = words.doc[: n - width + 1] == words.doc[width - 1 :]
        docs.append(words.doc[: n - width + 1][whole])
        out.append(mix(total[whole]))
    short = np.flatnonzero((words.counts > 0) & (words.counts < width))
    if len(short):
        first = np.searchsorted(words.doc, short)
        total = words.counts[short].astype(U64) * U64(0xA24BAED4963EE407)
        for k in range(width - 1):
            has = words.counts[short] > k
            total[has] += hashes[first[has] + k] * _STEP[k]
        docs.append(short)
        out.append(mix(total))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    doc, value = np.concatenate(docs), np.concatenate(out)
    order = np.argsort(doc, kind="stable") if len(docs) > 1 else slice(None)
    return doc[order], value[order]


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column: values dealt out by counts."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, kind))


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    """A batch of these columns, arrays or lists."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

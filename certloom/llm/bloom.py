"""Two Bloom filters, for hashes seen once and seen twice, built in slices of the hash space.

Each task packs the 64-bit hashes of its rows by slice (8 bytes a value, a value at most twice in a pack, no texts);
the task of a slice streams them through its pair of filters. As long as the second filters together have at most
MAX_BITS they are broadcast, and tasks test their own rows. Beyond that nothing is broadcast: slices are cut finer, a
value leaves its slice as a row when it goes from the first filter to the second, and rows learn by joins which of their
values did. Either way all values that repeat are suspected, and few others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

U64 = np.uint64
SLICES = 64
BITS_PER_KEY = 12
PROBES = 4
#: What is broadcast at most: 2^28 bits, 32 MiB.
MAX_BITS = 1 << 28
#: Values of a slice that is not broadcast, on average at most; its two filters then have 16 MiB each.
SLICE_VALUES = 1 << 23

PACKED = "slice int, n bigint, hashes binary"
_PACKED = pa.schema([("slice", pa.int32()), ("n", pa.int64()), ("hashes", pa.binary())])

#: Of a batch: the row that each value belongs to, the values, and what emit() may use besides.
Values = tuple[np.ndarray, np.ndarray, Any]


def pack(parts: list[np.ndarray], slices: int = SLICES) -> pa.RecordBatch:
    """Rows (slice, n, hashes) of what a task has gathered: a value that is there more often is there twice."""
    h, times = np.unique(np.concatenate(parts) if parts else np.zeros(0, U64), return_counts=True)
    h = np.repeat(h, np.minimum(times, 2))
    own, first = np.unique(slice_of(h, slices), return_index=True)
    edge = np.append(first, len(h))
    rows = [(int(k), int(b - a), h[a:b].tobytes()) for k, a, b in zip(own, edge[:-1], edge[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_PACKED)], schema=_PACKED)


def slice_of(h: np.ndarray, slices: int) -> np.ndarray:
    """By the first bits; slices is a power of two."""
    bits = slices.bit_length() - 1
    return (h >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def packing(batches: Iterator[pa.RecordBatch], hashes: Callable[[pa.RecordBatch], np.ndarray], most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """hashes(batch) gives the values of a batch; packed rows leave before they take much memory."""
    parts, n = [], 0
    for batch in batches:
        h = hashes(batch)
        parts.append(h)
        n += len(h)
        if n >= most:
            yield pack(parts)
            parts, n = [], 0
    yield pack(parts)


def probes(h: np.ndarray, bits: int) -> np.ndarray:
    """(PROBES, n) bit positions in a slice of bits, a power of two."""
    a, b = h, common.mix(h) | U64(1)
    return np.stack([(a + U64(i) * b) & U64(bits - 1) for i in range(PROBES)])


def test(filter_: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.ones(at.shape[1], bool)
    for p in at:
        out &= (filter_[p >> U64(3)] >> (p & U64(7)).astype(np.uint8)) & 1 == 1
    return out


def put(filter_: np.ndarray, at: np.ndarray) -> None:
    for p in at:
        np.bitwise_or.at(filter_, p >> U64(3), (1 << (p & U64(7))).astype(np.uint8))


def add(once: np.ndarray, twice: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values not in once go there; those that are go to twice, and those that are new there are returned."""
    h, n = np.unique(h, return_counts=True)
    at = probes(h, len(once) * 8)
    again = test(once, at) | (n > 1)
    new = again & ~test(twice, at)
    put(twice, at[:, again])
    put(once, at[:, ~again])
    return h[new]


def _bits(n: int) -> int:
    """For n values: a power of two, at least BITS_PER_KEY each."""
    return max(1 << 16, 1 << int(BITS_PER_KEY * n).bit_length())


class Twice:
    """What repeats, by slice; test() may also hold for some values that do not."""

    def __init__(self, bits: int, slices: dict[int, bytes]):
        self.bits = bits
        self.slices = {k: np.frombuffer(v, np.uint8) for k, v in slices.items()}

    def test(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), bool)
        if not len(h):
            return out
        s = slice_of(h, SLICES)
        order = np.argsort(s, kind="stable")
        edge = np.searchsorted(s[order], np.arange(SLICES + 1))
        for k, own in self.slices.items():
            i = order[edge[k] : edge[k + 1]]
            if len(i):
                out[i] = test(own, probes(h[i], self.bits))
        return out


def _sent(packed: DataFrame, bits: int, fill: Callable, kind: type[Twice]) -> Broadcast:
    """The filters of all slices, of bits each, broadcast; fill(state, hashes) streams into [once, twice]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for s, h in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                fill(own.setdefault(s, [np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)]), np.frombuffer(h.as_buffer(), U64))
        for s, (_, twice) in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([twice.tobytes()], pa.binary())], names=["slice", "bits"])

    rows = packed.select("slice", "hashes").repartition(SLICES, "slice").mapInArrow(run, "slice int, bits binary").collect()  # SLICES rows, MAX_BITS in all
    return packed.sparkSession.sparkContext.broadcast(kind(bits, {r[0]: bytes(r[1]) for r in rows}))


def _crossing(packed: DataFrame, n: int, slice_values: int) -> DataFrame:
    """(hash): the values that went from the first filter of their slice to the second. Nothing of it is broadcast or collected."""
    slices = max(SLICES, 1 << max(0, (n - 1) // slice_values).bit_length())
    bits = _bits(-(-2 * n // slices))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pack([np.frombuffer(h.as_buffer(), U64) for h in batch.column(0)], slices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, twice = -1, None, None
        for batch in batches:
            for s, h in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if s != now:
                    now, once, twice = s, np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
                new = add(once, twice, np.frombuffer(h.as_buffer(), U64))
                yield pa.RecordBatch.from_arrays([pa.array(new.view(np.int64))], names=["hash"])

    tasks = max(slices, int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    finer = packed.select("hashes").mapInArrow(cut, PACKED).select("slice", "hashes")
    return finer.repartition(tasks, "slice").sortWithinPartitions("slice").mapInArrow(run, "hash bigint")


def suspects(docs: DataFrame, values: Callable[[pa.RecordBatch], Values], emit: Callable[[pa.RecordBatch, Values, np.ndarray], pa.RecordBatch], schema: str, max_bits: int | None = None, slice_values: int | None = None) -> DataFrame:
    """Rows that emit(batch, values, suspected) makes of batches of docs, whose first column is a bigint that names a row.

    suspected tells which of the values repeat anywhere in docs, or may do so. Rows may share a name; each of them then
    has the suspects of all.
    """
    max_bits, slice_values = max_bits or MAX_BITS, slice_values or SLICE_VALUES
    name = docs.columns[0]

    def packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packing(batches, lambda batch: values(batch)[1])

    packed = common.shared_table(docs.mapInArrow(packed_rows, PACKED), "hashes")
    n = packed.agg(F.sum("n")).first()[0] or 0
    if _bits(n) <= max_bits:
        twice = _sent(packed, _bits(n) // SLICES, lambda own, h: add(*own, h), Twice)
        common.forget(packed)

        def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = values(batch)
                yield emit(batch, own, twice.value.test(own[1]))

        return docs.mapInArrow(tested, schema)

    crossed = common.shared_table(_crossing(packed, n, slice_values).distinct(), "crossed")
    common.forget(packed)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, h, _ = values(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(h.view(np.int64))], names=["__row", "hash"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.select(range(batch.num_columns - 1))
            wanted = np.asarray(batch.column(batch.num_columns - 1).flatten()).view(U64)
            of = values(own)
            yield emit(own, of, np.isin(of[1], wanted))

    lists = docs.mapInArrow(pairs, "__row bigint, hash bigint").join(crossed, "hash", "left_semi").groupBy("__row").agg(F.collect_set("hash").alias("__hashes"))
    return docs.join(lists, docs[name] == lists["__row"]).drop("__row").mapInArrow(listed, schema)


class Members(Twice):
    """A set of ids; test() takes ids and may also hold for some others."""

    def test(self, ids: np.ndarray) -> np.ndarray:
        return super().test(common.mix(ids.astype(np.int64).view(U64)))


def members(ids: DataFrame, max_bits: int | None = None) -> Broadcast | None:
    """The filter of a column of ids as a broadcast variable; none if it would have more than max_bits."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packing(batches, lambda batch: common.mix(np.unique(np.asarray(batch.column(0))).astype(np.int64).view(U64)))

    packed = common.shared_table(ids.mapInArrow(hashes, PACKED), "ids")
    n = packed.agg(F.sum("n")).first()[0] or 0
    out = None
    if _bits(n) <= (max_bits or MAX_BITS):
        bits = _bits(n) // SLICES
        out = _sent(packed, bits, lambda own, h: put(own[1], probes(h, bits)), Members)
    common.forget(packed)
    return out


def holding(docs: DataFrame, filter_: Broadcast | None, inside: bool = True) -> DataFrame:
    """Rows of docs whose first column, an id, may be a member (inside), or is none for sure. Without a filter all may be."""
    if filter_ is None:
        return docs if inside else docs.limit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(filter_.value.test(np.asarray(batch.column(0))) == inside))

    return docs.mapInArrow(run, docs.schema)

"""Document fingerprints: bottom-k sketches of the hashes of five-word shingles.

Sketches of parts merge to the sketch of the whole, and estimate resemblance, containment and the number of distinct
shingles.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

K, WIDTH, BITS = 128, 5, 40
_SHIFT = np.uint64(64 - BITS)


def sketches(texts: pa.Array, k: int = K) -> list[np.ndarray]:
    """For each text, the k least 40-bit hashes of its distinct shingles, in order. A null or wordless text has none."""
    data, offsets = common.raw(texts)
    out = []
    for lo, hi in common.chunks(offsets):
        words = common.Words(data, offsets[lo : hi + 1], common.SPACES)
        doc, value = common.shingles(words, words.hash64(), WIDTH)
        value, edge = value >> _SHIFT, np.searchsorted(doc, np.arange(hi - lo + 1))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            own = value[a:b]
            if len(own) > 8 * k:  # the least of many: sort few
                for take in (2 * k, 8 * k):
                    least = np.unique(np.partition(own, take)[:take])
                    if len(least) >= k:
                        break
                else:
                    least = np.unique(own)
            else:
                least = np.unique(own)
            out.append(least[:k])
    return out


def merge(*parts: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union."""
    return np.unique(np.concatenate(parts))[:k] if parts else np.zeros(0, np.uint64)


def distinct(sketch: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(sketch)) if len(sketch) < k else (k - 1) * float(1 << BITS) / float(sketch[-1])


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated size of the intersection over that of the union; two empty ones are alike, an empty and another are not."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    least = merge(a, b, k=k)
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(least, both, assume_unique=True).sum()) / len(least)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    both = resemblance(a, b, k) * distinct(merge(a, b, k=k), k)
    return min(1.0, both / distinct(a, k))


def encode(sketch: np.ndarray) -> str:
    """As text: five bytes a hash, base64."""
    return base64.b64encode(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()).decode()


def decode(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 5)
    return np.concatenate([np.zeros((len(raw), 3), np.uint8), raw], axis=1).reshape(-1).view(">u8").astype(np.uint64)


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, n_shingles): a sketch per row and the estimated number of its distinct shingles. Equal texts have equal sketches."""
    common.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = sketches(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encode(s) for s in own], pa.string()), pa.array([distinct(s) for s in own], pa.float64())], names=["doc_id", "fingerprint", "n_shingles"])

    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fingerprint string, n_shingles double")


#: Documents of a range of doc_id into which with_next() deals them, about; fewer if there would be few ranges.
RANGE_ROWS = 1_000_000
#: Ranges for each shuffle partition, and so in all, at least.
RANGES_EACH, RANGES = 4, 1024


def _range_of(bounds: list[int]) -> Column:
    """How many of the bounds, which descend, are above doc_id: first by every m-th of them, then within m."""
    if not bounds:
        return F.lit(0)
    m = math.isqrt(len(bounds)) + 1
    every = F.array(*map(F.lit, bounds))
    coarse = F.size(F.filter(F.array(*map(F.lit, bounds[m - 1 :: m])).cast("array<bigint>"), lambda b: b > F.col("doc_id"))) * m
    return F.element_at(F.transform(F.array(coarse), lambda k: k + F.size(F.filter(F.slice(every, k + 1, m), lambda b: b > F.col("doc_id")))), 1)


def with_next(docs: DataFrame) -> DataFrame:
    """(range, is_copy, doc_id, text), where within a range each document's next by descending doc_id follows it.

    Documents go to ranges of doc_id by one shuffle; the first of a range is also copied to the end of the one before
    it (that of the first range to the last), so no order over all documents is needed in one task.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null")
    n = max(min(RANGES, RANGES_EACH * parts), -(-docs.count() // RANGE_ROWS))
    bounds = sorted({int(x) for x in docs.stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (8 * n))}, reverse=True)
    parted = docs.withColumn("range", _range_of(bounds))
    heads = sorted((r[0], r[1]) for r in parted.groupBy("range").agg(F.max("doc_id")).collect())  # a row for each range
    before = [(first, heads[i - 1][0]) for i, (_, first) in enumerate(heads)]
    copies = F.broadcast(spark.createDataFrame(before, "_head bigint, _to int"))  # as many rows as ranges
    extra = parted.join(copies, F.col("doc_id") == F.col("_head"))
    rows = parted.select("range", F.lit(False).alias("is_copy"), "doc_id", "text").unionByName(extra.select(F.col("_to").alias("range"), F.lit(True).alias("is_copy"), "doc_id", "text"))
    return rows.repartition(min(n, RANGES_EACH * max(parts, RANGES)), "range").sortWithinPartitions("range", "is_copy", F.desc("doc_id"), "text")


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of the text whose last third is replaced by the beginning of the next document's.

    Rows without doc_id have no place in the order and are left out; rows that share one follow each other by text. A
    null text is empty, a long one taken whole. Of a single document the next is itself; an empty table gives no rows.
    Other columns are not read.
    """
    common.prepare(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (range, doc_id, text, sketch) that waits for its next
        for batch in batches:
            texts = batch.column(3).fill_null("")
            own = sketches(texts)
            pairs = []
            for part, copy, doc, text, sketch in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), texts.to_pylist(), own, strict=True):
                if last and last[0] == part:
                    third = len(last[2]) // 3
                    pairs.append((last[1], len(last[2]), last[2][: len(last[2]) - third] + text[:third], last[3], sketch))
                last = None if copy else (part, doc, text, sketch)
            new = sketches(pa.array([p[2] for p in pairs], pa.string()))
            yield common.batch_of(schema, [[p[0] for p in pairs], [p[1] for p in pairs], [hashlib.sha256(p[2].encode()).hexdigest() for p in pairs], [encode(p[3]) for p in pairs], [encode(s) for s in new], [resemblance(p[3], s) for p, s in zip(pairs, new, strict=True)], [resemblance(p[3], p[4]) for p in pairs]])

    return with_next(docs).mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

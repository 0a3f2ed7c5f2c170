"""Line dedup.

Two Bloom filters take the hashes of all line keys, once seen and twice seen. Only lines that the second suspects are
shuffled, by their whole key, to confirm how many documents hold them and which of these keeps its copy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom, common

MIN_CHARS, MIN_DOCS = 20, 3
_BLANK = b" \t\n\x0b\x0c\r"


def key_of(line: bytes) -> bytes:
    return line.strip(_BLANK).lower()  # bytes.lower() turns A-Z alone


def long_enough(key: bytes, least: int) -> bool:
    """At least so many code points."""
    return len(key) >= least and (len(key) >= 4 * least or sum(b & 0xC0 != 0x80 for b in key) >= least)


def hash_of(key: bytes) -> int:
    return xxhash.xxh64_intdigest(key, 42)


def _texts(column: pa.Array) -> Iterator[bytes]:
    data, offsets = common.raw(column)
    data = data.tobytes()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield data[a:b]


def _keys(text: bytes, least: int) -> dict[bytes, int]:
    """The distinct keys that are long enough, and their hashes."""
    return {k: hash_of(k) for k in {key_of(x) for x in text.split(b"\n")} if long_enough(k, least)}


_SUSPECTS = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("hash", pa.int64())])


def _values(batch: pa.RecordBatch) -> bloom.Values:
    """Hashes of the keys of a batch (doc_id, text), and the keys."""
    own = [_keys(text, MIN_CHARS) for text in _texts(batch.column(1))]
    return np.repeat(np.arange(len(own)), [len(x) for x in own]), np.array([h for x in own for h in x.values()], np.uint64), [k for x in own for k in x]


def _suspected(batch: pa.RecordBatch, own: bloom.Values, suspected: np.ndarray) -> pa.RecordBatch:
    """(doc_id, key, hash) of the keys of a batch (doc_id, text) whose hash is suspected to repeat."""
    hit = np.flatnonzero(suspected)
    return common.batch_of(_SUSPECTS, [batch.column(0).take(pa.array(own[0][hit])), [own[2][i] for i in hit], own[1][hit].view(np.int64)])


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, hashes): the keys whose lines each document loses, by their 64-bit hash."""
    common.prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    suspects = bloom.suspects(docs, _values, _suspected, "doc_id bigint, key binary, hash bigint").distinct()
    suspects = common.shared_table(suspects, "suspects")
    dropped = suspects.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= MIN_DOCS).select("key", "keeper")
    return suspects.join(dropped, "key").where("doc_id <> keeper").groupBy("doc_id").agg(F.collect_list("hash").alias("hashes"))


def dedup_lines(docs: DataFrame, text: str = "text") -> tuple[DataFrame, list[str]]:
    """docs with repeated lines dropped from text, and two more columns, whose names are returned: lines before, lines dropped.

    A line's key is the line without [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased. A key of MIN_CHARS code points or
    more that MIN_DOCS documents or more hold (rows with the same doc_id are one document) stays only in the largest
    doc_id; there all its lines stay. Null or empty text is one empty line; it and rows without doc_id lose nothing, a
    null text stays null. All rows and other columns stay.
    """
    n_lines, n_dropped, gone, of = common.fresh(docs, "n_lines", "n_dropped", "gone", "of")
    lost = find(docs.select("doc_id", F.col(text).alias("text"))).select(F.col("doc_id").alias(of), F.col("hashes").alias(gone))
    joined = docs.join(lost, docs["doc_id"] == lost[of], "left").drop(of)
    schema = common.extended(docs, **{n_lines: "bigint", n_dropped: "bigint"})
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, at = to_arrow_schema(schema), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, before, dropped = [], [], []
            null = batch.column(at).is_null().to_pylist()
            for t, lose, none in zip(_texts(batch.column(at)), batch.column(batch.num_columns - 1), null, strict=True):
                lines = t.split(b"\n")
                kept = lines
                if lose.is_valid:
                    lose = {h & 0xFFFFFFFFFFFFFFFF for h in lose.as_py()}
                    kept = [x for x in lines if not (len(x) >= MIN_CHARS and hash_of(k := key_of(x)) in lose and long_enough(k, MIN_CHARS))]
                texts.append(None if none else b"\n".join(kept) if len(kept) < len(lines) else t)
                before.append(len(lines))
                dropped.append(len(lines) - len(kept))
            out = batch.columns[:-1]
            out[at] = pa.array(texts, pa.binary()).cast(pa.string(), safe=False)
            yield common.batch_of(arrow, [*out, before, dropped])

    return joined.mapInArrow(run, schema), [n_lines, n_dropped]


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    out, (n_lines, n_dropped) = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col(n_lines).alias("n_lines"), F.col(n_dropped).alias("n_dropped"), F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, i, line, lower_az AS key FROM (
    SELECT doc_id, i, line, translate(regexp_replace(line, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az
    FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents))),
held AS (SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT l.doc_id, l.i, l.line, (h.key IS NOT NULL AND l.doc_id <> h.keeper) AS gone FROM lines l LEFT JOIN held h ON l.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

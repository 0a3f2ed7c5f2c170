"""Alignment of two tokenizers over the same bytes.

Tokens of one tokenizer (A) and tokens of the other (B) are the two sides of a graph; a link joins those whose byte
ranges overlap. Its connected components, found by union-find, are exactly the smallest groups of tokens that cover the
same bytes. The members of components expand to links, and the documents that hold each pair of ids linked are counted
over the whole corpus: tasks send sums of their pairs, no texts.

Texts are encoded once. What a document needs for the second look, its linked pairs and how often it has each, is kept
in the shared folder. The table of counts has a row for each pair of ids that ever meets; it is broadcast if it was
counted to have at most MAX_PAIRS rows, else joined.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Files of the two tokenizers of op13; a deployment passes its own.
BYTE_BPE, PIECE_BPE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Rows of the table of pairs that are broadcast: 12 bytes each, 48 MB.
MAX_PAIRS = 4_000_000
#: Bytes of texts whose tokens are in memory at once; a longer text comes alone.
PIECE = 1 << 18
#: How a text is split before merges: fixed value, that of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

STORED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, codes binary, times binary"
_STORED = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("codes", pa.binary()), ("times", pa.binary())])
_COUNTED = pa.schema([("code", pa.int64()), ("n", pa.int64())])


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 is itself, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE from the JSON file of its vocabulary, whose ids stand in the order of the merges. Special tokens in a text are plain text."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["id"] for t in spec.get("added_tokens", [])}
        letters = byte_letters()
        vocabulary = {i: bytes(letters[c] for c in token) for token, i in spec["model"]["vocab"].items() if i not in special}
        self.bytes = [vocabulary.get(i, b"") for i in range(max(vocabulary) + 1)]
        self.width = np.array([len(x) for x in self.bytes], np.int64)
        self.encoder = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks={v: k for k, v in vocabulary.items()}, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.encoder.encode_ordinary(" " + t) for t in texts]


class Pieces:
    """A SentencePiece model, which puts a space before the text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [self._bytes(i) for i in range(self.model.get_piece_size())]
        self.width = np.array([len(x) for x in self.bytes], np.int64)

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


_loaded: dict[str, ByteLevel | Pieces] = {}


def tokenizer(path: str) -> ByteLevel | Pieces:
    """Loaded once in each process."""
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _loaded[path] = ByteLevel(path) if path.endswith(".json") else Pieces(path)
    return _loaded[path]


class Side:
    """Ids of one tokenizer, of several texts one after the other: ends of the tokens in bytes, counted through all texts."""

    def __init__(self, ids: list[list[int]], width: np.ndarray):
        self.counts = np.array([len(x) for x in ids], np.int64)
        self.ids = np.fromiter(chain.from_iterable(ids), np.int64, int(self.counts.sum()))
        self.end = np.cumsum(width[self.ids])


def union(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of the component of each of n nodes, by union-find: roots are hooked under lesser ones, then paths are halved until all point to roots."""
    parent = np.arange(n)
    while True:
        x, y = parent[a], parent[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        open_ = low < high
        if not open_.any():
            return parent
        np.minimum.at(parent, high[open_], low[open_])
        while True:
            above = parent[parent]
            if (above == parent).all():
                break
            parent = above


@lru_cache(maxsize=2)
def _decimals(n: int) -> tuple[list[str], np.ndarray]:
    """Ids under n as text with what may follow them, "," then "|" then ";", and the lengths."""
    words = [f"{i}{mark}" for mark in ",|;" for i in range(n)]
    return words, np.array([len(w) for w in words], np.int64)


class Aligned:
    """Links, groups and their texts, of texts that both sides cover alike."""

    def __init__(self, a: Side, b: Side, text_end: np.ndarray, vocabulary: int):
        n_a, n_b = len(a.ids), len(b.ids)
        # between two neighbouring ends of either side is one token of A and one of B: a link
        ends = np.sort(np.concatenate([a.end, b.end]), kind="stable")
        ends = ends[np.append(True, ends[1:] != ends[:-1])]
        self.a, self.b = np.searchsorted(a.end, ends), np.searchsorted(b.end, ends)
        root = union(n_a + n_b, self.a, n_a + self.b)
        # each component is named by its first token of A, so names are in the order of the bytes
        names = root == np.arange(n_a + n_b)
        group = (np.cumsum(names) - 1)[root]
        self.groups = np.bincount(np.searchsorted(text_end, a.end[names[:n_a]]), minlength=len(text_end))
        self.text = np.searchsorted(text_end, ends)
        self.links = np.bincount(self.text, minlength=len(text_end))
        place = 2 * group
        place[n_a:] += 1
        order = np.argsort(place, kind="stable")  # a group's A ids, then its B ids
        place = place[order]
        mark = np.where(np.append(place[1:] != place[:-1], True), 1 + (place & 1), 0)
        word = np.concatenate([a.ids, b.ids])[order] + mark * vocabulary
        words, width = _decimals(vocabulary)
        text = "".join(map(words.__getitem__, word.tolist()))
        at = np.concatenate([[0], np.cumsum(width[word])])[np.concatenate([[0], np.cumsum(a.counts + b.counts)])].tolist()
        self.strings = [text[x : y - 1] for x, y in zip(at[:-1], at[1:], strict=True)]


def align(texts: list[str], left: ByteLevel | Pieces, right: ByteLevel | Pieces) -> Iterator[tuple]:
    """(n_a, n_b, n_groups, n_links, groups, codes, times) of each text; codes (A id << 32 | B id) without repeats."""
    ids_a, ids_b = left.encode(texts), right.encode(texts)
    own = [(" " + t).encode() for t in texts]
    whole = lambda table, ids: b"".join(map(table.__getitem__, ids))
    fit = [len(t) > 0 and whole(left.bytes, x) == o and whole(right.bytes, y) == o for t, x, y, o in zip(texts, ids_a, ids_b, own, strict=True)]
    kept = [i for i, f in enumerate(fit) if f]
    if kept:
        a, b = Side([ids_a[i] for i in kept], left.width), Side([ids_b[i] for i in kept], right.width)
        found = Aligned(a, b, np.cumsum([len(own[i]) for i in kept]), max(len(left.bytes), len(right.bytes)))
        bits = len(right.bytes).bit_length()
        wide = bits + len(left.bytes).bit_length()  # texts of a chunk take what is left of 63 bits
        code = np.sort((found.text << wide) | (a.ids[found.a] << bits) | b.ids[found.b])
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        times = np.diff(first, append=len(code))
        code = code[first]
        edge = np.searchsorted(code >> wide, np.arange(len(kept) + 1)).tolist()
        code = (((code >> bits) & ((1 << (wide - bits)) - 1)) << 32) | (code & ((1 << bits) - 1))
    at = 0
    for f in fit:
        if not f:
            yield 0, 0, 0, 0, None, np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        lo, hi = edge[at], edge[at + 1]
        yield int(a.counts[at]), int(b.counts[at]), int(found.groups[at]), int(found.links[at]), found.strings[at], code[lo:hi], times[lo:hi]
        at += 1


def encoded(docs: DataFrame, text: str, left: str, right: str) -> DataFrame:
    """STORED of each row of docs: what it links, for a second look without its text."""
    common.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = tokenizer(left), tokenizer(right)
        for batch in batches:
            _, offsets = common.raw(batch.column(1))
            for lo, hi in common.chunks(offsets, PIECE):
                texts = [t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
                rows = [(*x[:4], hashlib.sha256(x[4].encode()).hexdigest() if x[4] is not None else "", x[5].tobytes(), x[6].astype(np.uint32).tobytes()) for x in align(texts, a, b)]
                yield common.batch_of(_STORED, [batch.column(0).slice(lo, hi - lo), *map(list, zip(*rows, strict=True))])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, STORED)


def pair_counts(stored: DataFrame) -> DataFrame:
    """(code, n, best): in how many documents the pair of ids is linked, and whether no other pair of its A id is in more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        parts: list[np.ndarray] = []

        def summed() -> tuple[np.ndarray, np.ndarray]:
            new, times = np.unique(np.concatenate(parts), return_counts=True) if parts else (codes[:0], n[:0])
            both, at = np.unique(np.concatenate([codes, new]), return_inverse=True)
            return both, np.bincount(at, np.concatenate([n, times]), len(both)).astype(np.int64)

        for batch in batches:
            data, offsets = common.raw(batch.column(0))
            parts.append(data[offsets[0] : offsets[-1]].view(np.int64))
            if sum(map(len, parts)) >= 1 << 20:
                (codes, n), parts = summed(), []
                if len(codes) >= 1 << 21:  # a task's sums may leave in several parts
                    yield common.batch_of(_COUNTED, [codes, n])
                    codes, n = codes[:0], n[:0]
        codes, n = summed()
        yield common.batch_of(_COUNTED, [codes, n])

    counts = stored.select("codes").where("octet_length(codes) > 0").mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    counts = common.shared_table(counts, "pairs")
    top = counts.groupBy(F.shiftright("code", 32).alias("a")).agg(F.max("n").alias("top"))
    return counts.join(top, F.shiftright("code", 32) == F.col("a")).select("code", "n", (F.col("n") == F.col("top")).alias("best"))


def _looked_up(stored: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """stored with n_best and count_sum, by a broadcast table of n pairs."""
    table = pairs.toArrow().combine_chunks() if n else None
    codes, counts, best = (np.asarray(table.column(i)) for i in range(3)) if n else (np.zeros(0, np.int64),) * 3
    order = np.argsort(codes)
    sent = stored.sparkSession.sparkContext.broadcast((codes[order], (counts[order] << 1) | best[order].astype(np.int64)))
    keep = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    schema = pa.schema([*[(c, pa.int64()) for c in keep], ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, value = sent.value
        for batch in batches:
            data, offsets = common.raw(batch.column(6))
            own = data[offsets[0] : offsets[-1]].view(np.int64)
            data, _offsets = common.raw(batch.column(7))
            times = data[_offsets[0] : _offsets[-1]].view(np.uint32).astype(np.int64)
            found = value[np.searchsorted(known, own)] if len(own) else own
            edge = (offsets - offsets[0]) // 8
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (times * (found & 1), times * (found >> 1))]
            yield common.batch_of(schema, [*batch.columns[:5], *[s[edge[1:]] - s[edge[:-1]] for s in sums], batch.column(5)])

    return stored.mapInArrow(run, ", ".join(f"{c} bigint" for c in [*keep, "n_best", "count_sum"]) + ", groups_sha256 string")


def _met(stored: DataFrame, pairs: DataFrame) -> DataFrame:
    """As _looked_up, by a join with the table of pairs: of any size, on both sides."""
    schema = pa.schema([("row", pa.int64()), ("code", pa.int64()), ("times", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (codes, at), (times, _at) = common.raw(batch.column(1)), common.raw(batch.column(2))
            yield common.batch_of(schema, [np.repeat(np.asarray(batch.column(0)), np.diff(at) // 8), codes[at[0] : at[-1]].view(np.int64), times[_at[0] : _at[-1]].view(np.uint32).astype(np.int64)])

    rows = common.shared_table(stored.withColumn("row", F.monotonically_increasing_id()), "rows")
    links = rows.select("row", "codes", "times").where("octet_length(codes) > 0").mapInArrow(run, "row bigint, code bigint, times bigint")
    sums = links.join(pairs, "code").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = F.lit(0).cast("bigint")
    return rows.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")


def alignment(docs: DataFrame, text: str = "text", left: str = BYTE_BPE, right: str = PIECE_BPE, max_pairs: int | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of docs.

    The bytes are a space and the text. left and right are files of tokenizers, the same on all machines (*.json: a
    byte-level BPE, else a SentencePiece model). Null and empty texts, and texts whose tokens do not give these bytes
    back on one of the sides, have no tokens: zeros, and '' for the digest. n_best counts the links of a pair that is
    in as many documents as any of its A id (ties included), count_sum adds the documents of all links. Repeated rows
    count as documents each; a null doc_id is one like others. Texts of any length are taken whole; an empty table has
    no rows; other columns are not read.
    """
    stored = common.shared_table(encoded(docs, text, left, right), "encoded")
    pairs = common.shared_table(pair_counts(stored), "counted")
    n = pairs.count()
    return _looked_up(stored, pairs, n) if n <= (max_pairs or MAX_PAIRS) else _met(stored, pairs)

"""Benchmark decontamination.

A generalised suffix automaton of the normalised test items; the words of each document stream through it and the
longest matching length is tracked at every word. Windows of 13 words (or a whole shorter item) that occur are hits;
hit spans are cut out, and a document whose hits reach a share of its words goes as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 13
#: Words of test items in one automaton; more items are dealt over several, applied one after the other.
MAX_WORDS = 1_000_000


class Automaton:
    """Generalised suffix automaton over word numbers."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.words: dict[int, int] = {}
        self.ids: list[str] = []
        self.ends: list[tuple[int, int, int]] = []  # (state, words, item) of items shorter than the window
        self.shortest = window
        self.paths: list[list[int]] = []

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        q = nxt[last].get(c)
        if q is not None and length[q] == length[last] + 1:
            return q
        if q is None:
            new = self._state({}, length[last] + 1)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = new
                p = link[p]
            link[new] = 0 if p < 0 else self._split(p, c)
            return new
        return self._split(last, c)

    def _state(self, nxt: dict[int, int], length: int, link: int = -1) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, c: int) -> int:
        """The state of length[p] + 1 that c leads to from p; made out of the longer one if need be."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(dict(self.next[q]), self.length[p] + 1, self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def add(self, item: str, hashes: np.ndarray) -> None:
        """One item by the hashes of its words; none without words."""
        if not len(hashes):
            return
        last, number = 0, len(self.paths)
        for h in hashes.tolist():
            last = self._extend(last, self.words.setdefault(h, len(self.words)))
        self.ids.append(item)
        self.paths.append([self.words[h] for h in hashes.tolist()])
        if len(hashes) < self.window:
            self.ends.append((-1, len(hashes), number))
            self.shortest = min(self.shortest, len(hashes))

    def finish(self) -> Automaton:
        """Which items each state occurs in, and which short items end at it."""
        n = len(self.next)
        self.items: list[set[int]] = [set() for _ in range(n)]
        self.short: dict[int, list[tuple[int, int]]] = {}
        for number, path in enumerate(self.paths):
            v = 0
            for c in path:
                v = self.next[v][c]
                u = v
                while u > 0 and number not in self.items[u]:
                    self.items[u].add(number)
                    u = self.link[u]
        for _, size, number in self.ends:
            v = 0
            for c in self.paths[number]:
                v = self.next[v][c]
            self.short.setdefault(v, []).append((size, number))
        self.hashes = np.array(sorted(self.words), np.uint64)
        self.numbers = np.array([self.words[h] for h in self.hashes.tolist()], np.int64)
        self.paths = []
        return self

    def scan(self, numbers: list[int], hit: np.ndarray, at: int, found: set[int]) -> None:
        """Stream word numbers that stand from position at on: marks hit words and adds the items met."""
        nxt, link, length, window = self.next, self.link, self.length, self.window
        v = matched = 0
        for i, c in enumerate(numbers):
            while v and c not in nxt[v]:
                v = link[v]
                matched = length[v]
            v = nxt[v].get(c, 0)
            matched = matched + 1 if v else 0
            if matched >= window:
                u = v
                while length[link[u]] >= window:
                    u = link[u]
                found |= self.items[u]
                hit[at + i - window + 1 : at + i + 1] = True
            if self.short:
                u = v
                while u > 0:
                    for size, number in self.short.get(u, ()):
                        if size <= matched:
                            found.add(number)
                            hit[at + i - size + 1 : at + i + 1] = True
                    u = link[u]


def build(items: list[tuple[str, str | None]], window: int = WINDOW) -> Automaton:
    out = Automaton(window)
    text = pa.array([t or "" for _, t in items], pa.string())
    data, offsets = common.raw(text)
    words = common.Words(data, offsets, common.LETTERS)
    hashes = words.hash64()
    first = np.concatenate([[0], np.cumsum(words.counts)])
    for k, (item, _) in enumerate(items):
        out.add(item, hashes[first[k] : first[k + 1]])
    return out.finish()


def _shards(items: DataFrame, most: int) -> tuple[DataFrame, int]:
    """(item_id, text, shard) of items, and the number of shards, of about `most` words each. Several are written by shard, so that each is read by itself."""
    words = F.length(F.coalesce(F.col("text"), F.lit(""))) / 2 + 1  # no text has more words
    total = items.agg(F.sum(words)).first()[0] or 0
    n = max(1, -(-int(total) // most))
    rows = items.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), "text", F.pmod(F.xxhash64("item_id"), F.lit(n)).alias("shard"))
    return (common.shared_table(rows.repartitionByRange(n, "shard").sortWithinPartitions("shard"), "items") if n > 1 else rows), n


def _automaton(rows: DataFrame, shard: int, window: int) -> Broadcast:
    """The automaton of one shard: the driver builds it, and tasks get it once."""
    own = rows.where(F.col("shard") == shard).select("item_id", "text").collect()  # bounded by the words of a shard
    return rows.sparkSession.sparkContext.broadcast(build([(r[0], r[1]) for r in own], window))


def _spans(hit: np.ndarray) -> np.ndarray:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return edge.reshape(-1, 2)


def _pass(shard: Broadcast, first: bool, schema: pa.Schema, text: int):
    """mapInArrow function: adds what one automaton finds to the columns n_words, spans (word numbers and bytes) and items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = shard.value
        for batch in batches:
            kept = batch.columns if first else batch.columns[:-3]
            data, offsets = common.raw(batch.column(text))
            n_words, spans, items = [], [], []
            before = [None] * batch.num_rows if first else batch.column(batch.num_columns - 2).to_pylist()
            known = [[]] * batch.num_rows if first else batch.column(batch.num_columns - 1).to_pylist()
            for lo, hi in common.chunks(offsets):
                words = common.Words(data, offsets[lo : hi + 1], common.LETTERS)
                number = np.full(len(words.start), -1, np.int64)
                if len(auto.hashes) and len(number):
                    h = words.hash64()
                    k = np.minimum(np.searchsorted(auto.hashes, h), len(auto.hashes) - 1)
                    same = auto.hashes[k] == h
                    number[same] = auto.numbers[k[same]]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], (number >= 0).astype(np.int8), [0]]))).reshape(-1, 2)
                starts = np.concatenate([[0], np.cumsum(words.counts)])
                cut = np.unique(np.concatenate([edge.ravel(), starts]))  # runs of known words do not cross documents
                left, right = cut[:-1], cut[1:]
                if len(number):
                    left, right = left[(good := (number[left.clip(max=len(number) - 1)] >= 0) & (right - left >= auto.shortest))], right[good]
                hit, found = np.zeros(len(number), bool), {}
                for a, b in zip(left.tolist(), right.tolist(), strict=True):
                    auto.scan(number[a:b].tolist(), hit, a, found.setdefault(int(words.doc[a]), set()))
                for d in range(hi - lo):
                    a, b = int(starts[d]), int(starts[d + 1])
                    own = hit[a:b]
                    for x in before[lo + d] or ():
                        own[x["word"] : x["word_end"]] = True
                    out = []
                    if own.any():
                        at = int(words.offsets[d])
                        out = [{"word": int(x), "word_end": int(y), "byte": int(words.start[a + x]) - at, "byte_end": int(words.end[a + y - 1]) - at} for x, y in _spans(own)]
                    n_words.append(b - a)
                    spans.append(out)
                    items.append(sorted({*known[lo + d], *(auto.ids[i] for i in found.get(d, ()))}))
            yield common.batch_of(schema, [*kept, n_words, spans, items])

    return run


def find(docs: DataFrame, items: DataFrame, text: str = "text", window: int = WINDOW, most: int = MAX_WORDS) -> tuple[DataFrame, list[str]]:
    """docs with three more columns, whose names are returned: words, hit spans (words and UTF-8 bytes), items met.

    items has (item_id, text); items without words or id are ignored. A document without text has no words. Texts of any
    length are taken whole, and of words that several items hit all items count. All rows and columns of docs stay,
    repeated ones too. Items of more than `most` words are several automata, of which one is in memory at a time: the
    documents pass each in turn, and what was found is written in between.
    """
    common.prepare(docs.sparkSession)
    names = common.fresh(docs, "n_words", "spans", "items")
    schema = common.extended(docs, **dict(zip(names, ("bigint", "array<struct<word: bigint, word_end: bigint, byte: bigint, byte_end: bigint>>", "array<string>"), strict=True)))
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, at = to_arrow_schema(schema), docs.columns.index(text)
    rows, n = _shards(items, most)
    for k in range(n):
        automaton = _automaton(rows, k, window)
        found = docs.mapInArrow(_pass(automaton, k == 0, arrow, at), schema)
        if k + 1 < n:
            found = common.shared_table(found, "met")
            automaton.destroy()
            if k:
                common.forget(docs)
        docs = found
    return docs, names


def _hits(spans: str) -> Column:
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda a, x: a + x["word_end"] - x["word"])


def is_contaminated(n_words: str, spans: str, one_in: int = 20) -> Column:
    hits = _hits(spans)
    return (hits > 0) & (hits * one_in >= F.col(n_words))


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", one_in: int = 20, window: int = WINDOW) -> DataFrame:
    """docs without those in which one word in one_in or more is hit; from the others the hit spans are cut out."""
    columns = docs.columns
    found, (n_words, spans, _) = find(docs, items, text, window)
    found = found.where(~is_contaminated(n_words, spans, one_in))
    raw = F.col(text).cast("binary")
    size = F.octet_length(text)
    ends = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(spans, lambda x: x["byte_end"]))
    starts = F.concat(F.transform(spans, lambda x: x["byte"]), F.array(size.cast("bigint")))
    pieces = F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda x: F.decode(F.substring(raw, (x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int")), "utf-8"))
    cleaned = F.when(F.size(spans) > 0, F.concat_ws("", pieces)).otherwise(F.col(text))
    return found.select(*[cleaned.alias(c) if c == text else F.col(f"`{c}`") for c in columns])


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found, (n_words, spans, met) = find(docs.select("doc_id", "text"), items)
    return found.select("doc_id", F.col(n_words).alias("n_words"), _hits(spans).alias("n_hit"), F.size(met).cast("bigint").alias("n_items"), F.sha2(F.array_join(F.array_sort(met), ",").cast("binary"), 256).alias("items_sha256"), is_contaminated(n_words, spans).alias("contaminated"))

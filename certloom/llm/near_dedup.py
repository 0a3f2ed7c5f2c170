"""MinHash near-dedup by an LSH forest.

Each distinct set of five-word shingles has a signature of 128 minima. A tree is a sorted order of all signatures,
beginning at another place of the signature; sets that agree in the first four minima of an order are a region. In a
region of few sets all are compared; in a denser one the order goes on by further minima, and a set is compared with
those next to it, which share the longest prefix with it. Candidates are confirmed on their full sets.

Regions are runs of a range-partitioned sort, so one that holds a third of all rows is spread over tasks. Sets that
are linked already are not compared again: the first round links dense regions through few comparisons by two trees,
the next takes all trees, and only pairs from different components. The third takes the dense regions that still hold
several components, and counts what each pair of sets from different ones shares; a region goes in blocks, and each
pair of blocks is a cell that any task can take.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom, common
from .components import components

U64 = np.uint64
WIDTH, PERCENT = 5, 75
MINIMA, BAND = 128, 4
TREES = MINIMA // BAND
FIRST_TREES = 2
#: Neighbours before it, in an order, that a set is compared with.
NEIGHBOURS = 3
FAN = 8
#: Sets, and shingles, of a block of a dense region: what a task holds at once, two blocks at most.
BLOCK_SETS, BLOCK_SHINGLES = 1000, 1_000_000

_A = (common.mix(np.arange(1, MINIMA + 1, dtype=U64)) >> U64(32)).astype(np.uint32) | np.uint32(1)
_B = (common.mix(np.arange(1001, 1001 + MINIMA, dtype=U64)) >> U64(32)).astype(np.uint32)
_TREE = common.mix(np.arange(501, 501 + TREES, dtype=U64))


def sets(column: pa.Array) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted; empty for a text without words."""
    data, offsets = common.raw(column)
    out = []
    for lo, hi in common.chunks(offsets):
        words = common.Words(data, offsets[lo : hi + 1], common.SPACES)
        doc, value = common.shingles(words, words.hash64(), WIDTH)
        edge = np.searchsorted(doc, np.arange(hi - lo + 1))
        out += [np.unique(value[a:b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
    return out


def signature(own: np.ndarray) -> np.ndarray:
    """128 minima of a set that is not empty."""
    h = (own >> U64(32)).astype(np.uint32)
    least = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(h), 1024):
        np.minimum(least, (h[i : i + 1024, None] * _A[None, :] + _B[None, :]).min(axis=0), out=least)
    return least


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both) and both > 0


def describe(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, signature): set_a and set_b are 128 bits of hash of the set; no set, no hash."""
    common.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = sets(batch.column(1))
            n = [len(s) for s in own]
            a = [int(common.mix(s).sum(dtype=U64).view(np.int64)) if len(s) else None for s in own]
            b = [int(common.mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64).view(np.int64)) if len(s) else None for s in own]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([signature(s).tobytes() if len(s) else None for s in own], pa.binary())], names=["doc_id", "n_shingles", "set_a", "set_b", "signature"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text).mapInArrow(run, "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, signature binary")


def _orders(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(sets, TREES) region keys and what follows in the order: a byte of each of seven further minima, and the tree."""
    data, _ = common.raw(column)
    s = data[: len(column) * MINIMA * 4].view(np.uint32).reshape(len(column), MINIMA).astype(U64)
    pair = s[:, 0::2] | (s[:, 1::2] << U64(32))
    key = common.mix(common.mix(pair[:, 0::2]) + pair[:, 1::2])
    key = common.mix(key ^ _TREE[None, :])
    rest = np.zeros(key.shape, U64)
    at = BAND * np.arange(TREES)
    for k in range(BAND, BAND + 7):
        rest = (rest << U64(8)) | (s[:, (at + k) % MINIMA] & U64(0xFF))
    return key, (rest << U64(8)) | np.arange(TREES, dtype=U64)[None, :]


_FOREST = pa.schema([("key", pa.int64()), ("rest", pa.int64()), ("doc_id", pa.int64())])


def _values(batch: pa.RecordBatch) -> bloom.Values:
    """Region keys of the signatures of a batch (doc_id, signature), and what follows in the orders."""
    key, rest = _orders(batch.column(1))
    return np.repeat(np.arange(batch.num_rows), TREES), key.ravel(), rest.ravel()


def _shared(batch: pa.RecordBatch, own: bloom.Values, suspected: np.ndarray) -> pa.RecordBatch:
    row, key, rest = (x[suspected] for x in own)
    return common.batch_of(_FOREST, [key.view(np.int64), rest.view(np.int64), batch.column(0).take(pa.array(row))])


def forest(classes: DataFrame) -> DataFrame:
    """(key, rest, doc_id) of each set in each tree, but for regions that hold one set alone."""
    return bloom.suspects(classes.select("doc_id", "signature"), _values, _shared, "key bigint, rest bigint, doc_id bigint")


def _sorted(rows: DataFrame) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "rest", "doc_id"]
    return rows.repartitionByRange(n, *order).sortWithinPartitions(*order)


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_MET = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("edge", pa.int64())])


def _branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that join each region by short paths: the i-th set with the one at i less its last digit to the base FAN, and each FAN-th with the one before."""
    key, i, above, last = None, 0, [], 0
    for batch in batches:
        a, b = [], []
        for k, doc in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != key:
                key, i, above = k, 0, [doc] * 24
            else:
                i += 1
                level, rest = 0, i
                while rest % FAN == 0:
                    level, rest = level + 1, rest // FAN
                a.append(above[level + 1])
                b.append(doc)
                if level:
                    a.append(last)
                    b.append(doc)
                    above[1 : level + 1] = [doc] * level
            last = doc
        yield common.batch_of(_PAIRS, [np.minimum(a, b).astype(np.int64), np.maximum(a, b).astype(np.int64)])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of each set with the NEIGHBOURS before it in its region, if their components differ; and the first and the last region (edge), which other tasks may hold parts of."""
    tail, first = np.zeros((0, 3), np.int64), None
    for batch in batches:
        rows = np.concatenate([tail, np.stack([np.asarray(batch.column(i)) for i in range(3)], axis=1)])
        a, b, n = [], [], len(tail)
        for lag in range(1, NEIGHBOURS + 1):
            now, then = rows[max(n, lag) :], rows[max(n, lag) - lag : len(rows) - lag]
            fit = (now[:, 0] == then[:, 0]) & (now[:, 2] != then[:, 2])
            a.append(then[fit, 1])
            b.append(now[fit, 1])
        a, b = np.concatenate(a), np.concatenate(b)
        yield common.batch_of(_MET, [np.minimum(a, b), np.maximum(a, b), pa.nulls(len(a), pa.int64())])
        tail = rows[-NEIGHBOURS:]
        if first is None and len(rows):
            first = rows[0, 0]
    if first is not None:
        yield common.batch_of(_MET, [pa.nulls(2, pa.int64()), pa.nulls(2, pa.int64()), [first, tail[-1, 0]]])


def _join_cell(of: np.ndarray, own: list[np.ndarray], label: np.ndarray) -> tuple[list[int], list[int]]:
    """Links between labels of a cell: its sets are of one block, or of two; then only those of different blocks meet. What two sets share is counted in full."""
    size = np.array([len(s) for s in own], np.int64)
    one = of[0] == of[-1]
    left, right = (np.arange(len(of)),) * 2 if one else (np.flatnonzero(of == of[0]), np.flatnonzero(of != of[0]))
    value, owner = np.concatenate([own[k] for k in right]), np.repeat(np.arange(len(right)), size[right])
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    begin = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    length, value = np.diff(begin, append=len(value)), value[begin]
    root, a, b = label.copy(), [], []
    for k in left.tolist():
        other = root[right] != root[k]
        if one:
            other[k:] = False
        if not other.any():
            continue
        at = np.minimum(np.searchsorted(value, own[k]), len(value) - 1)
        at = at[value[at] == own[k]]
        n = length[at]
        found = owner[np.repeat(begin[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        both = np.bincount(found, minlength=len(right))
        for m in right[other & (both > 0) & (100 * both >= PERCENT * (size[k] + size[right] - both))].tolist():
            if root[m] != root[k]:
                a.append(int(label[k]))
                b.append(int(label[m]))
                root[root == root[m]] = root[k]
    return a, b


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) between labels, of rows (key, low, high, block, label, own) in order of their cells (key, low, high) and blocks."""
    cell, of, own, label = None, [], [], []

    def done() -> pa.RecordBatch:
        a, b = _join_cell(np.array(of), own, np.array(label, np.int64))
        return common.batch_of(_PAIRS, [np.array(a, np.int64), np.array(b, np.int64)])

    for batch in batches:
        for key, low, high, block, name, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (key, low, high) != cell:
                if cell:
                    yield done()
                cell, of, own, label = (key, low, high), [], [], []
            of.append(block)
            own.append(np.frombuffer(data, U64))
            label.append(name)
    if cell:
        yield done()


def dense_links(trees: DataFrame, labels: DataFrame, edges: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """Links (a, b) between labels by all pairs of sets of different labels in the regions where _near cannot meet all: those of more sets than it sees at once, and those (edges: key) that several tasks had parts of. labels: (doc_id, n_shingles, label)."""
    rows = trees.select("key", "doc_id").join(labels, "doc_id")
    regions = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"), F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y")
    dense = regions.join(edges.withColumn("parted", F.lit(True)), "key", "left").where((F.col("n") > NEIGHBOURS + 1) | F.col("parted"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_SETS), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("bigint").alias("blocks")
    rows = common.shared_table(rows.join(dense.select("key", blocks), "key").select("key", "doc_id", "label", "blocks", F.pmod(F.xxhash64("doc_id"), "blocks").alias("block")), "dense")
    wanted = bloom.members(rows.select(F.col("doc_id").alias("x")))

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if wanted is not None:
                batch = batch.filter(pa.array(wanted.value.test(np.asarray(batch.column(0)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets(batch.column(1))], pa.binary())], names=["doc_id", "own"])

    held = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), text).mapInArrow(taken, "doc_id bigint, own binary").where("octet_length(own) > 0")
    cells = rows.join(held, "doc_id").withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    cells = cells.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "label", "own")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(n, "key", "low", "high").sortWithinPartitions("key", "low", "high", "block").mapInArrow(_cells, "a bigint, b bigint")


def confirm(pairs: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """Those of the pairs (a, b) whose full sets are linked. Only texts of documents in a pair move."""
    pairs = common.shared_table(pairs.where("a <> b").distinct(), "pairs")
    wanted = bloom.members(pairs.select(F.explode(F.array("a", "b")).alias("x")))
    texts = bloom.holding(docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text")), wanted)
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fit = [linked(x, y) for x, y in zip(sets(batch.column(2)), sets(batch.column(3)), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(fit, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def _merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """groups (node, component), with the components that links (a, b) between their names join."""
    joined = components(links).select(F.col("node").alias("old"), F.col("component").alias("new"))
    groups = groups.join(joined, groups["component"] == joined["old"], "left").select("node", F.coalesce("new", "component").alias("component"))
    # sets that only these links join are their own old component
    late = joined.join(groups, joined["old"] == groups["node"], "left_anti").select(F.col("old").alias("node"), F.col("new").alias("component"))
    return groups.union(late)


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of docs.

    A set is that of the distinct five-word shingles, A-Z lower-cased, or the whole sequence of fewer words; documents
    whose sets have a resemblance of 75 % or more are linked, and a component is named by its least doc_id. Without
    words or text a set is empty and linked with none. Rows with the same doc_id are in one component if their sets
    are linked. A null doc_id is in no component, and kept. Texts of any length are taken whole; other columns of docs
    are not read; an empty table has no rows.
    """
    described = common.shared_table(describe(docs, text), "signatures")
    sets_ = described.where("doc_id is not null and set_a is not null")
    classes = sets_.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("doc_id"), F.min_by("signature", "doc_id").alias("signature"), F.max("n_shingles").alias("n_shingles"))
    classes = common.shared_table(classes, "classes")
    trees = common.shared_table(forest(classes), "forest")

    first = _sorted(trees.where(F.pmod("rest", F.lit(256)) < FIRST_TREES)).select("key", "doc_id").mapInArrow(_branch, "a bigint, b bigint")
    groups = common.shared_table(components(confirm(first, docs, text)), "groups")

    label = F.coalesce("component", "doc_id").alias("label")
    labelled = trees.join(groups, trees["doc_id"] == groups["node"], "left").select("key", "rest", "doc_id", label)
    met = common.shared_table(_sorted(common.shared_table(labelled, "labelled")).select("key", "doc_id", "label").mapInArrow(_near, "a bigint, b bigint, edge bigint"), "met")
    edges = met.where("edge is not null").groupBy(F.col("edge").alias("key")).count().where("count > 1").select("key")  # two rows a task, whatever the input
    links = confirm(met.where("edge is null").select("a", "b"), docs, text)
    named = links
    for side in ("a", "b"):
        of = groups.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
        named = named.join(of, side, "left").withColumn(side, F.coalesce(f"c{side}", side)).drop(f"c{side}")
    groups = common.shared_table(_merged(groups, named), "groups")

    labels = classes.join(groups, classes["doc_id"] == groups["node"], "left").select("doc_id", "n_shingles", label)
    final = _merged(groups, dense_links(trees, labels, edges, docs, text))

    named = classes.join(final, classes["doc_id"] == final["node"], "left").select("set_a", "set_b", F.coalesce("component", "doc_id").alias("class"))
    out = described.select("doc_id", "n_shingles", "set_a", "set_b").join(named, ["set_a", "set_b"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one document of each component, that of the least doc_id; all rows that have this doc_id stay, as they are one document."""
    (lost_id,) = common.fresh(docs, "lost")
    lost = near_duplicates(docs, text).where(~F.col("kept")).select(F.col("doc_id").alias(lost_id)).distinct()
    return docs.join(lost, docs["doc_id"] == lost[lost_id], "left_anti")

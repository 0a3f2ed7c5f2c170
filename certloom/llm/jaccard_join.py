"""The join of all documents whose word n-gram sets have a Jaccard likeness of 80 % or more, exact.

Equal sets are one class. In an order that all sets use, rarest shingles first by counts of all shingles in buckets,
two linked sets share `shared(size)` shingles at least among the first size - ceil(0.8 size) + shared(size) of each. So
a set of whose first shingles fewer occur in other sets is linked with none; most sets go no further, and of the
others only these shingles leave their task. A shingle and a size band then name sets that may link. Each key has a
hub, its least set; a set forgets the hubs that it has the fewest keys with, as long as what two sets forget is less than
what linked ones share. So sets that share a phrase by chance do not hang together. What does is a region.

The sets of a region meet in tiles: all of a small region, or two blocks of the same or of neighbouring size bands. A
task looks at one tile. There bitmap signatures, in which each shingle flips a hashed bit, bound what two sets share
from above, as all bits that differ are of shingles that one has and the other lacks; what passes is intersected
exactly. Tiles give sums of links for each set and as few links as hold its components together, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bloom, common
from .components import components
from .near_dedup import sets

U64 = np.uint64
PERCENT = 80
#: Buckets of shingle counts; 8 bytes each are broadcast.
BUCKET_BITS = 20
SLICES = 64
#: Sets, and shingles, of a block: what a task holds at once, two blocks at most.
BLOCK_SETS, BLOCK_SHINGLES = 1000, 1_000_000
#: Bits of a signature for each shingle of the largest set of its band.
BITS = 4


def _bands() -> np.ndarray:
    """Least sizes of the bands. A set is at most 5/4 of one that it is linked with, so bands that are not neighbours hold no links."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, -(-out[-1] * 5 // 4)))
    return np.array(out, np.int64)


BANDS = _bands()


def band_of(size: np.ndarray) -> np.ndarray:
    return np.searchsorted(BANDS, size, "right") - 1


def describe(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set, node): node is 128 bits of hash of the set, set the first 64 of them; both null for no set."""
    common.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = sets(batch.column(1))
            names = [_name(s) if len(s) else None for s in own]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in own], pa.int64()), pa.array([n and n[0] for n in names], pa.int64()), pa.array([n and n[1] for n in names], pa.binary())], names=["doc_id", "n_shingles", "set", "node"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text).mapInArrow(run, "doc_id bigint, n_shingles bigint, set bigint, node binary")


def _name(own: np.ndarray) -> tuple[int, bytes]:
    both = np.array([common.mix(own).sum(dtype=U64), common.mix(own ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64)], U64)
    return int(both[:1].view(np.int64)[0]), both.tobytes()


def bucket_counts(docs: DataFrame) -> Broadcast:
    """How many sets of docs (doc_id, text) have shingles of each bucket: sums by slices of the buckets."""
    size = (1 << BUCKET_BITS) // SLICES

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.uint32)
        for batch in batches:
            for own in sets(batch.column(1)):
                np.add.at(total, own >> U64(64 - BUCKET_BITS), np.uint32(1))
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([total[k * size : (k + 1) * size].tobytes() for k in range(SLICES)], pa.binary())], names=["slice", "counts"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, own in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total.setdefault(k, np.zeros(size, np.int64))
                total[k] += np.frombuffer(own.as_buffer(), np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["slice", "counts"])

    rows = docs.mapInArrow(counted, "slice int, counts binary").repartition(SLICES, "slice").mapInArrow(summed, "slice int, counts binary").collect()  # SLICES rows, 8 MiB in all
    out = np.zeros(1 << BUCKET_BITS, np.int64)
    for k, own in rows:
        out[k * size : (k + 1) * size] = np.frombuffer(bytes(own), np.int64)
    return docs.sparkSession.sparkContext.broadcast(out)


def least_shared(size: np.ndarray) -> np.ndarray:
    """Shingles that a set has in its first ones beyond those that it could miss in a linked set."""
    return np.maximum(-(-size // 10), np.minimum(needed(size), 8))


def needed(size: np.ndarray) -> np.ndarray:
    """What a set shares with a linked one at least."""
    return -(-size * PERCENT // 100)


def shared(size: np.ndarray) -> np.ndarray:
    """What a set shares with any linked set among the first shingles of both: least_shared of the smallest set that it can be linked with."""
    return least_shared(needed(size))


def rarest(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the order of (count of the bucket, hash)."""
    n = len(own) - int(needed(np.int64(len(own)))) + int(least_shared(np.int64(len(own))))
    return own[np.lexsort((own, counts[own >> U64(64 - BUCKET_BITS)]))[:n]]


_FIRST = pa.schema([("shingle", pa.int64()), ("set", pa.int64()), ("hot", pa.bool_())])


def firsts(docs: DataFrame, counts: Broadcast) -> DataFrame:
    """(shingle, set, hot) of docs (doc_id, text): the rarest shingles of each set. hot: its bucket is so full that other sets have it for sure, or as good as."""
    most = 1000 + 8 * int(counts.value.mean())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [s for s in sets(batch.column(1)) if len(s)]
            first = [rarest(s, counts.value) for s in own]
            all_ = np.concatenate([*first, np.zeros(0, U64)])
            names = np.repeat(np.array([_name(s)[0] for s in own], np.int64), [len(x) for x in first])
            yield common.batch_of(_FIRST, [all_.view(np.int64), names, counts.value[all_ >> U64(64 - BUCKET_BITS)] > most])

    return docs.mapInArrow(run, "shingle bigint, set bigint, hot boolean")


def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(set, shingle) of rows (shingle, set, hot) in order whose shingle is hot or has another set beside it. A row that batches part from the next is let through."""
    for batch in batches:
        shingle, name = (np.asarray(batch.column(i)) for i in (0, 1))
        if not len(shingle):
            continue
        same = shingle[1:] == shingle[:-1]
        first = np.flatnonzero(np.append(True, ~same))
        mixed = np.logical_or.reduceat(np.append(False, same & (name[1:] != name[:-1])), first)
        out = np.repeat(mixed, np.diff(first, append=len(shingle))) | np.asarray(batch.column(2).to_numpy(zero_copy_only=False), bool)
        out |= (shingle == shingle[0]) | (shingle == shingle[-1])
        yield pa.RecordBatch.from_arrays([pa.array(name[out]), pa.array(shingle[out])], names=["set", "shingle"])


def repeated(first: DataFrame) -> DataFrame:
    """(set, shingle) of firsts that several sets have, and a few more. Rows meet by shingle, but for hot ones, which are spread."""
    n = int(first.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    to = F.when(F.col("hot"), F.xxhash64("shingle", "set")).otherwise(F.col("shingle"))
    return first.repartition(n, to).sortWithinPartitions("shingle", "set").mapInArrow(_again, "set bigint, shingle bigint")


def _needed(size: Column) -> Column:
    """As needed()."""
    return F.ceil(size * PERCENT / 100)


def _shared(size: Column) -> Column:
    """As shared()."""
    n = _needed(size)
    return F.greatest(F.ceil(n / 10), F.least(_needed(n), F.lit(8)))


def _band(size: Column) -> Column:
    """As band_of()."""
    return F.lit(len(BANDS) - 1) - F.size(F.filter(F.array(*map(F.lit, BANDS.tolist())), lambda least: least > size))


def meetings(again: DataFrame, sizes: DataFrame) -> DataFrame:
    """(key, set, band) of sets with shared(size) shingles that others have too: linked sets have as many keys of a band in common. sizes: (set, n_shingles)."""
    held = again.groupBy("set").agg(F.collect_set("shingle").alias("shingles")).join(sizes, "set").where(F.size("shingles") >= _shared(F.col("n_shingles")))
    own, low = _band(F.col("n_shingles")), _band(_needed(F.col("n_shingles")))  # the larger one of a pair may be what the band below names
    bands = F.when(low < own, F.array(own, own - 1)).otherwise(F.array(own))
    rows = held.select("set", F.explode(bands.cast("array<tinyint>")).alias("band"), "shingles").select("set", "band", F.explode("shingles").alias("shingle"))
    return rows.select(F.xxhash64("shingle", "band").alias("key"), "set", "band")


def regions(met: DataFrame, sizes: DataFrame) -> DataFrame:
    """(node, component) of sets that hang together by hubs of keys that they have not forgotten."""
    met = common.shared_table(met, "met")
    hubs = met.groupBy("key").agg(F.min("set").alias("hub"), F.max("set").alias("last")).where("hub <> last").select("key", "hub")
    ways = met.join(hubs, "key").where("set <> hub").groupBy("set", "band", "hub").agg(F.count("*").alias("n")).join(sizes, "set")
    before = F.sum("n").over(Window.partitionBy("set", "band").orderBy("n", "hub").rowsBetween(Window.unboundedPreceding, 0))
    kept = ways.withColumn("so_far", before).where(F.col("so_far") > F.floor((_shared(F.col("n_shingles")) - 1) / 2))
    return components(kept.select(F.col("hub").alias("a"), F.col("set").alias("b")).distinct())


def signatures(own: list[np.ndarray], bits: int) -> np.ndarray:
    """(sets, bits / 64) words; each shingle flips a bit. bits is a power of two, 64 at least."""
    size = np.array([len(s) for s in own])
    at = np.repeat(np.arange(len(own)) * bits, size) + (common.mix(np.concatenate(own)) & U64(bits - 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=len(own) * bits) & 1).astype(bool)
    return np.packbits(odd, bitorder="little").view(U64).reshape(len(own), bits // 64)


def enough(both: np.ndarray, a: int, b: np.ndarray) -> np.ndarray:
    """Whether sets of sizes a and b that share so many are linked."""
    return 100 * both >= PERCENT * (a + b - both)


def join_tile(side: np.ndarray, own: list[np.ndarray], copies: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(links, ends): the documents that each set is linked with here, and links that hold the components together.

    Sets are sorted, and in the order of their sizes. If there are two sides, only sets of different sides meet.
    """
    size = np.array([len(s) for s in own], np.int64)
    links, root, ends = np.zeros(len(own), np.int64), np.arange(len(own)), []
    band, one = band_of(size), (side == side[0]).all()
    _, flat = np.unique(np.concatenate(own), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(int(flat.max()) + 1, bool)
    for k in np.unique(band).tolist():
        lo, hi = np.searchsorted(band, k), np.searchsorted(band, k + 1, "right")
        bits = max(64, 1 << (int(BANDS[k + 1]) * BITS - 1).bit_length())
        shape = signatures(own[lo:hi], bits)
        for i in range(lo, int(np.searchsorted(band, k, "right"))):
            last = int(np.searchsorted(size, size[i] * 100 // PERCENT, "right"))
            others = np.arange(i + 1, last)
            if not one:
                others = others[side[others] != side[i]]
            if not len(others):
                continue
            differ = np.bitwise_count(shape[others - lo] ^ shape[i - lo]).sum(axis=1, dtype=np.int64)
            others = others[enough((size[i] + size[others] - differ) // 2, size[i], size[others])]
            if not len(others):
                continue
            mark[flat[begin[i] : begin[i + 1]]] = True
            n = size[others]
            start = np.cumsum(n) - n
            both = np.add.reduceat(mark[flat[np.repeat(begin[others] - start, n) + np.arange(n.sum())]], start, dtype=np.int64)
            mark[flat[begin[i] : begin[i + 1]]] = False
            others = others[enough(both, size[i], n)]
            links[i] += copies[others].sum()
            links[others] += copies[i]
            for other, its in zip(others.tolist(), root[others].tolist(), strict=True):
                if root[other] != root[i]:
                    ends.append((i, other))
                    root[root == root[other]] = root[i]
    return links, ends


_LINKED = pa.schema([("node", pa.binary()), ("links", pa.int64()), ("other", pa.binary())])
TILE = ["region", "low", "low_block", "high", "high_block"]


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, links, null) and (node, null, other) of rows (*TILE, n_shingles, node, side, copies, own) in the order of their tiles and sizes."""
    tile, held = None, {}

    def done() -> pa.RecordBatch:
        nodes = list(held)
        side, copies, own = (list(x) for x in zip(*held.values(), strict=True))
        links, ends = join_tile(np.array(side), own, np.array(copies, np.int64))
        some = np.flatnonzero(links).tolist()
        return common.batch_of(_LINKED, [[nodes[i] for i in some] + [nodes[i] for i, _ in ends], links[some].tolist() + [None] * len(ends), [None] * len(some) + [nodes[j] for _, j in ends]])

    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for now, node, side, copies, own in zip(zip(*columns[:5], strict=True), *columns[6:], strict=True):
            if now != tile:
                if len(held) > 1:
                    yield done()
                tile, held = now, {}
            held.setdefault(node, (side, copies, np.frombuffer(own, U64)))  # a repeated row is there once
    if len(held) > 1:
        yield done()


def tiled(members: DataFrame) -> DataFrame:
    """members (region, node, n_shingles, ...) with TILE and side, a row for each tile that a set is in."""
    members = members.withColumn("band", _band(F.col("n_shingles")))
    blocks = lambda n, s: F.greatest(F.ceil(n / BLOCK_SETS), F.ceil(s / BLOCK_SHINGLES)).cast("bigint")
    by_band = members.groupBy("region", "band").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    large = by_band.groupBy("region").agg(blocks(F.sum("n"), F.sum("s")).alias("all"), F.map_from_entries(F.collect_list(F.struct("band", blocks(F.col("n"), F.col("s"))))).alias("blocks")).where("all > 1").drop("all")
    at = lambda k: F.coalesce(F.try_element_at("blocks", F.col("band") + k), F.lit(0))
    rows = members.join(large, "region", "left").withColumn("block", F.pmod(F.xxhash64("node"), F.greatest(at(0), F.lit(1))))

    def to(low, low_block, high, high_block, side):  # noqa: ANN001, ANN202
        return F.struct(low.cast("int").alias("low"), low_block.cast("bigint").alias("low_block"), high.cast("int").alias("high"), high_block.cast("bigint").alias("high_block"), side.cast("int").alias("side"))

    def each(n, made):  # noqa: ANN001, ANN202
        return F.transform(F.filter(F.sequence(F.lit(0).cast("bigint"), n), lambda y: y < n), made)

    own, block, zero = F.col("band"), F.col("block"), F.lit(0)
    same = each(at(0), lambda y: to(own, F.least(block, y), own, F.greatest(block, y), (block > y).cast("int")))
    above = each(at(1), lambda y: to(own, block, own + 1, y, zero))
    below = each(at(-1), lambda y: to(own - 1, y, own, block, F.lit(1)))
    tiles = F.when(F.col("blocks").isNull(), F.array(to(F.lit(-1), zero, F.lit(-1), zero, zero))).otherwise(F.concat(same, above, below))
    return rows.select(*members.columns, F.explode(tiles).alias("t")).select(*members.columns, "t.*")


def links(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of each row of docs.

    A set is that of the distinct five-word shingles, A-Z lower-cased, or the whole sequence of fewer words. Documents
    are linked if 100 times what their sets share is 80 times their union or more; n_links counts the other documents
    that one is linked with, component_id is the least doc_id reachable by links, its own included. Without words or
    text a set is empty and linked with none. Rows with the same doc_id count each. A null doc_id is linked with none:
    its component is null. Ties are links. Texts of any length are taken whole; other columns of docs are not read; an
    empty table has no rows.
    """
    described = common.shared_table(describe(docs, text), "sets")
    some = described.where("doc_id is not null and node is not null")
    classes = common.shared_table(some.groupBy("node").agg(F.min("set").alias("set"), F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n_shingles"), F.count("*").alias("copies")), "classes")

    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    one_each = bloom.holding(texts, bloom.members(classes.select("doc_id")))
    sizes = classes.groupBy("set").agg(F.max("n_shingles").alias("n_shingles"))
    again = repeated(firsts(one_each, bucket_counts(one_each)))
    region = common.shared_table(regions(meetings(again, sizes), sizes), "regions")
    members = common.shared_table(classes.join(region, classes["set"] == region["node"]).select(F.col("component").alias("region"), classes["node"], "doc_id", "n_shingles", "copies"), "members")

    wanted = bloom.members(members.select("doc_id"))

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = sets(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_name(s)[1] if len(s) else None for s in own], pa.binary()), pa.array([s.tobytes() for s in own], pa.binary())], names=["doc_id", "node", "own"])

    held = bloom.holding(texts, wanted).mapInArrow(taken, "doc_id bigint, node binary, own binary").where("node is not null")
    rows = tiled(members).join(held, ["doc_id", "node"]).select(*TILE, "n_shingles", "node", "side", "copies", "own")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.repartition(n, *TILE).sortWithinPartitions(*TILE, "n_shingles").mapInArrow(_tiles, "node binary, links bigint, other binary")
    found = common.shared_table(found, "links")

    joined = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "of")
    sums = found.where("links is not null").groupBy(F.col("node").alias("linked")).agg(F.sum("links").alias("links"))
    named = classes.join(joined, classes["node"] == joined["of"], "left").join(sums, classes["node"] == sums["linked"], "left")
    named = common.shared_table(named.select("node", "doc_id", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "named")
    least = named.groupBy("component").agg(F.min("doc_id").alias("least"))
    classed = named.join(least, "component").select(F.col("node").alias("of"), "least", "n_links")

    out = described.join(classed, described["node"] == classed["of"], "left")
    has = F.col("doc_id").isNotNull()
    return out.select("doc_id", "n_shingles", F.when(has, F.coalesce("least", "doc_id")).alias("component_id"), F.when(has, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("bigint").alias("n_links"))

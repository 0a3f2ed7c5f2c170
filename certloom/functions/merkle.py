"""Hashes of a log's Merkle tree, as binary columns."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sha256(x: Column) -> Column:
    return F.unhex(F.sha2(x, 256))


def leaf_hash(entry: Column) -> Column:
    """Of a timestamped entry: the prefix of leaves, version 1 and leaf type 0 come before it."""
    return sha256(F.concat(F.lit(b"\x00\x00\x00"), entry))


def node_hash(left: Column, right: Column) -> Column:
    return sha256(F.concat(F.lit(b"\x01"), left, right))


def perfect_root(hashes: Column) -> Column:
    """Root over an array of hashes, of length a power of two up to 2^16; null for other lengths."""
    n = F.size(hashes)

    def up(level: Column, _: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(level) / 2).cast("int"), F.lit(1)) - 1), lambda i: node_hash(F.get(level, 2 * i), F.get(level, 2 * i + 1)))
        return F.when(F.size(level) > 1, pairs).otherwise(level)

    folded = F.aggregate(F.sequence(F.lit(1), F.lit(16)), hashes, up)
    return F.when((n > 0) & (F.bit_count(n) == 1), F.get(folded, F.lit(0)))


def compact_root(roots: Column) -> Column:
    """Root over the roots of perfect subtrees, largest first; that of no entries is the hash of nothing."""
    return F.when(F.size(roots) == 0, sha256(F.lit(b""))).otherwise(F.aggregate(F.slice(F.reverse(roots), 2, F.greatest(F.size(roots) - 1, F.lit(1))), F.element_at(roots, -1), lambda acc, x: node_hash(x, acc)))


def next_level(hashes: DataFrame, index: str = "index", hash_: str = "hash") -> DataFrame:
    """Pairs of hashes of one level joined to those of the next: one sum by key, without order over all rows. An odd last one goes up as it is."""
    i = F.col(index)
    two = hashes.groupBy(F.floor(i / 2).cast("bigint").alias(index)).agg(F.max(F.when(i % 2 == 0, F.col(hash_))).alias("l"), F.max(F.when(i % 2 == 1, F.col(hash_))).alias("r"))
    return two.select(index, F.when(F.col("r").isNull(), F.col("l")).otherwise(node_hash(F.col("l"), F.col("r"))).alias(hash_))


def tree_root(hashes: DataFrame, size: int) -> DataFrame:
    """One row with the root over size leaf hashes (index, hash): levels are summed up in turn, each half as long."""
    while size > 1:
        hashes, size = next_level(hashes), (size + 1) // 2
    return hashes.select(F.col("hash").alias("root"))


TILE_BITS, TOP_LEVEL = 8, 5


def subtree(size: int) -> tuple[int, int]:
    """(level, hashes) of the tile with the hashes that a perfect subtree of size (a power of two) is made of."""
    level = min(((size & -size).bit_length() - 1) // TILE_BITS, TOP_LEVEL)
    return level, size >> (8 * level)


def subtree_plan(size: int) -> list[tuple[int, int, int]]:
    """(start, size, level) of the perfect subtrees of a tree, largest first."""
    out, start = [], 0
    for bit in range(size.bit_length() - 1, -1, -1):
        if size >> bit & 1:
            out.append((start, 1 << bit, subtree(1 << bit)[0]))
            start += 1 << bit
    return out


@dataclass(frozen=True)
class Frontier:
    """The roots of the perfect subtrees of a tree of `size` leaves, largest first: all that a tree needs of its past to grow."""

    size: int = 0
    roots: tuple[bytes, ...] = ()

    def grown(self, size: int, root_of: Callable[[int, int], bytes]) -> Frontier:
        """The frontier at a larger size. root_of(start, n) is the root of n leaves from start on, a perfect subtree of what is new: nothing older is asked for."""
        sizes, roots, at = [n for _, n, _ in subtree_plan(self.size)], list(self.roots), self.size
        while at < size:
            n = at & -at if at else 1 << (size.bit_length() - 1)
            while at + n > size:
                n >>= 1
            sizes.append(n)
            roots.append(root_of(at, n))
            at += n
            while len(sizes) > 1 and sizes[-1] == sizes[-2]:
                right = roots.pop()
                sizes.pop()
                roots[-1] = hashlib.sha256(b"\x01" + roots[-1] + right).digest()
                sizes[-1] *= 2
        return Frontier(at, tuple(roots))

    def root(self) -> bytes:
        """Of the whole tree; that of no leaves is the hash of nothing."""
        if not self.roots:
            return hashlib.sha256(b"").digest()
        out = self.roots[-1]
        for left in reversed(self.roots[:-1]):
            out = hashlib.sha256(b"\x01" + left + out).digest()
        return out


def tile_of(index: Column) -> Column:
    """The tile of 256 hashes that an index (bigint) is in. It is never null (-1 instead), so that Spark puts no filters of its own before shuffles by it, and shares them."""
    return F.coalesce(F.shiftright(index, TILE_BITS), F.lit(-1).cast("bigint"))


def tile_levels(leaves: Column) -> Column:
    """array<array<binary>>: the leaves (place, hash) of a tile, which is 256 hashes, those of their pairs, and so on up to its root; null where a leaf is missing."""
    last = 1 << TILE_BITS
    placed = _bound(F.array_sort(leaves), lambda x: _bound(F.struct(x["place"].alias("places"), x["hash"].alias("hashes")), lambda y: F.transform(F.sequence(F.lit(0), F.lit(last - 1)), lambda i: F.get(y["hashes"], (F.array_position(y["places"], i) - 1).cast("int")))))

    def up(levels: Column, k: Column) -> Column:
        def pair(i: Column) -> Column:
            return node_hash(F.get(F.get(levels, k), 2 * i), F.get(F.get(levels, k), 2 * i + 1))

        return F.concat(levels, F.array(F.transform(F.sequence(F.lit(0), F.call_function("shiftright", F.lit(last // 2), k) - 1), pair)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(TILE_BITS - 1)), F.array(placed), up)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), value being computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def frontiers(hashes: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """(size, roots): the frontier at each of the sizes (size, at most `most`), of leaf hashes (index, hash).

    Leaves and sizes meet once, by their tile. The low bits of a size ask for subtrees inside its tile; the others ask for
    the frontier of the full tiles before it, which all sizes of the tile share: it is told in the same way from the roots
    of tiles. So rows that move are as many as leaves and sizes, not as the subtrees of all sizes. A subtree in which a
    leaf is missing has no root.
    """
    return _frontiers(hashes.where("index >= 0"), sizes.where("size >= 0"), most)


def _frontiers(hashes: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    place = F.col("index").bitwiseAND((1 << TILE_BITS) - 1).cast("int").alias("place")
    tiles = hashes.groupBy(tile_of(F.col("index")).alias("tile")).agg(F.collect_list(F.struct(place, "hash")).alias("leaves"))
    asked = sizes.groupBy(tile_of(F.col("size")).alias("tile")).agg(F.collect_set("size").alias("sizes"))
    met, above = asked, F.array().cast("array<binary>")
    if most >> TILE_BITS:
        tops = tiles.select(F.col("tile").alias("index"), F.get(F.element_at(tile_levels(F.col("leaves")), -1), F.lit(0)).alias("hash"))
        upper = _frontiers(tops, asked.select(F.col("tile").alias("size")), most >> TILE_BITS)
        met, above = asked.join(upper.select(F.col("size").alias("tile"), F.col("roots").alias("above")), "tile", "left"), F.coalesce("above", above)

    def own(levels: Column, size: Column) -> Column:
        def root(k: Column) -> Column:
            n = F.call_function("shiftright", size.bitwiseAND((1 << TILE_BITS) - 1).cast("int"), k)
            return F.when(n.bitwiseAND(1) == 1, F.get(F.get(levels, k), n - 1))

        return F.filter(F.transform(F.sequence(F.lit(TILE_BITS - 1), F.lit(0)), root), lambda x: x.isNotNull())

    told = _bound(tile_levels(F.col("leaves")), lambda levels: F.transform("sizes", lambda size: F.struct(size.alias("size"), F.concat(above, own(levels, size)).alias("roots"))))
    return met.join(tiles.hint("merge"), "tile", "left").select(F.inline(told)).where((F.size("roots") > 0) | (F.col("size") == 0))


def subtree_plans(size: Column) -> Column:
    """subtree_plan of a column of sizes (bigint): array<struct<start, subtree, level>>, largest first; empty for 0."""
    bits = F.filter(F.sequence(F.lit(62), F.lit(0)), lambda b: F.call_function("shiftright", size, b).bitwiseAND(1) == 1)

    def part(b: Column) -> Column:
        one = F.call_function("shiftleft", F.lit(1).cast("bigint"), b)
        above = size - F.pmod(size, one) - one
        return F.struct(above.alias("start"), one.alias("subtree"), F.least(F.floor(b / TILE_BITS).cast("int"), F.lit(TOP_LEVEL)).alias("level"))

    return F.transform(bits, part)


def hash_tile(data: Column) -> Column:
    """array<binary> of the 32-byte hashes of a tile; null if bytes are left over."""
    n = F.octet_length(data)
    return F.when((n > 0) & (n % 32 == 0), F.transform(F.sequence(F.lit(0), (n / 32).cast("int") - 1), lambda i: F.substr(data, i * 32 + 1, F.lit(32))))


def verify_leaves(entries: DataFrame, hashes: DataFrame) -> DataFrame:
    """(index, ok) of the entries (index, hash) against the log's hashes (index, hash): a missing one on either side is not ok."""
    e, h = entries.select("index", F.col("hash").alias("got")), hashes.select("index", F.col("hash").alias("want"))
    return e.join(h, "index", "full_outer").select("index", F.coalesce(F.col("got") == F.col("want"), F.lit(False)).alias("ok"))

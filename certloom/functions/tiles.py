"""Arithmetic of the tiles of a static certificate log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = 256
MAX_LEVEL = 5


def tile_index(index: Column) -> Column:
    """The index in groups of three digits, all but the last after an x: 1234067 is x001/x234/067."""
    digits = index.cast("string")
    n = F.ceil(F.length(digits) / 3).cast("int")
    padded = F.lpad(digits, 3 * n, F.lit("0"))
    groups = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.when(i < n, "x").otherwise(""), F.substr(padded, 3 * i - 2, F.lit(3))))
    return F.array_join(groups, "/")


def tile_path(level: Column, index: Column, width: Column) -> Column:
    """Path of a tile; level null: of entries. Null if there is no such tile."""
    kind = F.when(level.isNull(), "data").otherwise(level.cast("string"))
    part = F.when(width.isNotNull(), F.concat(F.lit(".p/"), width.cast("string"))).otherwise("")
    valid = (level.isNull() | level.between(0, MAX_LEVEL)) & (width.isNull() | width.between(1, TILE - 1))
    return F.when(valid, F.concat(F.lit("tile/"), kind, F.lit("/"), tile_index(index), part))


def level_count(size: Column, level: Column) -> Column:
    """Hashes of a level in a tree of so many entries."""
    return F.floor(size / F.pow(F.lit(256.0), level)).cast("bigint")


def partial_width(size: Column, level: Column) -> Column:
    """Width of the last tile of a level; null if it is full or there is none."""
    rest = F.pmod(level_count(size, level), F.lit(TILE))
    return F.when(rest > 0, rest).cast("int")


def latest_tile(size: Column, level: Column) -> Column:
    """struct<index, width> of the last tile of a level; null if there is none."""
    n = level_count(size, level)
    return F.when(n > 0, F.struct(F.floor((n - 1) / TILE).cast("bigint").alias("index"), partial_width(size, level).alias("width")))


def tree_tile_width(size: Column, level: Column, index: Column) -> Column:
    """Width of a tile: that of the partial one if it is it, else null."""
    n = level_count(size, level)
    return F.when(index == F.floor(n / TILE), partial_width(size, level))


def base_url(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "/+$", ""), "/checkpoint$", ""), "/+$", "")


def tile_url(base: Column, path: Column) -> Column:
    return F.concat(base_url(base), F.lit("/"), path)


def checkpoint_url(base: Column) -> Column:
    return F.concat(base_url(base), F.lit("/checkpoint"))


def tile_window(last_entry: Column, size: Column, max_tiles: int, start: Column | None = None) -> Column:
    """struct<first, last> of the tiles of the next step: after the last entry seen, or from start, or the last tile alone; at most max_tiles. Null if nothing is new."""
    newest = F.floor((size - 1) / TILE).cast("bigint")
    first = F.coalesce(F.floor((last_entry + 1) / TILE).cast("bigint"), start if start is not None else F.lit(None).cast("bigint"), newest)
    new = (size > 0) & (F.coalesce(last_entry, F.lit(-1)) + 1 < size)
    return F.when(new & (first <= newest), F.struct(first.alias("first"), F.least(first + max_tiles - 1, newest).alias("last")))


def metadata(entries: DataFrame, index: str = "index") -> DataFrame:
    """(tile, entries, width, first_entry) of each data tile that entries (of such an index) are in; width null: a full one."""
    n = F.count("*")
    width = F.when(n < TILE, n).cast("int")
    return entries.groupBy(F.floor(F.col(index) / TILE).cast("bigint").alias("tile")).agg(n.alias("entries"), width.alias("width"), F.min(index).alias("first_entry"))

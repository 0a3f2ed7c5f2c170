"""A Merkle manifest of a data set: a tree for each source, a tree over the sources, and a proof for every document.

A document's leaf is the digest of its fields. In a source the leaves stand by doc_id; every 16 nodes that follow one
another are hashed to one of the next level, until one is left, the source's subroot. Subroots stand by source and
make the root in the same way. All nodes above the leaves are a table (tree, level, idx, digest).

Proofs are looked up by coordinates: from index and size of its tree each run of leaves explodes the coordinates of
all siblings on its way up, an equi-join with the table of nodes brings their digests, and these are put in order. The
16 leaves of a run have the same way, so that they ask once. What is left for a leaf is to concatenate and fold.

Indices come from a range-partitioned sort and the counts of its partitions, so a source that holds a third of all rows
is spread like any other. The few nodes near the top that everyone asks for are broadcast if their bytes were counted
to be within TOP_BYTES; below them a node is asked for by no more than the leaves under its parent.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

FAN = 16
#: A tree of more levels would have over 2^48 leaves.
MAX_LEVELS = 13
#: What is broadcast of the table of nodes, or of roots of sources, at most.
TOP_BYTES = 16 << 20
#: The tree over the sources. Names of sources begin with "=" or, for null, are empty.
TOP = "top"

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _field(value: Column) -> Column:
    plain = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(plain).cast("string"), F.lit(":"), plain))


def _sha(text: Column) -> Column:
    """The 32 bytes of a digest; as text a digest is its lower-case hexadecimal form."""
    return F.unhex(F.sha2(text, 256))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf(text: Column | None = None) -> Column:
    """The digest of a document's fields; text: one to take in place of its own."""
    return _sha(F.concat(*[_field(F.col(c) if c != "text" or text is None else text) for c in FIELDS]))


def lower_ascii(text: Column) -> Column:
    """Only A-Z become a-z."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _above(n: Column, levels: int) -> Column:
    """Nodes on the level so much higher."""
    return F.floor((n + (FAN**levels - 1)) / F.lit(FAN**levels)).cast("bigint")


def _div(x: Column, by: Column | int) -> Column:
    return F.floor(x / (F.lit(by) if isinstance(by, int) else by)).cast("bigint")


def indexed(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their place idx in their tree and its size n; order: the columns that rows of a tree stand by."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["tree", *order]
    placed = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    placed = common.shared_table(placed.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), name)
    # a row for each partition and each tree more: what a tree has in the partitions before
    held = placed.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("held"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("tree", "part", "first", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"), F.sum("held").over(tree).alias("n"))
    return placed.join(held, ["tree", "part"]).withColumn("idx", F.col("at") - F.col("first") + F.col("before")).drop("part", "at", "first", "before")


def _parents(nodes: DataFrame) -> DataFrame:
    """(tree, idx, n, digest) of the next level, of trees with several nodes."""
    members = F.transform(F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda x: _hex(x["digest"]))
    runs = nodes.where("n > 1").groupBy("tree", _div(F.col("idx"), FAN).alias("idx")).agg(F.min("n").alias("n"), _sha(F.array_join(members, "")).alias("digest"))
    return runs.withColumn("n", _above(F.col("n"), 1))


@dataclass
class Tree:
    """Level by level (tree, idx, n, digest): levels[0] are the leaves."""

    levels: list[DataFrame]
    #: Bytes of each level above the leaves, about.
    bytes: list[int]

    def nodes(self, first: int, last: int | None = None) -> DataFrame | None:
        """(tree, level, idx, digest) of the levels from first to before last."""
        out = None
        for level in range(first, len(self.levels) if last is None else last):
            own = self.levels[level].where("n > 1").select("tree", F.lit(level).alias("level"), "idx", "digest")
            out = own if out is None else out.unionByName(own)
        return out

    def roots(self) -> DataFrame:
        """(tree, digest): of each tree the node that is left."""
        out = None
        for level in self.levels:
            own = level.where("n = 1").select("tree", "digest")
            out = own if out is None else out.unionByName(own)
        return out


def grown(leaves: DataFrame, name: str) -> Tree:
    """The trees over leaves (tree, idx, n, digest), each level written once."""
    n, high = F.col("n"), range(1, MAX_LEVELS)
    sizes = leaves.where("idx = 0").agg(F.max("n"), *[F.sum(F.when(n > FAN ** (k - 1), _above(n, k) * (F.octet_length("tree") + 64))) for k in high]).first()
    most, tree = sizes[0] or 0, Tree([leaves], [0])
    while most > 1:
        most = -(-most // FAN)
        tree.levels.append(common.shared_table(_parents(tree.levels[-1]), f"{name}-{len(tree.levels)}"))
        tree.bytes.append(sizes[len(tree.levels) - 1] or 0)
    return tree


def _siblings(level: Column, at: Column, n: Column) -> Column:
    """Coordinates of the others of a run: at is one's own place on a level of n nodes; none on the last."""
    first = _div(at, FAN) * FAN
    others = F.filter(F.sequence(first, F.least(first + (FAN - 1), n - 1)), lambda i: i != at)
    return F.when(n > 1, F.transform(others, lambda i: F.struct(level.alias("level"), i.alias("idx")))).otherwise(F.array().cast("array<struct<level:int,idx:bigint>>"))


def _steps(found: Column, path: Column) -> Column:
    """array<struct<left, right>>, from below: what stands on both sides of the node on one's way. found: array<struct<level, idx, digest>>; path: array<struct<level, at>> of levels with siblings."""
    side = lambda p, own: F.array_join(F.transform(F.filter(found, lambda x: (x["level"] == p["level"]) & own(x["idx"], p["at"])), lambda x: _hex(x["digest"])), "")
    return F.transform(path, lambda p: F.struct(side(p, lambda i, at: i < at).alias("left"), side(p, lambda i, at: i > at).alias("right")))


STEPS = "array<struct<left:string,right:string>>"


def _upward(runs: DataFrame, tree: Tree, first: int, key: list[str]) -> DataFrame:
    """runs with steps: the proof of their node (idx on level first of its tree of n leaves) up to the tree's root.

    key: columns that name a run. A node that has no siblings has no steps.
    """
    levels = range(first, len(tree.levels))
    if not levels:
        return runs.withColumn("steps", F.array().cast(STEPS))
    at = lambda level: _div(F.col("idx"), FAN ** (level - first))
    size = lambda level: _above(F.col("n"), level)
    wanted = F.flatten(F.array(*[_siblings(F.lit(level), at(level), size(level)) for level in levels]))
    asked = runs.where("n > 1").select(*key, F.explode(wanted).alias("c")).select(*key, F.col("c.level").alias("level"), F.col("c.idx").alias("at"))

    # near the top all ask for the same nodes: those levels go to each task, if they are counted to be small
    top = next((k for k in levels if sum(tree.bytes[k:]) <= TOP_BYTES), len(tree.levels)) if first else len(tree.levels)
    met = None
    for part, nodes, side in ((asked.where(F.col("level") >= top), tree.nodes(max(top, first)), F.broadcast), (asked.where(F.col("level") < top), tree.nodes(first, top), lambda x: x)):
        if nodes is None:
            continue
        nodes = nodes.select(F.col("tree").alias("__tree"), F.col("level").alias("__level"), F.col("idx").alias("__idx"), F.col("digest").alias("__digest"))
        own = part.join(side(nodes), (F.col("tree") == F.col("__tree")) & (F.col("level") == F.col("__level")) & (F.col("at") == F.col("__idx")))
        own = own.select(*key, F.struct("level", F.col("at").alias("idx"), F.col("__digest").alias("digest")).alias("x"))
        met = own if met is None else met.unionByName(own)
    found = met.groupBy(*key).agg(F.array_sort(F.collect_list("x")).alias("found"))
    renamed = found.select(*[F.col(k).alias(f"__{k}") for k in key], "found")
    joined = runs.join(renamed, [F.col(k) == F.col(f"__{k}") for k in key], "left").drop(*[f"__{k}" for k in key])
    path = F.filter(F.array(*[F.struct(F.lit(level).alias("level"), at(level).alias("at"), size(level).alias("n")) for level in levels]), lambda p: p["n"] > 1)
    none = F.array().cast("array<struct<level:int,idx:bigint,digest:binary>>")
    return joined.withColumn("steps", _steps(F.coalesce("found", none), path).cast(STEPS)).drop("found")


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row of docs (doc_id, source, lang, n_chars, text).

    tampered: a column of docs with texts to verify in place of the rows' own; a null text is one of no bytes that is
    not there, as everywhere. The root is recomputed from the leaf of that text and the siblings that were stored;
    verified tells if it is the root of the manifest. Without it the texts themselves are verified.

    Rows with the same doc_id in a source stand by their leaves, so that repeated rows have one root in any order. Null
    doc_ids come first; null sources are a tree of their own, the first. Texts of any length are taken whole. An empty
    table has no rows. Columns beside these are not read.
    """
    tree = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    checked = leaf() if tampered is None else leaf(tampered)
    leaves = docs.select(tree.alias("tree"), F.col("doc_id").cast("bigint").alias("doc_id"), leaf().alias("digest"), checked.alias("checked"))
    leaves = common.shared_table(leaves, "leaves")  # texts are read once
    leaves = common.shared_table(indexed(leaves, ["doc_id", "digest"], "placed"), "indexed")
    trees = grown(leaves.select("tree", "idx", "n", "digest"), "nodes")

    tops = common.shared_table(indexed(trees.roots().select(F.lit(TOP).alias("tree"), F.col("tree").alias("source"), "digest"), ["source"], "subroots"), "top")
    top = grown(tops.select("tree", "idx", "n", "digest"), "top")
    root = top.roots().select(_hex(F.col("digest")).alias("root"))
    last = _upward(tops, top, 0, ["tree", "idx"])
    last = last.select(F.col("source").alias("tree"), _hex(F.col("digest")).alias("subroot"), F.col("steps").alias("last_steps"))
    last = common.shared_table(last.withColumn("root", F.lit(_only(root))), "ways")  # one row for each source

    members = F.array_sort(F.collect_list(F.struct("idx", "doc_id", "digest", "checked")))
    runs = leaves.groupBy("tree", _div(F.col("idx"), FAN).alias("idx")).agg(F.min("n").alias("n"), members.alias("members"))
    runs = _upward(runs, trees, 1, ["tree", "idx"])
    few = last.agg(F.sum(F.octet_length("tree") + F.size("last_steps") * 2048 + 256)).first()[0] or 0
    runs = runs.join(F.broadcast(last) if few <= TOP_BYTES else last, "tree")

    texts = F.transform("members", lambda m: _hex(m["digest"]))
    count = F.size("members")
    own = F.posexplode("members").alias("k", "m")
    rows = runs.select("subroot", "root", "steps", "last_steps", "n", texts.alias("texts"), count.alias("count"), own)
    first = F.struct(F.array_join(F.slice("texts", 1, F.col("k")), "").alias("left"), F.array_join(F.slice("texts", F.col("k") + 2, F.col("count")), "").alias("right"))
    steps = F.concat(F.when(F.col("n") > 1, F.array(first)).otherwise(F.array().cast(STEPS)).cast(STEPS), "steps", "last_steps")
    rows = rows.select(F.col("m.doc_id").alias("doc_id"), _hex(F.col("m.digest")).alias("leaf"), "subroot", "root", steps.alias("steps"), _hex(F.col("m.checked")).alias("checked"))
    proof = F.sha2(F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    folded = F.aggregate("steps", F.col("checked"), lambda digest, s: F.sha2(F.concat(s["left"], digest, s["right"]), 256))
    out = rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _only(root: DataFrame) -> str | None:
    """The root of all: one row, or none of an empty table."""
    row = root.first()
    return row[0] if row else None


def digest(docs: DataFrame) -> DataFrame:
    """manifest(), a fifth of the texts tampered with: those whose doc_id has a CRC-32 that 5 divides are lower-cased."""
    fifth = F.crc32(F.col("doc_id").cast("bigint").cast("string").cast("binary")) % 5 == 0
    return manifest(docs, F.when(fifth, lower_ascii(F.col("text"))).otherwise(F.col("text")))


def oracle() -> str:
    """DuckDB SQL of digest(): seven levels, so sources of at most 16^6 documents."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf_of = lambda text: "sha256(" + " || ".join(field(c) for c in FIELDS[:-1]) + f" || {field(text)})"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    step = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    crc = "list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])), lambda c, i: " + step + "))"
    out = [
        f"marked AS (SELECT *, xor({crc}, 4294967295) % 5 = 0 AS fifth FROM documents)",
        f"l0 AS (SELECT doc_id, source, {leaf_of('text')} AS h, CASE WHEN fifth THEN {leaf_of(low)} ELSE {leaf_of('text')} END AS checked, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM marked)",
    ]

    def above(name: str, key: str, levels: int) -> None:
        for k in range(1, levels):
            out.append(f"{name}{k} AS (SELECT {key}, sha256(string_agg(h, '' ORDER BY idx)) AS h, idx // 16 AS idx, (any_value(n) + 15) // 16 AS n FROM {name}{k - 1} WHERE n > 1 GROUP BY {key}, idx // 16)")

    above("l", "source", 7)
    subs = " UNION ALL ".join(f"SELECT source, h FROM l{k} WHERE n = 1" for k in range(7))
    out.append(f"t0 AS (SELECT 0 AS one, source, h, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM ({subs}))")
    above("t", "one", 4)
    out.append("root AS (" + " UNION ALL ".join(f"SELECT h AS root FROM t{k} WHERE n = 1" for k in range(4)) + ")")
    # the two sides of each step up, one after the other
    out.append("w0 AS (SELECT l0.*, h AS leaf, checked AS acc, '' AS proof, l0.idx AS place FROM l0)")
    said = 0
    for name, key, levels in (("l", "source", 7), ("t", "one", 4)):
        if name == "t":
            out.append(f"w{said + 1} AS (SELECT w.* EXCLUDE (h, idx, n, place), t0.h AS subroot, 0 AS one, t0.idx AS place FROM w{said} w JOIN t0 ON w.source IS NOT DISTINCT FROM t0.source)")
            said += 1
        for k in range(levels):
            on = f"r.{key} IS NOT DISTINCT FROM w.{key} AND r.idx // 16 = w.place // 16 AND r.idx <> w.place"
            side = lambda sign: f"coalesce(string_agg(r.h, '' ORDER BY r.idx) FILTER (WHERE r.idx {sign} w.place), '')"  # noqa: E731, B023
            out.append(f"s{said} AS (SELECT w.doc_id, {side('<')} AS a, {side('>')} AS b FROM w{said} w JOIN {name}{k} r ON {on} GROUP BY w.doc_id)")
            out.append(f"m{said} AS (SELECT {key}, max(n) AS n FROM {name}{k} GROUP BY {key})")
            out.append(f"w{said + 1} AS (SELECT w.* EXCLUDE (acc, proof, place), CASE WHEN m.n > 1 THEN sha256(coalesce(s.a, '') || w.acc || coalesce(s.b, '')) ELSE w.acc END AS acc, w.proof || coalesce(s.a, '') || coalesce(s.b, '') AS proof, w.place // 16 AS place FROM w{said} w LEFT JOIN s{said} s ON s.doc_id = w.doc_id LEFT JOIN m{said} m ON m.{key} IS NOT DISTINCT FROM w.{key})")
            said += 1
    return "WITH " + ",\n".join(out) + f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = root AS verified FROM w{said}, root"

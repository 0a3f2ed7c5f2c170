"""Queries of logs, DNS, state and sinks; see queries."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checkpoints, domains as D, merkle, tiles
from ..operators import decode, dns, scoring, sinks, state
from . import fixtures, scan
from .queries import _ALLOWED, _FIRST, _LATE, _O_ALERTS, _O_CORPUS, _O_FOUND, _O_NAMES, CFG, ORACLES, QUERIES, _flat, _list, _pairs, alerts_grouped, corpus, events, found, names, observed, query, simple  # noqa: F401

# --- tiles ---------------------------------------------------------------------------------------------------------
_EVENTS = "ids AS (SELECT event_id AS idx FROM events)"


def _ids(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select(F.col("event_id").alias("idx"))


def _o_index(n: str) -> str:
    p = f"lpad(CAST({n} AS VARCHAR), CAST(ceil(length(CAST({n} AS VARCHAR)) / 3.0) * 3 AS INT), '0')"
    return f"regexp_replace(rtrim(regexp_replace({p}, '([0-9]{{3}})', 'x\\1/', 'g'), '/'), 'x([0-9]{{3}})$', '\\1')"


_SIZE = "(idx * 7919 + idx * idx)"


def _big() -> Column:
    return F.col("idx") * 7919 + F.col("idx") * F.col("idx")


simple("tile_index", lambda: tiles.tile_index(F.col("idx") * 7919), _o_index("idx * 7919"), _ids, _EVENTS, "ids")
simple("tile_path", lambda: tiles.tile_path(F.when(F.col("idx") % 3 != 0, F.col("idx") % 8), F.col("idx") * 311, F.when(F.col("idx") % 2 == 0, F.col("idx") % 300)), f"CASE WHEN (idx % 3 = 0 OR idx % 8 <= 5) AND (idx % 2 = 1 OR idx % 300 BETWEEN 1 AND 255) THEN 'tile/' || CASE WHEN idx % 3 = 0 THEN 'data' ELSE CAST(idx % 8 AS VARCHAR) END || '/' || {_o_index('idx * 311')} || CASE WHEN idx % 2 = 0 THEN '.p/' || (idx % 300) ELSE '' END END", _ids, _EVENTS, "ids")
simple("tile_width", lambda: tiles.partial_width(_big(), F.col("idx") % 3), f"CAST(nullif(({_SIZE} // CASE idx % 3 WHEN 0 THEN 1 WHEN 1 THEN 256 ELSE 65536 END) % 256, 0) AS INT)", _ids, _EVENTS, "ids")
simple("tree_tile_width", lambda: tiles.tree_tile_width(_big(), F.lit(0), F.floor(_big() / 256).cast("bigint") - F.col("idx") % 2), f"CASE WHEN idx % 2 = 0 THEN CAST(nullif({_SIZE} % 256, 0) AS INT) END", _ids, _EVENTS, "ids")
simple("tile_urls", lambda: tiles.tile_url(F.concat(F.lit("https://log.example/"), F.col("idx").cast("string"), F.when(F.col("idx") % 2 == 0, "/checkpoint").otherwise("//")), tiles.tile_path(F.lit(None), F.col("idx"), F.lit(None))), f"'https://log.example/' || idx || '/tile/data/' || {_o_index('idx')}", _ids, _EVENTS, "ids")


@query("latest_tile", f"WITH {_EVENTS} SELECT idx, ({_SIZE} - 1) // 256 AS tile, CAST(nullif({_SIZE} % 256, 0) AS INT) AS width FROM ids WHERE {_SIZE} > 0")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _ids(spark, sf).withColumn("t", tiles.latest_tile(_big(), F.lit(0))).where("t is not null").select("idx", F.col("t.index").alias("tile"), F.col("t.width").alias("width"))


@query("tile_window", f"WITH {_EVENTS} SELECT idx, (idx + 1) // 256 AS first, least((idx + 1) // 256 + 3, (idx + idx % 2000 - 1) // 256) AS last FROM ids WHERE idx + idx % 2000 > idx + 1 AND (idx + 1) // 256 <= (idx + idx % 2000 - 1) // 256")
def _(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("idx") + F.col("idx") % 2000
    return _ids(spark, sf).withColumn("w", tiles.tile_window(F.col("idx"), size, 4)).where("w is not null").select("idx", "w.first", "w.last")


@query("tile_meta", "SELECT event_id // 256 AS tile, count(*) AS entries, CASE WHEN count(*) < 256 THEN CAST(count(*) AS INT) END AS width, min(event_id) AS first_entry FROM events GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tiles.metadata(events(spark, sf).select(F.col("event_id").alias("index")))


@query("events_limit", f"WITH {_O_CORPUS} SELECT idx, raw FROM corpus ORDER BY idx LIMIT 10")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return scan.first_entries(corpus(spark, sf), 10, "idx").select("idx", "raw")


# --- Merkle trees --------------------------------------------------------------------------------------------------
def _hashed(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("event_id").alias("index"), merkle.leaf_hash(F.lpad(F.col("event_id").cast("string"), 8, "0").cast("binary")).alias("hash"))


def _leaves(spark: SparkSession, sf: str) -> DataFrame:
    return _hashed(events(spark, sf))


_LEAF = "unhex(sha256(unhex('000000') || encode(lpad(CAST(event_id AS VARCHAR), 8, '0'))))"
_NODE = "unhex(sha256(unhex('01') || {0} || {1}))"


@query("leaf_hash", f"SELECT event_id AS index, lower(hex({_LEAF})) AS hash FROM events")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _leaves(spark, sf).select("index", F.lower(F.hex("hash")).alias("hash"))


@query("node_hash", f"WITH l AS (SELECT event_id AS i, {_LEAF} AS h FROM events) SELECT a.i // 2 AS index, lower(hex({_NODE.format('a.h', 'b.h')})) AS hash FROM l a JOIN l b ON b.i = a.i + 1 WHERE a.i % 2 = 0")
def _(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _leaves(spark, sf).where(F.col("index") < F.lit(events(spark, sf).count() // 2 * 2))
    return merkle.next_level(pairs).select("index", F.lower(F.hex("hash")).alias("hash"))


def _o_levels(n: int, where: str) -> str:
    out = [f"l0 AS (SELECT event_id AS i, {_LEAF} AS h FROM events WHERE {where})"]
    for k in range(n):
        out.append(f"l{k + 1} AS (SELECT i // 2 AS i, CASE WHEN count(*) = 1 THEN any_value(h) ELSE {_NODE.format('max(h) FILTER (WHERE i % 2 = 0)', 'max(h) FILTER (WHERE i % 2 = 1)')} END AS h FROM l{k} GROUP BY i // 2)")
    return ", ".join(out)


#: Levels of SQL that reach the root of any table here; a single hash goes up as it is.
_LEVELS = 40


@query("merkle_root", f"WITH {_o_levels(_LEVELS, 'true')} SELECT lower(hex(h)) AS root FROM l{_LEVELS}")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.tree_root(_leaves(spark, sf), events(spark, sf).count()).select(F.lower(F.hex("root")).alias("root"))


def _o_frontiers() -> str:
    """Roots of perfect subtrees by level and place, and for each size those that it is made of, folded from the last."""
    levels = 18
    out = [f"p0 AS (SELECT event_id AS i, {_LEAF} AS h FROM events)"]
    out += [f"p{k + 1} AS (SELECT a.i // 2 AS i, {_NODE.format('a.h', 'b.h')} AS h FROM p{k} a JOIN p{k} b ON b.i = a.i + 1 WHERE a.i % 2 = 0)" for k in range(levels)]
    nodes = " UNION ALL ".join(f"SELECT {k} AS level, i, h FROM p{k}" for k in range(levels + 1))
    plan = f"plan AS (SELECT event_id + 1 AS size, unnest(list_filter(range({levels + 1}), lambda k: ((event_id + 1) >> k) % 2 = 1)) AS level FROM events)"
    own = "own AS (SELECT size, list(h ORDER BY plan.level) AS hs FROM plan JOIN nodes ON nodes.level = plan.level AND nodes.i = ((size >> plan.level) - 1) GROUP BY size)"
    return ", ".join([*out, f"nodes AS ({nodes})", plan, own])


#: The last root of a frontier is of the smallest subtree, which others are put to the left of.
@query("frontier_root", f"WITH {_o_frontiers()} SELECT size, len(hs) AS n_roots, lower(hex(list_reduce(hs, lambda acc, x: {_NODE.format('x', 'acc')}))) AS root FROM own")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The root of the tree at each size that it has had."""
    rows = events(spark, sf).select("event_id")
    most = rows.agg(F.max("event_id")).first()[0]
    leaves = _hashed(rows.repartition(merkle.tile_of(F.col("event_id"))))  # ids move, not their hashes
    found = merkle.frontiers(leaves, rows.select((F.col("event_id") + 1).alias("size")), 0 if most is None else most + 1)
    return found.select("size", F.size("roots").cast("bigint").alias("n_roots"), F.lower(F.hex(merkle.compact_root(F.col("roots")))).alias("root"))


def _groups(spark: SparkSession, sf: str, size: int) -> DataFrame:
    """(part, hashes) of each full group of neighbouring leaves."""
    grouped = _leaves(spark, sf).groupBy(F.floor(F.col("index") / size).cast("bigint").alias("part"))
    hashes = F.transform(F.array_sort(F.collect_list(F.struct("index", "hash"))), lambda x: x["hash"]).alias("hashes")
    return grouped.agg(hashes).where(F.size("hashes") == size)


@query("merkle_perfect", f"WITH {_o_levels(4, 'event_id < (SELECT count(*) // 16 * 16 FROM events)')} SELECT i AS part, lower(hex(h)) AS root FROM l4")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _groups(spark, sf, 16).select("part", F.lower(F.hex(merkle.perfect_root(F.col("hashes")))).alias("root"))


@query("merkle_compact", f"WITH l AS (SELECT event_id AS i, {_LEAF} AS h FROM events) SELECT a.i // 3 AS part, lower(hex({_NODE.format('a.h', _NODE.format('b.h', 'c.h'))})) AS root FROM l a JOIN l b ON b.i = a.i + 1 JOIN l c ON c.i = a.i + 2 WHERE a.i % 3 = 0")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _groups(spark, sf, 3).select("part", F.lower(F.hex(merkle.compact_root(F.col("hashes")))).alias("root"))


@query(
    "subtree_plan",
    "WITH bits AS (SELECT event_id AS size, unnest(range(63)) AS b FROM events) SELECT size, size - size % (1::BIGINT << b) - (1::BIGINT << b) AS start, 1::BIGINT << b AS subtree, CAST(least(b // 8, 5) AS INT) AS level FROM bits WHERE (size >> b) & 1 = 1",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select(F.col("event_id").alias("size"), F.inline(merkle.subtree_plans(F.col("event_id"))))


@query("hash_tile", "SELECT t AS tile, len(hs) AS n, lower(hs[1]) AS first, lower(hs[-1]) AS last FROM (SELECT event_id // 256 AS t, list(hex(" + _LEAF + ") ORDER BY event_id) AS hs FROM events GROUP BY ALL)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    by = _leaves(spark, sf).groupBy(F.floor(F.col("index") / 256).cast("bigint").alias("tile")).agg(F.array_sort(F.collect_list(F.struct("index", "hash"))).alias("all"))
    data = F.unhex(F.array_join(F.transform("all", lambda x: F.hex(x["hash"])), ""))
    hashes = by.select("tile", merkle.hash_tile(data).alias("h"))
    return hashes.select("tile", F.size("h").cast("bigint").alias("n"), F.lower(F.hex(F.get("h", F.lit(0)))).alias("first"), F.lower(F.hex(F.element_at("h", -1))).alias("last"))


@query("leaf_verify", "SELECT event_id AS index, event_id % 50 <> 3 AND event_id % 97 <> 5 AS ok FROM events")
def _(spark: SparkSession, sf: str) -> DataFrame:
    leaves = _leaves(spark, sf)
    theirs = leaves.where("index % 97 <> 5").withColumn("hash", F.when(F.col("index") % 50 == 3, F.unhex(F.lit("00"))).otherwise(F.col("hash")))
    return merkle.verify_leaves(leaves, theirs)


# --- checkpoints ---------------------------------------------------------------------------------------------------
_ROOT = "to_base64(unhex(sha256(CAST(event_id AS VARCHAR))))"


def _notes(spark: SparkSession, sf: str) -> DataFrame:
    root = F.base64(F.unhex(F.sha2(F.col("event_id").cast("string").cast("binary"), 256)))
    size = F.when(F.col("event_id") % 5 == 1, "012").when(F.col("event_id") % 5 == 2, "x").otherwise(F.col("event_id").cast("string"))
    tail = F.when(F.col("event_id") % 5 == 3, "").otherwise("— log.example AQIDBHNpZw==\n")
    return events(spark, sf).select("event_id", F.concat(F.lit("log.example\n"), size, F.lit("\n"), root, F.lit("\n\n"), tail).alias("note"))


@query("ckpt_parse", f"SELECT event_id, CASE WHEN event_id % 5 IN (0, 4) THEN event_id END AS size, CASE WHEN event_id % 5 IN (0, 4) THEN {_ROOT} END AS root_hash, CASE event_id % 5 WHEN 1 THEN 'bad size' WHEN 2 THEN 'bad size' WHEN 3 THEN 'no signature' END AS error FROM events")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _notes(spark, sf).select("event_id", checkpoints.parse(F.col("note")).alias("c")).select("event_id", "c.size", "c.root_hash", "c.error")


@query("ckpt_root_hex", "SELECT event_id, sha256(CAST(event_id AS VARCHAR)) AS root FROM events WHERE event_id % 5 IN (0, 4)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _notes(spark, sf).select("event_id", checkpoints.root_hex(checkpoints.parse(F.col("note"))["root_hash"]).alias("root")).where("root is not null")


@query("note_key_id", "SELECT event_id, substr(sha256(encode('log' || event_id) || unhex('0A05') || unhex(sha256('k' || event_id))), 1, 8) AS key_id FROM events")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select("event_id", checkpoints.note_key_id(F.concat(F.lit("log"), F.col("event_id").cast("string")), F.sha2(F.concat(F.lit("k"), F.col("event_id").cast("string")).cast("binary"), 256)).alias("key_id"))


_HISTORY = "SELECT 'log' || user_id % 50 AS log_url, event_id AS seen, event_id - CASE WHEN event_id % 11 = 0 THEN 900 ELSE 0 END AS size, 'r' || (event_id - CASE WHEN event_id % 11 = 0 THEN 900 ELSE 0 END) AS root_hash FROM events"


@query("ckpt_rollback", f"SELECT log_url, seen, CASE WHEN size < prev THEN 'rollback' END AS problem FROM (SELECT *, lag(size) OVER (PARTITION BY log_url ORDER BY seen) AS prev FROM ({_HISTORY}))")
def _(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("event_id") - F.when(F.col("event_id") % 11 == 0, 900).otherwise(0)
    history = events(spark, sf).select(F.concat(F.lit("log"), (F.col("user_id") % 50).cast("string")).alias("log_url"), F.col("event_id").alias("at"), size.alias("size"), F.concat(F.lit("r"), size.cast("string")).alias("root_hash"))
    return state.rollbacks(history).select("log_url", F.col("at").alias("seen"), "problem")


# --- bytes ---------------------------------------------------------------------------------------------------------
_O_ENTRIES = "entries AS (SELECT event_id AS i FROM events)"


def _tiles(spark: SparkSession, sf: str) -> DataFrame:
    """Data tiles (index, width, bytes) with an entry for each event, made where they are read."""
    from ..ship import ship

    ship(spark)

    def made(frames):
        for frame in frames:
            for at in range(0, len(frame), 8):  # a few tiles at a time: a frame of rows is many bytes of tiles
                part = frame.iloc[at : at + 8]
                made_ = [fixtures.tile(int(i) * tiles.TILE, int(n)) for i, n in zip(part["index"], part["n"], strict=True)]
                yield part[["index"]].assign(width=part["n"].where(part["n"] < tiles.TILE).astype("Int32"), bytes=made_)

    each = events(spark, sf).groupBy(F.floor(F.col("event_id") / tiles.TILE).cast("bigint").alias("index")).agg(F.count("*").alias("n"))
    each = each.repartition(spark.sparkContext.defaultParallelism, "index")  # few bytes here, many once a tile is made
    # its columns as they are: under a projection Spark does not see that two uses of the tiles are the same
    return each.mapInPandas(made, "index bigint, width int, bytes binary")


@query("decode_tile", f"WITH {_O_ENTRIES} SELECT i AS index, 1700000000000 + i AS timestamp_millis, CASE WHEN i % 5 = 4 THEN 'precertificate' ELSE 'x509' END AS kind, 1 AS n_chain, 0 AS extensions_len FROM entries")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return decode.decode_tiles(_tiles(spark, sf)).select("index", "timestamp_millis", "kind", F.size("chain_fingerprints").alias("n_chain"), "extensions_len")


@query("parse_cert", f"WITH {_O_ENTRIES} SELECT i AS index, 'CN=Test CA' AS issuer, '2026-01-01T00:00:00Z' AS not_before, '*.Wild.example.org|bad_name.example|login-paypa1-' || i || '.net|www.host' || i || '.example.com' AS sans FROM entries WHERE i % 7 <> 6")
def _(spark: SparkSession, sf: str) -> DataFrame:
    parsed = decode.parse_certificates(decode.decode_tiles(_tiles(spark, sf)))
    return parsed.where("error is null").select("index", "issuer", "not_before", F.array_join("san_dns_names", "|").alias("sans"))


@query("events_and_errors", f"WITH {_O_ENTRIES} SELECT i AS index, i % 7 = 6 AS failed FROM entries")
def _(spark: SparkSession, sf: str) -> DataFrame:
    good, bad = decode.events_and_errors(decode.decode_tiles(_tiles(spark, sf)), "log")
    return good.select("index", F.lit(False).alias("failed")).union(bad.select("index", F.lit(True)))


@query("san_event", f"WITH {_O_ENTRIES} SELECT i AS index, 'wild.example.org|login-paypa1-' || i || '.net|www.host' || i || '.example.com' AS domains, 1 AS n_rejected FROM entries WHERE i % 7 <> 6")
def _(spark: SparkSession, sf: str) -> DataFrame:
    good, _ = decode.events_and_errors(decode.decode_tiles(_tiles(spark, sf)), "log")
    return good.select("index", F.array_join(F.transform("domains", lambda d: d["normalized"]), "|").alias("domains"), F.size("rejected_domains").alias("n_rejected"))


@query("observations", f"WITH {_O_ENTRIES} SELECT i AS index, p AS pos, CASE p WHEN 0 THEN 'wild.example.org' WHEN 1 THEN 'login-paypa1-' || i || '.net' ELSE 'www.host' || i || '.example.com' END AS domain FROM entries, (VALUES (0), (1), (2)) v(p) WHERE i % 7 <> 6")
def _(spark: SparkSession, sf: str) -> DataFrame:
    good, _ = decode.events_and_errors(decode.decode_tiles(_tiles(spark, sf)), "log")
    return decode.observations(good).select(F.col("certificate_index").alias("index"), "pos", "domain")


@query("scan_tiles", f"WITH {_O_ENTRIES} SELECT 'login-paypa1-' || i || '.net' AS domain, 100 AS score FROM entries WHERE i % 7 <> 6")
def _(spark: SparkSession, sf: str) -> DataFrame:
    alerts, _ = scan.scan_tiles(_tiles(spark, sf), "log", CFG)
    return alerts.where(F.col("domain").like("login%")).select("domain", "score")


@query("san_sorted", "SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), '|') AS kinds FROM events GROUP BY user_id")
def _(spark: SparkSession, sf: str) -> DataFrame:
    lists = events(spark, sf).groupBy("user_id").agg(F.collect_list("event_type").alias("names"))
    return lists.select("user_id", F.array_join(decode.sorted_names(F.col("names")), "|").alias("kinds"))


_O_SAID = "said AS (SELECT event_id // 4 AS index, list(lower(event_type) || event_id || '.example' || event_id % 3 || '.org' ORDER BY event_id) AS names, min(ts) AS ts FROM events GROUP BY 1)"


def _said(spark: SparkSession, sf: str) -> DataFrame:
    """(index, san_dns_names, observed_at): four events make one of several names."""
    name = F.concat(F.lower("event_type"), F.col("event_id").cast("string"), F.lit(".example"), (F.col("event_id") % 3).cast("string"), F.lit(".org"))
    grouped = events(spark, sf).select(F.floor(F.col("event_id") / 4).cast("bigint").alias("index"), F.struct("event_id", name.alias("name")).alias("x"), "ts").groupBy("index").agg(F.array_sort(F.collect_list("x")).alias("xs"), F.min("ts").alias("ts"))
    return grouped.select("index", F.transform("xs", lambda x: x["name"]).alias("san_dns_names"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("observed_at"))


@query("src_mock_events", f"WITH {_O_SAID} SELECT index, unnest(names) AS domain, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS observed_at, 'mock' AS source_type FROM said")
def _(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources import mock

    rows = decode.observations(mock.events_from(_said(spark, sf)))
    return rows.select(F.col("certificate_index").alias("index"), "domain", "observed_at", "source_type")


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, or where that is unset a temporary one of this machine."""
    import tempfile
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return f"{shared}/{name}-{uuid.uuid4().hex}" if shared else f"{tempfile.mkdtemp(prefix='certloom-')}/{name}"


@query("src_jsonl", f"WITH {_O_SAID} SELECT index, unnest(names) AS domain, 'log' || index % 2 AS source_log, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS observed_at, 'ct' AS source_type FROM said")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Events written as JSON lines, and read by the source."""
    from ..sources import static_log

    path = _scratch(spark, "jsonl")
    _said(spark, sf).select(F.concat(F.lit("log"), (F.col("index") % 2).cast("string")).alias("source_log"), F.col("san_dns_names").alias("domains"), "observed_at", "index").write.json(path)
    rows = decode.observations(static_log.read_json_events(spark, path))
    return rows.select(F.col("certificate_index").alias("index"), "domain", "source_log", "observed_at", "source_type")


@query("tile_scan", "SELECT event_id AS index, 1700000000000 + event_id AS timestamp_millis, CASE WHEN event_id % 5 = 4 THEN 'precertificate' ELSE 'x509' END AS kind FROM events")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """A mirror of a log with an entry for each event, read by the data source; each entry is checked against its hash tile."""
    from ..sources import static_log

    folder, size = _scratch(spark, "mirror"), events(spark, sf).count()
    static_log.write_mirror(_tiles(spark, sf), folder)
    spark.dataSource.register(static_log.StaticLogSource)
    rows = spark.read.format("static_log").option("mirror", folder).option("size", size).load()
    return rows.select("index", "timestamp_millis", "kind")


# --- DNS -----------------------------------------------------------------------------------------------------------
_TARGETS = ("old.herokuapp.com", "page.GitHub.io.", "cdn.example.net", "shop.myshopify.com", "x.s3.amazonaws.com")
_RANK = "length(domain) + ascii(domain)"


def answers(domains: DataFrame) -> DataFrame:
    """Made-up answers for names, by their length and first letter."""
    n = F.length("domain") + F.ascii("domain")
    status = F.element_at(F.array(*map(F.lit, dns.STATUSES)), (n % 7 + 1).cast("int"))
    ips = F.when(n % 7 == 0, F.when(n % 2 == 0, F.array(F.lit("192.0.2.1"))).otherwise(F.array(F.lit("192.0.2.1"), F.lit("192.0.2.2")))).otherwise(F.array().cast("array<string>"))
    chain = F.when(n % 3 != 0, F.array(F.element_at(F.array(*map(F.lit, _TARGETS)), (n % 5 + 1).cast("int")))).otherwise(F.array().cast("array<string>"))
    return domains.select("domain", (n % 7 == 0).alias("resolved"), status.alias("status"), ips.alias("ips"), chain.alias("cname_chain"), F.array().cast("array<string>").alias("errors"))


_O_DNS = f"""answers AS (SELECT domain, n, n % 7 = 0 AS resolved, list_extract({_list(dns.STATUSES)}, CAST(n % 7 AS INT) + 1) AS status,
CASE WHEN n % 7 <> 0 THEN [] WHEN n % 2 = 0 THEN ['192.0.2.1'] ELSE ['192.0.2.1', '192.0.2.2'] END AS ips,
CASE WHEN n % 3 <> 0 THEN [list_extract({_list(_TARGETS)}, CAST(n % 5 AS INT) + 1)] ELSE [] END AS chain FROM (SELECT domain, {_RANK} AS n FROM (SELECT DISTINCT domain FROM names WHERE NOT list_contains({_ALLOWED}, domain))))"""


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import detectors

    return names(spark, sf).where(~detectors.allowed(F.col("domain"), CFG)).select("domain").distinct()


@query("dns_domains", f"WITH {_O_NAMES} SELECT DISTINCT domain FROM names WHERE NOT list_contains({_ALLOWED}, domain)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return dns.lookup_domains(found(spark, sf), _asked(spark, sf))


@query("dns_status", f"WITH {_O_NAMES}, {_O_DNS} SELECT domain, CASE WHEN len(ips) > 0 THEN 'resolved' ELSE 'no_data' END AS status FROM answers")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return answers(_asked(spark, sf)).select("domain", dns.answer(F.col("ips")).alias("status"))


_SHOWN = "CASE status WHEN 'serv_fail' THEN 'ServFail' WHEN 'refused' THEN 'Refused' WHEN 'timeout' THEN 'Timeout' ELSE 'TransportError' END"


@query("dns_enrich", f"""WITH {_O_FOUND}, {_O_DNS} SELECT t.certificate_index, t.domain, t.detector,
array_to_string(list_concat(t.reasons, list_filter([CASE WHEN a.resolved THEN 'DNS resolved to ' || len(ips) || CASE WHEN len(ips) = 1 THEN ' IP address' ELSE ' IP addresses' END WHEN status IN ('nx_domain', 'no_data') THEN 'DNS lookup did not return IP addresses' ELSE 'DNS lookup ended with status ' || {_SHOWN} END, CASE WHEN len(chain) > 0 THEN 'DNS CNAME chain contains 1 target' END], lambda x: x IS NOT NULL)), '|') AS reasons,
array_to_string(list_concat(list_concat(list_concat(t.evidence, ['dns.resolved=' || a.resolved, 'dns.status=' || replace(a.status, '_', '')]), list_transform(ips, lambda i: 'dns.ip=' || i)), list_transform(chain, lambda c: 'dns.cname=' || c)), '|') AS evidence FROM tidy t JOIN answers a ON t.domain = a.domain""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = dns.apply_dns(found(spark, sf), answers(_asked(spark, sf)))
    return out.select("certificate_index", "domain", "detector", F.array_join("reasons", "|").alias("reasons"), _pairs("evidence").alias("evidence"))


_O_SUFFIX = "(VALUES " + ", ".join(f"('{p}', '{s}', '{u}')" for p, ss, u in dns.PROVIDERS for s in ss) + ") f(provider, suffix, reference)"


@query("takeover", f"""WITH {_O_NAMES}, {_O_DNS}, hit AS (SELECT DISTINCT domain, provider, c AS cname, reference FROM (SELECT domain, unnest(chain) AS c FROM answers WHERE NOT resolved AND status IN ('nx_domain', 'no_data')) JOIN {_O_SUFFIX} ON lower(rtrim(c, '.')) = suffix OR lower(rtrim(c, '.')) LIKE '%.' || suffix)
SELECT domain, 'takeover' AS detector, 'high' AS severity, 70 AS score, 'unresolved domain has CNAME target `' || cname || '` matching takeover provider `' || provider || '`' AS reasons, 'takeover.status=candidate|takeover.provider=' || provider || '|takeover.cname=' || cname || '|takeover.reference=' || reference AS evidence FROM hit""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(dns.takeover_findings(dns.takeover_candidates(answers(_asked(spark, sf)), dns.fingerprints(spark))))


#: An upstream list as large as pages: hosts are suffixes, every fifth of a provider that the curated list has too.
_O_UP = r"""up AS (SELECT CASE WHEN page_id % 5 = 0 THEN 'heroku' ELSE array_to_string(string_split(host, '.')[-2:], '.') END AS k, host AS suffix FROM (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?]+)', 1)) AS host FROM pages))"""


@query("fingerprint_merge", f"WITH {_O_UP}, f AS (SELECT lower(provider) AS k, suffix FROM {_O_SUFFIX} UNION SELECT * FROM up) SELECT k AS provider, array_to_string(list_sort(list(DISTINCT suffix)), '|') AS suffixes FROM f GROUP BY k")
def _(spark: SparkSession, sf: str) -> DataFrame:
    host = F.lower(F.parse_url("url", F.lit("HOST")))
    site = F.substring_index(host, ".", -2)
    provider = F.when(F.col("page_id") % 5 == 0, "Heroku ").when(F.col("page_id") % 2 == 0, F.upper(site)).otherwise(site)
    up = spark.read.parquet(f"{sf}/pages.parquet").select(provider.alias("provider"), F.concat(F.lit("*."), host, F.lit(".")).alias("suffix"), F.lit(None).cast("string").alias("reference"))
    return dns.merge_fingerprints(up, dns.fingerprints(spark)).select(F.lower("provider").alias("provider"), F.array_join("suffixes", "|").alias("suffixes"))


# --- state ---------------------------------------------------------------------------------------------------------
_NOW = 1_800_000_000
_PARTS = "list_concat(list_transform(reasons, lambda r: 'reason=' || r), list_filter(evidence, lambda e: NOT starts_with(e, 'ct.observed_at=')))"
_PRINT = f"sha256(array_to_string(list_sort(list_distinct({_PARTS})), chr(10)))"
_KEY = f"""sha256('{{"log_id":"demo-log","certificate_index":' || certificate_index || ',"certificate_fingerprint":null,"normalized_domain":"' || domain || '","detector":"' || detector || '","evidence_fingerprint":"' || {_PRINT} || '"}}')"""
_O_KEYED = f"{_O_FOUND}, keyed AS (SELECT *, {_KEY} AS key FROM tidy)"


@query("evidence_fp", f"WITH {_O_FOUND} SELECT certificate_index, detector, {_PRINT} AS fingerprint FROM tidy")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return found(spark, sf).select("certificate_index", "detector", state.evidence_fingerprint(F.col("reasons"), F.col("evidence")).alias("fingerprint"))


@query("alert_identity", f"WITH {_O_KEYED} SELECT certificate_index, detector, key FROM keyed")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return state.identity(found(spark, sf)).select("certificate_index", "detector", "key")


#: Records as an earlier batch left them: of two thirds of the entries, some expired, some of a lower severity.
_RECORDS = f"records AS (SELECT key, CASE WHEN certificate_index % 5 = 0 THEN 'info' ELSE severity END AS highest_severity, {_NOW} - 1000 AS first_seen_unix, {_NOW} - 500 AS last_seen_unix, {_NOW} + CASE WHEN certificate_index % 7 = 0 THEN -1 ELSE 1000 END AS expires_at_unix FROM keyed WHERE certificate_index % 3 <> 0)"


def _records(keyed: DataFrame) -> DataFrame:
    at = F.lit(_NOW).cast("bigint")
    severity = F.when(F.col("certificate_index") % 5 == 0, "info").otherwise(F.col("severity"))
    return keyed.where("certificate_index % 3 <> 0").select("key", severity.alias("highest_severity"), (at - 1000).alias("first_seen_unix"), (at - 500).alias("last_seen_unix"), (at + F.when(F.col("certificate_index") % 7 == 0, -1).otherwise(1000)).alias("expires_at_unix"))


_RANKED = "list_position(['info', 'low', 'medium', 'high', 'critical'], {0})"
_O_NEW = f"{_O_KEYED}, {_RECORDS}, fresh AS (SELECT k.* FROM keyed k LEFT JOIN (SELECT * FROM records WHERE expires_at_unix > {_NOW}) r ON k.key = r.key WHERE r.key IS NULL OR {_RANKED.format('k.severity')} > {_RANKED.format('r.highest_severity')})"


@query("dedupe_findings", f"WITH {_O_NEW} SELECT certificate_index, detector, severity FROM fresh")
def _(spark: SparkSession, sf: str) -> DataFrame:
    keyed = state.identity(found(spark, sf))
    return state.unseen(keyed, _records(keyed), _NOW).select("certificate_index", "detector", "severity")


@query("dedupe_alerts", f"WITH {_O_NEW}, {_O_ALERTS[len(_O_FOUND) + 2:]} SELECT domain, score FROM alerts WHERE score >= 60 AND domain IN (SELECT domain FROM fresh)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    keyed = state.identity(found(spark, sf))
    return state.new_alerts(scan.heads(observed(spark, sf), CFG), state.unseen(keyed, _records(keyed), _NOW), 60).select("domain", "score")


@query("alert_upsert", f"WITH {_O_NEW} SELECT coalesce(r.key, f.key) AS key, CASE WHEN f.key IS NULL THEN r.highest_severity ELSE f.severity END AS highest_severity, coalesce(r.first_seen_unix, {_NOW}) AS first_seen_unix, CASE WHEN f.key IS NULL THEN r.last_seen_unix ELSE {_NOW} END AS last_seen_unix, CASE WHEN f.key IS NULL THEN r.expires_at_unix ELSE {_NOW + state.TTL_SECONDS} END AS expires_at_unix FROM records r FULL OUTER JOIN fresh f ON r.key = f.key")
def _(spark: SparkSession, sf: str) -> DataFrame:
    keyed = state.identity(found(spark, sf))
    records = _records(keyed)
    return state.remember(records, state.unseen(keyed, records, _NOW), _NOW)


@query("alert_prune", f"WITH {_O_KEYED}, {_RECORDS} SELECT key FROM records WHERE expires_at_unix > {_NOW}")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return state.prune(_records(state.identity(found(spark, sf))), _NOW).select("key")


@query("watch_batch", f"WITH {_O_NEW} SELECT domain, count(*) AS n_new FROM fresh WHERE certificate_index >= 512 GROUP BY domain")
def _(spark: SparkSession, sf: str) -> DataFrame:
    keyed = state.identity(found(spark, sf))
    fresh = state.unseen(keyed.where("certificate_index >= 512"), _records(keyed), _NOW)
    return fresh.groupBy("domain").agg(F.count("*").alias("n_new"))


@query("legacy_domain_dedupe", f"WITH {_O_CORPUS} SELECT DISTINCT lower(raw) AS domain FROM corpus")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return state.alerted_domains(corpus(spark, sf).select(F.col("raw").alias("domain")))


@query("dedupe_keys", "SELECT user_id, min(event_id) AS first FROM events GROUP BY user_id")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return state.first_of_key(events(spark, sf), "user_id", "event_id").select("user_id", F.col("event_id").alias("first"))


@query("dead_letter_cap", "SELECT event_id AS index FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 1024")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return state.newest(events(spark, sf).where("event_type = 'error'").select(F.col("event_id").alias("index")))


_O_OUT = "out AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'webhook' ELSE 'chat' END AS sink, '{\"n\":' || event_id % 100 || '}' AS payload FROM events)"
_OUT_ID = "sha256(encode(sink) || unhex('00') || encode(payload))"


def _outgoing(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select("event_id", F.when(F.col("event_id") % 2 == 0, "webhook").otherwise("chat").alias("sink"), F.concat(F.lit('{"n":'), (F.col("event_id") % 100).cast("string"), F.lit("}")).alias("payload"))


@query("outbox_id", f"WITH {_O_OUT} SELECT event_id, {_OUT_ID} AS id FROM out")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _outgoing(spark, sf).select("event_id", state.outbox_id(F.col("sink"), F.col("payload")).alias("id"))


@query("outbox_dedupe", f"WITH {_O_OUT} SELECT DISTINCT {_OUT_ID} AS id, sink, payload FROM out")
def _(spark: SparkSession, sf: str) -> DataFrame:
    from .. import schemas

    return state.enqueue(spark.createDataFrame([], schemas.OUTBOX), _outgoing(spark, sf).select("sink", "payload"), _NOW).select("id", "sink", "payload")


# --- sinks ---------------------------------------------------------------------------------------------------------
_QUOTED = "list_transform({0}, lambda x: '\"' || x || '\"')"
_JSON = "'{\"domain\":\"' || domain || '\",\"detector\":\"' || detector || '\",\"severity\":\"' || severity || '\",\"score\":' || score || ',\"reasons\":[' || array_to_string(" + _QUOTED.format("reasons") + ", ',') || '],\"evidence\":[' || array_to_string(list_transform(evidence, lambda e: '{\"kind\":\"' || split_part(e, '=', 1) || '\",\"value\":\"' || substr(e, length(split_part(e, '=', 1)) + 2) || '\"}'), ',') || ']}'"


@query("sink_jsonl", f"WITH {_O_FOUND} SELECT {_JSON} AS value FROM tidy")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.json_lines(found(spark, sf))


@query("idempotency_key", f"WITH {_O_FOUND} SELECT sha256({_JSON}) AS key FROM tidy")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.json_lines(found(spark, sf)).select(sinks.idempotency_key(F.col("value")).alias("key"))


@query("slack_text", f"WITH {_O_FOUND} SELECT certificate_index, 'Certloom alert: ' || domain || ' severity=' || upper(severity[1]) || severity[2:] || ' score=' || score || ' detector=' || detector AS text FROM tidy")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return found(spark, sf).select("certificate_index", sinks.chat_text().alias("text"))


@query("slack_alert_findings", f"WITH {_O_FOUND} SELECT 'Certloom alert: ' || domain || ' severity=' || upper(max(severity)[1]) || max(severity)[2:] || ' score=' || max(score) || ' detector=' || detector AS text FROM tidy GROUP BY domain, detector")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.alert_findings(scan.heads(observed(spark, sf), CFG)).select(sinks.chat_text().alias("text"))


@query(
    "webhook_payload",
    f"WITH {_O_FOUND} SELECT count(*) AS n, '{{\"kind\":\"findings\",\"count\":' || count(*) || ',\"findings\":[' || string_agg({_JSON}, ',' ORDER BY score DESC, domain, {_JSON}) || ']}}' AS payload FROM tidy GROUP BY certificate_index",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.envelopes(found(spark, sf), "findings", F.col("certificate_index")).select(F.col("count").alias("n"), "payload")


# --- names that need Unicode rules ---------------------------------------------------------------------------------
_IDN = ("bücher.host{n}.example", "xn--pypal-4ve.com", "xn--paypa1-4ve.com", "münchen.de", "plain{n}.com", "pаypal.login{n}.com", "Straße.de", "micrоsоft.com")
#: Known ASCII forms of these names; the third has none.
_IDN_ASCII = ("xn--bcher-kva.host{n}.example", "xn--pypal-4ve.com", "", "xn--mnchen-3ya.de", "plain{n}.com", "xn--pypal-4ve.login{n}.com", "xn--strae-oqa.de", "xn--micrsft-djgb.com")
_O_IDN = f"idn AS (SELECT event_id AS idx, CAST(event_id % {len(_IDN)} AS INT) + 1 AS k, nullif(replace(list_extract({_list(_IDN_ASCII)}, CAST(event_id % {len(_IDN)} AS INT) + 1), '{{n}}', CAST(event_id AS VARCHAR)), '') AS domain, lower(replace(list_extract({_list(_IDN)}, CAST(event_id % {len(_IDN)} AS INT) + 1), '{{n}}', CAST(event_id AS VARCHAR))) AS shown FROM events)"


def _idn_names(spark: SparkSession, sf: str) -> DataFrame:
    pick = F.element_at(F.array(*map(F.lit, _IDN)), (F.col("event_id") % len(_IDN) + 1).cast("int"))
    return events(spark, sf).select(F.col("event_id").alias("idx"), F.replace(pick, F.lit("{n}"), F.col("event_id").cast("string")).alias("raw"))


def _idn_observed(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions import idn

    named = idn.normalize(_idn_names(spark, sf)).where("domain is not null")
    return scan.with_metadata(named.select("domain", F.col("idx").alias("certificate_index"), F.lit("2026-01-01T00:00:00Z").alias("observed_at")), "demo-log", "ct")


@query("normalize_idn", f"WITH {_O_IDN} SELECT idx, domain FROM idn")
def _(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions import idn

    return idn.normalize(_idn_names(spark, sf)).select("idx", "domain")


def _o_glyph(letter: str) -> str:
    """SQL list of a text for each of the look-alikes that a name shows, in order."""
    return f"list_transform(list_filter(string_split(readable, ''), lambda c: c IN ('а', 'о')), lambda c: {letter})"


#: The third and fifth name have nothing to find; umlauts and ß only mix scripts; the others show Cyrillic letters.
_O_IDN_HITS = f"""{_O_IDN},
shown_ AS (SELECT *, CASE k WHEN 2 THEN 'pаypal.com' ELSE shown END AS readable FROM idn WHERE k NOT IN (3, 5)),
shapes AS (SELECT *, CASE k WHEN 2 THEN 'paypal.corn' WHEN 6 THEN 'paypal.login' || replace(replace(CAST(idx AS VARCHAR), '0', 'o'), '1', 'l') || '.corn' WHEN 8 THEN 'rnicrosoft.corn' END AS skeleton, CASE WHEN k IN (2, 6) THEN 'paypal' END AS protected FROM shown_)"""


@query("detect_homoglyph_idn", f"""WITH {_O_IDN_HITS} SELECT idx, domain, CASE WHEN protected IS NULL THEN 45 ELSE 85 END AS score,
array_to_string(list_concat(list_concat(CASE WHEN protected IS NULL THEN [] ELSE ['decoded domain skeleton matches protected name `' || protected || '`'] END, {_o_glyph("'domain contains lookalike character `' || c || '` that may resemble `' || translate(c, 'ао', 'ao') || '`'")}), ['domain mixes ASCII and non-ASCII letters']), '|') AS reasons,
array_to_string(list_concat(list_concat(list_concat(CASE WHEN protected IS NULL THEN [] ELSE ['homoglyph.skeleton=' || skeleton, 'homoglyph.protected_name=' || protected] END, ['idn.decoded=' || readable]), {_o_glyph("'glyph=' || c || '->' || translate(c, 'ао', 'ao')")}), ['idn.script_mixing=ascii+non_ascii']), '|') AS evidence FROM shapes""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Through a whole scan: names are normalised, decoded, detected and merged."""
    own = F.slice("evidence", 1, F.size("evidence") - 4)
    hits = scan.findings(_idn_observed(spark, sf), CFG).where("detector = 'homoglyph'")
    return hits.select(F.col("certificate_index").alias("idx"), "domain", "score", F.array_join("reasons", "|").alias("reasons"), _pairs(own).alias("evidence"))


#: What the other detectors find in the ASCII forms: three hyphens and more, and parts an edit or two from official labels.
@query("detect_all_idn", f"""WITH {_O_IDN_HITS},
found AS (SELECT idx, domain, 'homoglyph' AS detector, CASE WHEN protected IS NULL THEN 45 ELSE 85 END AS score FROM shapes
UNION ALL SELECT idx, domain, 'composition', 45 FROM idn WHERE k IN (2, 4, 7, 8)
UNION ALL SELECT idx, domain, 'typosquat', CASE damerau_levenshtein(string_split(domain, '-')[3], CASE k WHEN 2 THEN 'paypal' ELSE 'microsoft' END) WHEN 1 THEN 85 ELSE 70 END FROM idn WHERE k IN (2, 8))
SELECT idx, domain, detector, score FROM found""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = scan.findings(_idn_observed(spark, sf), CFG)
    return rows.select(F.col("certificate_index").alias("idx"), "domain", "detector", "score")


@query("san_idn", f"""WITH {_O_IDN}, raw AS (SELECT *, replace(list_extract({_list(_IDN)}, k), '{{n}}', CAST(idx AS VARCHAR)) AS original FROM idn)
SELECT idx, 'plain' || idx || '.example' AS domain, 'plain' || idx || '.example' AS original, false AS is_idn FROM raw
UNION ALL SELECT idx, domain, original, contains(domain, 'xn--') FROM raw WHERE domain IS NOT NULL""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Names of a certificate, one of them in another script or in punycode."""
    from ..sources import mock

    rows = _idn_names(spark, sf).select(F.col("idx").alias("index"), F.array(F.concat(F.lit("plain"), F.col("idx").cast("string"), F.lit(".example")), "raw").alias("san_dns_names"), F.lit("2026-01-01T00:00:00Z").alias("observed_at"))
    return mock.events_from(rows).select(F.col("index").alias("idx"), F.explode("domains").alias("d")).select("idx", F.col("d.normalized").alias("domain"), F.col("d.original").alias("original"), F.col("d.is_idn").alias("is_idn"))

import base64
import json
import struct
from collections import Counter

import pytest
from pyspark.sql import functions as F

from certloom.config import demo
from certloom.functions import checkpoints, tiles
from certloom.operators import decode, state
from certloom.plans import fixtures
from certloom.sources import mock, static_log
from certloom.streaming.watch import Store, Watch, bucket_of, emit_new, next_tiles

from .test_logs import root_of


def test_watch_suppresses_repeats_and_keeps_what_is_not_delivered(spark, tmp_path):
    sent, broken, now = [], [False], [1000]

    def deliver(sink, payload):
        if broken[0]:
            raise ConnectionError("down")
        sent.append((sink, json.loads(payload)))

    def watch():
        return Watch(spark, demo(), Store(spark, str(tmp_path / "state")), "log", deliver, clock=lambda: now[0])

    def events(*rows):
        return mock.events_of(spark, [(i, [n], "2026-01-01T00:00:00Z") for i, n in rows])

    errors = spark.createDataFrame([(9, "bad"), (9, "bad")], "index bigint, error string")
    first = watch().step(events((1, "paypa1-login.com"), (2, "clean.example")), errors, 0)
    assert first["new_findings"] == 4 and len(sent) == 1 and sent[0][1]["count"] == 1
    assert watch().step(events((1, "paypa1-login.com")), errors, 1)["new_findings"] == 0 and len(sent) == 1
    assert watch().step(events((5, "paypa1-login.com")), None, 2)["new_findings"] == 4 and len(sent) == 2  # another certificate
    assert watch().store.load("dead_letters").count() == 1
    broken[0] = True
    with pytest.raises(ConnectionError):
        watch().step(events((6, "payapl.com")), None, 3)
    waiting = watch().store.load("outbox").collect()
    assert len(waiting) == 1 and waiting[0]["attempts"] == 1 and "down" in waiting[0]["last_error"]
    broken[0] = False
    watch().step(events((6, "payapl.com")), None, 4)
    assert [p["alerts"][0]["domain"] for _, p in sent[2:]] == ["payapl.com"] and watch().store.load("outbox").count() == 0
    now[0] += state.TTL_SECONDS + 1
    assert watch().step(events((1, "paypa1-login.com")), None, 5)["new_findings"] == 4  # expired
    again = watch().step(events((1, "paypa1-login.com")), None, 5)  # a replayed batch begins from the state before it
    assert again["new_findings"] == 4
    records = watch().store.load("records")
    assert records.count() == records.select("key").distinct().count() and records.where("first_seen_unix > last_seen_unix").count() == 0
    other = Watch(spark, demo(), Store(spark, str(tmp_path / "state")), "another log", deliver, clock=lambda: now[0])
    assert other.store.load("records").count() == 0 and other.store.position()["checkpoint_size"] == 0
    assert other.step(events((1, "paypa1-login.com")), None, 6)["new_findings"] == 4


def test_a_crash_before_the_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    sent = []
    watch = Watch(spark, demo(), Store(spark, str(tmp_path / "state")), "log", lambda sink, payload: sent.append(payload), clock=lambda: 1000)
    events = mock.events_of(spark, [(1, ["paypa1-login.com"], "2026-01-01T00:00:00Z")])
    publish, calls = Store._publish, []

    def crash(self, version, body):
        calls.append(version)
        if len(calls) == 2:  # the step is saved, what was delivered of it is not
            raise OSError("lost")
        publish(self, version, body)

    monkeypatch.setattr(Store, "_publish", crash)
    with pytest.raises(OSError):
        watch.step(events, None, 0)
    assert len(sent) == 1 and [r["payload"] for r in watch.store.load("outbox").collect()] == sent  # still waits
    watch.flush()
    assert sent[0] == sent[1] and watch.store.load("outbox").count() == 0 and watch.store.load("records").count() == 4
    monkeypatch.setattr(Store, "_publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        watch.step(mock.events_of(spark, [(2, ["payapl.com"], "2026-01-01T00:00:00Z")]), None, 1)
    assert watch.store.load("records").count() == 4 and len(sent) == 2


def test_a_step_reads_the_buckets_of_its_keys(spark, tmp_path, monkeypatch):
    """Old records of other buckets are not read, whatever their number; crowded buckets are gathered and split, and nothing is lost."""
    monkeypatch.setattr("certloom.streaming.watch.MAX_PARTS", 1)
    monkeypatch.setattr("certloom.streaming.watch.BUCKET_RECORDS", 400)
    store = Store(spark, str(tmp_path / "state"), "log")
    watch = Watch(spark, demo(), store, "log", lambda *x: None, clock=lambda: 1000)
    hexes = F.sha2(F.col("id").cast("string"), 256)
    old = lambda n: spark.range(n).select(hexes.alias("key"), F.lit("low").alias("highest_severity"), F.lit(1).cast("bigint").alias("first_seen_unix"), F.lit(1).cast("bigint").alias("last_seen_unix"), F.lit(10**9).cast("bigint").alias("expires_at_unix"))
    own = spark.createDataFrame([("a" * 64,), ("b" * 64,)], "key string")
    read = []
    for version, n in enumerate((1000, 8000)):
        store.save(version, {}, {"last_entry": None, "checkpoint_size": 0, "checkpoint_root": None}, old(n), store.manifest()["tables"]["records"] if version else [])
        paths = store.buckets(own)
        assert {p.rpartition("=")[2] for p in paths} == {"a", "b"}
        read.append(store.load("records", paths=paths).count() / n)
    assert max(read) < 0.2  # two buckets of 16
    for version in range(2, 5):
        assert watch.step(mock.events_of(spark, [(version, ["paypa1-login.com"], "2026-01-01T00:00:00Z")]), None, version)["new_findings"] == 4
    names = {p.rpartition("=")[2] for p in store.manifest()["tables"]["records"]}
    assert store.digits() >= 2 and {1, 2} <= {len(n) for n in names}
    rows = store.load("records")
    assert rows.count() == 8000 + 3 * 4 == rows.select("key").distinct().count()
    assert watch.step(mock.events_of(spark, [(2, ["paypa1-login.com"], "2026-01-01T00:00:00Z")]), None, 5)["new_findings"] == 0


def test_records_are_gathered_now_and_then(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("certloom.streaming.watch.MAX_PARTS", 2)
    watch = Watch(spark, demo(), Store(spark, str(tmp_path / "state")), "log", lambda *_: None, clock=lambda: 1000)
    parts = []
    for n in range(5):
        watch.step(mock.events_of(spark, [(n, ["paypa1-login.com"], "2026-01-01T00:00:00Z")]), None, n)
        parts.append(max(Counter(map(bucket_of, watch.store.manifest()["tables"]["records"])).values()))
        assert watch.store.load("records").count() == 4 * (n + 1)
    assert max(parts) <= 2 and len(list((tmp_path / "state").glob("d-*"))) < 20


@pytest.fixture
def grown(spark, tmp_path):
    """A log that a test can let grow, signed by a key made here."""
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    maker = jvm.java.security.KeyPairGenerator.getInstance("EC")
    maker.initialize(256)
    pair = maker.generateKeyPair()
    encoded = jvm.java.lang.Class.forName("java.security.Key").getMethod("getEncoded", array(jvm.java.lang.Class, 0))
    key = checkpoints.Key.of("log", base64.b64encode(bytes(encoded.invoke(pair.getPublic(), array(jvm.java.lang.Object, 0)))).decode())
    root = tmp_path / "log"

    def put(path, data):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(data)

    def grow(size, forged=b"", salt=0, signed=True):
        leaves = []
        for index in range(-(-size // 256)):
            width = min(256, size - 256 * index)
            data = fixtures.tile(256 * index + 1000 * salt, width)
            put(static_log.tile_path(None, index, width % 256 or None), data)
            hashes = [bytes.fromhex(r["merkle_leaf_hash"]) for r in decode.read_tile(data, index, width if width < 256 else None)]
            put(static_log.tile_path(0, index, width % 256 or None), b"".join(hashes))
            leaves.append(hashes)
        if size >= 256:
            put(static_log.tile_path(1, 0, size // 256), b"".join(root_of(x) for x in leaves if len(x) == 256))
        top = forged or root_of([h for x in leaves for h in x])
        signer = jvm.java.security.Signature.getInstance("SHA256withECDSA")
        signer.initSign(pair.getPrivate())
        signer.update(bytearray(checkpoints.tree_head(1, size if signed else size + 1, top)))
        made = bytes(signer.sign())
        put("checkpoint", fixtures.checkpoint("log", size, top, key.key_id() + struct.pack(">QBBH", 1, 4, 3, len(made)) + made).encode())

    return static_log.mirror(str(root)), key, grow


def test_cycles(spark, tmp_path, grown):
    log, key, grow = grown
    sent = []
    watch = Watch(spark, demo(), Store(spark, str(tmp_path / "state")), "log", lambda sink, payload: sent.append(json.loads(payload)), clock=lambda: 1000)
    grow(300)
    first = watch.cycle(log, key)  # at the latest tile
    assert (first["first_tile"], first["last_tile"], first["entries"], first["last_entry"]) == (1, 1, 44, 299) and first["alerts"] > 0 and sent
    idle = watch.cycle(log, key)
    assert idle["entries"] == 0 and idle["message"] == "no new entries" and {k: v for k, v in watch.store.position().items() if k != "frontier"} == {"last_entry": 299, "checkpoint_size": 300, "checkpoint_root": log.root_hash(300)}
    assert watch.store.position()["frontier"] == [x.hex() for x in log.frontier(300).roots]
    grow(700)
    assert [watch.cycle(log, key)["last_entry"] for _ in range(3)] == [511, 699, 699]
    for wrong in (lambda: grow(690), lambda: grow(700, b"\1" * 32), lambda: grow(720, salt=1), lambda: grow(720, signed=False), lambda: grow(720, b"\1" * 32)):
        wrong()
        before = watch.store.manifest()
        with pytest.raises((checkpoints.CheckpointError, static_log.LogError)):
            watch.cycle(log, key)
        assert watch.store.manifest() == before
    grow(720)
    assert watch.cycle(log, key)["entries"] == 20
    watch.store.reset()
    assert watch.store.load("records").count() == 0 and watch.cycle(log, key, max_tiles=2, seed_tile=0)["last_entry"] == 511
    told = []
    watch.run(log, key, told=told.append, once=True)
    assert told[0]["first_tile"] == 2


def test_next_tiles(spark):
    cases = [(None, 0, None), (None, 700, None), (None, 700, 0), (None, 700, 5), (699, 700, None), (10, 700, None), (255, 700, None), (255, 256, None), (0, 1, None), (0, 2, None)]
    for last, size, seed in cases:
        window = tiles.tile_window(F.lit(last).cast("bigint"), F.lit(size), 2, F.lit(seed).cast("bigint"))
        want = spark.range(1).select(window.alias("w")).first()["w"]
        assert next_tiles(last, size, 2, seed) == (tuple(want) if want else None)


def test_keyed_state_lets_escalations_pass(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "key string, domain string, detector string, severity string, score int, now_unix bigint"
    batches = [[("k", "d", "x", "low", 30, 10), ("k", "d", "x", "low", 30, 10)], [("k", "d", "x", "low", 30, 20)], [("k", "d", "x", "high", 80, 30)], [("k", "d", "x", "low", 30, 30 + state.TTL_SECONDS + 1)]]
    source = tmp_path / "in"
    source.mkdir()
    got = []
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        q = emit_new(stream).writeStream.foreachBatch(lambda df, _: got.extend(r["severity"] for r in df.collect())).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert got == [["low"] * 2, ["low"] * 2, ["low", "low", "high"], ["low", "low", "high", "low"]][n]

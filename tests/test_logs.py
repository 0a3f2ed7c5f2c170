import base64
import hashlib
import random
import struct

import pytest
from pyspark.sql import functions as F

from certloom.config import demo
from certloom.functions import checkpoints, merkle, signatures, tiles
from certloom.operators import decode
from certloom.plans import fixtures, scan
from certloom.sources import static_log


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tile_arithmetic(spark):
    for n, want in ((0, "000"), (7, "007"), (123, "123"), (1234, "x001/234"), (1234067, "x001/x234/067")):
        assert one(spark, tiles.tile_index(F.lit(n))) == want == static_log.index_path(n)
    null = F.lit(None)
    assert one(spark, tiles.tile_path(null, F.lit(273), F.lit(112))) == "tile/data/273.p/112" == static_log.tile_path(None, 273, 112)
    assert one(spark, tiles.tile_path(F.lit(1), F.lit(4), null)) == "tile/1/004" and one(spark, tiles.tile_path(F.lit(6), F.lit(4), null)) is None
    assert [one(spark, tiles.partial_width(F.lit(70000), F.lit(k))) for k in range(3)] == [112, 17, 1]
    assert tuple(one(spark, tiles.latest_tile(F.lit(70000), F.lit(0)))) == (273, 112) and tuple(one(spark, tiles.latest_tile(F.lit(512), F.lit(0)))) == (1, None)
    assert [merkle.subtree(n) for n in (1, 128, 256, 32768)] == [(0, 1), (0, 128), (1, 1), (1, 128)]


def root_of(leaves):
    if len(leaves) == 1:
        return leaves[0]
    k = 1
    while k * 2 < len(leaves):
        k *= 2
    return hashlib.sha256(b"\x01" + root_of(leaves[:k]) + root_of(leaves[k:])).digest()


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 300])
def test_roots(spark, n):
    leaves = [hashlib.sha256(bytes([0, i % 256, i // 256])).digest() for i in range(n)]
    rows = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(leaves)], "index bigint, hash binary")
    assert bytes(merkle.tree_root(rows, n).first()["root"]) == root_of(leaves)
    array = F.array(*[F.lit(x) for x in leaves]) if n <= 64 else None
    if array is not None:
        got = one(spark, merkle.perfect_root(array))
        assert (bytes(got) == root_of(leaves)) if n & (n - 1) == 0 else got is None


def test_checkpoint_signature(spark):
    jvm = spark._jvm
    maker = jvm.java.security.KeyPairGenerator.getInstance("EC")
    maker.initialize(256)
    pair = maker.generateKeyPair()
    array = spark.sparkContext._gateway.new_array
    encoded = jvm.java.lang.Class.forName("java.security.Key").getMethod("getEncoded", array(jvm.java.lang.Class, 0))
    spki = bytes(encoded.invoke(pair.getPublic(), array(jvm.java.lang.Object, 0)))
    key = checkpoints.Key.of("log.example", base64.b64encode(spki).decode())
    root = hashlib.sha256(b"r").digest()
    signer = jvm.java.security.Signature.getInstance("SHA256withECDSA")
    signer.initSign(pair.getPrivate())
    signer.update(bytearray(checkpoints.tree_head(1234, 99, root)))
    signature = bytes(signer.sign())
    note = fixtures.checkpoint("log.example", 99, root, key.key_id() + struct.pack(">QBBH", 1234, 4, 3, len(signature)) + signature)
    c = spark.createDataFrame([(note,)], "t string").select(checkpoints.parse(F.col("t")).alias("c")).first()["c"]
    assert (c["error"], c["size"], base64.b64decode(c["root_hash"])) == (None, 99, root)
    assert checkpoints.verify(c["origin"], 99, c["root_hash"], c["signatures"], key)
    assert not checkpoints.verify(c["origin"], 100, c["root_hash"], c["signatures"], key)
    with pytest.raises(checkpoints.CheckpointError):
        checkpoints.verify("other", 99, c["root_hash"], c["signatures"], key)
    with pytest.raises(checkpoints.CheckpointError):
        checkpoints.consistent(5, "a", 4, "b")
    with pytest.raises(checkpoints.CheckpointError):
        checkpoints.consistent(5, "a", 5, "b")
    with pytest.raises(checkpoints.CheckpointError):
        checkpoints.consistent(5, "a", 9, "b", lambda size: "other")
    checkpoints.consistent(5, "a", 9, "b", lambda size: "a"), checkpoints.consistent(0, None, 9, "b"), checkpoints.consistent(5, None, 9, "b")
    good = note
    bad = ["", "a\nb\n", good.replace("\n99\n", "\nx\n"), good.replace("\n99\n", "\n099\n"), good.replace("\n99\n", "\n99\nmore\n"), good.split("—")[0], good.replace("\n99\n", "\n99\r\n")]
    got = spark.createDataFrame([(x,) for x in bad], "t string").select(checkpoints.parse(F.col("t"))["error"].alias("e")).collect()
    assert all(r["e"] for r in got)
    for text, row in zip(bad, got, strict=True):
        with pytest.raises(checkpoints.CheckpointError, match=row["e"]):
            checkpoints.Checkpoint.of(text)
    assert checkpoints.Checkpoint.of(note).root_hash == c["root_hash"]


@pytest.mark.parametrize(("family", "size", "name", "hash_"), [("EC", 256, "SHA256withECDSA", "sha256"), ("EC", 384, "SHA384withECDSA", "sha384"), ("EC", 384, "SHA256withECDSA", "sha256"), ("RSA", 2048, "SHA256withRSA", "sha256"), ("RSA", 2048, "SHA512withRSA", "sha512")])
def test_signatures_made_by_the_jvm(spark, family, size, name, hash_):
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    maker = jvm.java.security.KeyPairGenerator.getInstance(family)
    maker.initialize(size)
    pair = maker.generateKeyPair()
    encoded = jvm.java.lang.Class.forName("java.security.Key").getMethod("getEncoded", array(jvm.java.lang.Class, 0))
    spki = bytes(encoded.invoke(pair.getPublic(), array(jvm.java.lang.Object, 0)))
    for message in (b"", b"head", b"x" * 1000):
        signer = jvm.java.security.Signature.getInstance(name)
        signer.initSign(pair.getPrivate())
        signer.update(bytearray(message))
        made = bytes(signer.sign())
        assert signatures.verified(spki, family, hash_, message, made)
        assert not signatures.verified(spki, family, hash_, message + b"!", made)
        assert not signatures.verified(spki, family, hash_, message, made[:-1] + bytes([made[-1] ^ 1]))
        assert not signatures.verified(spki, family, hash_, message, b"")
    for key in (spki[:40], spki[:-1] + bytes([spki[-1] ^ 1]) if family == "EC" else b"", b"0"):
        with pytest.raises(signatures.BadKey):
            signatures.verified(key, family, hash_, b"m", made)


def test_entries_and_certificates():
    cert = fixtures.certificate(["paypa1-login.com", "www.example.test", "*.wild.example.test"], 300)
    got = decode.read_certificate(cert)
    assert sorted(got["san_dns_names"]) == ["*.wild.example.test", "paypa1-login.com", "www.example.test"] and got["serial_number"] == "01:2c" and got["not_after"] == "2027-01-01T00:00:00Z"
    assert decode.read_certificate(cert + b"x")["error"] and decode.read_certificate(b"")["error"] and decode.read_certificate(cert[:40])["error"]
    whole = fixtures.entry(5, cert)
    row = decode.read_tile(whole, 0, 1)[0]
    assert row["merkle_leaf_hash"] == hashlib.sha256(b"\x00\x00\x00" + whole[:-34]).hexdigest()
    assert decode.read_tile(fixtures.entry(5, cert, True), 3, 1)[0]["index"] == 768
    for data, width in ((whole[:16], 1), (fixtures.entry(5, cert, chain=b"x" * 31), 1), (whole, 2), (whole, None), (fixtures.entry(5, b""), 1), (b"\xff" * 12 + whole[12:], 1)):
        with pytest.raises(decode.DecodeError):
            decode.read_tile(data, 0, width)


@pytest.fixture(scope="module")
def mirror(tmp_path_factory):
    """A mirrored log of 300 entries."""
    root = tmp_path_factory.mktemp("log")

    def put(path, data):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(data)

    leaves = []
    for index, width in ((0, 256), (1, 44)):
        data = fixtures.tile(index * 256, width)
        put(static_log.tile_path(None, index, width % 256 or None), data)
        hashes = [bytes.fromhex(r["merkle_leaf_hash"]) for r in decode.read_tile(data, index, width if width < 256 else None)]
        put(static_log.tile_path(0, index, width % 256 or None), b"".join(hashes))
        leaves += hashes
    put(static_log.tile_path(1, 0, 1), root_of(leaves[:256]))
    put("checkpoint", fixtures.checkpoint("log", 300, root_of(leaves)).encode())
    return str(root)


def test_log_client(spark, mirror):
    log = static_log.mirror(mirror)
    size = 300
    assert base64.b64encode(log.root(size)).decode() == log.checkpoint().split("\n")[2]
    assert [r["index"] for r in log.entries(size, 1)] == list(range(256, 300))
    with pytest.raises(ValueError):
        log.entries(size, 2)
    tampered = static_log.Log(mirror, lambda p: log.get(p) if not p.startswith("tile/0/") else b"\x00" * len(log.get(p)))
    with pytest.raises(static_log.LogError):
        tampered.entries(size, 0)
    found = static_log.read_mirror(spark, mirror)
    assert sorted((r["index"], r["width"]) for r in found.select("index", "width").collect()) == [(0, None), (1, 44)]
    alerts, errors = scan.scan_tiles(found, "log", demo(), first_entry=100)
    assert alerts.count() > 100 and errors.count() == sum(i % 7 == 6 for i in range(100, 300))


def test_log_source(spark, mirror, tmp_path):
    spark.dataSource.register(static_log.StaticLogSource)
    rows = spark.read.format("static_log").options(mirror=mirror, firstEntry="250").load()
    assert sorted(r["index"] for r in rows.select("index").collect()) == list(range(250, 300))
    stream = spark.readStream.format("static_log").options(mirror=mirror, maxTiles="1").load()
    query = stream.select("index").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="0 seconds").start()
    try:
        import time

        for _ in range(60):
            query.processAllAvailable()
            if spark.read.schema("index bigint").parquet(str(tmp_path / "out")).count() == 300:
                break
            time.sleep(0.5)
    finally:
        query.stop()
    got = [r["index"] for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == list(range(300))


def test_frontier_follows_a_growing_tree():
    """At each size the root of the whole tree, whatever the sizes in between; only new subtrees are asked for; forks and rollbacks are found."""
    leaves = [hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(600)]
    rng, asked = random.Random(4), []

    def root(start, n):
        asked.append(start)
        return root_of(leaves[start : start + n])

    assert merkle.Frontier().root() == hashlib.sha256(b"").digest()
    for _ in range(20):
        own = merkle.Frontier()
        while own.size < 600:
            old, asked[:] = own, []
            own = own.grown(min(600, own.size + rng.choice([0, 1, 2, 17, 256])), root)
            assert all(x >= old.size for x in asked) and len(asked) < 20
            assert own.size == 0 or own.root() == root_of(leaves[: own.size]) and len(own.roots) == own.size.bit_count()


def test_a_log_is_followed_by_its_frontier(tmp_path):
    fetched = []

    def log_of(leaves, root=None):
        tiles = {static_log.tile_path(0, i // 256, (len(leaves) - i) if len(leaves) - i < 256 else None): b"".join(leaves[i : i + 256]) for i in range(0, len(leaves), 256)}
        full = [root_of(leaves[i : i + 256]) for i in range(0, len(leaves) - 255, 256)]
        if full:
            tiles[static_log.tile_path(1, 0, len(full))] = b"".join(full)
        tiles["checkpoint"] = fixtures.checkpoint("log", len(leaves), root or root_of(leaves)).encode()

        def get(path):
            fetched.append(path)
            if path not in tiles:
                raise FileNotFoundError(path)
            return tiles[path]

        return static_log.Log("log", get)

    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(1000)]
    now, at = log_of(leaves[:700]).followed(None, merkle.Frontier())
    assert now.size == 700 and at.root() == root_of(leaves[:700])
    fetched.clear()
    now, grown = log_of(leaves[:720]).followed(None, at)
    assert grown.root() == root_of(leaves[:720]) and set(fetched) == {"checkpoint", "tile/0/002.p/208"}  # nothing of the old full tiles
    assert log_of(leaves[:720]).followed(None, grown)[1] == grown
    other = [hashlib.sha256(b"x").digest(), *leaves[1:]]
    for wrong, why in ((log_of(leaves[:690]), "rolled back"), (log_of(other[:720]), "two roots"), (log_of(other[:730]), "seen before"), (log_of(leaves[:730], leaves[0]), "seen before")):
        with pytest.raises(checkpoints.CheckpointError, match=why):
            wrong.followed(None, grown)

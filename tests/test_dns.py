import socket
import struct
import threading
import time
import uuid

import pytest
from pyspark.sql import functions as F

from certloom.config import Dns
from certloom.operators import dns
from certloom.sources import resolver


def packed(name):
    return b"".join(bytes([len(x)]) + x.encode() for x in name.split(".")) + b"\0"


class Server:
    """A DNS server of fixed answers: name -> (code, [(type, value)]); an unknown name is NXDOMAIN, 'silent.example' is not answered."""

    def __init__(self, zone):
        self.zone = zone
        self.socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
        self.socket.bind(("127.0.0.1", 0))
        self.tcp = socket.create_server(("127.0.0.1", self.port))
        for target in (self.udp, self.whole):
            threading.Thread(target=target, daemon=True).start()

    @property
    def port(self):
        return self.socket.getsockname()[1]

    def reply(self, question):
        name, end = resolver._name(question, 12)
        kind = struct.unpack(">H", question[end : end + 2])[0]
        code, records = self.zone.get(name, (3, []))
        found = [(k, v) for k, v in records if k in (kind, resolver.CNAME)]
        body = b"".join(b"\xc0\x0c" + struct.pack(">HHIH", k, 1, 60, len(v)) + v for k, v in [(k, packed(v) if k == resolver.CNAME else socket.inet_pton(socket.AF_INET if k == resolver.A else socket.AF_INET6, v)) for k, v in found])
        return question[:2] + struct.pack(">HHHHH", 0x8180 | code, 1, len(found), 0, 0) + question[12:] + body

    def udp(self):
        while True:
            question, who = self.socket.recvfrom(4096)
            name = resolver._name(question, 12)[0]
            if name == "silent.example":
                continue
            self.socket.sendto(b"\0\0 forged", who)
            cut_short = question[:2] + struct.pack(">HHHHH", 0x8380, 1, 0, 0, 0) + question[12:]
            self.socket.sendto(cut_short if name == "long.example" else self.reply(question), who)

    def whole(self):
        while True:
            peer, _ = self.tcp.accept()
            question = peer.recv(4096)[2:]
            reply = self.reply(question)
            peer.sendall(struct.pack(">H", len(reply)) + reply)
            peer.close()


C, A = resolver.CNAME, resolver.A
ZONE = {
    "ok.example": (0, [(A, "192.0.2.2"), (A, "192.0.2.1"), (resolver.AAAA, "2001:db8::1")]),
    "shop.example": (3, [(C, "Gone.HerokuApp.com")]),
    "two.example": (0, [(C, "mid.example")]),
    "mid.example": (3, [(C, "x.github.io")]),
    "a.loop": (0, [(C, "b.loop")]),
    "b.loop": (0, [(C, "a.loop")]),
    "refused.example": (5, []),
    "broken.example": (2, []),
    "empty.example": (0, []),
    "long.example": (0, [(A, "192.0.2.9")]),
} | {f"n{i}.deep": (0, [(C, f"n{i + 1}.deep")]) for i in range(20)}


@pytest.fixture(scope="module")
def ask():
    server = Server(ZONE)
    return resolver.Resolver(["127.0.0.1"], server.port, timeout=0.6)


def test_lookups(ask):
    assert ask("ok.example") == {"domain": "ok.example", "ips": ["192.0.2.1", "192.0.2.2", "2001:db8::1"], "cname_chain": [], "error": None, "ttl": 60}
    assert ask("long.example")["ips"] == ["192.0.2.9"]  # by TCP
    assert ask("a.loop")["cname_chain"] == ["b.loop", "a.loop", "b.loop"]
    assert ask("n0.deep")["cname_chain"] == [f"n{i}.deep" for i in range(1, 9)]
    assert [ask(x)["error"] for x in ("nowhere.example", "refused.example", "broken.example", "empty.example")] == ["NXDOMAIN", "Query Refused", "SERVFAIL", "no records found"]
    assert ask("x" * 70 + ".example")["error"] == "bad name"
    began = time.monotonic()
    assert ask("silent.example")["error"] == resolver.TIMED_OUT and time.monotonic() - began < 2.5


def test_chains():
    steps = {"a": "b", "b": "c", "c": "b"}
    assert resolver.chain_of("A.", steps.get) == ["b", "c", "b"] and resolver.chain_of("z", steps.get) == []
    assert resolver.chain_of("a", lambda x: x + "a", 3) == ["aa", "aaa", "aaaa"]


def test_replies_that_are_broken():
    for data in (b"", b"\0\1\x81\x80\0\0\0\1\0\0\0\0", b"\0\1\x81\x80\0\1\0\0\0\0\0\0\xc0\x0c", b"\0\1\x01\x80" + b"\0" * 8):
        with pytest.raises(resolver.LookupFailed):
            resolver.reply(data, 1)


def test_dangling_names_are_takeover_candidates(spark, ask):
    names = spark.createDataFrame([(x,) for x in ("ok.example", "shop.example", "two.example", "silent.example", "refused.example")], "domain string").repartition(2)
    answers = dns.resolve(names, 4, ask).persist()
    got = {r["domain"]: r for r in answers.collect()}
    assert {d: r["status"] for d, r in got.items()} == {"ok.example": "resolved", "shop.example": "nx_domain", "two.example": "no_data", "silent.example": "timeout", "refused.example": "refused"}
    assert got["ok.example"]["resolved"] and got["ok.example"]["errors"] == [] and got["shop.example"]["errors"] == ["NXDOMAIN"]
    found = dns.takeover_candidates(answers, dns.fingerprints(spark)).collect()
    assert sorted((r["domain"], r["cname"], r["provider"]) for r in found) == [("shop.example", "gone.herokuapp.com", "Heroku"), ("two.example", "x.github.io", "GitHub Pages")]


def test_only_expired_answers_are_asked_again(spark, tmp_path):
    """Answers stay for as long as they say, names without address for the configured time, failures shortly; nothing is asked twice."""
    log = tmp_path / "asked"
    log.mkdir()

    def lookup(domain):
        (log / f"{domain}-{uuid.uuid4().hex}").touch()
        ttl = {"long.example": 5000, "short.example": 1, "forever.example": 10**7}.get(domain)
        return {"domain": domain, "ips": ["192.0.2.1"] if ttl else [], "cname_chain": [], "error": None if ttl else "NXDOMAIN" if domain == "gone.example" else "timed out", "ttl": ttl}

    def asked(now):
        before = {p.name for p in log.iterdir()}
        rows = {r["domain"]: (r["status"], r["ips"]) for r in dns.answered(names, options, now, lookup).collect()}
        assert {d: s for d, (s, _) in rows.items()} == {"long.example": "resolved", "short.example": "resolved", "forever.example": "resolved", "gone.example": "nx_domain", "slow.example": "timeout"}
        return sorted(p.name.rpartition("-")[0].split(".")[0] for p in log.iterdir() if p.name not in before)

    names = spark.createDataFrame([(f"{x}.example",) for x in ("long", "short", "forever", "gone", "slow")], "domain string")
    options = Dns(enabled=True, concurrency=2, cache=str(tmp_path / "cache"), negative_ttl=900)
    assert asked(1000) == ["forever", "gone", "long", "short", "slow"]
    assert asked(1010) == []
    assert asked(1061) == ["short", "slow"]  # sixty seconds at least
    assert asked(2000) == ["gone", "short", "slow"]
    assert asked(6001) == ["gone", "long", "short", "slow"]
    dns.compact_answers(spark, options, 6001)
    assert spark.read.parquet(options.cache).count() == 5 and asked(6002) == []
    assert asked(1000 + 86_400) == ["forever", "gone", "long", "short", "slow"]  # a day at most


def test_limits_hold_over_all_tasks(spark, tmp_path):
    """However many partitions ask: no more at once, and no more a second, than the configuration says."""

    def lookup(domain):
        began = time.time()
        time.sleep(0.05)
        (tmp_path / f"{began}-{time.time()}-{domain}").touch()
        return {"domain": domain, "ips": [], "cname_chain": [], "error": "x", "ttl": None}

    names = spark.range(40).select(F.concat(F.lit("n"), F.col("id").cast("string"), F.lit(".example")).alias("domain")).repartition(16)
    assert dns.resolve(names, 3, lookup, 20.0).count() == 40
    spans = sorted(tuple(map(float, p.name.split("-")[:2])) for p in tmp_path.iterdir())
    assert len(spans) == 40 and spans[-1][0] - spans[0][0] > 0.5 * 40 / 20
    assert max(sum(a <= t < b for a, b in spans) for t, _ in spans) <= 3

import dataclasses
import random

import pytest
from pyspark.sql import functions as F

from certloom.config import Config, ConfigError, Rules, ct_base_url, demo, from_mapping
from certloom.functions import domains as D
from certloom.functions import idn, suffixes
from certloom.operators import decode, detection, detectors, dns, scoring, sinks, state
from certloom.plans import fixtures, scan


def apply(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").repartition(2)
    return [r[0] for r in rows.select("i", make(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_normal_form(spark):
    table = {"PayPal.COM": "paypal.com", "*.example.com": "example.com", "*.*.example.com": "example.com", "example.com..": "example.com", "  a.b\t": "a.b", "": None, "localhost": None, "example..com": None, "api.*.example.com": None, "a_b.com": None, "-a.com": None, "a-.com": None, "a" * 64 + ".com": None, "a" * 63 + ".com": "a" * 63 + ".com", "x/y.com": None, None: None, "*.": None, ("a" * 60 + ".") * 5 + "com": None}
    assert apply(spark, list(table), D.normalize) == list(table.values())


def test_internationalised_names(spark):
    rows = spark.createDataFrame([("bücher.example",), ("XN--BCHER-KVA.example",), ("xn--paypa1-4ve.com",), ("pаypal.com",), ("plain.com",), (None,)], "raw string")
    got = {r["raw"]: r["domain"] for r in idn.normalize(rows).collect()}
    assert got == {"bücher.example": "xn--bcher-kva.example", "XN--BCHER-KVA.example": "xn--bcher-kva.example", "xn--paypa1-4ve.com": None, "pаypal.com": "xn--pypal-4ve.com", "plain.com": "plain.com", None: None}
    found = idn.readable(detectors.features(spark.createDataFrame([("xn--pypal-4ve.com",), ("a.com",)], "domain string")))
    hit = found.select("domain", F.get(detectors.homoglyph(demo()), F.lit(0)).alias("f")).where("f is not null").select("domain", "f.*").first()
    assert hit["domain"] == "xn--pypal-4ve.com" and hit["score"] == 85
    assert [e["kind"] for e in hit["evidence"]] == ["homoglyph.skeleton", "homoglyph.protected_name", "idn.decoded", "glyph", "idn.script_mixing"]


def test_registrable_part(spark):
    rules = spark.createDataFrame(D.public_suffix_rules(["// comment", "com", "co.uk", "uk", "*.ck", "!www.ck", ""]), "suffix string, kind string")
    rows = spark.createDataFrame([(x,) for x in ("secure.example.co.uk", "a.b.com", "com", "x.y.ck", "a.x.y.ck", "www.ck", "a.www.ck", "host.test", "co.uk")], "domain string")
    got = {r["domain"]: r["registrable"] for r in D.registrable_by_join(rows, rules).collect()}
    assert got == {"secure.example.co.uk": "example.co.uk", "a.b.com": "b.com", "com": "com", "x.y.ck": "x.y.ck", "a.x.y.ck": "x.y.ck", "www.ck": "www.ck", "a.www.ck": "www.ck", "host.test": "host.test", "co.uk": "co.uk"}
    assert apply(spark, ["secure.example.co.uk"], D.registrable_label) == ["example"]


def osa(a, b):
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_distance(spark):
    rng = random.Random(1)
    pairs = [("payapl", "paypal"), ("ca", "abc"), ("a", "a"), ("", "ab"), ("ab", ""), ("", "")]
    pairs += [tuple("".join(rng.choice("abc") for _ in range(rng.randrange(7))) for _ in range(2)) for _ in range(300)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = [r[1] for r in rows.select("i", D.osa_distance(F.col("a"), F.col("b")).alias("d")).orderBy("i").collect()]
    assert got == [osa(*p) for p in pairs]


#: domain -> ({detector: score}, alert score, severity) under the demo configuration.
GOLDEN = {
    "paypa1-login.com": ({"composition": 80, "homoglyph": 85, "keyword": 30, "typosquat": 85}, 100, "critical"),
    "paypal-secure-login.com": ({"brand": 50, "composition": 75, "homoglyph": 85, "keyword": 40}, 100, "critical"),
    "micr0soft-support.net": ({"composition": 80, "keyword": 30, "typosquat": 85}, 100, "critical"),
    "secure-wallet-example.net": ({"composition": 45, "keyword": 40}, 55, "medium"),
    "paypa1.com": ({"composition": 80, "homoglyph": 85, "typosquat": 85}, 100, "critical"),
    "payapl.com": ({"typosquat": 85}, 85, "high"),
    "support.example.com": ({"keyword": 30}, 30, "low"),
    "login.account-reset.example.org": ({"composition": 55, "keyword": 50}, 65, "medium"),
    "paypal.com.evil.top": ({"brand": 50, "composition": 30, "homoglyph": 85}, 100, "critical"),
    "www.paypal.com": ({"brand": 50, "homoglyph": 85}, 95, "critical"),
    "githab.io": ({"typosquat": 85}, 85, "high"),
    "microsoft-login.com": ({"brand": 50, "composition": 75, "keyword": 30}, 95, "critical"),
    "my-paypal.xyz": ({"brand": 50, "composition": 30, "homoglyph": 85}, 100, "critical"),
    "a-b-c-d.com": ({"composition": 45}, 45, "medium"),
    "secure.example.co.uk": ({"composition": 30, "keyword": 30}, 40, "medium"),
}


def test_golden_alerts(spark):
    rows = scan.scan_domains(spark, [*GOLDEN, "github.com", "example.com", "mylogin.com"], demo()).collect()
    assert {r["domain"]: ({f["detector"]: f["score"] for f in r["findings"]}, r["score"], r["severity"]) for r in rows} == GOLDEN
    assert [(-r["score"], r["domain"]) for r in rows] == sorted((-r["score"], r["domain"]) for r in rows)
    first = next(r for r in rows if r["domain"] == "paypa1-login.com")
    assert first["detectors"] == ["composition", "homoglyph", "keyword", "typosquat"]
    own = next(f for f in first["findings"] if f["detector"] == "composition")["evidence"]
    assert [e["kind"] for e in own].count("composition.protected_name") == 1
    with pytest.raises(ValueError):
        scan.scan_domains(spark, ["ok.com", "not a domain"], demo())
    low = scan.scan_domains(spark, ["paypa1-login.com"], demo().overridden(min_score=50)).first()
    assert low["detectors"] == ["composition", "homoglyph", "typosquat"]


def test_merge_keeps_the_first_as_it_is(spark):
    e = lambda *xs: [("k", x) for x in xs]
    rows = spark.createDataFrame([(2, "d", "x", "high", 70, ["r2", "r1"], e("a", "c")), (1, "d", "x", "low", 30, ["r1"], e("a", "a", "b")), (3, "d", "x", "odd", 70, ["r3"], e("c", "d"))], "at int, domain string, detector string, severity string, score int, reasons array<string>, evidence array<struct<kind: string, value: string>>")
    r = scoring.merge_findings(rows, ["at"]).first()
    assert (r["severity"], r["score"], r["reasons"], [x["value"] for x in r["evidence"]]) == ("high", 70, ["r1", "r2", "r3"], ["a", "a", "b", "c", "d"])


def test_configuration():
    assert demo().overridden(allowlist_suffixes=[".Example.org"]).rules.allowlist_suffixes == ["example.org"]
    assert ct_base_url("https://log.example/x/checkpoint") == "https://log.example/x"
    for bad in ({"nope": 1}, {"rules": {"min_score": 101}}, {"rules": {"x": 1}}, {"dns": {"concurrency": 0}}, {"outputs": {"webhook_url": "ftp://x"}}, {"brands": [" "]}):
        with pytest.raises(ConfigError):
            from_mapping(bad)
    with pytest.raises(ConfigError):
        Config(rules=Rules(min_alert_score=-1)).validated()


def test_suffix_rule(spark):
    make = lambda c: D.matches_suffix(c, "console.aws.amazon.com")
    assert apply(spark, ["console.aws.amazon.com", "support.console.aws.amazon.com", "evilconsole.aws.amazon.com"], make) == [True, True, False]


def test_dns_and_takeover(spark):
    assert apply(spark, ["response code: Non-Existent Domain", "x Server Failure", "Query Refused", "boom"], D.classify_dns_error) == ["nx_domain", "serv_fail", "refused", "transport_error"]
    answers = spark.createDataFrame([("a.com", False, "nx_domain", [], ["Old-Project.herokuapp.com."], []), ("b.com", False, "no_data", [], ["user.github.io", "user.github.io"], []), ("c.com", True, "resolved", ["1.1.1.1"], ["x.github.io"], []), ("d.com", False, "timeout", [], ["x.github.io"], ["timed out"]), ("e.com", False, "nx_domain", [], ["notgithub.io"], [])], "domain string, resolved boolean, status string, ips array<string>, cname_chain array<string>, errors array<string>")
    got = {(r["domain"], r["provider"]) for r in dns.takeover_candidates(answers, dns.fingerprints(spark)).collect()}
    assert got == {("a.com", "Heroku"), ("b.com", "GitHub Pages")}
    found = spark.createDataFrame([(d, "x", "low", 30, ["r"], [("k", "v")]) for d in ("c.com", "d.com", "z.com")], "domain string, detector string, severity string, score int, reasons array<string>, evidence array<struct<kind: string, value: string>>")
    out = {r["domain"]: r for r in dns.apply_dns(found, answers).collect()}
    assert out["c.com"]["reasons"] == ["r", "DNS resolved to 1 IP address", "DNS CNAME chain contains 1 target"]
    assert [tuple(e) for e in out["d.com"]["evidence"]] == [("k", "v"), ("dns.resolved", "false"), ("dns.status", "timeout"), ("dns.cname", "x.github.io"), ("dns.error", "timed out")]
    assert out["z.com"]["reasons"] == ["r"]
    live = dns.resolve(answers.select("domain"), 2, lambda d: {"domain": d, "ips": ["::1"], "cname_chain": [], "error": None})
    assert live.where("resolved").count() == 5


def test_sinks():
    assert sinks.signature("s", "1", b"{}").startswith("sha256=") and len(sinks.signature("s", "1", b"{}")) == 71
    sent = []
    sinks.deliver_webhook("https://x", "{}", "secret", send=lambda url, body, headers: sent.append((url, body, sorted(headers))))
    sinks.deliver_chat("https://y", "hi", send=lambda url, body, headers: sent.append(body))
    assert sent == [("https://x", b"{}", ["Content-Type", "Idempotency-Key", "X-Certloom-Signature", "X-Certloom-Timestamp"]), b'{"text": "hi"}']


def test_dead_letters_and_outbox(spark):
    letters = spark.range(1034).select(F.lit("l").alias("log_url"), F.col("id").alias("index"))
    assert sorted(r["index"] for r in state.newest(letters).collect()) == list(range(10, 1034))
    box = spark.createDataFrame([], "id string, sink string, payload string, created_at_unix bigint, attempts int, last_error string")
    box = state.enqueue(box, spark.createDataFrame([("w", "a"), ("w", "a"), ("c", "a")], "sink string, payload string"), 5)
    again = state.enqueue(box, spark.createDataFrame([("w", "a")], "sink string, payload string"), 6)
    assert again.count() == 2
    ids = [r["id"] for r in again.orderBy("sink").collect()]
    bad = state.failed(again, spark.createDataFrame([(ids[0], "down")], "id string, error string"))
    assert sorted((r["attempts"], r["last_error"]) for r in bad.collect() if r["last_error"]) == [(1, "down")]
    assert state.delivered(bad, spark.createDataFrame([(ids[0],)], "id string")).count() == 1


def test_lookalikes_of_ones_own(spark):
    assert D.lookalikes_of('{"ø": "o", "а": "a"}') == {"ø": "o", "а": "a"}
    for bad in ("", "[]", '{"ab": "c"}', '{"a": "bc"}', '{"a": 1}', "{", '{"": "a"}'):
        assert D.lookalikes_of(bad) == D.FEW_LOOKALIKES
    rows = detectors.features(spark.createDataFrame([("xn--x-4ga.com",)], "domain string"), demo()).withColumn("unicode", F.lit("xø.com"))
    found = rows.select(F.explode(detectors.homoglyph(Config(brands=["x"], lookalikes='{"ø": "o"}'))).alias("f")).first()["f"]
    assert "domain contains lookalike character `ø` that may resemble `o`" in found["reasons"]


def test_idn_forms():
    cases = {"Straße.DE": "xn--strae-oqa.de", "bücher。example": "xn--bcher-kva.example", "ﬁnd.com": "find.com", "a\u00adb.com": "ab.com", "\u0301a.com": None, "xn--a.com": None, "xn--strae-oqa.de": "xn--strae-oqa.de", "ｅｘａｍｐｌｅ.com": "example.com", "a\u2028b.com": None}
    assert {k: idn.to_ascii(k) for k in cases} == cases


def test_skeletons_of_unicode_names(spark):
    table = idn.confusables(spark)
    shapes = {"pаypаl.com": "paypal.corn", "раураl": "paypal", "micrоsоft": "rnicrosoft", "gοοgle": "google", "paypa1": "paypal", "ｇithub": "github"}
    assert {k: idn.skeleton_of(k, table) for k in shapes} == shapes


SUFFIX_LIST = """// comment
com
uk
co.uk
github.io
*.ck
!www.ck
kawasaki.jp
*.kawasaki.jp
!city.kawasaki.jp
jp
公司.cn
cn
"""


def test_public_suffixes(spark, tmp_path, monkeypatch):
    """Tasks and the driver agree, on rules of all kinds: the longest ending counts, exceptions go before it."""
    (tmp_path / "list.dat").write_text(SUFFIX_LIST)
    known = suffixes.rules(str(tmp_path / "list.dat"))
    want = {
        "secure.example.co.uk": "example.co.uk", "co.uk": "co.uk", "a.b.com": "b.com", "com": "com", "x.y.ck": "x.y.ck", "a.x.y.ck": "x.y.ck", "ck": "ck", "y.ck": "y.ck", "a.www.ck": "www.ck", "www.ck": "www.ck",
        "me.github.io": "me.github.io", "deep.me.github.io": "me.github.io", "github.io": "github.io", "host.test": "host.test", "a.host.test": "host.test", "a.b.c.kawasaki.jp": "b.c.kawasaki.jp", "a.city.kawasaki.jp": "city.kawasaki.jp",
        "kawasaki.jp": "kawasaki.jp", "x.jp": "x.jp", "a.b.xn--55qx5d.cn": "b.xn--55qx5d.cn",
    }
    rows = spark.createDataFrame([(x,) for x in [*want, None]], "domain string")
    for most in (suffixes.MAX_BROADCAST, 0):
        monkeypatch.setattr(suffixes, "MAX_BROADCAST", most)
        found = suffixes.with_registrable(rows, known)
        assert {r["domain"]: r["registrable"] for r in found.collect() if r["domain"]} == want
        assert found.where("domain is null").first()["registrable"] is None
    assert {d: suffixes.registrable(d, known) for d in want} == want
    (tmp_path / "list.dat").write_text("com\nb.com\n")
    assert suffixes.rules(str(tmp_path / "list.dat")) == known
    suffixes.refresh(str(tmp_path / "list.dat"))
    assert suffixes.rules(str(tmp_path / "list.dat")) == {"com": 1, "b.com": 1}


def test_suffix_rules_reach_the_detectors(spark, tmp_path):
    """A private suffix of the configuration's list moves the registrable label, and with it what detectors see."""
    (tmp_path / "own.dat").write_text("com\nshop.example\n*.wild.example\n")
    plan = lambda path: [(r["detector"], r["reasons"]) for r in scan.findings(scan.manual_observations(spark, ["payapl.shop.example"]), dataclasses.replace(demo(), public_suffixes=path)).collect()]
    assert [d for d, _ in plan(str(tmp_path / "own.dat"))] == ["typosquat"]
    assert plan(None) == []
    assert len(suffixes.rules()) > 5000  # a whole list comes with Spark
    joined = suffixes.with_registrable(spark.createDataFrame([("a.b.com",)], "domain string"), suffixes.rules())
    text = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_names_of_other_scripts_in_a_scan(spark):
    """Given by a user, or in certificates, raw or in punycode: decoded, and found by their skeleton."""
    given = ["pаypal.com", "XN--PYPAL-4VE.net", "plain.example"]
    alerts = {r["domain"]: r for r in scan.scan_domains(spark, given, demo()).collect()}
    assert set(alerts) == {"xn--pypal-4ve.com", "xn--pypal-4ve.net"}
    for domain, alert in alerts.items():
        (found,) = [f for f in alert["findings"] if f["detector"] == "homoglyph"]
        assert (found["score"], found["severity"]) == (85, "high") and ("idn.decoded", domain.replace("xn--pypal-4ve", "pаypal")) in [tuple(e) for e in found["evidence"]]
    for bad in ("xn--paypa1-4ve.com", "xn--a.com", "a�.com"):
        with pytest.raises(ValueError, match="internationalised"):
            scan.manual_observations(spark, ["ok.com", bad])
    names = ["pаypal.com", "*.xn--bcher-kva.example", "xn--paypa1-4ve.com", "bad_name.example", "Plain.example", "bücher.example"]
    raw = spark.createDataFrame([(1, names), (2, ["only.example"]), (3, None)], "index bigint, san_dns_names array<string>")
    null = F.lit(None).cast("string")
    raw = raw.withColumns(dict.fromkeys(("source_log", "observed_at", "source_type", "certificate_sha256", "serial_number", "issuer", "not_before", "not_after"), null))
    rows = {r["index"]: r for r in decode.certificate_events(raw).collect()}
    assert [(d["normalized"], d["is_wildcard"], d["is_idn"]) for d in rows[1]["domains"]] == [("xn--pypal-4ve.com", False, True), ("xn--bcher-kva.example", True, True), ("plain.example", False, False)]
    assert {r["value"]: r["error"] for r in rows[1]["rejected_domains"]} == {"xn--paypa1-4ve.com": "no valid internationalised name", "bad_name.example": "invalid characters in label"}
    assert [d["normalized"] for d in rows[2]["domains"]] == ["only.example"]


def test_certificates_with_names_of_other_scripts(spark):
    """Through tiles: what Python reads anyway also gives the ASCII forms."""
    tile = b"".join(fixtures.entry(1_700_000_000_000 + i, fixtures.certificate(names, i + 1)) for i, names in enumerate([["xn--pypal-4ve.com"], ["plain.example"], ["xn--paypa1-4ve.com"]]))
    tiles = spark.createDataFrame([(0, 3, bytearray(tile))], "index bigint, width int, bytes binary")
    alerts, errors = scan.scan_tiles(tiles, "log", demo())
    assert [(r["domain"], "homoglyph" in r["detectors"]) for r in alerts.collect()] == [("xn--pypal-4ve.com", True)] and errors.count() == 0


def test_plain_names_stay_in_the_jvm(spark):
    """The branch of plain names has no Python in it: Arrow stands behind the filter for other scripts only."""
    names = scan.with_metadata(spark.range(5).select(F.concat(F.lit("paypa1-"), F.col("id").cast("string"), F.lit(".com")).alias("domain")), "log", "ct")
    found = detection.detect(names, demo())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.index("RepartitionByExpression") < plan.index("ArrowEvalPython")
    assert found.where("detector = 'typosquat'").count() == 5
    found.collect()
    assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()  # names are gathered once for both branches

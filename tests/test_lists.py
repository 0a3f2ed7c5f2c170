import json
import random

import pytest
from pyspark.sql import functions as F

from certloom import config
from certloom.config import Config
from certloom.operators import detection, list_detectors
from certloom.plans import scan


@pytest.fixture(scope="module")
def names(spark):
    rng = random.Random(3)
    words = ["paypal", "paypa1", "login", "secure", "bank-of", "my", "x", "micros0ft", "rnicrosoft", "microsofd", "github", "gthub", "githubb", "account", "zz9", "shop", "payapl", "wallet", "ab"]
    out = {".".join(["-".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 4))] + [rng.choice(["com", "top", "co.uk", "net"])]) for _ in range(300)}
    out |= {"login.com", "paypal.com", "a.paypal.com", "0rg-paypal.xyz", "my-loginpage.com", "paypal-login-paypal-login.com", "ab.com", "a1b.net"}
    rows = [(d, i) for i, d in enumerate(sorted(out))] + [("paypa1-login.com", 9000), ("paypa1-login.com", 9001)]
    return scan.with_metadata(spark.createDataFrame(rows, "domain string, certificate_index bigint").withColumn("observed_at", F.lit("2026-01-01T00:00:00Z")), "log", "ct").persist()


def rows(df):
    found = df.orderBy("certificate_index", "position").select("certificate_index", "domain", "detector", "severity", "score", "reasons", "evidence").collect()
    return sorted(((r[0], r[2], r) for r in found), key=lambda x: (x[0], x[1], repr(x[2])))


CONFIGS = [
    Config(brands=["paypal", "GitHub", "microsoft", "paypal", "my"], official_domains=["paypal.com", "bank-of-x.co.uk", "ab.com", "github.com"]),
    Config(brands=[], official_domains=["microsoft.com"], keywords=[]),
    Config(brands=["zz9"], official_domains=[], keywords=["login", "log", "secure", "my"]),
]


@pytest.mark.parametrize("cfg", CONFIGS)
@pytest.mark.parametrize("few", [0, list_detectors.FEW])
def test_lists_as_tables_find_the_same(spark, names, monkeypatch, cfg, few):
    monkeypatch.setattr(list_detectors, "FEW", few)  # 0: no list is broadcast
    cfg = cfg.validated()
    monkeypatch.setattr(detection, "LITERALS", 0)
    got = rows(detection.detect(names, cfg))
    monkeypatch.setattr(detection, "LITERALS", 200)
    want = rows(detection.detect(names, cfg))
    assert len(want) > 50 and [x[2] for x in got] == [x[2] for x in want]


def test_plans_do_not_grow_with_the_lists(spark, names):
    size = {}
    for n in (300, 10_000):
        cfg = Config(brands=[f"brand{i}" for i in range(n)] + ["paypal"], official_domains=[f"official{i}.com" for i in range(n)], keywords=[f"key{i}" for i in range(n)] + ["login"])
        found = detection.joined(names, list_detectors.findings(detection.names_of(names, cfg), list_detectors.Lists.of(spark, cfg)))
        size[n] = len(found._jdf.queryExecution().optimizedPlan().toString())
    assert size[10_000] < 1.2 * size[300]
    assert found.where("detector = 'brand'").count() > 20


def test_deletions(spark):
    got = spark.range(1).select(list_detectors.deletions(F.lit("abcd"), 2).alias("x"), list_detectors.deletions(F.lit("a"), 1).alias("y")).first()
    assert sorted(got["x"]) == sorted({"abcd", "bcd", "acd", "abd", "abc", "cd", "bd", "bc", "ad", "ac", "ab"}) and sorted(got["y"]) == ["", "a"]


def test_long_lists_of_a_configuration_are_tables(spark):
    """Literals or joins by the lengths of the lists, reached from the configuration, with the same alerts."""
    text = {"brands": ["paypal"], "official_domains": ["paypal.com"], "allowlist": ["fine.com"], "rules": {"allowlist_suffixes": ["ok.example"]}}
    long = {"brands": ["paypal"] + [f"brand{i}x" for i in range(500)], "official_domains": ["paypal.com"] + [f"official{i}.com" for i in range(500)], "allowlist": ["fine.com"] + [f"a{i}.com" for i in range(500)], "rules": {"allowlist_suffixes": ["ok.example"] + [f"s{i}.example" for i in range(500)]}}
    given = ["paypa1-login.com", "my-paypal.xyz", "fine.com", "x.ok.example", "paypal.com", "xn--pypal-4ve.com", "a7.com"]
    shown = {}
    for name, values in (("short", text), ("long", long)):
        cfg = config.from_yaml(json.dumps(values))
        assert detection.by_tables(cfg) == (name == "long")
        alerts = scan.scan_domains(spark, given, cfg)
        shown[name] = [(r["domain"], r["score"], r["detectors"], r["reasons"], sorted((e["kind"], e["value"] or "") for e in r["evidence"] if e["kind"] != "ct.observed_at")) for r in alerts.collect()]
    assert [x for x in shown["long"] if x[0] != "a7.com"] == shown["short"]
    assert [x[0] for x in shown["short"]] == ["my-paypal.xyz", "paypa1-login.com", "xn--pypal-4ve.com"]


def test_words_inside_labels(spark, monkeypatch):
    """The automaton and the substrings find the same; a list a hundred times as long gives no more rows and no larger plan."""
    labels = ["paypal-login", "xpaypalx", "my", "paypaypal", "", "aaaa", "pay-pal", "a-mypaypal-mypaypal"]
    names = spark.createDataFrame([(f"{x}.com", x) for x in labels], "domain string, reg_label string")
    plans, want = {}, sorted((f"{x}.com", x, w) for x in labels for w in ("paypal", "pay", "mypaypal", "aaa") if w in x)
    for n in (10, 20_000):
        words = spark.createDataFrame([(w,) for w in ["paypal", "pay", "mypaypal", "aaa", *(f"zz{i}q" for i in range(n))]], "word string").persist()
        for most in (8 << 20, 0):
            monkeypatch.setattr(list_detectors, "MAX_WORD_BYTES", most)
            found = list_detectors.contained(names, words, 3, 8)
            assert sorted(map(tuple, found.select("domain", "reg_label", "word").collect())) == want
            plans.setdefault(most, []).append(len(found._jdf.queryExecution().optimizedPlan().toString()))
    assert all(b < 1.2 * a for a, b in plans.values())

import json

import pytest

from certloom import cli
from certloom.config import demo
from certloom.sources import static_log

from .test_watch import grown  # noqa: F401  a fixture


@pytest.fixture
def config(tmp_path):
    def write(**more):
        cfg = demo()
        path = tmp_path / "config.json"
        path.write_text(json.dumps({"brands": cfg.brands, "official_domains": cfg.official_domains, "allowlist": cfg.allowlist} | more))
        return str(path)

    return write


def run(spark, *argv):
    said = []
    return cli.main(list(argv), spark, said.append), "\n".join(said)


def test_scan_domain(spark, config):
    code, said = run(spark, "scan-domain", "paypa1-login.com", "github.com", "--config", config(), "--format", "json", "--grouped")
    body = json.loads(said)
    assert code == 0 and [a["domain"] for a in body["alerts"]] == ["paypa1-login.com"] and body["summary"] == {"domains": 2, "findings": 4, "alerts": 1, "message": "1 grouped alert produced"}
    code, said = run(spark, "scan-domain", "paypa1-login.com", "--config", config(), "--format", "json")
    found = json.loads(said)["findings"]
    assert {f["detector"] for f in found} == {"keyword", "typosquat", "homoglyph", "composition"}
    code, said = run(spark, "scan-domain", "paypa1-login.com", "--config", config(), "--min-score", "84", "--summary")
    assert code == 0 and "findings: 2" in said and "HIGH" in said
    assert "No matching findings" in run(spark, "scan-domain", "a.paypa1.net", "--config", config(), "--allowlist-suffix", "paypa1.net")[1]
    assert run(spark, "scan-domain", "not a domain")[0] == 2


def test_findings_go_to_the_webhook(spark, config, monkeypatch):
    sent = []
    monkeypatch.setattr("certloom.operators.sinks.deliver_webhook", lambda url, payload, secret: sent.append((url, json.loads(payload))))
    assert run(spark, "scan-domain", "paypa1-login.com", "--config", config(), "--webhook-url", "https://hook.example/x")[0] == 0
    assert [(u, p["kind"], p["count"]) for u, p in sent] == [("https://hook.example/x", "findings", 4)]


def test_logs(spark, config, grown, monkeypatch, tmp_path):  # noqa: F811
    log, key, grow = grown
    grow(300)
    monkeypatch.setattr(cli, "Log", lambda url: static_log.Log(url, log.get))
    import base64

    path = config(ct={"trusted_logs": [{"origin": "log", "base_url": "https://log.example", "public_key": base64.b64encode(key.spki).decode()}]})
    assert run(spark, "validate-config", "--config", path) == (0, "config is valid")
    code, said = run(spark, "fetch-checkpoint", "https://log.example", "-f", "json")
    assert code == 0 and json.loads(said)["checkpoint"]["size"] == 300
    tile = lambda *a: run(spark, "fetch-tile", "https://log.example", "-f", "json", *a)
    assert json.loads(tile("--latest-size", "300")[1])["tile"] | {"bytes": 0} == {"kind": "data", "level": None, "index": 1, "width": 44, "bytes": 0}
    assert json.loads(tile("--kind", "tree", "--level", "1", "--latest-size", "300")[1])["tile"]["bytes"] == 32
    assert [tile(*a)[0] for a in ((), ("--level", "1", "--index", "0"), ("--kind", "tree", "--index", "0"), ("--latest-size", "300", "--index", "1"), ("--kind", "tree", "--level", "2", "--latest-size", "300"))] == [2] * 5
    body = json.loads(run(spark, "fetch-events", "https://log.example", "--latest-size", "300", "--limit", "3", "-f", "json")[1])
    assert [e["index"] for e in body["events"]] == [256, 257, 259] and [e["index"] for e in body["errors"]] == [258, 265, 272]
    body = json.loads(run(spark, "scan-ct", "https://log.example", "--config", path, "--grouped", "-f", "json")[1])
    assert (body["summary"]["tile"], body["summary"]["entries"], body["summary"]["parse_errors"]) == (1, 44, 6) and len(body["alerts"]) == body["summary"]["alerts"] > 30
    assert run(spark, "scan-ct", "https://other.example", "--config", path)[0] == 2
    state = str(tmp_path / "state")
    watch = lambda *a: json.loads(run(spark, "watch-ct", "https://log.example", "--config", path, "--state", state, "--once", "--grouped", "-f", "json", *a)[1])
    assert watch("--seed-index", "0")["last_entry"] == 255 and watch()["last_entry"] == 299 and watch()["message"] == "no new entries"
    assert watch("--reset-state")["first_tile"] == 1
    grow(290)
    assert run(spark, "watch-ct", "https://log.example", "--config", path, "--state", state, "--once")[0] == 2


def test_watch_of_fixed_events(spark, config):
    code, said = run(spark, "watch", "--mock", "--once", "--grouped", "--config", config(), "-f", "json")
    assert code == 0 and len(json.loads(said)["alerts"]) >= 2
    assert run(spark, "watch", "--once")[0] == 2


def test_refreshing_fingerprints(spark, tmp_path):
    (tmp_path / "up.json").write_text(json.dumps([{"service": "New", "cname": ["*.new.example"], "vulnerable": True}, {"service": "heroku", "cname": ["more.herokuapp.example"], "vulnerable": True}, {"service": "Safe", "cname": ["safe.example"], "vulnerable": False}]))
    assert run(spark, "refresh-fingerprints", str(tmp_path / "up.json"), str(tmp_path / "out.json"))[0] == 0
    got = {x["provider"]: x["suffixes"] for x in json.loads((tmp_path / "out.json").read_text())}
    assert got["New"] == ["new.example"] and "more.herokuapp.example" in got["Heroku"] and "Safe" not in got and len(got) > 30

"""Command line: python -m certloom.cli COMMAND ..."""

from __future__ import annotations

import argparse
import dataclasses
import json
import os
import sys
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config, ConfigError, from_yaml
from .functions import tiles
from .functions.checkpoints import Checkpoint, CheckpointError, Key
from .operators import decode, sinks
from .plans import scan
from .sources import mock
from .sources.static_log import Log, LogError

#: Environment variables that stand for flags.
CONFIG_VARIABLE, WEBHOOK_VARIABLE = "CERTLOOM_CONFIG", "CERTLOOM_WEBHOOK_URL"
UNVERIFIED = "unverified_diagnostic"


class UsageError(ValueError):
    pass


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="certloom")
    sub = p.add_subparsers(dest="command", required=True)
    shown = argparse.ArgumentParser(add_help=False)
    shown.add_argument("-f", "--format", choices=("human", "json"), default="human")
    rules = argparse.ArgumentParser(add_help=False)
    rules.add_argument("-c", "--config", default=os.environ.get(CONFIG_VARIABLE))
    rules.add_argument("--grouped", action="store_true", help="alerts by domain in place of findings")
    rules.add_argument("--summary", action="store_true")
    rules.add_argument("--dns", action="store_true")
    rules.add_argument("--takeover", action="store_true")
    rules.add_argument("--webhook-url", default=os.environ.get(WEBHOOK_VARIABLE))
    rules.add_argument("--min-score", type=int)
    rules.add_argument("--allowlist-suffix", action="append", default=[])
    place = argparse.ArgumentParser(add_help=False)
    place.add_argument("url")
    place.add_argument("--index", type=int)
    place.add_argument("--latest-size", type=int, help="the last tile of a tree of so many entries")
    place.add_argument("--width", type=int)

    sub.add_parser("scan-domain", parents=[shown, rules]).add_argument("domains", nargs="+")
    sub.add_parser("validate-config").add_argument("-c", "--config", default=os.environ.get(CONFIG_VARIABLE), required=CONFIG_VARIABLE not in os.environ)
    sub.add_parser("fetch-checkpoint", parents=[shown]).add_argument("url")
    q = sub.add_parser("fetch-tile", parents=[shown, place])
    q.add_argument("--kind", choices=("data", "tree"), default="data")
    q.add_argument("--level", type=int)
    sub.add_parser("fetch-events", parents=[shown, place]).add_argument("--limit", type=int, default=10)
    sub.add_parser("scan-ct", parents=[shown, rules, place]).add_argument("--latest", action="store_true")
    for name, interval in (("watch-ct", 30_000), ("watch", 1000)):
        q = sub.add_parser(name, parents=[shown, rules])
        q.add_argument("--once", action="store_true")
        q.add_argument("--interval-ms", type=int, default=interval)
        if name == "watch":
            q.add_argument("--mock", action="store_true", help="fixed events; the only source of this command")
        else:
            q.add_argument("url")
            q.add_argument("--state", default=".certloom/state")
            q.add_argument("--max-tiles", type=int, default=1)
            q.add_argument("--seed-index", type=int, help="first tile where there is no state")
            q.add_argument("--reset-state", action="store_true")
    q = sub.add_parser("refresh-fingerprints", help="merge a list of takeover fingerprints (JSON) into the built-in one")
    q.add_argument("upstream")
    q.add_argument("out")
    return p


def configured(args: argparse.Namespace) -> Config:
    """The configuration file, with the flags over it."""
    cfg = from_yaml(Path(args.config).read_text()) if args.config else Config().validated()
    cfg = cfg.overridden(args.min_score, args.allowlist_suffix)
    dns = dataclasses.replace(cfg.dns, enabled=cfg.dns.enabled or args.dns, takeover=cfg.dns.takeover or args.takeover)
    outputs = dataclasses.replace(cfg.outputs, webhook_url=args.webhook_url or cfg.outputs.webhook_url)
    return dataclasses.replace(cfg, dns=dns, outputs=outputs).validated()


def tile_of(args: argparse.Namespace, size: int | None = None) -> tuple[int | None, int, int | None]:
    """(level, index, width) of the tile that the flags name; level None: entries. size: of a verified tree, whose last tile is the default."""
    level = getattr(args, "level", None)
    tree = getattr(args, "kind", "data") == "tree"
    if tree != (level is not None):
        raise UsageError("--level goes with --kind tree, which needs it")
    last = args.latest_size
    if last is not None and (args.index is not None or args.width is not None):
        raise UsageError("--latest-size goes without --index and --width")
    if last is not None and size is not None and last != size:
        raise UsageError(f"the checkpoint has {size} entries, not {last}")
    if last is None and args.index is None:
        if size is None:
            raise UsageError("--index or --latest-size is needed")
        last = size
    if last is None:
        return level, args.index, args.width
    n = last >> (8 * (level or 0))
    if n <= 0:
        raise UsageError(f"no such tile in a tree of {last} entries")
    return level, (n - 1) // tiles.TILE, n % tiles.TILE or None


def trusted(cfg: Config, url: str) -> tuple[Log, Key]:
    found = cfg.trusted_log(url)
    if found is None:
        raise ConfigError("the log is not among ct.trusted_logs")
    return Log(found.base_url), Key.of(found.origin, found.public_key, found.log_id)


def message(n: int, grouped: bool) -> str:
    what = "grouped alert" if grouped else "finding"
    if not n:
        return f"No matching {'alerts' if grouped else 'findings'} for current rules"
    return f"{n} {what}{'' if n == 1 else 's'} produced"


def report(found: DataFrame, cfg: Config, args: argparse.Namespace, out: Callable[[str], None], about: dict, deliver: bool = True) -> None:
    """Findings, or the alerts that they make, to the sinks of the configuration and to out."""
    rows = scan.scoring.ranked(scan.alerts(found, cfg)) if args.grouped else found.orderBy(F.desc("score"), "domain", "detector").select(*sinks.FINDING_FIELDS)
    kind = "alerts" if args.grouped else "findings"
    rows = rows.persist()
    if deliver:
        from .streaming.watch import webhook

        send = webhook(cfg)
        for row in sinks.payload(rows, kind).toLocalIterator():
            for sink in ("webhook", "chat"):
                send(sink, row["payload"])
    n = rows.count()
    n_findings = rows.agg(F.sum(F.size("findings"))).first()[0] or 0 if args.grouped else n
    summary = about | {"findings": n_findings, "alerts": n if args.grouped else 0, "message": message(n, args.grouped)}
    if args.format == "json":
        out(json.dumps({"summary": summary, kind: [r.asDict(recursive=True) for r in rows.toLocalIterator()]}, ensure_ascii=False, indent=2))
    else:
        if args.summary:
            for k, v in summary.items():
                out(f"{k}: {v}")
        for r in rows.toLocalIterator():
            out(f"{r['severity'].upper():8} {r['score']:3} {r['domain']}  [{', '.join(r['detectors']) if args.grouped else r['detector']}]")
            for reason in r["reasons"]:
                out(f"    - {reason}")
        if not n and not args.summary:
            out(summary["message"])
    rows.unpersist()


def _found(observed: DataFrame, cfg: Config) -> DataFrame:
    return scan.enriched(scan.findings(observed, cfg), observed, cfg)


def show(args: argparse.Namespace, body: dict, out: Callable[[str], None]) -> None:
    if args.format == "json":
        out(json.dumps(body, ensure_ascii=False, indent=2, default=str))
    else:
        for k, v in body.items():
            out(f"{k}: {json.dumps(v, ensure_ascii=False, default=str) if isinstance(v, (dict, list)) else v}")


def fetch_checkpoint(args: argparse.Namespace, out: Callable[[str], None]) -> None:
    found = Checkpoint.of(Log(args.url).checkpoint())
    show(args, {"verification": UNVERIFIED, "checkpoint": dataclasses.asdict(found)}, out)


def fetch_tile(args: argparse.Namespace, out: Callable[[str], None]) -> None:
    level, index, width = tile_of(args)
    data, real = Log(args.url).tile(level, index, width)
    show(args, {"verification": UNVERIFIED, "tile": {"kind": "data" if level is None else "tree", "level": level, "index": index, "width": real, "bytes": len(data)}}, out)


def fetch_events(spark: SparkSession, args: argparse.Namespace, out: Callable[[str], None]) -> None:
    _, index, width = tile_of(args)
    data, real = Log(args.url).tile(None, index, width)
    tile = spark.createDataFrame([(index, real, bytearray(data))], "index bigint, width int, bytes binary")
    events, errors = decode.events_and_errors(decode.decode_tiles(tile), args.url)
    first = {k: [r.asDict(recursive=True) for r in scan.first_entries(df, args.limit).collect()] for k, df in (("events", events), ("errors", errors))}
    show(args, {"verification": UNVERIFIED, "tile": index, "width": real} | first, out)


def scan_ct(spark: SparkSession, args: argparse.Namespace, out: Callable[[str], None]) -> None:
    cfg = configured(args)
    log, key = trusted(cfg, args.url)
    size = log.verified(key).size
    if args.latest and args.index is not None:
        raise UsageError("--latest goes without --index")
    _, index, width = tile_of(args, size)
    entries = log.entries(size, index)
    if width is not None and width != len(entries):
        raise UsageError(f"the tile has {len(entries)} entries")
    from . import schemas

    rows = spark.createDataFrame([tuple(r.values()) for r in entries], schemas.ENTRIES)
    events, errors = decode.events_and_errors(rows, log.base_url)
    about = {"tile": index, "entries": len(entries), "events": events.count(), "parse_errors": errors.count()}
    report(_found(decode.observations(events), cfg), cfg, args, out, about)


def watch_ct(spark: SparkSession, args: argparse.Namespace, out: Callable[[str], None]) -> None:
    from .streaming.watch import Store, Watch, webhook

    if args.interval_ms <= 0 or args.max_tiles <= 0:
        raise UsageError("--interval-ms and --max-tiles must be over 0")
    cfg = configured(args)
    log, key = trusted(cfg, args.url)
    names = tuple(n for n, url in (("webhook", cfg.outputs.webhook_url), ("chat", cfg.outputs.slack_webhook_url)) if url)
    watch = Watch(spark, cfg, Store(spark, args.state), log.base_url, webhook(cfg), args.grouped, names)
    if args.reset_state:
        watch.store.reset()
    watch.run(log, key, args.max_tiles, args.seed_index, args.once, args.interval_ms / 1000, lambda x: show(args, x, out) if args.once or args.summary or x["new_findings"] else None)


def watch_mock(spark: SparkSession, args: argparse.Namespace, out: Callable[[str], None], sleep: Callable[[float], None] = time.sleep) -> None:
    if not args.mock:
        raise UsageError("only --mock has events for this command; watch-ct watches logs")
    if args.interval_ms <= 0:
        raise UsageError("--interval-ms must be over 0")
    cfg = configured(args)
    report(_found(decode.observations(mock.demo_events(spark)), cfg), cfg, args, out, {})
    while not args.once:  # the fixed events come once
        sleep(args.interval_ms / 1000)


def refresh_fingerprints(spark: SparkSession, args: argparse.Namespace, out: Callable[[str], None]) -> None:
    """Providers of a list [{service, cname: [...], vulnerable, documentation}] that are vulnerable and have CNAMEs, merged into the built-in ones."""
    from .operators import dns

    raw = spark.read.schema("service string, cname array<string>, vulnerable boolean, documentation string").option("multiLine", True).json(args.upstream)
    found = raw.where("vulnerable").select(F.col("service").alias("provider"), F.explode("cname").alias("suffix"), F.col("documentation").alias("reference"))
    merged = dns.merge_fingerprints(found, dns.fingerprints(spark)).orderBy(F.lower("provider")).collect()
    Path(args.out).write_text(json.dumps([r.asDict() for r in merged], ensure_ascii=False, indent=2) + "\n")
    out(f"{len(merged)} providers")


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out: Callable[[str], None] = print) -> int:
    args = parser().parse_args(argv)
    try:
        _run(args, spark, out)
        return 0
    except (ConfigError, CheckpointError, LogError, UsageError, ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


def _run(args: argparse.Namespace, spark: SparkSession | None, out: Callable[[str], None]) -> None:
    if args.command == "validate-config":
        from_yaml(Path(args.config).read_text())
        out("config is valid")
    elif args.command == "fetch-checkpoint":
        fetch_checkpoint(args, out)
    elif args.command == "fetch-tile":
        fetch_tile(args, out)
    else:
        spark = spark or SparkSession.builder.appName("certloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        if args.command == "scan-domain":
            cfg = configured(args)
            report(_found(scan.manual_observations(spark, args.domains), cfg), cfg, args, out, {"domains": len(args.domains)})
        else:
            {"fetch-events": fetch_events, "scan-ct": scan_ct, "watch-ct": watch_ct, "watch": watch_mock, "refresh-fingerprints": refresh_fingerprints}[args.command](spark, args, out)


if __name__ == "__main__":
    sys.exit(main())

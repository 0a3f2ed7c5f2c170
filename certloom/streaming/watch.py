"""Watching a log: each step is scanned, what was alerted before is dropped, the rest is put into an outbox and delivered.

State is three tables (records of alerts, dead letters, outbox) and the position in the log, under one folder. A step
writes new files and then a manifest that names them; until that is there, the state is the one before. A result is
therefore delivered at least once, and a repeat carries the same id.

Records of alerts are kept by key: in buckets, named by the first digits of their keys (which are hashes), as what each
step changed. A step reads the buckets that its own keys fall in and no others. A bucket of MAX_PARTS parts is gathered
when a step reads it, without what has expired, and goes on by one more digit if it has grown over BUCKET_RECORDS; so
what a step reads depends on its own findings, not on the records of 90 days.
"""

from __future__ import annotations

import json
import time
import uuid
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..config import Config
from ..functions import domains as D
from ..functions.checkpoints import Key
from ..functions.merkle import Frontier
from ..operators import decode, sinks, state
from ..plans import scan
from ..sources.static_log import TILE, Log

TABLES = {"records": schemas.ALERT_RECORDS, "dead_letters": schemas.DEAD_LETTERS, "outbox": schemas.OUTBOX}
#: Parts of a bucket of records after which they are written as one.
MAX_PARTS = 24
#: Records of a bucket after which it is split, on average of the buckets that are gathered.
BUCKET_RECORDS = 50_000
#: Digits of keys that name buckets: 16^digits buckets.
FIRST_DIGITS, MAX_DIGITS = 1, 6
#: Buckets that a step names one by one; one that needs more reads all.
MAX_NAMED = 4096


@dataclass
class Store:
    """Versions of the state of one log on shared storage. A version has revisions: what was delivered of it."""

    spark: SparkSession
    folder: str
    log_url: str = ""

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self) -> list[tuple[int, int]]:
        fs, path = self._fs()
        if not fs.exists(path(self.folder)):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(path(self.folder))]
        return sorted(tuple(map(int, n[2:-5].split("-"))) for n in names if n.startswith("m-") and n.endswith(".json"))

    def _read(self, version: int, revision: int) -> dict:
        fs, path = self._fs()
        stream = fs.open(path(f"{self.folder}/m-{version:012d}-{revision:06d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def manifest(self, before: int | None = None) -> dict | None:
        """The latest manifest of this log, of a version before the given one."""
        for version, revision in reversed(self._names()):
            if before is None or version < before:
                found = self._read(version, revision)
                if found["log_url"] == self.log_url:
                    return found if not found.get("reset") else None
        return None

    def versions(self) -> list[int]:
        return sorted({v for v, _ in self._names()})

    def load(self, name: str, before: int | None = None, paths: list[str] | None = None) -> DataFrame:
        """A table of the version; paths: some of its files only."""
        if paths is None:
            found = self.manifest(before)
            paths = found["tables"].get(name) if found else None
        if not paths:
            return self.spark.createDataFrame([], TABLES[name])
        rows = self.spark.read.schema(TABLES[name]).parquet(*paths)
        return state.newest_records(rows) if name == "records" and len(paths) > 1 else rows

    def digits(self, before: int | None = None) -> int:
        """How many digits of a key name the buckets that are written now."""
        found = self.manifest(before)
        return found.get("digits", FIRST_DIGITS) if found else FIRST_DIGITS

    def buckets(self, keys: DataFrame, before: int | None = None) -> list[str]:
        """The files of records of the buckets that keys (column key) fall in."""
        found = self.manifest(before)
        paths = found["tables"].get("records", []) if found else []
        if not paths:
            return []
        wanted = [r[0] for r in keys.select(F.substring("key", 1, self.digits(before)).alias("name")).distinct().limit(MAX_NAMED + 1).collect()]
        if len(wanted) > MAX_NAMED:
            return paths
        return [p for p in paths if any(w.startswith(n) or n.startswith(w) for n in [bucket_of(p)] for w in wanted)]

    def position(self, before: int | None = None) -> dict:
        """last_entry, checkpoint_size, checkpoint_root and frontier (hashes, see functions.merkle.Frontier) of the version."""
        found = self.manifest(before)
        return found["position"] if found else {"last_entry": None, "checkpoint_size": 0, "checkpoint_root": None, "frontier": []}

    def _written(self, name: str, df: DataFrame) -> str:
        at = f"{self.folder}/d-{uuid.uuid4().hex}/{name}"
        df.select(*[f.split()[0] for f in TABLES[name].split(", ")]).write.parquet(at)
        return at

    def _bucketed(self, records: DataFrame, digits: int) -> list[str]:
        """Files of records, one for each bucket."""
        at = f"{self.folder}/d-{uuid.uuid4().hex}/records"
        rows = records.select(*[f.split()[0] for f in TABLES["records"].split(", ")]).withColumn("bucket", F.substring("key", 1, digits))
        rows.repartition("bucket").write.partitionBy("bucket").parquet(at)
        fs, path = self._fs()
        return sorted(str(x.getPath().toString()) for x in fs.listStatus(path(at)) if x.getPath().getName().startswith("bucket="))

    def save(self, version: int, tables: dict[str, DataFrame], position: dict | None = None, records: DataFrame | None = None, instead_of: list[str] = (), split: bool = False, keep: int = 3, revision: bool = False) -> None:
        """New files of tables and of records, then the manifest; what is not named stays as it is in the manifest before.

        records: what is added to the buckets, or put in the place of these files (instead_of); split: buckets get names
        of one more digit from now on. revision: another state of this version, not of the one before it. Older versions than the last `keep` go.
        """
        old = self.manifest(version + 1 if revision else version)
        made = dict(old["tables"]) if old else {}
        for name, df in tables.items():
            made[name] = [self._written(name, df)]
        digits = min(self.digits(version + 1 if revision else version) + split, MAX_DIGITS)
        if records is not None:
            made["records"] = [*(p for p in made.get("records", []) if p not in set(instead_of)), *self._bucketed(records, digits)]
        self._publish(version, {"tables": made, "digits": digits, "position": position or (old["position"] if old else self.position(0))})
        self._clean(keep)

    def _publish(self, version: int, body: dict) -> None:
        fs, path = self._fs()
        revision = max((r for v, r in self._names() if v == version), default=-1) + 1
        at = f"{self.folder}/m-{version:012d}-{revision:06d}.json"
        out = fs.create(path(f"{at}.tmp"), True)
        out.write(bytearray(json.dumps({"version": version, "revision": revision, "log_url": self.log_url} | body).encode()))
        out.close()
        if not fs.rename(path(f"{at}.tmp"), path(at)):
            raise OSError(f"could not publish {at}")

    def _clean(self, keep: int) -> None:
        fs, path = self._fs()
        kept = set(self.versions()[-keep:])
        names = self._names()
        newest = {v: max(r for w, r in names if w == v) for v in kept}
        used = {p for v, r in newest.items() for ps in self._read(v, r).get("tables", {}).values() for p in ps}
        for v, r in names:
            if newest.get(v) != r:
                fs.delete(path(f"{self.folder}/m-{v:012d}-{r:06d}.json"), True)
        folders = {name for p in used for name in p.split("/") if name.startswith("d-")}
        for x in fs.listStatus(path(self.folder)):
            if x.getPath().getName().startswith("d-") and x.getPath().getName() not in folders:
                fs.delete(x.getPath(), True)

    def reset(self) -> None:
        """From now on this log has no state."""
        self._publish(max(self.versions(), default=-1) + 1, {"tables": {}, "position": None, "reset": True})


def bucket_of(path: str) -> str:
    """The digits that all keys of a file of records begin with."""
    return path.rpartition("bucket=")[2]


Deliver = Callable[[str, str], None]


@dataclass
class Watch:
    """One step after another of schemas.EVENTS and parse errors."""

    spark: SparkSession
    cfg: Config
    store: Store
    log_url: str
    deliver: Deliver
    grouped: bool = True
    sinks: tuple[str, ...] = ("webhook",)
    clock: Callable[[], int] = field(default=lambda: int(time.time()))
    answers: DataFrame | None = None

    def __post_init__(self):
        self.store.log_url = self.log_url

    def step(self, events: DataFrame, errors: DataFrame | None, batch: int, position: dict | None = None) -> dict:
        """Scan a batch, save, deliver. An undelivered event stays in the outbox, and its error is raised after it is saved."""
        now = self.clock()
        self.flush(batch - 1)
        observed = decode.observations(events)
        found = state.identity(scan.enriched(scan.findings(observed, self.cfg), observed, self.cfg, self.answers)).persist()
        held = self.store.buckets(found, batch)
        records = state.prune(self.store.load("records", batch, held), now)
        fresh = state.unseen(found, records, now).persist()
        alerts = state.new_alerts(scan.alerts(found.drop("key"), self.cfg), fresh, self.cfg.rules.min_alert_score).persist() if self.grouped else None
        body = sinks.payload(alerts, "alerts") if self.grouped else sinks.payload(fresh, "findings")
        outgoing = body.select(F.explode(F.array(*map(F.lit, self.sinks))).alias("sink"), "payload").persist()
        letters = self.store.load("dead_letters", batch)
        if errors is not None:
            letters = letters.unionByName(errors.select(F.lit(self.log_url).alias("log_url"), "index", "error", F.lit(now).cast("bigint").alias("recorded_at_unix"))).dropDuplicates(["log_url", "index"])
        report = {"batch": batch, "findings": found.count(), "new_findings": fresh.count(), "alerts": alerts.count() if self.grouped else 0, "outgoing": outgoing.count()}
        tables = {"dead_letters": state.newest(letters), "outbox": state.enqueue(self.store.load("outbox", batch), outgoing, now)}
        if max(Counter(map(bucket_of, held)).values(), default=0) < MAX_PARTS:
            self.store.save(batch, tables, position, state.changed(records, fresh, now))
        else:
            gathered = state.remember(records, fresh, now).persist()
            grown = gathered.count() > BUCKET_RECORDS * len(set(map(bucket_of, held)))
            self.store.save(batch, tables, position, gathered, held, grown)
            gathered.unpersist()
        for df in (found, fresh, alerts, outgoing):
            if df is not None:
                df.unpersist()
        self.flush(batch)
        return report

    def flush(self, version: int | None = None) -> None:
        """Deliver what waits in the outbox of a version (or the latest); delivered events leave it. The first failure is saved and raised."""
        own = self.store.manifest(None if version is None else version + 1)
        if own is None or version is not None and own["version"] != version:
            return
        waiting = self.store.load("outbox", own["version"] + 1)
        done, failure = [], None
        for row in waiting.orderBy("created_at_unix", "id").toLocalIterator():
            try:
                self.deliver(row["sink"], row["payload"])
                done.append((row["id"],))
            except Exception as e:
                failure = (row["id"], f"{type(e).__name__}: {e}"), e
                break
        if not done and failure is None:
            return
        left = state.delivered(waiting, self.spark.createDataFrame(done, "id string"))
        if failure:
            left = state.failed(left, self.spark.createDataFrame([failure[0]], "id string, error string"))
        self.store.save(own["version"], {"outbox": left}, revision=True)
        if failure:
            raise failure[1]

    def cycle(self, log: Log, key: Key | None, max_tiles: int = 1, seed_tile: int | None = None) -> dict:
        """One step of the log: deliver what waits, verify the checkpoint against the one before, scan the next tiles, save, deliver.

        It begins after the last entry that was scanned; at first at the seed tile, or else at the latest one. CheckpointError
        and LogError leave the state as it is.
        """
        self.flush()
        at, version = self.store.position(), max(self.store.versions(), default=-1) + 1
        if at.get("frontier") is None and at["checkpoint_size"]:  # of a state without one: once, from the old tree's tiles
            log.verified(key, (at["checkpoint_size"], at["checkpoint_root"]))
            before = log.frontier(at["checkpoint_size"])
        else:
            before = Frontier(at["checkpoint_size"], tuple(map(bytes.fromhex, at.get("frontier") or ())))
        now, grown = log.followed(key, before)
        report = {"log_url": self.log_url, "checkpoint_size": now.size, "first_tile": None, "last_tile": None, "entries": 0, "parse_errors": 0, "findings": 0, "new_findings": 0, "alerts": 0, "last_entry": at["last_entry"], "message": "no new entries"}
        position = {"last_entry": at["last_entry"], "checkpoint_size": now.size, "checkpoint_root": now.root_hash, "frontier": [x.hex() for x in grown.roots]}
        window = next_tiles(at["last_entry"], now.size, max_tiles, seed_tile)
        if window is None:
            self.store.save(version, {}, position)
            return report
        first, last = window
        begin, end = first * TILE if at["last_entry"] is None else at["last_entry"] + 1, min((last + 1) * TILE, now.size)
        entries = self._entries(log, now.size, begin, end).persist()
        events, errors = decode.events_and_errors(entries, self.log_url)
        position["last_entry"] = end - 1
        report |= self.step(events, errors, version, position)
        report |= {"first_tile": first, "last_tile": last, "entries": entries.count(), "parse_errors": errors.count(), "last_entry": end - 1, "message": f"{end - begin} entries scanned"}
        entries.unpersist()
        return report

    def _entries(self, log: Log, size: int, begin: int, end: int) -> DataFrame:
        """schemas.ENTRIES, read by tasks, a tile each; every entry is checked against the log's hash of it."""
        from ..ship import ship

        ship(self.spark)
        tiles = self.spark.range(begin // TILE, -(-end // TILE), numPartitions=max(1, -(-end // TILE) - begin // TILE))
        names = [f.split()[0] for f in schemas.ENTRIES.split(", ")]

        def read(frames):
            import pandas as pd

            for frame in frames:
                rows = [r for i in frame["id"] for r in log.entries(size, int(i)) if begin <= r["index"] < end]
                yield pd.DataFrame({n: [r[n] for r in rows] for n in names}, dtype=object)

        return tiles.mapInPandas(read, schemas.ENTRIES)

    def run(self, log: Log, key: Key | None, max_tiles: int = 1, seed_tile: int | None = None, once: bool = False, interval: float = 30.0, told: Callable[[dict], None] = print, sleep: Callable[[float], None] = time.sleep) -> None:
        """cycle() again and again, or once."""
        while True:
            told(self.cycle(log, key, max_tiles, seed_tile))
            if once:
                return
            sleep(interval)

    def start(self, entries: DataFrame, checkpoint: str, once: bool = False, interval: str = "30 seconds") -> StreamingQuery:
        """Run on a stream of schemas.ENTRIES."""

        def each(batch: DataFrame, number: int) -> None:
            events, errors = decode.events_and_errors(batch, self.log_url)
            self.step(events, errors, number)

        writer = entries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def next_tiles(last_entry: int | None, size: int, max_tiles: int, seed_tile: int | None = None) -> tuple[int, int] | None:
    """First and last tile of the next step, as functions.tiles.tile_window plans them for a column."""
    newest = (size - 1) // TILE
    first = (last_entry + 1) // TILE if last_entry is not None else newest if seed_tile is None else seed_tile
    if size <= 0 or (last_entry or 0) >= size - 1 and last_entry is not None or first > newest:
        return None
    return first, min(first + max_tiles - 1, newest)


def emit_new(findings: DataFrame, clock: str = "now_unix") -> DataFrame:
    """A stream of findings with key and a clock column -> those that are new, by keyed state: for queries that need no outbox.

    Equal keys of one batch all pass; a later one passes if its severity is higher or the record has expired. Expiry is
    held in the state, so a stream that ends when its input does, ends.
    """
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class Seen(StatefulProcessor):
        def init(self, handle) -> None:  # noqa: ANN001
            self.state = handle.getValueState("seen", "rank int, expires bigint")

        def handleInputRows(self, key, rows, timers):  # noqa: ANN001, ANN201
            rows = pd.concat(list(rows))
            was = self.state.get() if self.state.exists() else (-1, 0)
            now = int(rows[clock].max())
            ranks = rows["severity"].map({s: i for i, s in enumerate(D.SEVERITIES)})
            floor = was[0] if was[1] > now else -1
            new = rows[ranks > floor]
            if len(new):
                self.state.update((int(max(ranks.max(), floor)), now + state.TTL_SECONDS))
            yield new[["key", "domain", "detector", "severity", "score"]]

        def close(self) -> None:
            pass

    return findings.select("key", "domain", "detector", "severity", "score", clock).groupBy("key").transformWithStateInPandas(statefulProcessor=Seen(), outputStructType="key string, domain string, detector string, severity string, score int", outputMode="Append", timeMode="None")


def webhook(cfg: Config) -> Deliver:
    """Delivery to the configured sinks."""

    def send(sink: str, payload: str) -> None:
        if sink == "webhook" and cfg.outputs.webhook_url:
            sinks.deliver_webhook(cfg.outputs.webhook_url, payload, cfg.outputs.webhook_signing_secret)
        elif sink == "chat" and cfg.outputs.slack_webhook_url:
            body = json.loads(payload)
            rows = body.get("findings") or [f for a in body.get("alerts", []) for f in a["findings"]]
            for f in rows:
                sinks.deliver_chat(cfg.outputs.slack_webhook_url, f"Certloom alert: {f['domain']} severity={f['severity'].title()} score={f['score']} detector={f['detector']}")

    return send

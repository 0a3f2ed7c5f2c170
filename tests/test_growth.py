"""What keeps the work of a row, of a task and of a domain small on large tables."""

import hashlib

from pyspark.sql import functions as F

from certloom.config import demo
from certloom.functions import domains as D
from certloom.functions import merkle
from certloom.operators import decode, detection, list_detectors, scoring
from certloom.plans import fixtures, scan
from certloom.sources import static_log


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_forms_of_a_name_are_computed_once(spark):
    names = spark.createDataFrame([(r,) for r in ("a.com", "A.com", " *.x.org. ", "a.com\n", "a..com", "x" * 64 + ".com", "-a.com", None, "a b.com", "*.", "a.*.com", "x." * 126 + "com")], "raw string")
    made = names.select("raw", D.normalize(F.col("raw")).alias("name"), D.problem(F.col("raw")).alias("problem"))
    assert plan(made).count("regexp_replace") <= 16  # each form was written out wherever it was used
    want = ["a.com", "a.com", "x.org", "a.com", "empty label", "label too long", "hyphen at the edge of label", "null", "white space or control character", "wildcard inside", "wildcard inside", "too long"]
    assert [r["name"] or r["problem"] for r in made.collect()] == want


def test_distance_without_swaps_is_the_plain_one(spark):
    import itertools
    import random

    def slow(a, b):
        d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    rng = random.Random(3)
    pairs = [("".join(rng.choices("abc", k=rng.randint(0, 6))), "".join(rng.choices("abc", k=rng.randint(0, 6)))) for _ in range(600)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", D.osa_distance(F.col("a"), F.col("b")).alias("d"))
    assert "levenshtein" in plan(got)  # the table of cells is for names with a swap only
    assert [(r["a"], r["b"], r["d"]) for r in got.collect()] == [(a, b, slow(a, b)) for a, b in pairs]


def _observed(spark):
    rows = [(d, i % 7, i) for i in range(40) for d in ("paypa1-login.com", "payapl.com", f"my-paypal{i}.xyz", "plain.org")]
    return scan.with_metadata(spark.createDataFrame(rows, "domain string, certificate_index bigint, pos int").withColumn("observed_at", F.concat(F.lit("t"), (F.col("pos") % 3).cast("string"))), "log", "ct")


def test_findings_are_those_of_merging_each_observation(spark):
    seen, cfg = _observed(spark), demo()
    want = scoring.merge_findings(detection.detect(seen, cfg), ["pos", "position"], ["certificate_index"])
    got = scan.findings(seen, cfg)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_heads_of_alerts_need_no_row_of_all_evidence(spark):
    seen, cfg = _observed(spark), demo()
    whole = {r["domain"]: r for r in scan.alerts(scan.findings(seen, cfg), cfg).collect()}
    rows = scan.counted_heads(seen, cfg)
    assert {r["domain"]: (r["severity"], r["score"], r["detectors"], r["reasons"], r["n_evidence"]) for r in rows.collect()} == {d: (r["severity"], r["score"], r["detectors"], r["reasons"], len(r["evidence"])) for d, r in whole.items()}
    assert "observed_at" not in plan(scan.heads(seen, cfg))  # told by names alone


def test_alerts_by_names_are_those_of_all_findings(spark):
    seen, cfg = _observed(spark), demo()
    whole, rows = scan.alerts(scan.findings(seen, cfg), cfg), scan.observed_alerts(seen, cfg)
    assert rows.columns == whole.columns
    assert sorted(map(repr, rows.collect())) == sorted(map(repr, whole.collect()))


def test_alerts_of_tiles_read_each_tile_once(spark):
    tiles = spark.createDataFrame([(0, 100, bytearray(fixtures.tile(0, 100)))], "index bigint, width int, bytes binary").repartition(2, "index")
    rows = scan.scan_tiles(tiles, "log", demo())[0].where(F.col("domain").like("login%")).select("domain", "score")
    assert sorted(map(tuple, rows.collect())) == sorted((f"login-paypa1-{i}.net", 100) for i in range(100) if i % 7 != 6)
    last = rows._jdf.queryExecution().executedPlan().toString()
    assert last.split("Initial Plan")[0].count("MapInArrow") == 2  # tiles, then certificates; it was six


def test_names_of_a_certificate_are_looked_at_once(spark):
    raw = spark.createDataFrame([(1, ["A.example", "a.example", "*.b.example", "bad_name.example", "a.example."])], "index bigint, san_dns_names array<string>")
    raw = raw.withColumns(dict.fromkeys(("source_log", "observed_at", "source_type", "certificate_sha256", "serial_number", "issuer", "not_before", "not_after"), F.lit(None).cast("string")))
    rows = decode.observations(decode.certificate_events(raw)).select("pos", "domain")
    assert plan(rows).count("z0-9-]{0,61}") <= 4  # twice in a pattern, one for each branch; a filter inferred from the explosion looked at all names again
    assert sorted(map(tuple, rows.collect())) == [(0, "a.example"), (1, "b.example")]


def test_names_are_spread_though_they_are_few_bytes(spark):
    names = detection.names_of(_observed(spark), demo())
    names.collect()
    assert "REPARTITION_BY_NUM" in names._jdf.queryExecution().executedPlan().toString()


def test_features_of_names_are_not_made_where_they_come_from(spark):
    cfg, seen = demo(), _observed(spark)
    found = list_detectors.findings(detection.names_of(seen, cfg), list_detectors.Lists.of(spark, cfg), ["composition"])
    filters = [line for line in plan(found).splitlines() if "Filter" in line and "array_distinct" in line and "size(" in line and "terms" not in line]
    assert not filters  # tokens were made, for a filter, of each row of the observations
    assert {r["domain"] for r in found.collect()} >= {"paypa1-login.com", "my-paypal0.xyz"}


def test_entries_of_one_tile_at_a_time():
    import pyarrow as pa

    tiles = pa.RecordBatch.from_pylist([{"index": i, "width": None, "bytes": fixtures.tile(i * 256, 256)} for i in range(3)])
    assert [b.num_rows for b in decode.tile_entries([tiles], True)] == [256] * 3


def test_tasks_of_a_log_are_runs_of_tiles(tmp_path):
    reader = static_log._Batch({"mirror": str(tmp_path), "size": str(256 * 100_000 + 5)})
    runs = reader.partitions()
    assert len(runs) < 2_000 and [i for r in runs for i in range(r.index, r.index + r.count)] == list(range(100_001))


def _frontier(leaves, size):
    """Roots of the perfect subtrees of a size, largest first, of those whose leaves ({index: hash}) are all there."""
    out = []
    for start, n, _ in merkle.subtree_plan(size):
        level = [leaves.get(i) for i in range(start, start + n)]
        while len(level) > 1:
            level = [None if a is None or b is None else hashlib.sha256(b"\x01" + a + b).digest() for a, b in zip(level[::2], level[1::2], strict=True)]
        out += [x for x in level if x is not None]
    return out


def _leaf_rows(spark, n, missing=()):
    made = spark.range(n).where(~F.col("id").isin(*missing)) if missing else spark.range(n)
    return made.select(F.col("id").alias("index"), merkle.sha256(F.col("id").cast("string").cast("binary")).alias("hash"))


def test_frontiers_at_any_size_and_with_leaves_missing(spark):
    n, missing = 66_600, (3, 300, 1024, 66_000)
    sizes = sorted({0, 1, 2, 3, 4, 5, 255, 256, 257, 511, 512, 1023, 1024, 1025, 4095, 65_535, 65_536, 65_537, 66_001, 66_048, n - 1, n})
    asked = spark.createDataFrame([(s,) for s in (*sizes, 5)], "size bigint")  # one is asked for twice
    for gone in ((), missing):
        leaves = {i: hashlib.sha256(str(i).encode()).digest() for i in range(n) if i not in gone}
        got = {r["size"]: [bytes(x) for x in r["roots"]] for r in merkle.frontiers(_leaf_rows(spark, n, gone), asked, n).collect()}
        assert got == {s: _frontier(leaves, s) for s in sizes if s == 0 or _frontier(leaves, s)}


def _moved(df):
    """Bytes of rows that the shuffles of a collected table have dealt."""

    def walk(node):
        kind = node.getClass().getSimpleName()
        own = node.metrics().apply("dataSize").value() if kind == "ShuffleExchangeExec" else 0
        below = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else []
        below += [node.children().apply(i) for i in range(node.children().size())]
        return own + sum(map(walk, below))

    return walk(df._jdf.queryExecution().executedPlan())


def test_subtrees_of_each_size_do_not_move(spark):
    n = 20_000
    found = merkle.frontiers(_leaf_rows(spark, n), spark.range(1, n + 1).select(F.col("id").alias("size")), n)
    assert len(found.collect()) == n
    assert 0 < _moved(found) < 200 * n  # all subtrees of each size were dealt twice

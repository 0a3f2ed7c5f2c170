"""Queries over all rows of a table against plain versions."""

import hashlib

import pytest
from pyspark.sql import functions as F

from certloom.functions import merkle
from certloom.plans.queries import QUERIES

N = 2503


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.range(N).selectExpr("id AS event_id", "id % 7 AS user_id", "'view' AS event_type", "timestamp'2026-01-01 00:00:00' AS ts").write.parquet(f"{path}/events.parquet")
    return path


def _root(hashes):
    if len(hashes) == 1:
        return hashes[0]
    k = 1 << (len(hashes) - 1).bit_length() - 1
    return hashlib.sha256(b"\x01" + _root(hashes[:k]) + _root(hashes[k:])).digest()


LEAVES = [hashlib.sha256(b"\0\0\0" + b"%08d" % i).digest() for i in range(N)]


def test_merkle(spark, sf):
    assert [r[0] for r in QUERIES["merkle_root"](spark, sf).collect()] == [_root(LEAVES).hex()]
    assert sorted(map(tuple, QUERIES["merkle_perfect"](spark, sf).collect())) == [(p, _root(LEAVES[16 * p : 16 * p + 16]).hex()) for p in range(N // 16)]


def test_subtree_plan(spark, sf):
    got = sorted(map(tuple, QUERIES["subtree_plan"](spark, sf).collect()))
    assert got == sorted((n, *x) for n in range(N) for x in merkle.subtree_plan(n))
    big = [0, 70_000, 2**32 + 5, 2**50 + 1, 2**62 + 3]
    made = spark.createDataFrame([(n,) for n in big], "n bigint").select("n", merkle.subtree_plans(F.col("n")))
    assert {r[0]: [tuple(x) for x in r[1]] for r in made.collect()} == {n: merkle.subtree_plan(n) for n in big}


def test_webhook_payload(spark, sf):
    from certloom.operators import sinks
    from certloom.plans import queries

    rows = queries.found(spark, sf)
    got = QUERIES["webhook_payload"](spark, sf).collect()
    assert sum(r["n"] for r in got) == rows.count() and len(got) == rows.select("certificate_index").distinct().count() > 200
    one = rows.where("certificate_index = 2304")  # a later entry
    assert [r[0] for r in sinks.payload(one, "findings", 0).collect()] == [p for p in (r["payload"] for r in got) if "paypa1-login.com" in p and "certificate_index\",\"value\":\"2304\"" in p]


def _osa(a, b):
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_osa_distance(spark, sf):
    labels = {r["idx"]: r["value"] for r in QUERIES["registrable_label"](spark, sf).collect()}
    got = {r["idx"]: r["value"] for r in QUERIES["osa_distance"](spark, sf).collect()}
    assert max(map(len, labels.values())) > 8 and got == {k: _osa(v, "paypal") for k, v in labels.items()}


def test_composition_of_all_names(spark, sf):
    said = {k: [r["reason"] for r in QUERIES[f"{k}"](spark, sf).collect()] for k in ("comp_protected", "comp_digit_label", "comp_digit_token")}
    assert any("`microsoft`" in x for x in said["comp_protected"]) and any("`microsoft`" in x for x in said["comp_digit_token"])

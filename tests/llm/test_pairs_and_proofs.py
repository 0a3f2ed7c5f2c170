import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from certloom.llm import alignment, jaccard_join, manifest

from . import brute

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def words(rng, n, vocabulary=500):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(rng, text, n):
    w = text.split(" ")
    for k in rng.sample(range(len(w)), min(n, len(w))):
        w[k] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


# --- op11 ----------------------------------------------------------------------------------------------------------
def sources_of(rng):
    """Sources of one to 300 documents, a null one, names whose bytes and code points order alike only in UTF-8, clashing ids."""
    out, sizes = [], {"a": 300, "b": 16, "c": 17, "": 1, None: 33, "Z": 2, "é": 15, "￿": 1, "😀": 257, **{f"s{i:02}": 1 for i in range(18)}}
    for source, n in sizes.items():
        out += [(len(out) + i if rng.random() > 0.1 else 7, rng.choice([None, "", "Text ÄB", "plain", "A" * 50_000]), rng.choice([None, "en"]), source, rng.choice([None, 0, 5])) for i in range(n)]
    out += [out[0], out[0], (None, "X", None, "a", 1), (None, "Y", None, None, 1)]
    return out


def test_manifest(spark):
    made = sources_of(random.Random(3))
    docs = spark.createDataFrame(made, SCHEMA).repartition(7)
    want = brute.manifest([(d, s, lang, n, t) for d, t, lang, s, n in made])
    assert rows(manifest.digest(docs)) == sorted(want, key=repr)
    assert not all(w[-1] for w in want) and any(w[-1] for w in want)


def test_manifest_by_shuffled_joins(spark, monkeypatch):
    made = [(i, f"Doc {i}", "en", f"s{i % 3}" if i % 2 else "hot", i) for i in range(700)]
    monkeypatch.setattr(manifest, "TOP_BYTES", 600)
    want = brute.manifest([(d, s, lang, n, t) for d, t, lang, s, n in made])
    assert rows(manifest.digest(spark.createDataFrame(made, SCHEMA))) == sorted(want, key=repr)


def test_manifest_edges(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert manifest.digest(none).collect() == []
    one = manifest.manifest(spark.createDataFrame([(1, "x", None, None, None)], SCHEMA)).first()
    assert one.leaf == one.subroot == one.root == one.folded_root == brute.sha("1:1---1:x") and one.verified and one.proof_sha256 == brute.sha("")
    clash = spark.createDataFrame([(1, "x", "en", "a", 1), (2, "y", "en", "a", 1)], SCHEMA).withColumns({c: F.lit(0) for c in ("tree", "idx", "digest", "n", "part", "level", "checked")})
    assert rows(manifest.digest(clash)) == rows(manifest.digest(clash.select("doc_id", "text", "lang", "source", "n_chars")))
    assert manifest.manifest(clash, F.lit("z")).where("verified").count() == 0


# --- op12 ----------------------------------------------------------------------------------------------------------
def crowd(rng):
    """Near copies around the limit, a dense group, pages of one template, chains, copies, sets of a few shingles."""
    out = []
    for size in (8, 9, 12, 24, 60, 130):
        base = words(rng, size)
        out += [base, base] + [edited(rng, base, k) for k in range(1, 1 + max(1, size // 12))] + [base + " " + words(rng, k) for k in range(1, 1 + size // 4)]
    dense = words(rng, 90)
    out += [edited(rng, dense, rng.randrange(3)) for _ in range(40)]
    template = words(rng, 110)
    out += [f"{template} {words(rng, 60, 10**6)}" for _ in range(30)]
    chain = words(rng, 160).split(" ")
    out += [" ".join(chain[k : k + 80]) for k in range(0, 80, 4)]
    out += [None, "", " \t", "one", "ONE", "a b c", "a  b\nc", "a b c d e", "a b c d e f", words(rng, 30_000), "x " * 300, "x " * 200]
    return out


@pytest.mark.parametrize("most", [1000, 7])
def test_jaccard_join(spark, monkeypatch, most):
    texts = crowd(random.Random(most))
    made = [(i * 13 % 1009 if i % 50 else None if i else 5, t, None, None, 0) for i, t in enumerate(texts)]
    made += [made[3], made[3]]
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", most)
    docs = spark.createDataFrame(made, SCHEMA).repartition(5).withColumns({c: F.lit("0") for c in ("node", "own", "set", "region", "side")})
    want = brute.jaccard_links([(r[0], r[1]) for r in made])
    assert rows(jaccard_join.links(docs)) == sorted(want, key=repr)
    assert sum(w[3] for w in want) > 1000


def test_jaccard_join_empty(spark):
    assert jaccard_join.links(spark.createDataFrame([], SCHEMA)).collect() == []
    lone = jaccard_join.links(spark.createDataFrame([(3, None, "", "", 0), (3, "a b", "", "", 0)], SCHEMA))
    assert rows(lone) == [(3, 0, 3, 0), (3, 1, 3, 0)]


def test_bands_hold_all_links():
    size = np.arange(1, 200_000)
    band = jaccard_join.band_of(size)
    assert (band[(size * 5 // 4).clip(max=size[-1]) - 1] - band <= 1).all()


def test_linked_sets_share_first_shingles():
    """At least shared(size) of both, and so more than what two sets forget."""
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 9, 1 << jaccard_join.BUCKET_BITS)
    for _ in range(1500):
        n = int(rng.integers(1, 130))
        a = rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2)
        out, more = int(rng.integers(0, n // 5 + 1)), int(rng.integers(0, n // 4 + 1))
        a, b = np.unique(a), np.unique(np.concatenate([a[out:], rng.integers(0, 2**63, more).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both):
            met = len(np.intersect1d(jaccard_join.rarest(a, counts), jaccard_join.rarest(b, counts)))
            x, y = (int(jaccard_join.shared(np.int64(len(s)))) for s in (a, b))
            assert met >= max(x, y) and (x - 1) // 2 + (y - 1) // 2 < met


def test_signatures_bound_from_above():
    rng = np.random.default_rng(1)
    for n in (3, 50, 900):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 2**63, n).astype(np.uint64)]))
        for bits in (64, 256, 4096):
            x, y = jaccard_join.signatures([a, b], bits)
            assert (len(a) + len(b) - int(np.bitwise_count(x ^ y).sum())) // 2 >= len(np.intersect1d(a, b))


# --- op13 ----------------------------------------------------------------------------------------------------------
ODD = [
    None, "", " ", "  x", "a b", "ﬁne ½", "tab\tand\nline\n", "<s> </s> <|endoftext|> <0x41>", "日本語のテキスト", "é é", "▁x", "emoji 😀😀", "a" * 3000, "trailing  ", "\x00z",
    "don't WE'LL 12345 3.14", "der Überfluß naïve façade", "مرحبا بالعالم", "́‍", "x" + " " * 40 + "y", "word " * 20_000,
]


@pytest.fixture(scope="module")
def spoken():
    rng = random.Random(9)
    stock = "the of and international tokenization Straße über naïve running 2024 (see) \"quoted\" e-mail http://x.y/z ünïcödé".split(" ")
    return [(i - 3, t) for i, t in enumerate(ODD)] + [(100 + i, " ".join(rng.choices(stock, k=rng.randrange(1, 60)))) for i in range(40)] + [(7, "a b"), (7, "a b"), (None, "a b")]


@pytest.mark.parametrize("most", [None, 1])
def test_alignment(spark, spoken, most):
    docs = spark.createDataFrame(spoken, "doc_id bigint, text string").repartition(3).withColumns({c: F.lit(0) for c in ("codes", "row", "n", "times")})
    want = brute.alignment(spoken, alignment.BYTE_BPE, alignment.PIECE_BPE)
    assert rows(alignment.alignment(docs, max_pairs=most)) == sorted(want, key=repr)
    assert {w[0] for w in want if not w[1]} >= {-3, -2}


def test_alignment_empty(spark):
    assert alignment.alignment(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    assert rows(alignment.alignment(spark.createDataFrame([(1, None)], "doc_id bigint, text string"))) == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_union_is_the_components():
    rng = random.Random(2)
    for _ in range(20):
        n = rng.randrange(1, 60)
        ends = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(n))]
        plain = list(range(n))
        for _ in range(n):
            for a, b in ends:
                plain[a] = plain[b] = min(plain[a], plain[b])
        a, b = (np.array([e[k] for e in ends], np.int64) for k in (0, 1))
        assert alignment.union(n, a, b).tolist() == plain

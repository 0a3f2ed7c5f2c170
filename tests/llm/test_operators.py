import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from certloom.llm import bloom, bwt, chat, common, components, decontamination, fingerprints, language_id, line_dedup, mixing, near_dedup, pii, queries, repeats, toxicity

from . import brute

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}{'é' if rng.random() < 0.1 else ''}" for _ in range(n))


def edit(rng, text, share):
    return " ".join(f"x{rng.randrange(999)}" if rng.random() < share else w for w in text.split(" "))


@pytest.fixture(scope="module")
def texts():
    """Groups of copies, near copies at and around the limit, shared lines, periodic, empty, null, odd and long texts."""
    rng = random.Random(5)
    out, line = [], "This LINE is found in very many of the documents"
    for g in range(12):
        base = words(rng, 40 + 30 * g)
        out += [base, base] + [edit(rng, base, s) for s in (0.01, 0.02, 0.03, 0.05, 0.1)]
    passage = words(rng, 120)
    out += [f"{words(rng, 30)}\n  {line}\t\n{words(rng, 30)}" for _ in range(6)]
    out += [f"{words(rng, 50)} {passage} {words(rng, 50)}" for _ in range(5)]
    out += [None, "", " ", "one", "one two three", "One  two\tthree", "ab " * 400, "ab " * 300, "é" * 900, "é" * 900, words(rng, 20_000), "\n\n" + line.lower() + "\n", "Straße 12 ﬁn"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i * 7 % 1009, t, ["en", "de", None][i % 3], f"s{i % 4}", 0) for i, t in enumerate(texts)], SCHEMA).repartition(5).persist()


@pytest.fixture(scope="module")
def plain(docs):
    return [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_one_automaton_at_a_time(spark, docs, plain, monkeypatch):
    """Items of five shards: what they hit together is that of all at once, and no two automata are there."""
    long = max((t for _, t in plain if t), key=len).split(" ")
    items = [(i, " ".join(long[40 * i : 40 * i + 20])) for i in range(40)] + [(99, "one two three")]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    alive, most, made, plain_broadcast = [], [0], [0], spark.sparkContext.broadcast

    def broadcast(value):
        out = plain_broadcast(value)
        made[0] += 1
        alive.append(out)
        most[0] = max(most[0], len(alive))
        destroy = out.destroy
        out.destroy = lambda *a: (alive.remove(out), destroy(*a))
        return out

    monkeypatch.setattr(spark.sparkContext, "broadcast", broadcast)
    total = sum(len(t) / 2 + 1 for _, t in items)
    found, (n_words, spans, met) = decontamination.find(docs.select("doc_id", "text"), table, most=int(total / 4.5))
    got = rows(found.select("doc_id", F.col(n_words), decontamination._hits(spans), F.size(met).cast("bigint"), F.sha2(F.array_join(F.array_sort(met), ",").cast("binary"), 256), decontamination.is_contaminated(n_words, spans)))
    assert got == sorted(brute.decontamination(plain, items), key=repr)
    assert made[0] == 5 and most[0] == 1


def test_decontamination(spark, docs, plain, none):
    long = max((t for _, t in plain if t), key=len).split(" ")
    items = [(1, " ".join(long[100:140])), (2, "one two three"), (10, " ".join(long[110:123]).upper()), (3, None), (4, " . "), (5, "zzz"), (2, "one two three")]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    assert rows(decontamination.digest(docs, table)) == sorted(brute.decontamination(plain, items), key=repr)
    found, names = decontamination.find(docs.select("doc_id", "text"), table, most=40)  # several automata
    whole, other = decontamination.find(docs.select("doc_id", "text"), table)
    assert rows(found.select("doc_id", *names)) == rows(whole.select("doc_id", *other))
    assert decontamination.digest(none, table).count() == 0
    again = docs.unionAll(docs).withColumns({"n_words": F.lit(1), "__spans": F.lit(2)})
    assert rows(decontamination.digest(again, table)) == sorted(brute.decontamination(plain + plain, items), key=repr)
    assert decontamination.digest(docs, table.where("false")).where("contaminated").count() == 0
    kept = decontamination.decontaminate(docs.withColumn("__n_words", F.lit("mine")), table)
    assert kept.columns == [*docs.columns, "__n_words"]
    left = {r["doc_id"]: r["text"] for r in kept.collect()}
    by_id = dict(plain)
    big = next(d for d, t in plain if t and len(t.split(" ")) == len(long))
    assert by_id[big] != left[big] and " ".join(long[100:140]) not in left[big]
    assert all(left[d] == by_id[d] for d in left if d != big and not any(w in (by_id[d] or "") for w in ("one", "One")))


def test_automaton_on_random_words():
    rng = random.Random(3)
    for _ in range(60):
        items = [(str(k), " ".join(rng.choice("abc") for _ in range(rng.randrange(9)))) for k in range(5)]
        window = rng.randrange(1, 6)
        auto = decontamination.build(items, window)
        text = [rng.choice("abcd") for _ in range(40)]
        column = pa.array([" ".join(text)])
        w = common.Words(*common.raw(column), common.LETTERS)
        number = [auto.words.get(h, -1) for h in w.hash64().tolist()]
        hit, found = np.zeros(40, bool), set()
        auto.scan(number, hit, 0, found)
        want = brute.decontamination([(0, " ".join(text))], items, window)[0]
        assert (int(hit.sum()), len({auto.ids[i] for i in found})) == want[2:4]


def test_line_dedup(spark, docs, plain, none):
    want = [(d, n, k, brute.sha(t)) for d, n, k, t in brute.kept_lines(plain)]
    assert rows(line_dedup.digest(docs)) == sorted(want, key=repr)
    assert sum(x[2] for x in want) > 5
    assert line_dedup.digest(none).count() == 0
    line = "exactly twenty chars"
    same = spark.createDataFrame([(1, line), (1, line), (2, f"x\n{line.upper()} \ny"), (3, f"{line}\n{line}"), (None, line), (4, None), (5, "nineteen characters"), (6, "nineteen characters"), (7, "nineteen characters")], "doc_id bigint, text string")
    out, names = line_dedup.dedup_lines(same.withColumn("gone", F.lit(0)))
    assert rows(out.select("doc_id", "text", "gone", *names))[:4] == [(1, "", 0, 1, 1), (1, "", 0, 1, 1), (2, "x\ny", 0, 3, 1), (3, f"{line}\n{line}", 0, 2, 0)]


def test_near_dedup(spark, docs, plain, none):
    want = brute.near(plain)
    assert rows(near_dedup.near_duplicates(docs)) == sorted(want, key=repr)
    assert len({x[2] for x in want}) < len(want) - 20
    assert near_dedup.near_duplicates(none).count() == 0
    assert sorted(r["doc_id"] for r in near_dedup.dedup(docs).collect()) == sorted(x[0] for x in want if x[3])
    odd = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (0, None)], "doc_id bigint, text string")
    assert rows(near_dedup.near_duplicates(odd)) == [(0, 0, 0, True), (1, 2, 1, True), (1, 2, 1, True), (None, 2, None, True)]


def test_near_dedup_of_a_star(spark, monkeypatch):
    """Edits linked with one text and none with another: more than neighbours in any order can find."""
    rng = random.Random(8)
    base = words(rng, 300, 10**6).split(" ")
    texts = [" ".join(base)]
    for n in range(1100):
        cut = set(rng.sample(range(4, 296), 8))
        texts.append(" ".join(f"y{n}x{i}" if i in cut else w for i, w in enumerate(base)))
    data = [(k * 7 % 1103 + 1, t) for k, t in enumerate(texts)]
    want = sorted(brute.near(data), key=repr)
    assert max(sum(x[2] == y for x in want) for y in {x[2] for x in want}) > 1000
    table = spark.createDataFrame(data, "doc_id bigint, text string").repartition(4)
    assert rows(near_dedup.near_duplicates(table)) == want
    monkeypatch.setattr(near_dedup, "BLOCK_SETS", 150)  # several blocks
    assert rows(near_dedup.near_duplicates(table)) == want


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(0, 300) if i % 100 != 99] + [(5, 5), (400, 401), (401, 400)]
    got = {r[0]: r[1] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: i // 100 * 100 for i in range(300)} | {400: 400, 401: 400}


def test_signatures_find_pairs_at_the_limit():
    rng = np.random.default_rng(1)
    missed = 0
    for _ in range(200):
        own = rng.integers(0, 2**63, 700).astype(np.uint64)
        a, b = common.mix(np.unique(own[:600])), common.mix(np.unique(own[100:]))
        sa, sb = (near_dedup._orders(pa.array([near_dedup.signature(np.sort(x)).tobytes()], pa.binary()))[0] for x in (a, b))
        missed += not (sa == sb).any()
    assert missed == 0  # resemblance 5/7, a little under the limit


@pytest.mark.parametrize("most", [500, 3000, repeats.GROUP_BYTES])
def test_repeats(docs, plain, none, monkeypatch, most):
    monkeypatch.setattr(repeats, "GROUP_BYTES", most)  # pieces of a few windows, of some, none
    want = brute.repeats(plain)
    got = repeats.digest(docs)
    assert rows(got.drop("text")) == sorted(want, key=repr)
    assert all(brute.sha(r["text"]) == r["kept_sha256"] for r in got.collect() if "\ufffd" not in r["text"])
    assert sum(x[2] for x in want) > 3000
    assert repeats.digest(none).count() == 0


def test_repeats_of_one_passage_in_very_many_texts(spark, monkeypatch):
    """All between different words, with copies, at the ends of texts, and periodic text of the same anchors."""
    rng = random.Random(12)
    passage = words(rng, 110, 10**6)
    data = [f"{words(rng, rng.randrange(3))} {passage[rng.randrange(3) :]} {words(rng, rng.randrange(30), 50)}" for _ in range(700)]
    data += [passage, passage, passage[:400], passage[:399], passage * 3, "ab " * 5000, "x " + "ab " * 700, "ab " * 134, None, ""]
    want = sorted(brute.repeats(list(enumerate(data))), key=repr)
    table = spark.createDataFrame(list(enumerate(data)), "doc_id bigint, text string").repartition(3)
    assert rows(repeats.digest(table).drop("text")) == want
    monkeypatch.setattr(repeats, "GROUP_BYTES", 2000)
    assert rows(repeats.digest(table).drop("text")) == want


def test_runs_of_one_anchor_are_spread(spark, monkeypatch):
    rng = random.Random(13)
    passage = words(rng, 110, 10**6)
    data = [f"{words(rng, 60, 10**6)} {passage} {words(rng, 60, 10**6)}" for _ in range(400)]
    dealt = {}

    def kept(df, name, write=common.shared_table):
        if name == "texts":  # 400 runs for each anchor next to an end of the passage
            dealt["most"] = max(r[1] for r in df.groupBy(F.spark_partition_id()).count().collect())
            dealt["all"], dealt["anchor"] = df.count(), max(r[1] for r in df.groupBy("anchor").count().collect())
        return write(df, name)

    monkeypatch.setattr(repeats.common, "shared_table", kept)
    own = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        got = rows(repeats.digest(spark.createDataFrame(list(enumerate(data)), "doc_id bigint, text string").repartition(3)).drop("text"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == sorted(brute.repeats(list(enumerate(data))), key=repr)
    assert dealt["anchor"] >= 400 and dealt["most"] < dealt["all"] / 8, dealt  # one task had all of an anchor


@pytest.mark.parametrize("values", [50, 1 << 23])
def test_filters_that_are_too_large_to_broadcast(docs, plain, monkeypatch, values):
    monkeypatch.setattr(bloom, "MAX_BITS", 1)
    monkeypatch.setattr(bloom, "SLICE_VALUES", values)
    assert rows(repeats.digest(docs).drop("text")) == sorted(brute.repeats(plain), key=repr)
    assert rows(line_dedup.digest(docs)) == sorted(((d, n, k, brute.sha(t)) for d, n, k, t in brute.kept_lines(plain)), key=repr)
    assert rows(near_dedup.near_duplicates(docs)) == sorted(brute.near(plain), key=repr)


def test_filters_suspect_all_that_repeats_and_little_else():
    rng = np.random.default_rng(4)
    once, twice = rng.integers(0, 2**63, 40_000).astype(np.uint64), rng.integers(0, 2**63, 5000).astype(np.uint64)
    pair = [np.zeros(bloom._bits(50_000) // 8, np.uint8) for _ in range(2)]
    crossed = np.concatenate([bloom.add(*pair, h) for h in np.array_split(rng.permutation(np.concatenate([once, twice, twice])), 7)])
    assert set(twice.tolist()) <= set(crossed.tolist()) and len(crossed) < 5000 + 0.02 * 40_000
    suspected = bloom.test(pair[1], bloom.probes(np.concatenate([twice, once]), len(pair[1]) * 8))
    assert suspected[:5000].all() and suspected[5000:].mean() < 0.02


def test_transform_against_counting():
    rng = random.Random(1)
    for _ in range(150):
        length, letters = rng.choice([2, 3, 5, 9, 17]), rng.choice([1, 2, 3, 6])
        text = [rng.randint(1, letters) for _ in range(rng.randint(2, 200))] + [0]
        text[len(text) // 2 : len(text) // 2 + 20] = text[1:21]
        text[-1] = 0
        parts = [tuple(text[i : i + length]) for i in range(len(text) - length + 1)]
        assert bwt.repeated(np.array(text), length)[: len(parts)].tolist() == [parts.count(p) > 1 for p in parts]


def test_runs_of_a_long_text_meet_those_of_a_short_one():
    rng = random.Random(2)
    text = words(rng, 3000).encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    whole = list(repeats.runs(data, offsets))
    cut = list(repeats.runs(data, offsets, 2000))
    assert sum(int(r[2].sum()) for r in whole) == sum(int(r[2].sum()) for r in cut) == len(text) - 399
    assert {int(x) for r in whole for x in r[3]} == {int(x) for r in cut for x in r[3]}


def test_fingerprints(docs, plain, none):
    got = {r["doc_id"]: r for r in fingerprints.compare_edited(docs).collect()}
    for d, n, text in brute.edited(plain):
        assert (got[d]["n_chars"], got[d]["edited_sha256"]) == (n, brute.sha(text))
        a, b = brute.shingle_set(dict(plain)[d]), brute.shingle_set(text)
        if a and b:
            assert abs(got[d]["near_edited"] - len(a & b) / len(a | b)) < 0.2
    assert len(got) == len(plain)
    by_text = {}
    for d, t in plain:
        assert by_text.setdefault(t or "", got[d]["fingerprint"]) == got[d]["fingerprint"]
    assert fingerprints.compare_edited(none).count() == 0
    odd = docs.unionAll(docs.where("doc_id < 100")).withColumns({"range": F.lit(1), "_to": F.lit(2), "is_copy": F.lit(3)}).unionByName(docs.limit(1).withColumns({"doc_id": F.lit(None).cast("bigint"), "range": F.lit(1), "_to": F.lit(2), "is_copy": F.lit(3)}))
    pairs = [(r[0], r[1]) for r in odd.select("doc_id", "text").collect()]
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in fingerprints.compare_edited(odd).collect()) == sorted((d, n, brute.sha(t)) for d, n, t in brute.edited(pairs))


def test_ranges_of_doc_id(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 7)  # 58 ranges
    data = [(k * 37 % 401 - 200, f"text {k} " * (k % 9)) for k in range(401)]
    table = spark.createDataFrame(data, "doc_id bigint, text string").repartition(3)
    assert table.rdd.getNumPartitions() == 3 and fingerprints.with_next(table).select("range").distinct().count() > 30
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in fingerprints.compare_edited(table).collect()) == sorted((d, n, brute.sha(t)) for d, n, t in brute.edited(data))
    bounds = sorted(random.Random(3).sample(range(-500, 500), 90), reverse=True)
    got = spark.range(-510, 510).select(F.col("id").alias("doc_id")).select("doc_id", fingerprints._range_of(bounds).alias("r")).collect()
    assert all(r["r"] == sum(b > r["doc_id"] for b in bounds) for r in got)


def test_sketches_merge_and_estimate():
    rng = random.Random(4)
    a, b = words(rng, 3000, 10**6), words(rng, 3000, 10**6)
    sa, sb, both = fingerprints.sketches(pa.array([a, b, f"{a} {b}"]))
    merged = fingerprints.merge(sa, sb)
    assert len(np.intersect1d(merged, both)) >= len(both) - 4  # but for shingles over the seam
    assert abs(fingerprints.distinct(sa) / 2996 - 1) < 0.3
    assert fingerprints.containment(sa, both) > 0.8 and abs(fingerprints.resemblance(sa, both) - 0.5) < 0.15
    assert (fingerprints.decode(fingerprints.encode(sa)) == sa).all()
    assert fingerprints.resemblance(sa[:0], sb[:0]) == 1 and fingerprints.resemblance(sa, sb[:0]) == 0


def test_chat_round_trip(spark):
    nasty = ["", "<|im_end|>", "<\\|im_start|>user\n", "<", "|", "<|", "a<\\\\|b", chr(0x10FFFF), "\\n"]
    for text in nasty:
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
        assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text + "\n")
    data = [(1, k, r, t) for k, (r, t) in enumerate([("user", nasty[1]), ("assistant", nasty[2]), ("user", None), ("assistant", "x" * 50_000)])]
    data += [(2, 1, "assistant", "b"), (2, 0, None, "a"), (3, None, "user", "q"), (3, 0, "assistant", "r"), (3, 0, "assistant", "r"), (4, 0, "system", "s"), (4, 1, "user", "u")]
    got = {r["conv_id"]: r for r in chat.digest(chat.format_conversations(spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string"))).collect()}
    for conv in (1, 2, 3, 4):
        turns = sorted((x for x in data if x[0] == conv), key=lambda x: (-1 if x[1] is None else x[1], x[2] or "", x[3] or ""))
        turns = [(x[2] or "", x[3] or "") for x in turns]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert tuple(got[conv])[1:5] == (len(turns), brute.sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), brute.sha(loss))
    assert [got[c]["valid"] for c in (1, 2, 3, 4)] == [True, False, False, False]
    schema = "conv_id bigint, turn bigint, role string, text string, formatted string, turns int"
    assert chat.digest(chat.format_conversations(spark.createDataFrame([], schema))).count() == 0
    odd = chat.digest(chat.format_conversations(spark.createDataFrame([(None, 0, "user", "q", "mine", 1), (None, 1, "assistant", "a", None, 2), (9, None, None, None, None, None)], schema)))
    assert {r["conv_id"]: (r["n_turns"], r["loss_chars"], r["valid"]) for r in odd.collect()} == {None: (2, 1, True), 9: (1, 0, False)}
    assert chat.check_order(["system", "user", "assistant", "user", "assistant"]) == (True, -1)
    assert chat.check_order(["user", "user"]) == (False, 1)


def test_language_id(spark, none):
    rng = random.Random(6)
    sounds = {"en": "th er on an", "de": "sch ei ung der", "fr": "eau ou que é", "es": "ción ll ñ os"}
    table = [(i, " ".join("".join(rng.choice(sounds[lang].split()) for _ in range(3)) for _ in range(40)), lang, "s", 0) for i, lang in enumerate(list(sounds) * 60)]
    table += [(900, None, "en", "s", 0), (901, "12 !?", "fr", "s", 0), (902, "", None, "s", 0), (903, table[0][1], None, None, None)]
    docs = spark.createDataFrame(table, SCHEMA)
    out = {r["doc_id"]: r for r in language_id.digest(docs).collect()}
    held = [r for r in out.values() if r["held_out"] and r["doc_id"] < 900]
    assert len(held) > 30 and np.mean([r["lang_pred"] == table[r["doc_id"]][2] for r in held]) > 0.97
    assert [out[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and out[903]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert language_id.digest(none).count() == 0
    assert {r["lang_pred"] for r in language_id.digest(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_toxicity(spark, none):
    rng = random.Random(7)
    bad = ["vilest", "rotter", "scumbag", "ghastly"]

    def text(toxic):
        w = words(rng, rng.randrange(5, 80)).split(" ")
        for _ in range(rng.randrange(1, 5) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad) + rng.choice(["", ",", "s"]))
        return " ".join(w)

    table = [(i, text(i % 5 == 0), "en", "s", 0) for i in range(600)] + [(1000, None, None, None, None), (1001, "", "en", "s", 0)]
    docs = spark.createDataFrame(table, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)] + [(None, 1), (5000, 1), (7, None)], "doc_id bigint, toxic int")
    out = {r["doc_id"]: r for r in toxicity.digest(docs, labels).collect()}
    assert len(out) == len(table) and not out[1000]["toxic"] and not out[1001]["toxic"]
    assert np.mean([out[i]["toxic"] == (i % 5 == 0) for i in range(300, 600)]) > 0.97
    assert all(0 <= r["expected_severity"] <= 3 for r in out.values())
    kept = toxicity.reject_toxic(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {d for d, r in out.items() if not r["toxic"]}
    assert toxicity.digest(none, labels).count() == 0
    assert toxicity.digest(docs, labels.where("toxic = 0")).where("toxic").count() == 0
    twice = toxicity.grade(docs.unionAll(docs).withColumns({"__grade": F.lit("mine"), "severity": F.lit("mine")}), toxicity.fit(docs, labels))[0]
    assert twice.count() == 2 * len(table) and {r[0] for r in twice.select("__grade").collect()} == {"mine"}
    many = pa.array([" ".join(bad[:k]) for k in range(5)])
    model = toxicity.fit(docs, labels)
    severity = model.severity(many)[0]
    assert (np.diff(severity) > 0).all() and (np.diff(model.thresholds) > 0).all()


def test_severity_against_a_plain_sum(spark):
    """Expected severity by its definition, word for word, and the fit's marks of features by counting."""
    rng = random.Random(11)
    texts = [words(rng, 30) + (" vile scum" if i % 4 == 0 else "") for i in range(200)] + ["word " * 300_000 + "vile"]
    toxic = [int(i % 4 == 0) for i in range(201)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    model = toxicity.fit(docs, spark.createDataFrame(list(enumerate(toxic)), "doc_id bigint, toxic int"))
    own = toxicity.sparse(pa.array(texts))
    assert [len(x) for x in own[:3]] == [len({w for w in t.split()} | {(n, w.encode()[:n]) for w in t.split() for n in toxicity.BEGINNINGS if len(w.encode()) > n}) for t in texts[:3]]
    marked = set(np.flatnonzero(model.weights).tolist())
    vile = toxicity.sparse(pa.array(["vile scum"]))[0].tolist()
    assert marked & set(vile) and all(model.weights[f] > 0 for f in marked)
    severity, above = model.severity(pa.array(texts))
    for k, features in enumerate(own):
        score = sum(float(model.weights[f]) for f in features.tolist())
        at_least = [1 / (1 + np.exp(-(score - t))) for t in model.thresholds.tolist()]
        assert abs(severity[k] - sum(at_least)) < 1e-4 and abs(above[k] - at_least[0]) < 1e-4
    assert all(above[k] > 0.5 for k in range(200) if toxic[k]) and not any(above[k] > 0.5 for k in range(200) if not toxic[k]) and above[200] > 0.5


def test_raking_meets_its_marginals():
    rng = np.random.default_rng(2)
    cells = {(f"s{a}", f"l{b}", f"t{c}"): float(rng.integers(1, 1000)) for a in range(5) for b in range(3) for c in range(2)} | {("s9", "l0", "t0"): 0.0}
    weights = mixing.rake(cells, [{"s0": 0.5, "s1": 0.1}, 0.5, 0.0])
    total = sum(cells.values())
    share = lambda d, v: sum(n * weights[k] for k, n in cells.items() if k[d] == v) / total
    assert abs(share(2, "t0") - 0.5) < 1e-6 and weights[("s9", "l0", "t0")] == 1
    assert abs(share(0, "s0") / share(0, "s1") - 5) < 1e-5
    assert abs(sum(n * weights[k] for k, n in cells.items()) / total - 1) < 1e-6
    assert mixing.rake({}, [1.0, 1.0, 1.0]) == {}


def plain_rake(cells, targets, rounds=500):
    """Proportional fitting with dictionaries; targets: shares of each dimension's values."""
    fitted, total = dict(cells), sum(cells.values())
    for _ in range(rounds):
        for d, share in enumerate(targets):
            for v in share:
                now = sum(n for k, n in fitted.items() if k[d] == v)
                for k in fitted:
                    if k[d] == v and now:
                        fitted[k] *= share[v] * total / now
    return {k: fitted[k] / n if n else 1.0 for k, n in cells.items()}


def powered(cells, d, power):
    total, out = sum(cells.values()), {}
    for k, n in cells.items():
        out[k[d]] = out.get(k[d], 0) + n / total
    out = {v: x**power for v, x in out.items() if x}
    return {v: x / sum(out.values()) for v, x in out.items()}


@pytest.mark.parametrize("most", [None, 3])
def test_mixing_against_a_plain_version(spark, docs, most):
    """most: cells on the driver; more are raked as a table."""
    taken = docs.withColumns({"d0": F.lit(1), "_u": F.lit(2), "__weight": F.lit(3), "weight": F.lit("mine"), "N_TOKENS": F.lit("mine")})
    taken = taken.unionAll(taken.where("doc_id < 30")).unionAll(taken.limit(1).withColumn("doc_id", F.lit(None).cast("bigint")))
    out = mixing.mix(taken, F.col("source"), F.col("lang"), mixing.topic(), mixing.TARGETS, max_cells=most)
    got = out.withColumn("u", F.pmod(F.xxhash64(F.lit(0), F.col("doc_id")), F.lit(1 << 40)) / float(1 << 40)).collect()
    assert len(got) == taken.count() and all((r["d0"], r["_u"], r["__weight"]) == (1, 2, 3) for r in got)

    def cell(r):
        t = r["text"]
        lines = (t or "").count("\n") + 1
        topic = "none" if not t else "table" if " | " in t else "lines" if len(t) < 400 * lines else "prose"
        return r["source"], r["lang"] or "\x00null", topic

    cells = {}
    for r in got:
        cells[cell(r)] = cells.get(cell(r), 0) + len(brute.SPACES.findall(r["text"] or ""))
    want = plain_rake(cells, [powered(cells, d, p) for d, p in enumerate(mixing.TARGETS)])
    for r in got:
        w = want[cell(r)]
        assert abs(r["weight"] - w) < 1e-6 * w
        assert r["n_copies"] == int(r["weight"]) + (r["u"] < r["weight"] - int(r["weight"])) and r["n_tokens"] == len(brute.SPACES.findall(r["text"] or ""))
    assert mixing.mix(taken.limit(0), F.col("source"), F.col("lang"), mixing.topic(), mixing.TARGETS, max_cells=most).count() == 0


def test_raking_a_table_to_named_shares(spark):
    rng = np.random.default_rng(9)
    cells = {(f"s{a}", f"l{b}", "t"): float(rng.integers(1, 1000)) for a in range(4) for b in range(3)} | {("s9", "l0", "t"): 0.0}
    targets = [{"s0": 0.5, "s1": 0.1, "unknown": 0.2}, 0.5, 1.0]
    table = spark.createDataFrame([(*k, int(n)) for k, n in cells.items()], "d0 string, d1 string, d2 string, n bigint")
    got = {tuple(r)[:3]: r["weight"] for r in mixing.rake_table(table, targets).collect()}
    want = mixing.rake(cells, targets)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 * want[k] for k in want)


def test_mixing(spark, docs, none):
    out = mixing.mix_documents(docs.withColumn("weight", F.lit("mine")))
    got = out.collect()
    assert len(got) == docs.count() and all(r["n_tokens"] == len(brute.SPACES.findall(r["text"] or "")) for r in got)
    cells, by = {}, {}
    for r in docs.withColumn("t", mixing.topic()).collect():
        k = (r["source"], r["lang"] or "\x00null", r["t"])
        cells[k] = cells.get(k, 0) + len(brute.SPACES.findall(r["text"] or ""))
        by[r["doc_id"]] = k
    want = mixing.rake({k: float(v) for k, v in cells.items()}, mixing.TARGETS)
    assert all(abs(r["weight"] - want[by[r["doc_id"]]]) < 1e-6 and abs(r["n_copies"] - r["weight"]) < 1 for r in got)
    assert mixing.mix_documents(none).count() == 0
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.when(F.col("id") % 10 == 0, "a").otherwise("b").alias("source"), F.lit("en").alias("lang"), F.lit(0).alias("n_chars"))
    drawn = mixing.mix(many, F.col("source"), F.col("lang"), mixing.topic(), [{"a": 0.5, "b": 0.5}, 1.0, 1.0]).groupBy("source").agg(F.sum("n_copies").alias("n")).collect()
    assert all(abs(r["n"] - 10_000) < 400 for r in drawn)


def luhn(x):
    d = [int(c) for c in x if c.isdigit()][::-1]
    return sum(d[::2]) + sum(sum(divmod(2 * c, 10)) for c in d[1::2])


def test_pii(spark, none):
    import datetime
    import ipaddress
    import re

    values = {"card": ["4111111111111111", "4111 1111 1111 1111", "378282246310005"], "phone": ["+1 (832) 555-8455", "212-555-0153"], "ssn": ["123-45-6789"], "ip": ["24.167.185.253"], "date": ["2024-02-29", "31.12.1999", "04/05/2001"], "email": ["iddpf.23@mail7.example.com"]}
    bad = ["4111111111111112", "666-45-6789", "300.1.1.1", "2023-02-29", "31/31/1999", "12345678901234567890123", "1-2-3"]
    flat = [v for vs in values.values() for v in vs]
    table = [(1, " x ".join(flat) + "."), (2, f"again {flat[0]}, and {flat[-1]}\n"), (3, " ".join(bad)), (4, None), (5, ""), (6, "no numbers"), (7, "é" * 5000 + f" {flat[0]} " + "ü" * 5000)]
    docs = spark.createDataFrame(table, "doc_id bigint, text string")
    out = {r["doc_id"]: r for r in pii.digest(docs, "k").collect()}
    new = out[1]["text"].rstrip(".").split(" x ")
    assert len(new) == len(flat) and all(a != b and re.sub("[0-9]", "9", re.sub("[a-z]", "a", a)) == re.sub("[0-9]", "9", re.sub("[a-z]", "a", b)) for a, b in zip(flat, new, strict=True) if "." not in a or "@" in a)
    assert all(luhn(x) % 10 == 0 for x in new[:3]) and ipaddress.ip_address(new[6]) and new[0].replace(" ", "") == new[1].replace(" ", "")
    datetime.date.fromisoformat(new[7]), datetime.datetime.strptime(new[8], "%d.%m.%Y"), datetime.datetime.strptime(new[9], "%d/%m/%Y")
    assert new[10].endswith("@mail7.example.com")
    assert out[2]["text"] == f"again {new[0]}, and {new[-1]}\n" and out[7]["text"] == table[6][1].replace(flat[0], new[0])
    assert out[3]["text"] == table[2][1] and out[3]["n_found"] == 0 and out[4]["text"] is None and out[5]["text"] == "" and out[6]["text"] == "no numbers"
    assert [out[1][f"n_{k}"] for k in pii.KINDS] == [len(values[k]) for k in pii.KINDS]
    assert pii.digest(docs, "other").where("doc_id = 1").first()["text"] != out[1]["text"]
    assert pii.digest(none, "k").count() == 0
    clash = pii.pseudonymise(docs.unionAll(docs).withColumn("__found", F.lit("mine")), "k")
    assert clash.columns == ["doc_id", "text", "__found", "found"] and clash.where("__found = 'mine'").count() == 2 * len(table)
    days = spark.range(2000).select(F.col("id").alias("doc_id"), F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"))
    assert pii.digest(days, "k").select("text").distinct().count() == 2000
    numbers = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("123-45-"), F.lpad((F.col("id") + 1).cast("string"), 4, "0")).alias("text"))
    assert pii.digest(numbers, "k").select("text").distinct().count() == 3000


def test_pii_against_a_plain_version(spark):
    rng = random.Random(13)
    two = lambda: f"{rng.randrange(100):02d}"
    make = {
        "card": lambda: rng.choice(["", " ", "-"]).join(f"{rng.randrange(10**4):04d}" for _ in range(4)),
        "ssn": lambda: f"{rng.randrange(1000):03d}-{two()}-{rng.randrange(10**4):04d}",
        "phone": lambda: f"{rng.choice(['+1 ', '+1-', ''])}({rng.randrange(1000):03d}) {rng.randrange(1000):03d}-{rng.randrange(10**4):04d}",
        "ip": lambda: ".".join(str(rng.randrange(300)) for _ in range(4)),
        "date": lambda: rng.choice([f"{rng.randrange(1700, 2300)}-{two()}-{two()}", f"{rng.randrange(1, 32):02d}/{rng.randrange(1, 32):02d}/{rng.randrange(1800, 2200)}", f"{rng.randrange(1, 32):02d}.{rng.randrange(1, 13):02d}.1987", f"02/29/{rng.randrange(1896, 1912)}"]),
    }
    values = [(kind, make[kind]()) for kind in make for _ in range(250)]
    docs = spark.createDataFrame([(i, f"x {v} y") for i, (_, v) in enumerate(values)], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in pii.digest(docs, "k").collect()}
    changed = dict.fromkeys(make, 0)
    for i, (kind, v) in enumerate(values):
        want = brute.pseudonym(kind, v, "k")
        assert (got[i]["text"], got[i]["n_found"]) == (f"x {want or v} y", int(want is not None)), (kind, v)
        changed[kind] += want is not None
    assert min(changed.values()) > 15


def test_dates_that_begin_with_the_month_stay_apart(spark):
    days = spark.range(146_097).select(F.date_add(F.lit("1800-01-01").cast("date"), F.col("id").cast("int")).alias("d")).where("day(d) > 12 and year(d) % 7 = 0")
    dates = days.select(F.date_format("d", "MM/dd/yyyy").alias("old")).withColumn("new", pii.pseudonym(F.col("old"), F.lit("k"))["new"]).persist()
    n = dates.count()
    assert dates.where("new is not null and new <> old").count() > 0.99 * n and dates.select("new").distinct().count() == n
    assert dates.where("to_date(new, 'MM/dd/yyyy') is null or int(substr(new, 4, 2)) < 13").count() == 0


def test_pii_stays_in_the_jvm(docs):
    plan = pii.digest(docs, "k")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pipeline(spark, docs, texts, tmp_path):
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, 0), (14, 0)], "doc_id bigint, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    item = next(t for t in texts if t and len(t) > 50_000).split(" ")[200:240]
    spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == [*docs.columns, "n_tokens", "weight", "n_copies"]
    plain = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    lines = [(d, t if old is not None else None) for (d, _, _, t), (_, old) in zip(brute.kept_lines(plain), plain, strict=True)]
    kept = {d for d, _, _, keep in brute.near(lines) if keep}
    rest = [(d, t) for d, t in lines if d in kept]
    dirty = {x[0] for x in brute.decontamination(rest, [(1, " ".join(item))]) if x[5]}
    rows_ = got.collect()
    assert all(r["n_copies"] > 0 for r in rows_) and {r["doc_id"] for r in rows_} <= {d for d, _ in rest} - dirty
    assert not any(" ".join(item[:20]) in (r["text"] or "") for r in rows_)
    assert len(rows_) > len(rest) / 2


def _tables(spark, folder, docs, labels=(), items=()):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id bigint, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(items), "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline_of_empty_tables(spark, none, tmp_path):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, _tables(spark, tmp_path, none))
    assert got.count() == 0 and got.columns == [*none.columns, "n_tokens", "weight", "n_copies"]


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated rows, empty and long texts, other columns with the names that operators use."""
    import corpus_pipeline

    rng = random.Random(21)
    long = words(rng, 30_000, 10**6)
    rows_ = [(None, words(rng, 40), "en", "s", 1), (None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", None, 0), (3, long, None, "s", 9), (3, long, None, "s", 9), (4, words(rng, 60), "de", "t", 4), (4, words(rng, 60), "de", "t", 4)]
    odd = spark.createDataFrame(rows_, SCHEMA).withColumns({c: F.lit(k) for k, c in enumerate(("gone", "of", "__lost", "lost", "hash", "key", "spans", "items", "grade", "_u", "d0", "component_id", "kept", "uid", "ranges"))})
    item = " ".join(long.split(" ")[100:130])
    got = corpus_pipeline.run(spark, _tables(spark, tmp_path, odd, [(4, 0), (None, 1)], [(1, item), (2, None), (None, "x y")]))
    assert got.columns == [*odd.columns, "n_tokens", "weight", "n_copies"]
    out = got.collect()
    assert {r["doc_id"] for r in out} <= {None, 1, 2, 3, 4} and all(r["gone"] == 0 and r["ranges"] == 14 for r in out)
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["decontamination"](spark, odd.where("doc_id = 3"), str(tmp_path)).collect()
    assert len(clean) == 2 and all(item not in r["text"] and r["n_chars"] == len(r["text"]) for r in clean)
    assert all(f(spark, odd, str(tmp_path)).columns == odd.columns for n, f in stages.items() if n != "mixing")
    assert stages["near_dedup"](spark, odd, str(tmp_path)).where("doc_id is null").count() == 2  # in no group


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 11)]


def test_hashes_do_not_depend_on_what_was_hashed_before():
    code = "import sys, pyarrow as pa; from certloom.llm import common as c; f = lambda t: c.Words(*c.raw(pa.array([t])), c.SPACES).hash64().tolist(); long = f('x' * int(sys.argv[1])) if sys.argv[1] != '0' else 0; print(f('ab ba abc Ab'))"
    import subprocess
    import sys
    from pathlib import Path

    out = {subprocess.run([sys.executable, "-c", code, n], capture_output=True, text=True, cwd=Path(__file__).parents[2]).stdout for n in ("0", "70", "5000")}
    assert len(out) == 1
    h = eval(out.pop())
    assert h[0] == h[3] and len(set(h)) == 3

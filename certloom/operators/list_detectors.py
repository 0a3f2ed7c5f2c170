"""The detectors for lists of the configuration that are too long for a plan: the lists are tables, and match by equi-joins.

Findings depend on the name alone, so each distinct name is looked at once and its findings are joined to the
observations. A list is broadcast if it has at most FEW rows, else shuffled. What a name could match is exploded: its
tokens, the strings that deletions leave of a candidate; protected names inside a label are found by an automaton. The
results are those of `detectors`.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ACTION_TERMS, Config
from ..functions import domains as D
from ..functions import suffixes
from ..ship import ship
from . import detectors as base

FEW = 100_000
#: Bytes of words whose automaton each worker builds at most.
MAX_WORD_BYTES = 8 << 20


def _side(table: DataFrame, few: int | None = None) -> DataFrame:
    most = FEW if few is None else few
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def _once(table: DataFrame, least: int = 1) -> DataFrame:
    """(word, at): each word in lower case with its first place."""
    words = table.select(F.lower(F.trim("word")).alias("word"), "at").where(F.octet_length("word") >= least)
    return words.groupBy("word").agg(F.min("at").alias("at"))


def _labelled(words: DataFrame, rules: suffixes.Rules) -> DataFrame:
    """words with the registrable label of each domain among them."""
    named = suffixes.with_registrable(words.withColumn("label", F.regexp_replace("word", "[.]+$", "")), rules, "label", "registrable")
    return named.withColumn("label", F.substring_index("registrable", ".", 1)).drop("registrable")


@dataclass(frozen=True)
class Lists:
    """Tables (word, at), at being the place in the list: keywords, brands, official domains."""

    keywords: DataFrame
    brands: DataFrame
    officials: DataFrame
    rules: suffixes.Rules

    @classmethod
    def of(cls, spark: SparkSession, cfg: Config) -> Lists:
        table = lambda values: spark.createDataFrame([(v, i) for i, v in enumerate(values)], "word string, at bigint")
        return cls(table(cfg.keywords), table(cfg.brands), table(cfg.official_domains), suffixes.rules(cfg.public_suffixes))

    def protected(self) -> DataFrame:
        """Brands, and after them the registrable labels of official domains; three bytes or more."""
        ranked = lambda t, word, rank: t.select(word.alias("word"), F.struct(F.lit(rank).alias("list"), "at").alias("at"))
        known = _labelled(self.officials.withColumn("word", F.lower(F.trim("word"))), self.rules)
        return _once(ranked(self.brands, F.col("word"), 0).union(ranked(known, F.col("label"), 1)), 3)

    def terms(self) -> DataFrame:
        """(word): fixed action terms and keywords."""
        fixed = self.keywords.sparkSession.createDataFrame([(t,) for t in ACTION_TERMS], "word string")
        return _once(fixed.union(self.keywords.select("word")).withColumn("at", F.lit(0))).select("word")


def _exploded(names: DataFrame, parts: str | Column) -> DataFrame:
    """(domain, i, word) for each of the parts, null where there are none, which no join meets.

    Outer: of the other form Spark infers a filter by the size of the array and moves it to where the names come from,
    so that features are made of each name as often as it occurs, and other uses of the names cannot share the exchange.
    """
    return names.select("domain", F.posexplode_outer(parts).alias("i", "word"))


def _words_of(names: DataFrame, words: DataFrame, parts: str | Column = "tokens") -> DataFrame:
    """(domain, words): the words of a list that a name has among its parts, in the order of the list."""
    hits = _exploded(names, parts).select("domain", "word").join(_side(words), "word")
    return hits.groupBy("domain").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]).alias("words"))


def _first(names: DataFrame, finding: Column) -> DataFrame:
    """(domain, at, f) of an array of findings."""
    return names.select("domain", F.posexplode(finding).alias("at", "f")).select("domain", F.col("at").cast("bigint").alias("at"), "f")


def keyword(names: DataFrame, lists: Lists) -> DataFrame:
    return _first(_words_of(names, _once(lists.keywords)), base.keyword_finding(F.col("words")))


def brand(names: DataFrame, lists: Lists) -> DataFrame:
    return _first(_words_of(names, _once(lists.brands)), base.brand_finding(F.col("words")))


def homoglyph(names: DataFrame, lists: Lists) -> DataFrame:
    hits = _words_of(names, lists.protected(), D.skeleton_labels(F.col("skeleton")))
    return _first(names.join(hits, "domain", "left"), base.homoglyph_finding(F.coalesce("words", F.array().cast("array<string>"))))


def _upto(n: Column, made) -> Column:  # noqa: ANN001
    """made(i) for i of 1 to n, none for n under 1."""
    return F.filter(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.when(i <= n, made(i))), lambda x: x.isNotNull())


def _stripped(label: Column) -> Column:
    """array<struct<word, variant, rank>>: what stands beside a hyphen or underscore in a label, from it or up to it, and with it."""
    n = F.length(label)
    at = lambda i, size: F.substr(label, i, size)

    def beside(i: Column) -> Column:
        sep = at(i, F.lit(1))
        rank = F.when(sep == "-", 0).otherwise(2)
        after = _upto(n - i, lambda size: F.struct(at(i + 1, size).alias("word"), at(i, size + 1).alias("variant"), rank.alias("rank")))
        before = _upto(i - 1, lambda size: F.struct(at(i - size, size).alias("word"), at(i - size, size + 1).alias("variant"), (rank + 1).alias("rank")))
        return F.when(sep.isin("-", "_"), F.concat(after, before))

    return F.flatten(_upto(n, beside))


def candidates(names: DataFrame, keywords: DataFrame) -> DataFrame:
    """(domain, reg_label, candidate, place) as functions.domains.squat_candidates, by order of place."""
    label = F.col("reg_label")
    place = lambda stage, at, rank: F.struct(F.lit(stage).alias("stage"), at.cast("bigint").alias("at"), rank.cast("int").alias("rank")).alias("place")
    own = names.select("domain", label, F.posexplode(F.concat(F.array(label), F.split(label, "[^A-Za-z0-9]"))).alias("i", "candidate")).select("domain", "reg_label", "candidate", place(0, F.col("i"), F.lit(0)))
    beside = names.where(label.rlike("[-_]")).select("domain", label, F.inline(_stripped(label))).join(_side(_once(keywords)), "word")
    less = beside.select("domain", "reg_label", F.replace(label, F.col("variant"), F.lit("")).alias("candidate"), place(1, F.col("at"), F.col("rank")))
    both = own.union(less).withColumn("candidate", F.lower("candidate")).where(F.octet_length("candidate") >= 3)
    return both.groupBy("domain", "reg_label", "candidate").agg(F.min("place").alias("place"))


def deletions(word: Column, most: int) -> Column:
    """The word and what is left of it without up to `most` characters."""
    less = lambda w: _upto(F.length(w), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1, F.length(w))))
    out = level = F.array(word)
    for _ in range(most):
        level = F.array_distinct(F.flatten(F.transform(level, less)))
        out = F.concat(out, level)
    return F.array_distinct(out)


def officials_of(officials: DataFrame, rules: suffixes.Rules, max_distance: int) -> DataFrame:
    """(official, official_at, label, most): the label that each official domain is known by, and how far off a name may be."""
    known = _labelled(_once(officials), rules).select(F.col("word").alias("official"), F.col("at").alias("official_at"), F.col("label").alias("own"))
    label = F.when(F.octet_length("own") >= 3, F.col("own")).otherwise(F.substring_index("official", ".", 1))
    n = F.length("label")
    return known.withColumn("label", label).withColumn("most", F.least(F.lit(max_distance), F.when(n <= 4, 1).when(n <= 10, 2).otherwise(3)))


def typosquat(names: DataFrame, lists: Lists, max_distance: int = base.MAX_DISTANCE) -> DataFrame:
    """Two strings within a distance leave a common string after as many deletions each: these are joined, and the distance is then taken."""
    officials = officials_of(lists.officials, lists.rules, max_distance)
    longest = officials.agg(F.max(F.length("label") + F.col("most"))).first()[0]
    if longest is None:
        return _first(names.limit(0), F.array(base.typosquat_finding(F.lit(""), F.lit(""), F.lit(""), F.lit(0))))
    left = candidates(names, lists.keywords).where(F.length("candidate") <= longest).withColumn("rest", F.explode(deletions(F.col("candidate"), max_distance)))
    right = officials.withColumn("rest", F.explode(deletions(F.col("label"), max_distance)))
    near = (F.col("official") != F.col("domain")) & (F.col("candidate") != F.col("label")) & (F.abs(F.length("candidate") - F.length("label")) <= F.col("most"))
    pairs = left.join(_side(right), "rest").where(near).drop("rest").distinct()
    pairs = pairs.withColumn("distance", D.osa_distance(F.col("candidate"), F.col("label"))).where(F.col("distance").between(1, F.col("most")))
    best = pairs.groupBy("domain", "reg_label", "official", "official_at", "label").agg(F.min(F.struct("place", "candidate", "distance")).alias("x"))
    return best.select("domain", F.col("official_at").alias("at"), base.typosquat_finding(F.col("official"), F.col("label"), F.col("x.candidate"), F.col("x.distance")).alias("f"))


_automata: dict[int, object] = {}


def _automaton(words: Broadcast):  # noqa: ANN202
    """The automaton of the words of a broadcast variable, built once in each Python worker."""
    import ahocorasick

    key = id(words.value)
    if key not in _automata:
        _automata.clear()
        made = ahocorasick.Automaton()
        for word in words.value:
            made.add_word(word, word)
        made.make_automaton()
        _automata[key] = made
    return _automata[key]


def contained(names: DataFrame, words: DataFrame, shortest: int, longest: int) -> DataFrame:
    """(domain, reg_label, word): the words that each label has in it, each once.

    One pass of an Aho-Corasick automaton over the label, whatever the number of words; rows are matches only. The
    automaton's words are broadcast if they are counted to have MAX_WORD_BYTES at most. Beyond that, the substrings of
    each label that are as long as words meet the words in an equi-join.
    """
    bytes_ = words.agg(F.sum(F.octet_length("word"))).first()[0] or 0
    if importlib.util.find_spec("ahocorasick") is None or bytes_ > MAX_WORD_BYTES:
        label, n = F.col("reg_label"), F.length("reg_label")
        sizes = F.sequence(F.lit(shortest), F.lit(longest))
        parts = F.array_distinct(F.flatten(F.transform(sizes, lambda size: _upto(n - size + 1, lambda i: F.substr(label, i, size)))))
        return names.select("domain", "reg_label", F.explode(parts).alias("word")).join(_side(words.select("word")), "word")
    ship(names.sparkSession)
    sent = names.sparkSession.sparkContext.broadcast([r[0] for r in words.select("word").collect()])
    schema = pa.schema([(c, pa.string()) for c in ("domain", "reg_label", "word")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _automaton(sent)
            rows = [(domain, label, word) for domain, label in zip(*(c.to_pylist() for c in batch.columns), strict=True) for word in dict.fromkeys(w for _, w in found.iter(label or ""))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], schema=schema)

    return names.select("domain", "reg_label").mapInArrow(run, "domain string, reg_label string, word string")


def composition(names: DataFrame, lists: Lists) -> DataFrame:
    terms = _exploded(names, "tokens").select("domain", "i", "word").join(_side(lists.terms()), "word")
    terms = terms.groupBy("domain").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]).alias("terms"))
    own = names.join(terms, "domain", "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))

    protected = lists.protected()
    shortest, longest = protected.agg(F.min(F.length("word")), F.max(F.length("word"))).first()
    label = F.col("reg_label")
    fired = "array<struct<at: struct<list: int, at: bigint>, kind: int, protected: string, token: string>>"
    if longest is None:
        hits = own.select("domain", F.lit(None).cast(fired).alias("hits")).limit(0)
    else:
        none = F.lit(None).cast("string")
        inside = own.where(F.size("terms") > 0).select("domain", label)
        held = contained(inside, protected, shortest, longest).select("domain", label, F.lit(0).alias("kind"), "word", none.alias("token"), F.lit(0).alias("i"))
        digits = own.select("domain", label, F.lit(1).alias("kind"), D.undo_digits(label).alias("word"), none.alias("token"), F.lit(0).alias("i"))
        tokens = own.select("domain", label, F.lit(2).alias("kind"), F.posexplode_outer("tokens").alias("i", "token")).select("domain", "reg_label", "kind", D.undo_digits(F.col("token")).alias("word"), "token", "i")
        met = held.union(digits).union(tokens).join(_side(protected), "word").where(F.when(F.col("kind") == 2, F.col("token") != F.col("word")).otherwise(label != F.col("word")))
        first = met.groupBy("domain", "at", "kind", "word").agg(F.min_by("token", "i").alias("token"))  # of tokens the first counts
        hits = first.groupBy("domain").agg(F.array_sort(F.collect_list(F.struct("at", "kind", F.col("word").alias("protected"), "token"))).alias("hits"))
    empty = F.array().cast(fired)
    both = own.join(hits, "domain", "left").withColumn("hits", F.coalesce("hits", empty))
    return _first(both, base.composition_finding(F.col("terms"), lambda terms: F.transform("hits", lambda h: base.protected_rule(h["kind"], h["protected"], h["token"]))))


DETECTORS = {"keyword": keyword, "brand": brand, "typosquat": typosquat, "homoglyph": homoglyph, "composition": composition}


def findings(names: DataFrame, lists: Lists, only: list[str] | None = None) -> DataFrame:
    """(domain, position, f) of names with their features; position orders the findings of a name."""
    found = None
    for rank, (name, rows) in enumerate(DETECTORS.items()):
        if only is None or name in only:
            own = rows(names, lists).select("domain", (F.lit(rank << 40) + F.col("at")).alias("position"), "f")
            found = own if found is None else found.unionByName(own)
    return found

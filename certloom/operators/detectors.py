"""Detectors: each compiles a configuration to a column with a finding, or null.

A detector takes the features of a name (see features) and gives struct<detector, score, reasons, evidence>, typosquat
an array of them. Lists of the configuration become literals of the plan.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ACTION_TERMS, Config
from ..functions import domains as D
from ..functions import suffixes

#: Endings that campaigns favour.
RISKY_TLDS = ("best", "cam", "click", "cyou", "icu", "monster", "mov", "quest", "sbs", "support", "top", "wallet", "win", "xyz", "zip")
MAX_DISTANCE = 2

FEATURES = ("labels", "tokens", "reg_label", "unicode", "skeleton")


def features(df: DataFrame, cfg: Config | None = None, domain: str = "domain") -> DataFrame:
    """df with what several detectors need, each computed once. Names of other scripts: see functions.idn.readable."""
    d = F.col(domain)
    rows = suffixes.with_registrable(df, suffixes.rules(cfg.public_suffixes if cfg else None), domain, "reg_label")
    return rows.withColumns({"reg_label": F.substring_index("reg_label", ".", 1), "labels": D.labels(d), "tokens": D.tokens(d), "unicode": d, "skeleton": D.skeleton(d)})


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _evidence(kind: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))


NO_EVIDENCE = "array<struct<kind:string,value:string>>"
RULES = f"array<struct<score:int,reason:string,evidence:{NO_EVIDENCE}>>"


def _finding(detector: str, score: Column, reasons: Column, evidence: Column) -> Column:
    return F.struct(F.lit(detector).alias("detector"), score.cast("int").alias("score"), reasons.cast("array<string>").alias("reasons"), evidence.cast(NO_EVIDENCE).alias("evidence"))


def _clean(values: list[str], least: int = 1) -> list[str]:
    return [v for v in dict.fromkeys(x.strip().lower() for x in values) if len(v.encode()) >= least]


def protected_names(cfg: Config) -> list[str]:
    """Brands, and the registrable labels of official domains."""

    known = suffixes.rules(cfg.public_suffixes)
    label = lambda d: suffixes.registrable(d.strip().lower().rstrip("."), known).split(".")[0]
    return _clean([*cfg.brands, *map(label, cfg.official_domains)], 3)


def _each(kind: str, words: Column, score: Callable[[Column], Column], reason: str) -> Column:
    """An array with the finding of the words that a name has, or without one if it has none."""
    made = F.transform(
        F.array(words),
        lambda m: _finding(kind, score(F.size(m)), F.transform(m, lambda k: F.concat(F.lit(f"{reason} `"), k, F.lit("`"))), F.transform(m, lambda k: _evidence(kind, k))),
    )
    return F.filter(made, lambda f: F.size(f["reasons"]) > 0)


def keyword_finding(words: Column) -> Column:
    return _each("keyword", words, lambda n: 30 + F.least(10 * (n - 1), F.lit(30)), "domain contains suspicious keyword")


def brand_finding(words: Column) -> Column:
    return _each("brand", words, lambda n: F.least(50 + 10 * (n - 1), F.lit(80)), "domain contains protected brand")


def _has_any(text: Column, words: list[str]) -> Column:
    """Whether one of the words stands anywhere in the text: told at once, before arrays are made of it."""
    return reduce(operator.or_, [F.contains(text, F.lit(w)) for w in words], F.lit(False))


def _among_tokens(words: list[str]) -> Column:
    return F.filter(_strings(words), lambda k: F.array_contains(F.col("tokens"), k))


def keyword(cfg: Config) -> Column:
    words = _clean(cfg.keywords)
    return F.when(_has_any(F.lower("domain"), words), keyword_finding(_among_tokens(words))) if words else F.lit(None)


def brand(cfg: Config) -> Column:
    words = _clean(cfg.brands)
    return F.when(_has_any(F.lower("domain"), words), brand_finding(_among_tokens(words))) if words else F.lit(None)


def typosquat_finding(official: Column, label: Column, candidate: Column, distance: Column) -> Column:
    return _finding(
        "typosquat",
        F.when(distance == 1, 85).when(distance == 2, 70).otherwise(55),
        F.array(F.concat(F.lit("domain label candidate `"), candidate, F.lit("` is edit-distance "), distance.cast("string"), F.lit(" from `"), label, F.lit("`"))),
        F.array(_evidence("official_domain", official), _evidence("suspicious_label", F.col("reg_label")), _evidence("candidate_label", candidate), _evidence("distance_algorithm", F.lit("damerau_levenshtein")), _evidence("distance", distance)),
    )


def typosquat(cfg: Config, max_distance: int = MAX_DISTANCE) -> Column:
    """A finding for each official domain that a candidate label is close to; the first such candidate counts."""
    officials = []
    for d in _clean(cfg.official_domains):
        label = protected_names(Config(official_domains=[d], brands=[], public_suffixes=cfg.public_suffixes))
        short = label[0] if label else d.split(".")[0]
        officials.append((d, short, min(max_distance, 1 if len(short) <= 4 else 2 if len(short) <= 10 else 3)))
    if not officials:
        return F.lit(None)
    most = max(m for _, _, m in officials)
    table = F.array(*[F.struct(F.lit(d).alias("domain"), F.lit(s).alias("label"), F.lit(m).alias("most")) for d, s, m in officials])

    def close(candidates: Column, o: Column) -> Column:
        # twice the distance bounds the plain one, which is cheap
        near = F.filter(candidates, lambda c: (c != o["label"]) & (F.abs(F.length(c) - F.length(o["label"])) <= o["most"]) & (D.edit_distance(c, o["label"], 2 * most) >= 0))
        return F.filter(F.transform(near, lambda c: F.struct(c.alias("label"), D.osa_distance(c, o["label"]).alias("distance"))), lambda x: x["distance"].between(1, o["most"]))

    others = F.filter(table, lambda o: o["domain"] != F.col("domain"))
    best = F.transform(F.array(D.squat_candidates(F.col("reg_label"), _clean(cfg.keywords))), lambda cs: F.flatten(F.transform(others, lambda o: F.transform(F.slice(close(cs, o), 1, 1), lambda x: typosquat_finding(o["domain"], o["label"], x["label"], x["distance"])))))
    return F.flatten(best)


def homoglyph(cfg: Config) -> Column:
    shapes = D.skeleton_labels(F.col("skeleton"))
    table = D.LOOKALIKES if cfg.lookalikes is None else D.lookalikes_of(cfg.lookalikes)
    protected = protected_names(cfg)
    made = homoglyph_finding(F.filter(_strings(protected), lambda p: F.array_contains(shapes, p)), table)
    if any(k.isascii() for k in table):
        return made
    return F.when(_has_any(F.col("skeleton"), protected) | ~D.is_ascii(F.col("unicode")), made)


def homoglyph_finding(hit: Column, table: dict[str, str] = D.LOOKALIKES) -> Column:
    """hit: protected names that a name's skeleton has as labels; table: look-alike letters."""
    letters, mixed = D.glyphs(F.col("unicode"), table), D.mixes_scripts(F.col("unicode"))
    none = F.array().cast(NO_EVIDENCE)
    reasons = F.concat(
        F.transform(hit, lambda p: F.concat(F.lit("decoded domain skeleton matches protected name `"), p, F.lit("`"))),
        F.transform(letters, lambda g: F.concat(F.lit("domain contains lookalike character `"), g["glyph"], F.lit("` that may resemble `"), g["letter"], F.lit("`"))),
        F.when(mixed, F.array(F.lit("domain mixes ASCII and non-ASCII letters"))).otherwise(F.array().cast("array<string>")),
    )
    evidence = F.concat(
        F.flatten(F.transform(hit, lambda p: F.array(_evidence("homoglyph.skeleton", F.col("skeleton")), _evidence("homoglyph.protected_name", p)))),
        F.when(F.col("unicode") != F.col("domain"), F.array(_evidence("idn.decoded", F.col("unicode")))).otherwise(none),
        F.transform(letters, lambda g: _evidence("glyph", F.concat(g["glyph"], F.lit("->"), g["letter"]))),
        F.when(mixed, F.array(_evidence("idn.script_mixing", F.lit("ascii+non_ascii")))).otherwise(none),
    )
    return F.filter(F.array(_finding("homoglyph", F.when(F.size(hit) > 0, 85).otherwise(45), reasons, evidence)), lambda f: F.size(f["reasons"]) > 0)


def action_terms(cfg: Config) -> Column:
    known = _strings(_clean([*ACTION_TERMS, *cfg.keywords]))
    return F.filter(F.col("tokens"), lambda t: F.array_contains(known, t))


def _rule(score: Column | int, reason: Column, *evidence: Column) -> Column:
    return F.struct((F.lit(score) if isinstance(score, int) else score).cast("int").alias("score"), reason.alias("reason"), F.array(*evidence).cast(NO_EVIDENCE).alias("evidence"))


def protected_rule(kind: Column, protected: Column, token: Column) -> Column:
    """Kind 0: the label has a protected name beside a term; 1: it is one but for digits; 2: the token is."""
    name, label = _evidence("composition.protected_name", protected), F.col("reg_label")
    like = F.concat(F.lit("` normalizes to protected name `"), protected, F.lit("` after digit substitution"))
    return (
        F.when(kind == 0, _rule(75, F.concat(F.lit("domain combines protected name `"), protected, F.lit("` with security-action term(s)")), name))
        .when(kind == 1, _rule(80, F.concat(F.lit("registrable label `"), label, like), name, _evidence("composition.digit_substitution", D.undo_digits(label))))
        .otherwise(_rule(80, F.concat(F.lit("domain token `"), token, like), name, _evidence("composition.digit_substitution", D.undo_digits(token))))
    )


def composition_finding(terms: Column, protected: Callable[[Column], Column]) -> Column:
    """How a name is put together: action terms, ending, hyphens, depth, then the rules of protected names. The highest score counts."""
    n = F.size("labels")
    tld, hyphens = F.element_at("labels", -1), F.length(F.col("reg_label")) - F.length(F.replace(F.col("reg_label"), F.lit("-"), F.lit("")))

    def rules(terms: Column) -> Column:
        of_terms = F.struct(
            F.when(F.size(terms) >= 3, 55).otherwise(45).alias("score"),
            F.concat(F.lit("domain combines multiple security-action terms: "), F.array_join(terms, ", ")).alias("reason"),
            F.transform(terms, lambda t: _evidence("composition.action_term", t)).alias("evidence"),
        )
        fired = [
            F.when(F.size(terms) >= 2, of_terms),
            F.when(tld.isin(*RISKY_TLDS), _rule(30, F.concat(F.lit("domain uses high-abuse or campaign-friendly TLD `"), tld, F.lit("`")), _evidence("composition.risky_tld", tld))),
            F.when(hyphens >= 2, _rule(F.when(hyphens >= 3, 45).otherwise(35), F.concat(F.lit("registrable label contains "), hyphens.cast("string"), F.lit(" hyphens, a common phishing composition pattern")), _evidence("composition.hyphen_count", hyphens))),
            F.when(n >= 4, _rule(30, F.concat(F.lit("domain uses deep label nesting with "), n.cast("string"), F.lit(" DNS labels")), _evidence("composition.label_count", n))),
        ]
        return F.filter(F.concat(F.array(*fired), protected(terms)), lambda r: r.isNotNull())

    made = F.transform(F.array(terms), rules)
    made = F.transform(made, lambda rs: _finding("composition", F.array_max(F.transform(rs, lambda r: r["score"])), F.transform(rs, lambda r: r["reason"]), F.flatten(F.transform(rs, lambda r: r["evidence"]))))
    return F.filter(made, lambda f: F.size(f["reasons"]) > 0)


def composition(cfg: Config) -> Column:
    label, protected_ = F.col("reg_label"), protected_names(cfg)

    def fired(terms: Column, p: Column) -> Column:
        """The rules of one protected name, in order, null where one does not hold; the plan has them once for all names."""
        token = F.get(F.filter("tokens", lambda t: (t != p) & (D.undo_digits(t) == p)), F.lit(0))
        hit = lambda kind, token: F.struct(F.lit(kind).alias("kind"), p.alias("protected"), token.alias("token"))
        other, none = label != p, F.lit(None).cast("string")
        return F.array(F.when(other & F.contains(label, p) & (F.size(terms) > 0), hit(0, none)), F.when(other & (D.undo_digits(label) == p), hit(1, none)), F.when(token.isNotNull(), hit(2, token)))

    def protected(terms: Column) -> Column:
        if not protected_:
            return F.array().cast(RULES)
        hits = F.filter(F.flatten(F.transform(_strings(protected_), lambda p: fired(terms, p))), lambda h: h.isNotNull())
        return F.transform(hits, lambda h: protected_rule(h["kind"], h["protected"], h["token"]))

    return composition_finding(action_terms(cfg), protected)


Detector = Callable[[Config], Column]
#: In the order in which they run.
DETECTORS: dict[str, Detector] = {"keyword": keyword, "brand": brand, "typosquat": typosquat, "homoglyph": homoglyph, "composition": composition}


def exactly_allowed(cfg: Config) -> list[str]:
    return _clean([*cfg.allowlist, *cfg.official_domains])


def allowed(domain: Column, cfg: Config) -> Column:
    """On the allowlist, an official domain itself, or under an allowed suffix."""
    exact = exactly_allowed(cfg)
    out = domain.isin(*exact) if exact else F.lit(False)
    for suffix in cfg.rules.allowlist_suffixes:
        out = out | D.matches_suffix(domain, suffix)
    return out


def not_allowed_by_join(df: DataFrame, suffixes: DataFrame, domain: str = "domain") -> DataFrame:
    """Rows of df under none of the suffixes (column suffix), for lists too long for a plan: an anti join on all endings of a name."""
    parts = F.split(F.col(domain), "[.]")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.size(parts) - i + 1, i), "."))
    names = df.select(domain).distinct()
    hit = names.select(domain, F.explode(ends).alias("suffix")).join(suffixes.select("suffix").distinct(), "suffix", "left_semi").select(domain).distinct()
    return df.join(hit, domain, "left_anti")


def ct_evidence() -> Column:
    """Where a name was seen, as evidence; what is null is left out."""
    one = lambda kind, c: F.array(_evidence(kind, F.col(c)))
    fields = F.concat(
        one("ct.source_log", "source_log"), one("ct.certificate_index", "certificate_index"), one("ct.certificate_sha256", "certificate_sha256"), one("ct.serial_number", "serial_number"), one("ct.issuer", "issuer"), one("ct.not_before", "not_before"), one("ct.not_after", "not_after"),
        F.transform(F.coalesce("san_dns_names", F.array().cast("array<string>")), lambda s: _evidence("ct.san_dns_name", s)),
        one("ct.observed_at", "observed_at"), one("ct.source_type", "source_type"),
    )
    return F.filter(fields, lambda e: e["value"].isNotNull())

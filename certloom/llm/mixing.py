"""Mixing sources to target weights.

Iterative proportional fitting rakes the token weights of (source, language, topic) cells to target marginals;
documents are then sampled by the calibrated weights.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: A dimension's values: a target share each, or a power that tempers the shares found (1 keeps them, 0 evens them out).
Target = dict[str, float] | float

#: Cells of source x language x topic that the driver rakes, at most: 16 bytes each and their names.
MAX_CELLS = 100_000
TOLERANCE, MAX_ROUNDS = 1e-9, 500


def n_tokens(text: str = "text") -> Column:
    """Words parted by [\\x20\\x09-\\x0D]; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def topic(text: str = "text") -> Column:
    """A plain topic by a text's form, where a table has none of its own: table (cells parted by ' | '), lines (under 400 characters each) or prose; an empty or null text is 'none'."""
    t, lines = F.col(text), F.regexp_count(F.col(text), F.lit("\n")) + 1
    return (
        F.when(t.isNull() | (F.length(t) == 0), "none")
        .when(F.contains(t, F.lit(" | ")), "table")
        .when(F.length(t) < 400 * lines, "lines")
        .otherwise("prose")
    )


def shares(found: dict[str, float], target: Target) -> dict[str, float]:
    """Target shares of the values that have tokens, in all 1. A value that a dict does not name keeps its share."""
    total = sum(found.values())
    if isinstance(target, dict):
        free = sum(v for k, v in found.items() if k not in target) / total
        named = sum(target[k] for k in found if k in target)
        out = {k: target[k] * (1 - free) / named if k in target and named else v / total for k, v in found.items()}
    else:
        out = {k: (v / total) ** target for k, v in found.items()}
    whole = sum(out.values())
    return {k: v / whole for k, v in out.items()}


def rake(cells: dict[tuple[str, ...], float], targets: list[Target], tolerance: float = TOLERANCE, most: int = MAX_ROUNDS) -> dict[tuple[str, ...], float]:
    """Weight of each cell: its tokens times the weight have the target shares in each dimension, and the same total.

    Where the cells that have tokens allow no exact fit, the last round's fit is kept. Cells without tokens weigh 1.
    """
    live = {k: v for k, v in cells.items() if v > 0}
    if not live:
        return dict.fromkeys(cells, 1.0)
    tokens = np.array(list(live.values()), float)
    total, fitted = tokens.sum(), tokens.copy()
    dims = []
    for d, target in enumerate(targets):
        names, index = np.unique([k[d] for k in live], return_inverse=True)
        want = shares(dict(zip(names.tolist(), np.bincount(index, tokens).tolist(), strict=True)), target)
        dims.append((index, np.array([want[n] for n in names.tolist()]) * total))
    for _ in range(most):
        off = 0.0
        for index, want in dims:
            now = np.bincount(index, fitted)
            off = max(off, float(np.abs(now - want).max()) / total)
            fitted = fitted * (want / np.where(now > 0, now, 1))[index]
        if off < tolerance:
            break
    return dict.fromkeys(cells, 1.0) | dict(zip(live, (fitted / tokens).tolist(), strict=True))


def _dimensions(source: Column, language: Column, topic_: Column) -> list[Column]:
    return [F.coalesce(c.cast("string"), F.lit("\x00null")) for c in (source, language, topic_)]


def rake_table(cells: DataFrame, targets: list[Target], tolerance: float = TOLERANCE, most: int = MAX_ROUNDS) -> DataFrame:
    """rake() for cells that are too many for the driver: cells (d0, d1, d2, n) with their weight, by sums and joins for each dimension; the driver only gets how far off the fit is."""
    total = cells.agg(F.sum("n").cast("double")).first()[0] or 0.0
    state = common.shared_table(cells.withColumn("fitted", F.col("n").cast("double")), "raked")
    if not total:
        return state.withColumn("weight", F.lit(1.0)).drop("fitted")
    wants = []
    for d, target in enumerate(targets):
        found = cells.where("n > 0").groupBy(f"d{d}").agg(F.sum("n").cast("double").alias("found"))
        if isinstance(target, dict):
            aim = cells.sparkSession.createDataFrame(list(target.items()) or [(None, None)], f"d{d} string, aim double").where(f"d{d} is not null")
            found = found.join(aim, f"d{d}", "left")
            free, named = found.agg(F.sum(F.when(F.col("aim").isNull(), F.col("found"))), F.sum("aim")).first()
            want = F.when(F.col("aim").isNotNull() & F.lit(bool(named)), F.col("aim") * (1 - (free or 0.0) / total) / (named or 1.0)).otherwise(F.col("found") / total)
        else:
            want = F.pow(F.col("found") / total, F.lit(float(target)))
        want = found.select(f"d{d}", want.alias("want"))
        whole = want.agg(F.sum("want")).first()[0]
        wants.append(common.shared_table(want.select(f"d{d}", (F.col("want") / whole * total).alias("want")), "wanted"))
    for _ in range(most):
        off = 0.0
        for d, want in enumerate(wants):
            now = common.shared_table(state.groupBy(f"d{d}").agg(F.sum("fitted").alias("now")).join(want, f"d{d}"), "now")
            off = max(off, (now.agg(F.max(F.abs(F.col("now") - F.col("want")))).first()[0] or 0.0) / total)
            older, state = state, common.shared_table(state.join(now, f"d{d}", "left").select("d0", "d1", "d2", "n", (F.col("fitted") * F.coalesce(F.col("want") / F.nullif(F.col("now"), F.lit(0.0)), F.lit(1.0))).alias("fitted")), "raked")
            common.forget(older)
            common.forget(now)
        if off < tolerance:
            break
    return state.select("d0", "d1", "d2", "n", F.when(F.col("n") > 0, F.col("fitted") / F.col("n")).otherwise(1.0).alias("weight"))


def mix(docs: DataFrame, source: Column, language: Column, topic_: Column, targets: list[Target], seed: int = 0, names: tuple[str, str, str] = ("n_tokens", "weight", "n_copies"), max_cells: int | None = None) -> DataFrame:
    """docs with three more columns: tokens, calibrated weight and copies drawn (0: not in the sample).

    A document's expected copies are its weight, so the sample's tokens have the target marginals, and as many as
    before, in expectation. The draw depends on seed and doc_id alone; rows that share a doc_id share it, as do those
    without. Null source, language or topic is a value of its own. Null and empty texts have no tokens and the weight
    of their cell; long ones count whole. Columns that already have a name in names are replaced; others stay. Distinct
    cells are summed by Spark; MAX_CELLS of them are raked on the driver, more as a table.
    """
    dims = _dimensions(source, language, topic_)
    cells = docs.select(*[d.alias(f"d{i}") for i, d in enumerate(dims)], n_tokens().alias("n")).groupBy("d0", "d1", "d2").agg(F.sum("n").alias("n"))
    spark, most = docs.sparkSession, max_cells or MAX_CELLS
    rows = cells.limit(most + 1).collect()
    if len(rows) <= most:
        weights = rake({(r[0], r[1], r[2]): float(r[3]) for r in rows}, targets)
        table = F.broadcast(spark.createDataFrame([(*k, w) for k, w in weights.items()], "d0 string, d1 string, d2 string, weight double"))
    else:
        table = rake_table(common.shared_table(cells, "cells"), targets).select("d0", "d1", "d2", "weight")
    *keys, draw, weight = common.fresh(docs, "d0", "d1", "d2", "draw", "weight")
    table = table.select(*[F.col(f"d{i}").alias(f"{k}_of") for i, k in enumerate(keys)], F.col("weight").alias(weight))
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 40)) / float(1 << 40)
    joined = docs.select("*", *[d.alias(k) for k, d in zip(keys, dims, strict=True)], u.alias(draw))
    joined = joined.join(table, [F.col(k) == F.col(f"{k}_of") for k in keys], "left").withColumn(weight, F.coalesce(weight, F.lit(1.0)))
    copies = F.floor(weight) + F.when(F.col(draw) < F.col(weight) - F.floor(weight), 1).otherwise(0)
    mixed = joined.withColumns({names[0]: n_tokens(), names[1]: F.col(weight), names[2]: copies.cast("bigint")})
    return mixed.drop(*keys, *[f"{k}_of" for k in keys], draw, weight)


#: Shares of sources are evened out by half, those of languages and topics by less.
TARGETS: list[Target] = [0.5, 0.7, 0.7]


def mix_documents(docs: DataFrame) -> DataFrame:
    return mix(docs, F.col("source"), F.col("lang"), topic(), TARGETS)

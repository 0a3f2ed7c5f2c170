"""Toxicity by cumulative-link ordinal regression.

P(grade <= g) = logistic(threshold[g] - w.x) over sparse text features: the distinct words of a text and the beginnings
of its words. All thresholds share the weights w; the result is the expected severity grade.

Labels say toxic or not. Grade 0 is not toxic; toxic texts are graded 1 to 3 by how many different features they have
that toxic texts have far more often than others (terciles of the fitted rows).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, fingerprints

#: Features are hashed to 2^18; word beginnings of 4, 5 and 6 bytes count besides the word.
SPACE = 1 << 18
BEGINNINGS = (4, 5, 6)
GRADES = 4
#: Labelled rows that the fit takes at most, half of them toxic if there are as many.
MAX_ROWS = 6000
#: Features that the fit keeps at most: the most telling ones.
MAX_FEATURES = 300
#: Twice the log-likelihood that a feature's counts must gain.
LEAST_GAIN = 20.0


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of every word and word beginning, with repeats."""
    words = common.Words(data, offsets, common.LETTERS)
    sizes = words.end - words.start
    docs, found = [words.doc], [(words.hash64() & np.uint64(SPACE - 1)).astype(np.int64)]
    for n in BEGINNINGS:
        long = sizes > n
        part = common.mix(words.hash64(n)[long] + np.uint64(n))
        docs.append(words.doc[long])
        found.append((part & np.uint64(SPACE - 1)).astype(np.int64))
    return np.concatenate(docs), np.concatenate(found)


@dataclass
class Model:
    weights: np.ndarray  # float32, SPACE
    thresholds: np.ndarray  # GRADES - 1, increasing

    def severity(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade, and P(grade > 0), of each text."""
        data, offsets = common.raw(column)
        score = np.zeros(len(column))
        for lo, hi in common.chunks(offsets):
            doc, found = features(data, offsets[lo : hi + 1])
            tell = self.weights[found] != 0
            pair = np.unique(doc[tell] * SPACE + found[tell])
            score[lo:hi] = np.bincount(pair // SPACE, self.weights[pair % SPACE], minlength=hi - lo)
        above = 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -50, 50)))
        return above.sum(axis=1), above[:, 0]


def sparse(column: pa.Array) -> list[np.ndarray]:
    """The distinct features of each text, in order."""
    data, offsets = common.raw(column)
    out: list[np.ndarray] = []
    for lo, hi in common.chunks(offsets):
        doc, found = features(data, offsets[lo : hi + 1])
        pair = np.unique(doc * SPACE + found)
        edge = np.searchsorted(pair, np.arange(hi - lo + 1) * SPACE)
        out += [(pair[x:y] % SPACE).astype(np.int32) for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
    return out


def telling(in1: np.ndarray, in0: np.ndarray, n1: int, n0: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, log odds) of the features that speak for toxic texts, at most MAX_FEATURES, by how many toxic and other texts have each of SPACE."""
    rate, share = (in1 + in0) / (n1 + n0), n1 / (n1 + n0)
    with np.errstate(divide="ignore", invalid="ignore"):  # how much likelier the counts are if the two kinds differ
        gain = 2 * sum(np.where(x > 0, x * np.log(x / e), 0) for x, e in ((in1, rate * n1), (in0, rate * n0), (n1 - in1, (1 - rate) * n1), (n0 - in0, (1 - rate) * n0)))
    gain[(in1 * (1 - share) <= in0 * share) | (in1 < 3) | (gain < LEAST_GAIN)] = 0
    odds = np.log((in1 + 0.5) / (n1 - in1 + 0.5)) - np.log((in0 + 0.5) / (n0 - in0 + 0.5))
    keep = np.argsort(-gain, kind="stable")[:MAX_FEATURES]
    keep = np.sort(keep[gain[keep] > 0])
    return keep, odds[keep]


def _no_model() -> Model:
    return Model(np.zeros(SPACE, np.float32), np.array([20.0] * (GRADES - 1)))


def ascend(doc: np.ndarray, col: np.ndarray, toxic: np.ndarray, keep: np.ndarray, odds: np.ndarray, rounds: int = 600, ridge: float = 1e-5) -> Model:
    """Fit the cumulative links by ascent of the penalised log-likelihood in adaptive steps. (doc, col): which texts have which of the kept features."""
    if not len(keep):
        return _no_model()
    n_telling = np.bincount(doc, (odds > 1.5)[col], len(toxic))
    cuts = np.quantile(n_telling[toxic == 1], np.arange(1, GRADES - 1) / (GRADES - 1))
    grade = np.where(toxic == 1, 1 + (n_telling[:, None] > cuts[None, :]).sum(axis=1), 0)
    share = np.full(len(toxic), 1 / len(toxic))
    w, sw = np.zeros(len(keep)), np.full(len(keep), 1e-8)
    steps = np.array([0.0, 0.5, 0.5][: GRADES - 1])  # first threshold, then increments
    ss = np.full(len(steps), 1e-8)
    for _ in range(rounds):
        theta = np.cumsum(np.concatenate([steps[:1], np.exp(steps[1:])]))
        score = np.bincount(doc, w[col], len(toxic))
        cdf = 1 / (1 + np.exp(-np.clip(theta[None, :] - score[:, None], -30, 30)))
        cdf = np.concatenate([np.zeros((len(toxic), 1)), cdf, np.ones((len(toxic), 1))], axis=1)
        pdf = cdf * (1 - cdf)
        rows = np.arange(len(toxic))
        p = np.maximum(cdf[rows, grade + 1] - cdf[rows, grade], 1e-12)
        upper, lower = pdf[rows, grade + 1] / p, pdf[rows, grade] / p
        g_score = -(upper - lower) * share  # of the log-likelihood
        g_theta = np.array([(upper * share)[grade == k].sum() - (lower * share)[grade == k + 1].sum() for k in range(GRADES - 1)])
        g_steps = np.array([g_theta[i:].sum() * (1 if i == 0 else np.exp(steps[i])) for i in range(len(steps))])
        g_w = np.bincount(col, g_score[doc], len(keep)) - ridge * w
        sw += g_w**2
        ss += g_steps**2
        w += 0.5 * g_w / np.sqrt(sw)
        steps += 0.5 * g_steps / np.sqrt(ss)
    w[np.abs(w) < 1e-4] = 0
    out = _no_model()
    out.weights[keep] = w
    return Model(out.weights, np.cumsum(np.concatenate([steps[:1], np.exp(steps[1:])])))


def distinct_texts(sketches: list[list[int]]) -> list[int]:
    """Indices of texts of which less than half of the sketch is known from earlier ones: copies would count as evidence."""
    known: set[int] = set()
    out = []
    for i, own in enumerate(sketches):
        if 2 * sum(h in known for h in own) < len(own):
            out.append(i)
            known.update(own)
    return out


_ROWS = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("sketch", pa.list_(pa.int64())), ("features", pa.list_(pa.int32()))])


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, toxic) -> _ROWS."""
    for batch in batches:
        texts = batch.column(1)
        yield common.batch_of(_ROWS, [batch.column(0), batch.column(2), [s.astype(np.int64) for s in fingerprints.sketches(texts, 8)], sparse(texts)])


def chosen_labels(labels: DataFrame, most: int) -> DataFrame | None:
    """(doc_id, toxic) of at most `most` labelled rows, drawn by a hash of doc_id; half toxic if there are as many. None if there are none."""
    labels = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    have = {r[0]: r[1] for r in labels.groupBy("toxic").count().collect()}
    draw = F.xxhash64("doc_id")
    parts = []
    for k, n in have.items():
        cut = common.cut_of(min(1.0, most / 2 / n))
        parts.append(labels.where((F.col("toxic") == k) & (draw <= cut)).orderBy(draw).limit(most // 2))
    return None if not parts else parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_ROWS) -> Model:
    """Fit on a sample of at most `most` labelled rows, drawn by a hash of doc_id; half toxic if there are as many.

    Tasks turn the texts of the sample to features; the driver gets sketches of the sample, counts of features and
    which rows have which of the kept ones. Labels without doc_id or toxic, and those of documents that are not there or
    have no text, are ignored. With labels of one kind only, or none, every text has severity 0.
    """
    common.prepare(docs.sparkSession)
    chosen = chosen_labels(labels, most)
    if chosen is None:
        return _no_model()
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").dropDuplicates(["doc_id"])
    rows = common.shared_table(rows.mapInArrow(_described, "doc_id bigint, toxic int, sketch array<bigint>, features array<int>"), "labelled")
    sample = sorted((r[0], r[1], r[2]) for r in rows.select("doc_id", "toxic", "sketch").collect())
    sample = [sample[i] for i in distinct_texts([r[2] for r in sample])]
    number, toxic = {r[0]: i for i, r in enumerate(sample)}, np.array([r[1] for r in sample], float)
    model = _no_model()
    if len(sample) and toxic.min() != toxic.max():
        own = rows.join(F.broadcast(rows.sparkSession.createDataFrame([(r[0],) for r in sample], "doc_id bigint")), "doc_id", "left_semi").select("doc_id", "toxic", F.explode("features").alias("feature"))
        counts = own.groupBy("toxic", "feature").count().toArrow()  # 2 SPACE rows at most
        kind, feature, times = (counts.column(i).to_numpy() for i in range(3))
        in1, in0 = (np.bincount(feature[kind == k], times[kind == k], SPACE) for k in (1, 0))
        keep, odds = telling(in1, in0, int(toxic.sum()), int((1 - toxic).sum()))
        pairs = own.where(F.col("feature").isin(*keep.tolist())).select("doc_id", "feature").toArrow() if len(keep) else counts.slice(0, 0)  # `most` times MAX_FEATURES rows at most
        doc = np.array([number[d] for d in pairs.column(0).to_pylist()], np.int64)
        model = ascend(doc, np.searchsorted(keep, pairs.column(1).to_numpy()), toxic, keep, odds)
    common.forget(rows)
    return model


def grade(docs: DataFrame, model: Model, text: str = "text") -> tuple[DataFrame, list[str]]:
    """docs with three more columns, whose names are returned: expected severity (0 to 3), grade, P(toxic).

    The grade is the rounded severity. Null and empty texts have the severity of a text without features; of long ones
    every word counts. All rows, repeated ones too, and columns stay.
    """
    common.prepare(docs.sparkSession)
    names = common.fresh(docs, "severity", "grade", "p_toxic")
    schema = common.extended(docs, **dict(zip(names, ("double", "int", "double"), strict=True)))
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, at = to_arrow_schema(schema), docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SPACE weights: 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            severity, p = shared.value.severity(batch.column(at))
            yield common.batch_of(arrow, [*batch.columns, severity, np.rint(severity).astype(np.int32), p])

    return docs.mapInArrow(run, schema), names


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, expected_severity, grade, toxic."""
    out, (severity, grade_, p) = grade(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", F.round(severity, 6).alias("expected_severity"), F.col(grade_).alias("grade"), (F.col(p) >= 0.5).alias("toxic"))


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that are more likely toxic than not."""
    out, (_, _, p) = grade(docs, fit(docs, labels))
    return out.where(F.col(p) < 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])

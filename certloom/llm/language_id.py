"""Language identification in two steps.

Linear support vector machines over relative frequencies of hashed byte trigrams: one against the rest tells the
language family, then one-versus-one machines separate the related languages within it by votes.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: The family of a language code; any other code is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "indic": "hi bn ur mr pa gu",
    "cjk": "zh ja ko",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

BINS = 4096
#: Frequencies are fitted and weighed as so many times as much.
SCALE = 256
#: Labelled rows of each language that the fit takes at most.
MAX_ROWS = 600
#: Rows of all languages together that the fit takes at most.
MAX_TOTAL = 12_000


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each byte trigram, A-Z taken as a-z and all but letters as one blank; edges by document). Each text has a blank before and after it."""
    base = int(offsets[0])
    data, offsets = data[base : int(offsets[-1])], offsets - base
    n = len(offsets) - 1
    fold = np.full(256, 0x20, np.uint8)
    fold[0x61:0x7B] = np.arange(0x61, 0x7B)
    fold[0x41:0x5B] = np.arange(0x61, 0x7B)
    fold[0x80:] = np.arange(0x80, 0x100)
    text = np.insert(fold[data], np.repeat(offsets[1:-1], 2) if n > 1 else [], 0x20)
    text = np.concatenate([[0x20], text, [0x20]]).astype(np.uint32)
    key = (text[:-2] * np.uint32(0x9E3779B1)) ^ (text[1:-1] * np.uint32(0x85EBCA77)) ^ (text[2:] * np.uint32(0xC2B2AE3D))
    key = (key ^ (key >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (key >> np.uint32(20)).astype(np.int64), offsets + 2 * np.arange(n + 1)


def profile(column: pa.Array) -> np.ndarray:
    """(texts, BINS) relative frequencies of trigrams."""
    data, offsets = common.raw(column)
    out = np.zeros((len(column), BINS), np.float32)
    for lo, hi in common.chunks(offsets):
        bins, edge = _trigrams(data, offsets[lo : hi + 1])
        for d in range(hi - lo):
            own = bins[edge[d] : min(edge[d + 1], len(bins))]
            if len(own):
                out[lo + d] = np.bincount(own, minlength=BINS)[:BINS] / len(own)
    return out


def _svm(x: np.ndarray, y: np.ndarray, rounds: int = 12, c: float = 1.0) -> tuple[np.ndarray, float]:
    """Linear SVM (squared hinge loss) by dual coordinate descent; y is +-1."""
    scale = 1.0 / max(1e-12, float(np.sqrt((x * x).sum(axis=1)).mean()))
    x = np.concatenate([x * scale, np.ones((len(x), 1), np.float32)], axis=1)
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    diag = (x * x).sum(axis=1) + 0.5 / c
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(len(x)):
            g = y[i] * float(x[i] @ w) - 1 + alpha[i] * 0.5 / c
            new = max(0.0, alpha[i] - g / diag[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w[:-1] * scale, float(w[-1])


@dataclass
class Model:
    families: list[str]
    languages: list[list[str]]  # of each family
    weights: np.ndarray  # (BINS, machines): the families', then the pairs of each family in order
    bias: np.ndarray

    def predict(self, column: pa.Array) -> tuple[list[str | None], np.ndarray]:
        """The language of each text and a score of 0 to 1; None where nothing was learned."""
        if not self.families:
            return [None] * len(column), np.zeros(len(column))
        data, offsets = common.raw(column)
        margin = np.zeros((len(column), len(self.bias)))
        for lo, hi in common.chunks(offsets, 1 << 19):
            bins, edge = _trigrams(data, offsets[lo : hi + 1])
            if not len(bins):
                continue
            take = np.minimum(edge[:-1], len(bins) - 1)
            sums = np.add.reduceat(self.weights[bins], take, axis=0)
            size = np.maximum(np.minimum(edge[1:], len(bins)) - edge[:-1], 1)
            margin[lo:hi] = sums / size[:, None] * SCALE
        margin += self.bias
        family = np.argmax(margin[:, : len(self.families)], axis=1)
        sigmoid = 1 / (1 + np.exp(-np.clip(4 * margin, -30, 30)))
        out, score, at = np.empty(len(column), object), np.zeros(len(column)), len(self.families)
        for f, names in enumerate(self.languages):
            pairs = list(itertools.combinations(range(len(names)), 2))
            own = family == f
            votes, total = np.zeros((len(column), len(names))), np.zeros((len(column), len(names)))
            for k, (a, b) in enumerate(pairs):
                p = sigmoid[:, at + k]
                votes[:, a] += p >= 0.5
                votes[:, b] += p < 0.5
                total[:, a] += p
                total[:, b] += 1 - p
            at += len(pairs)
            best = np.argmax(votes + total / max(1, len(names)) / 2, axis=1)
            sure = total[np.arange(len(column)), best] / max(1, len(names) - 1) if pairs else np.ones(len(column))
            out[own] = np.array(names, object)[best[own]]
            score[own] = (sigmoid[np.arange(len(column)), family] * sure)[own]
        return out.tolist(), score


def fit_rows(x: np.ndarray, langs: list[str]) -> Model:
    codes = sorted(set(langs))
    family_of = {c: _FAMILY.get(c.lower().split("-")[0], c) for c in codes}
    families = sorted(set(family_of.values()))
    langs_ = np.array(langs, object)
    fam = np.array([family_of[c] for c in langs], object)
    grouped = [[c for c in codes if family_of[c] == f] for f in families]
    machines = [_svm(x, np.where(fam == f, 1.0, -1.0)) if len(families) > 1 else (np.zeros(BINS), 1.0) for f in families]
    for names in grouped:
        for a, b in itertools.combinations(names, 2):
            rows = (langs_ == a) | (langs_ == b)
            machines.append(_svm(x[rows], np.where(langs_[rows] == a, 1.0, -1.0)))
    return Model(families, grouped, np.stack([m[0] for m in machines], axis=1).astype(np.float32) if machines else np.zeros((BINS, 0), np.float32), np.array([m[1] for m in machines]))


def fold() -> Column:
    """crc32 of doc_id as text, modulo 4; rows of remainder 2 are held out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4


def fit(docs: DataFrame, most: int = MAX_ROWS) -> Model:
    """Fit on a sample, drawn by a hash of doc_id, of at most `most` rows of each language, outside the held-out fold.

    Rows without text or language teach nothing. Without any, no language is ever predicted.
    """
    common.prepare(docs.sparkSession)
    learn = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.coalesce(fold(), F.lit(0)) != 2))
    n = {r[0]: r[1] for r in learn.groupBy("lang").count().collect()}
    if not n:
        return Model([], [], np.zeros((BINS, 0), np.float32), np.zeros(0))
    each = min(most, max(1, MAX_TOTAL // len(n)))
    cut = F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(common.cut_of(min(1.0, each / v)))) for k, v in n.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([v.astype(np.float16).tobytes() for v in profile(batch.column(2)) * SCALE], pa.binary())], names=["doc_id", "lang", "x"])

    drawn = learn.where(F.xxhash64("doc_id") <= cut[F.col("lang")]).select("doc_id", "lang", "text")
    rows = drawn.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, lang string, x binary").limit(2 * MAX_TOTAL).collect()
    rows.sort(key=lambda r: (r[1], str(r[0]), bytes(r[2])))
    x = np.stack([np.frombuffer(bytes(r[2]), np.float16) for r in rows]).astype(np.float32) if rows else np.zeros((0, BINS), np.float32)
    return fit_rows(x, [r[1] for r in rows])


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of each row. Null texts and those without a letter are 'und' with score 0."""
    common.prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BINS weights for each machine

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, score = shared.value.predict(batch.column(1))
            letter = np.asarray(batch.column(2))
            langs = [x if ok and x is not None else "und" for x, ok in zip(langs, letter, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(np.where(letter, score, 0.0))], names=["doc_id", "lang_pred", "score"])

    letter = F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False))
    return docs.select("doc_id", F.col(text).alias("text"), letter.alias("letter")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    out = identify(docs, fit(docs))
    return out.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")

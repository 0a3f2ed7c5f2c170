"""Removal of byte strings that repeat anywhere in the corpus.

Every window of LENGTH bytes has an anchor: of its strings of GRAM bytes the one with the least hash, leftmost. Equal
windows have equal anchors, so only windows that share an anchor need comparing. Consecutive windows with the same
anchor are a run; runs whose anchor a pair of Bloom filters has seen twice are gathered by anchor, equal ones once with
their number. A Burrows-Wheeler transform of the different runs of an anchor tells which windows occur in several of
them.

A group whose different runs have more than GROUP_BYTES bytes is not transformed as a whole: its runs are cut into
pieces of fewer windows, by their distance from the anchor, and grouped by all the bytes that the windows of such a
piece must share. Equal pieces go on as one. Groups that are still too large are cut again, down to pieces of one
window, of which a group can hold only one kind; so no task takes more than BLOCK and GROUP_BYTES at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom, bwt, common

U64 = np.uint64
LENGTH, REACH = 400, 256
GRAM = LENGTH - REACH + 1
#: Bytes of the different runs, or pieces, of one group that are transformed together; of more, smaller pieces are.
GROUP_BYTES = 1 << 17
#: Windows of a piece, at most, each time a group is cut.
WIDTHS = (64, 16, 4, 1)
#: Bytes of the groups that one transform takes, but for the last of them.
BLOCK = 1 << 20

_RAW = common.mix(np.arange(7001, 7257, dtype=U64))
_INVERSE = U64(pow(int(common._P), -1, 1 << 64))
_inverse = np.ones(1, U64)


def _inverses(n: int) -> np.ndarray:
    global _inverse
    if len(_inverse) < n:
        size = 1 << (n - 1).bit_length()
        _inverse = np.cumprod(np.concatenate([[U64(1)], np.full(size - 1, _INVERSE, U64)]), dtype=U64)
    return _inverse


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of LENGTH bytes that begins in data and fits, the least hash of its GRAM-byte strings, and whether it begins with it."""
    n = len(data)
    total = np.zeros(n + 1, U64)
    np.cumsum(_RAW[data] * common.powers(n)[:n], out=total[1:])
    h = common.mix((total[GRAM:] - total[:-GRAM]) * _inverses(n)[: n - GRAM + 1])
    blocks = -(-len(h) // REACH)
    padded = np.full(blocks * REACH, ~U64(0))
    padded[: len(h)] = h
    square = padded.reshape(blocks, REACH)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    back = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - LENGTH + 1
    least = np.minimum(back[:m], ahead[REACH - 1 : REACH - 1 + m])
    return least, h[:m] == least


def runs(data: np.ndarray, offsets: np.ndarray, most: int = common.PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(document, first window, windows, anchor, again) of the runs of texts; windows by their first byte in data.

    again: the anchor's bytes come again within the run, as in periodic text, so that its own windows may be equal.

    Texts are taken in blocks of about `most` bytes; a longer text in several, whose windows do not overlap.
    """
    for lo, hi in common.chunks(offsets, most):
        if hi - lo > 1 or offsets[hi] - offsets[lo] <= 2 * most:
            blocks = [(int(offsets[lo]), int(offsets[hi]))]
        else:
            a, b = int(offsets[lo]), int(offsets[hi])
            blocks = [(x, min(b, x + most + LENGTH - 1)) for x in range(a, max(a + 1, b - LENGTH + 1), most)]
        for a, b in blocks:
            if b - a < LENGTH:
                continue
            least, begins = anchors(data[a:b])
            at = np.arange(a, a + len(least))
            doc = np.searchsorted(offsets, at, "right") - 1
            fits = at + LENGTH <= offsets[doc + 1]
            new = np.ones(len(at), bool)
            new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
            first = np.flatnonzero(new & fits)
            number = np.cumsum(new) - 1
            size = np.bincount(number, fits, minlength=number[-1] + 1).astype(np.int64)[number[first]]
            again = np.bincount(number[:-1], begins[:-1] & ~new[1:] & fits[1:], minlength=number[-1] + 1)[number[first]] > 0
            yield doc[first], at[first], size, common.mix(least[first]), again  # least values crowd near zero; mixed, they spread


_KEYS = "uid bigint, doc_id bigint, start bigint, n bigint, again boolean, anchor bigint, set_a bigint, set_b bigint, bytes binary"
_KEYS_ARROW = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("again", pa.bool_()), ("anchor", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("bytes", pa.binary())])


def _values(batch: pa.RecordBatch) -> bloom.Values:
    """Anchors of the runs of a batch (uid, doc_id, text), then once more those that come again within their run; and the runs."""
    found = list(runs(*common.raw(batch.column(2)))) or [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, bool))]
    own = tuple(np.concatenate(x) for x in zip(*found, strict=True))
    doc, anchor, again = own[0], own[3], own[4]
    return np.concatenate([doc, doc[again]]), np.concatenate([anchor, anchor[again]]), own


def _pair(x: bytes) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(x)
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def _suspected(batch: pa.RecordBatch, own: bloom.Values, suspected: np.ndarray) -> pa.RecordBatch:
    """Rows of _KEYS: the runs of a batch (uid, doc_id, text) whose anchor is suspected to repeat."""
    data, offsets = common.raw(batch.column(2))
    doc, first, size, anchor, again = (x[suspected[: len(x)]] for x in own[2])
    texts = [data[a : a + n + LENGTH - 1].tobytes() for a, n in zip(first.tolist(), size.tolist(), strict=True)]
    pairs = [_pair(t) for t in texts]
    return common.batch_of(_KEYS_ARROW, [batch.column(0).take(pa.array(doc)), batch.column(1).take(pa.array(doc)), first - offsets[doc], size, again, anchor.view(np.int64), [p[0] for p in pairs], [p[1] for p in pairs], texts])


def windows_repeated(texts: list[bytes]) -> list[np.ndarray]:
    """For each text, which of its windows occur elsewhere in these texts."""
    joined = b"\x00".join(texts) + b"\x00"
    numbers = np.frombuffer(joined, np.uint8).astype(np.int16) + 1
    ends = np.cumsum([len(t) + 1 for t in texts])
    numbers[ends - 1] = 0  # between texts; windows do not reach over it
    found = bwt.repeated(numbers, LENGTH)
    return [found[e - len(t) - 1 : e - LENGTH] for e, t in zip(ends.tolist(), texts, strict=True)]


#: Ranges of windows of a run.
_RANGES = "array<struct<lo: bigint, hi: bigint>>"
_HITS = f"run_a bigint, run_b bigint, windows {_RANGES}"
_HITS_ARROW = pa.schema([("run_a", pa.int64()), ("run_b", pa.int64()), ("windows", pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))])


def _transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, run_a, run_b, at, bytes) sorted by group, bytes of a group all different -> _HITS: of the runs that they are from, window `at` on, the windows that other bytes of the group have too."""
    rows: list[tuple] = []
    held = 0

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        out = [[], [], []]
        for (_, a, b, at, _), hit in zip(rows, windows_repeated([r[4] for r in rows]) if rows else [], strict=True):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))).reshape(-1, 2) + at
            if len(edge):
                for column, v in zip(out, (a, b, [{"lo": x, "hi": y} for x, y in edge.tolist()]), strict=True):
                    column.append(v)
        return common.batch_of(_HITS_ARROW, out)

    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held >= BLOCK and row[0] != rows[-1][0]:
                yield flush(rows)
                rows, held = [], 0
            rows.append(row)
            held += len(row[4])
    yield flush(rows)


def _transformed(rows: DataFrame) -> DataFrame:
    """rows: (group, run_a, run_b, at, bytes), of groups of GROUP_BYTES at most."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "group").sortWithinPartitions("group", "run_a", "run_b", "at").mapInArrow(_transform, _HITS)


_PIECES = f"run_a bigint, run_b bigint, windows {_RANGES}, times bigint, at bigint, place bigint, group bigint, set_a bigint, set_b bigint, size bigint, bytes binary"
_PIECES_ARROW = pa.schema([*_HITS_ARROW, ("times", pa.int64()), ("at", pa.int64()), ("place", pa.int64()), ("group", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("size", pa.int64()), ("bytes", pa.binary())])


def _places(text: bytes, anchor: int) -> list[int]:
    """Where the string of GRAM bytes with this anchor is."""
    data = np.frombuffer(text, np.uint8)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(_RAW[data] * common.powers(len(data))[: len(data)], out=total[1:])
    h = common.mix((total[GRAM:] - total[:-GRAM]) * _inverses(len(data))[: len(data) - GRAM + 1])
    return np.flatnonzero(common.mix(h) == np.int64(anchor).view(U64)).tolist()


def _cut(width: int):
    """(run_a, run_b, at, place, anchor, bytes) -> _PIECES of width windows at most. place: of the anchor in bytes; null if it is to be found by its hash, as there may be several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for run_a, run_b, at, place, anchor, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                n, begin = len(text) - LENGTH + 1, 0
                found: dict[tuple, list] = {}
                for p in _places(text, anchor) if place is None else [place]:  # each window goes with the leftmost in it
                    end = min(n, p + 1)
                    for j in range((p - end + 1) // width, (p - begin) // width + 1) if begin < end else ():
                        lo, hi = max(begin, p - j * width - width + 1), min(end, p - j * width + 1)
                        core = text[p - j * width : p - j * width - width + 1 + LENGTH]
                        part = text[lo : hi + LENGTH - 1]
                        key = (xxhash.xxh3_64_intdigest(core, seed=j) - (1 << 63), *_pair(part))
                        if key not in found:
                            found[key] = [[], 0, at + lo, p - lo, len(part), part]
                        own = found[key]
                        own[1] += 1
                        if own[0] and own[0][-1]["hi"] >= at + lo:
                            own[0][-1]["hi"] = at + hi
                        else:
                            own[0].append({"lo": at + lo, "hi": at + hi})
                    begin = max(begin, end)
                out += [(run_a, run_b, *own[:4], *key, *own[4:]) for key, own in found.items()]
            yield common.batch_of(_PIECES_ARROW, [list(c) for c in zip(*out, strict=True)] if out else [[]] * len(_PIECES_ARROW))

    return run


def _smaller(rows: DataFrame, width: int) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """rows: (run_a, run_b, at, place, anchor, bytes) of groups that are too large -> what pieces of width tell of them as _HITS, twice; rows of groups that are still too large."""
    pieces = common.shared_table(rows.mapInArrow(_cut(width), _PIECES), "pieces")
    piece = ["group", "set_a", "set_b"]
    one = F.first(F.struct("run_a", "run_b", "at", "place", "bytes")).alias("one")
    kinds = common.shared_table(pieces.groupBy(*piece, "size").agg(F.sum("times").alias("times"), one), "kinds")
    whole = pieces.join(kinds.where("times > 1").select(*piece), piece, "left_semi").select("run_a", "run_b", "windows")
    groups = kinds.groupBy("group").agg(F.count("*").alias("kinds"), F.sum("size").alias("sum")).where("kinds > 1").select("group", (F.col("sum") > GROUP_BYTES).alias("large"))
    groups = common.shared_table(groups, "groups")  # so that a very common group may be split
    several = common.shared_table(kinds.select("group", "one.*").join(groups, "group"), "several")
    return whole, _transformed(several.where("not large").select("group", "run_a", "run_b", "at", "bytes")), several.where("large").select("run_a", "run_b", "at", "place", F.lit(0).cast("bigint").alias("anchor"), "bytes")


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """(uid, doc_id, ranges) of texts with repeated windows: struct<lo, hi> from the first byte to after the last. uid is xxhash64 of the text."""
    common.prepare(docs.sparkSession)
    docs = docs.where(F.octet_length(text) >= LENGTH).select(F.xxhash64(text).alias("uid"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    found = common.shared_table(bloom.suspects(docs, _values, _suspected, _KEYS), "runs")
    places = found.drop("bytes")
    key = ["anchor", "set_a", "set_b"]
    kinds = common.shared_table(places.groupBy(*key).agg(F.count("*").alias("times"), F.bool_or("again").alias("again"), (F.first("n") + LENGTH - 1).alias("size")), "kinds")
    groups = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.bool_or("again").alias("again"), F.sum("size").alias("sum")).where("kinds > 1 or again")
    # Bytes are dealt by their whole key, equal ones as one; only short rows meet by the anchor, which may be very common.
    groups = common.shared_table(groups.select("anchor", (F.col("sum") > GROUP_BYTES).alias("large")), "groups")  # Spark splits no join whose side it sums in the same stage
    wanted = kinds.select(*key).join(groups, "anchor")
    texts = found.select(*key, "bytes").groupBy(*key).agg(F.first("bytes").alias("bytes")).join(wanted, key)
    texts = common.shared_table(texts.select("anchor", F.col("set_a").alias("run_a"), F.col("set_b").alias("run_b"), F.lit(0).cast("bigint").alias("at"), "large", "bytes"), "texts")

    hits = _transformed(texts.where("not large").select(F.col("anchor").alias("group"), "run_a", "run_b", "at", "bytes"))
    large = texts.where("large").select("run_a", "run_b", "at", F.lit(None).cast("bigint").alias("place"), "anchor", "bytes")
    for width in WIDTHS:
        if large.isEmpty():
            break
        whole, apart, large = _smaller(large, width)
        hits = hits.union(whole).union(apart)

    hits = hits.groupBy(F.col("run_a").alias("set_a"), F.col("run_b").alias("set_b")).agg(F.flatten(F.collect_list("windows")).alias("windows"))
    every = F.array(F.struct(F.lit(0).cast("bigint").alias("lo"), F.col("n").alias("hi")))
    known = kinds.join(hits, ["set_a", "set_b"], "left").where("times > 1 or windows is not null").select(*key, "times", "windows")
    marked = places.join(known, key).withColumn("windows", F.when(F.col("times") > 1, every).otherwise(F.col("windows")))
    spans = F.transform("windows", lambda w: F.struct((F.col("start") + w["lo"]).alias("lo"), (F.col("start") + w["hi"] + LENGTH - 1).alias("hi")))
    return marked.groupBy("uid", "doc_id").agg(F.flatten(F.collect_list(spans)).alias("ranges"))


def remove(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of each row: the bytes left where each byte of a string of LENGTH bytes that begins elsewhere too is cut out.

    Strings do not reach over the ends of a text, may overlap, and are judged on the texts as they are; all places of
    a string go. A null text is empty. Rows that are repeated repeat their text, so such texts of LENGTH bytes or more
    go wholly. kept is binary: a cut may part a character.
    """
    ranges = common.shared_table(find(docs, text), "ranges").select(F.col("uid").alias("__uid"), F.col("doc_id").alias("__doc"), "ranges")
    rows = docs.select(F.xxhash64(text).alias("uid"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    hit = bloom.members(ranges.select("__uid"))  # texts without ranges need not move
    rest = bloom.holding(rows, hit, inside=False).select("doc_id", "text", F.lit(None).cast(_RANGES).alias("ranges"))
    moved = bloom.holding(rows, hit)
    rows = moved.join(ranges, (F.col("uid") == F.col("__uid")) & F.col("doc_id").eqNullSafe(F.col("__doc")), "left").select("doc_id", "text", "ranges").union(rest)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.raw(batch.column(1))
            n, gone, spans, kept = [], [], [], []
            for d, own in enumerate(batch.column(2).to_pylist()):
                a, b = int(offsets[d]), int(offsets[d + 1])
                at, out, cut, count = a, [], 0, 0
                end = -1
                for x, y in sorted((r["lo"], r["hi"]) for r in own or ()):
                    if x > end:
                        count += 1
                    out.append(data[at : max(at, a + x)])
                    cut += max(0, y - max(x, end))
                    end = max(end, y)
                    at = max(at, a + y)
                out.append(data[at:b])
                n.append(b - a)
                gone.append(cut)
                spans.append(count)
                kept.append(b"".join(x.tobytes() for x in out))
            yield common.batch_of(schema, [batch.column(0), n, gone, spans, kept])

    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the text that is left, where U+FFFD stands for parted characters."""
    kept = F.make_valid_utf8(F.col("kept").cast("string"))
    return remove(docs.select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), kept.alias("text"))

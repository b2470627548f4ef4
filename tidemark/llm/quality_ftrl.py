"""Document quality: hashed word n-grams, logistic regression, FTRL-proximal.

Words are runs of letters and digits or runs of other signs, as written.  Their
uni- and bigrams are hashed into a fixed number of slots; a document is a sparse
vector of counts, damped by a logarithm and scaled to length one.  Hashes are
computed for whole batches with array operations.

The model is fitted on a bounded sample of the labelled rows and scored over all
documents; its size is fixed, so it is sent to the tasks as it is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize, operator
from .wordsplit import LETTER, NUMBER, SPACE, char_classes, chunks, code_points, span_hashes

SLOTS = 1 << 18
#: Labelled documents the model is fitted on at most: those with the smallest hashes
#: of their id.  Of these, as many as have this number of slots together.
FIT_ROWS, FIT_SLOTS = 12_000, 12_000_000
PASSES = 4
#: Weight of the rarer label 0 in the gradient.
REJECT_WEIGHT = 4.0
#: FTRL-proximal: learning rate, smoothing, L1 and L2.
ALPHA, BETA, L1, L2 = 0.8, 1.0, 0.02, 0.1
CUT = 0.3


def slots_of(texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the text, slot of each of its word uni- and bigrams)."""
    mask = np.uint64(SLOTS - 1)
    held: list[np.ndarray] = []
    open_at = -1
    for owners, parts in chunks(texts):
        joined = "".join(parts)
        lens = np.fromiter(map(len, parts), np.int64, len(parts))
        heads = np.cumsum(lens) - lens
        c = code_points(joined)
        cls = char_classes()[c]
        kind = np.where((cls == LETTER) | (cls == NUMBER), 1, np.where(cls == SPACE, 0, 2))
        edge = np.ones(len(c), bool)
        edge[1:] = kind[1:] != kind[:-1]
        edge[heads[heads < len(c)]] = True
        starts = np.flatnonzero(edge)
        ends = np.append(starts[1:], len(c))
        word = kind[starts] > 0 if len(starts) else np.zeros(0, bool)
        starts, ends = starts[word], ends[word]
        h = span_hashes(c, starts, ends) if len(c) else np.zeros(0, np.uint64)
        h = _mix(h)
        pair = _mix(h[:-1] * np.uint64(3) + h[1:]) if len(h) else h
        bounds = np.searchsorted(starts, np.append(heads, len(c)))
        for owner, a, b in zip(owners, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if owner != open_at:
                if open_at >= 0:
                    yield open_at, np.concatenate(held)
                open_at, held = owner, []
            held.append((h[a:b] & mask).astype(np.int64))
            held.append((pair[a : max(a, b - 1)] & mask).astype(np.int64))
    if open_at >= 0:
        yield open_at, np.concatenate(held)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def vector_of(slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sparse vector of length one: (slots, values)."""
    if not len(slots):
        return slots, np.zeros(0)
    at, n = np.unique(slots, return_counts=True)
    v = 1 + np.log(n)
    return at, v / math.sqrt(float(v @ v))


class Ftrl:
    """Follow-the-regularised-leader with a rate for each coordinate."""

    def __init__(self, slots: int = SLOTS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        # The last place is the bias, which isn't regularised.
        self.z, self.n = np.zeros(slots + 1), np.zeros(slots + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def bias(self) -> float:
        return -self.z[-1] * self.alpha / (self.beta + math.sqrt(self.n[-1]))

    def learn(self, at: np.ndarray, v: np.ndarray, label: int) -> None:
        w, b = self.weights(at), self.bias()
        p = sigmoid(float(w @ v) + b)
        e = (p - label) * (1.0 if label else REJECT_WEIGHT)
        self._step(at, e * v, w)
        self._step(len(self.z) - 1, e, b)

    def _step(self, at, g, w) -> None:
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def fit(docs: DataFrame, known: DataFrame, rows: int = FIT_ROWS, passes: int = PASSES, slots: int = FIT_SLOTS) -> tuple[np.ndarray, float]:
    """(weights, bias) from ``docs`` (``doc_id, text``) and ``known`` (distinct ``doc_id,
    label`` with label 0 or 1).

    Repeats of id, text and label count once.  Hashes of the texts choose the sample,
    and only its texts leave their place: they are turned into slots, and the sample
    (at most ``rows`` documents, and ``slots`` slots unless the first has more) meets in
    one task that learns from them in the order of their hashes.
    """
    keys = ["doc_id", "label", "text_hash"]
    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    labels = known.where(F.col("label").isin(0, 1)).select("doc_id", F.col("label").cast("int").alias("label"))
    chosen = hashed.drop("text").join(labels, "doc_id").select(*keys).distinct().orderBy(F.xxhash64("doc_id"), *keys).limit(rows)
    chosen = materialize(chosen, "chosen")  # at most ``rows`` rows, so it can be broadcast
    known = hashed.join(F.broadcast(chosen), ["doc_id", "text_hash"]).groupBy(*keys).agg(F.any_value("text").alias("text"))

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, labels = b.column(0).to_pylist(), b.column(2).to_pylist()
            for k, found in slots_of([t or "" for t in b.column(1).to_pylist()]):
                at, v = vector_of(found)
                cols = [pa.array([ids[k]], pa.int64()), pa.array([labels[k]], pa.int32()), b.column(3).slice(k, 1), pa.array([at.astype("<i4").tobytes()]), pa.array([v.astype("<f4").tobytes()])]
                yield pa.record_batch(cols, names=["doc_id", "label", "text_hash", "at", "v"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = []
        for b in batches:
            for label, at, v in zip(b.column(1).to_pylist(), b.column(3), b.column(4), strict=True):
                seen.append((np.frombuffer(at.as_buffer(), "<i4"), np.frombuffer(v.as_buffer(), "<f4").astype(np.float64), label))
        model = Ftrl()
        rng = np.random.default_rng(1)
        for _ in range(passes):
            for k in rng.permutation(len(seen)):
                model.learn(*seen[k])
        w = model.weights(slice(0, -1))
        at = np.flatnonzero(w)
        yield pa.record_batch([pa.array([at.astype("<i4").tobytes()]), pa.array([w[at].astype("<f8").tobytes()]), pa.array([model.bias()], pa.float64())], names=["at", "w", "bias"])

    features = known.select("doc_id", "text", "label", "text_hash").mapInArrow(featurize, "doc_id long, label int, text_hash long, at binary, v binary")
    features = materialize(features.withColumn("h", F.xxhash64("doc_id")), "features")
    order = ["h", "doc_id", "label", "text_hash"]
    sizes = features.select(*order, (F.octet_length("at") / 4).cast("long").alias("slots")).collect()  # at most ``rows`` rows
    total, last = 0, None
    for r in sorted(sizes):
        total += r.slots
        if last is not None and total > slots:
            break
        last = tuple(r)[:4]
    if last is not None:
        features = features.where(F.struct(*order) <= F.struct(*[F.lit(x).cast(t) for x, t in zip(last, ("long", "long", "int", "long"), strict=True)]))
    one = features.repartition(1).sortWithinPartitions(*order).select("doc_id", "label", "text_hash", "at", "v")
    w = np.zeros(SLOTS)
    bias = 0.0
    for r in one.mapInArrow(learn, "at binary, w binary, bias double").collect():
        w[np.frombuffer(r.at, "<i4")] = np.frombuffer(r.w, "<f8")
        bias = r.bias
    return w, bias


def quoted(names: list[str]) -> list[Column]:
    """Columns of these very names, dots and all."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def score(docs: DataFrame, model: tuple[np.ndarray, float], keep: list[str], text_col: str = "text") -> DataFrame:
    """``doc, score``: the columns ``keep`` as one structure, in which no name can
    clash, and the probability of label 1 of every whole text."""
    w, bias = model
    source = docs.select(F.struct(*quoted(keep)).alias("doc"), *[c.alias("text") for c in quoted([text_col])])
    schema = source.select("doc").schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            out = np.zeros(len(texts))
            for k, slots in slots_of(texts):
                at, v = vector_of(slots)
                out[k] = sigmoid(float(w[at] @ v) + bias)
            yield pa.record_batch([b.column(0), pa.array(out)], names=["doc", "score"])

    return source.mapInArrow(run, schema)


def held_out(id_col: Column) -> Column:
    """Documents kept apart for evaluation."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def train_on_labels(docs: DataFrame, labels: DataFrame, **kw) -> tuple[np.ndarray, float]:
    """Fit on labelled documents that aren't held out.

    Rows of ``labels`` with a null id or a quality other than 0 and 1 are left
    out; without any labelled document every score is 0.5.
    """
    known = labels.select("doc_id", F.col("quality").alias("label")).where(~held_out(F.col("doc_id"))).distinct()
    return fit(docs.select("doc_id", "text"), known, **kw)


@operator
def quality(docs: DataFrame, labels: DataFrame, cut: float = CUT, **kw) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document.

    Null text is scored as empty; null ids are scored and not held out; repeated
    rows and other columns change nothing; an empty table gives no rows.
    """
    model = train_on_labels(docs, labels, **kw)
    out = score(docs, model, ["doc_id"]).select("doc.*", "score")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


@operator
def reject(docs: DataFrame, labels: DataFrame, cut: float = CUT, **kw) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``cut``, all columns kept,
    whatever their names; nulls, repeats and empty tables as in :func:`quality`."""
    model = train_on_labels(docs, labels, **kw)
    return score(docs, model, docs.columns).where(F.col("score") >= cut).select("doc.*")

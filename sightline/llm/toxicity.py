"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Every coordinate has its own learning rate, and the L1 term keeps weights at exactly zero until their evidence is strong, so
a model is a few thousand (index, weight) pairs that are cheap to send to every executor.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces

BITS = 20
#: Most labelled rows a model is fitted on (chosen by a digest of doc_id); one task holds their features.
MOST_ROWS = 8_000
#: Words of a labelled text that are hashed at a time.
SLICE = 20_000
THRESHOLD = 0.3
#: Most words whose digests a worker remembers.
_CACHE = 100_000
STEMS = (5, 7)

#: Bytes as words are told apart: ASCII letters in lower case, other ASCII but digits and apostrophes a space.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b == 0x27 else 0x20 for b in range(256))
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


@dataclass(frozen=True)
class Settings:
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.5
    passes: int = 2


class _Digests(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


_digests = _Digests()


def features(body: bytes | None) -> np.ndarray:
    """Indices of the text's words, their stems, pairs of neighbours and pairs with one word between, with repeats.

    Stems are a word's first bytes, as many as STEMS says, so that inflected forms share their evidence.
    """
    return _hashed((body or b"").translate(_TABLE).split())


def present(body: bytes | None) -> np.ndarray:
    """The different indices of features(), sorted; a long text is hashed in slices that overlap by two words."""
    words = (body or b"").translate(_TABLE).split()
    if len(words) <= SLICE:
        return np.unique(_hashed(words))
    seen = np.zeros(1 << BITS, bool)
    for at in range(0, len(words), SLICE):
        seen[_hashed(words[at : at + SLICE + 2])] = True
    return np.flatnonzero(seen)


def _hashed(words: list[bytes]) -> np.ndarray:
    n = len(words)
    h = np.fromiter(map(_digests.__getitem__, words), np.uint64, n)
    parts = [h * _MIX[0]]
    for size in STEMS:
        stems = np.fromiter(map(_digests.__getitem__, [w[:size] for w in words]), np.uint64, n)
        parts.append(stems * _MIX[3] + _MIX[2] * np.uint64(size))
    if n > 1:
        parts.append((h[:-1] * _MIX[1] + h[1:]) * _MIX[0])
    if n > 2:
        parts.append((h[:-2] * _MIX[2] + h[2:] * _MIX[3]) * _MIX[0])
    return (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64)


class Ftrl:
    """FTRL-proximal with per-coordinate rates; features are present or not, and the last coordinate is the bias (no L1)."""

    def __init__(self, settings: Settings = Settings()) -> None:
        self.s = settings
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        s, z = self.s, self.z[at]
        l1 = np.where(at == 1 << BITS, 0.0, s.l1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((s.beta + np.sqrt(self.n[at])) / s.alpha + s.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        more = np.sqrt(self.n[at] + g * g)
        self.z[at] += g - (more - np.sqrt(self.n[at])) / self.s.alpha * w
        self.n[at] += g * g


def _fit_batches(settings: Settings):
    def fit(batches):
        rows = []
        for batch in pieces(batches):
            for label, body in zip(batch.column("toxic").to_pylist(), batch.column("body"), strict=True):
                rows.append((label, np.r_[present(body.as_py()), 1 << BITS].astype(np.int32)))
        model = Ftrl(settings)
        for _ in range(settings.passes):
            for label, at in rows:
                model.learn(at, label)
        every = np.arange((1 << BITS) + 1)
        w = model.weights(every)
        keep = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(keep.astype(np.int32)), pa.array(w[keep])], names=["at", "weight"])

    return fit


def held_out(doc_id: Column) -> Column:
    """Whether a document's label must not be learned: crc32 of its id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), most_rows: int = MOST_ROWS) -> dict[int, float]:
    """Weights by index (2 ** BITS is the bias) from labels (doc_id, toxic) that aren't held out; {} without any.

    At most about most_rows labelled rows are used, those whose digest of doc_id is smallest. Null ids or labels are left
    out; of several labels for one id the largest counts, of several texts the one with the smallest digest.
    """
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    if not n:
        return {}
    slot = F.pmod(F.xxhash64(F.col("labelled"), F.lit("toxicity")), F.lit(1 << 30))
    sample = known.filter(slot < int(min(1.0, most_rows / n) * (1 << 30)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("body"))
    rows = texts.join(F.broadcast(sample), F.col("doc_id") == F.col("labelled")).select("doc_id", "toxic", "body")
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min_by("body", F.xxhash64("body")).alias("body"))
    ordered = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "body")
    out = ordered.select("toxic", "body").mapInArrow(_fit_batches(settings), "at int, weight double").collect()
    return {r["at"]: r["weight"] for r in out}


def score_texts(weights: np.ndarray, bias: float, bodies: list[bytes | None]) -> np.ndarray:
    """Probabilities; a text's features count once each, however often they stand in it."""
    out = np.full(len(bodies), bias)
    for i, body in enumerate(bodies):
        at = features(body)
        at = at[weights[at] != 0]
        if len(at):
            out[i] += weights[np.unique(at)].sum()
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def _scorer(docs: DataFrame, model: dict[int, float]):
    keep = docs.sparkSession.sparkContext.broadcast((np.array(list(model), np.int64), np.array(list(model.values()))))

    def dense():
        at, w = keep.value
        table = np.zeros((1 << BITS) + 1)
        table[at] = w
        return table[:-1].astype(np.float64), float(table[-1])

    return dense


def score(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text), from a model of docs' labelled rows.

    A null or empty text gets the bias alone; without labels every score is 0.5. A null id isn't held out.
    """
    dense = _scorer(docs, fit(docs, labels, settings))

    def go(batches):
        weights, bias = dense()
        for batch in pieces(batches):
            p = score_texts(weights, bias, batch.column("body").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], names=["doc_id", "score"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("body"))
    scored = slim.mapInArrow(go, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), threshold: float = THRESHOLD) -> DataFrame:
    """docs with the same columns, without the rows that score at the threshold or above. Without labels nothing goes.

    A null text scores as an empty one. Rows without doc_id are scored like others; repeated rows stay or go together.
    """
    model = fit(docs, labels, settings)
    if not model:
        return docs
    dense = _scorer(docs, model)

    def go(batches):
        weights, bias = dense()
        for batch in pieces(batches):
            bodies = [None if x is None else x.encode() for x in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(score_texts(weights, bias, bodies) < threshold))

    return docs.mapInArrow(go, docs.schema)

"""Substring dedup by content-defined chunking.

A gear hash rolls over the text's bytes; where its top bits are zero a chunk ends. It sees only the last 32 bytes, so after
an insertion the cuts fall into step again, and the same passage in two texts is cut alike. Chunks are compared by a 128-bit
digest; all but the first occurrence in the corpus may go, in runs that are long enough to be a passage.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, pieces

#: Bytes of a chunk: least, most, and the bits of the hash that must be zero (mean about LEAST + 2 ** BITS).
LEAST, MOST, BITS = 16, 128, 5
#: A run of removable chunks shorter than this many bytes is left where it is: a common phrase, no passage.
RUN = 128
_TEMP = 1 << 20

#: The gear: one 32-bit number a byte value, drawn from a seeded digest.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 20240229) for b in range(256)], np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[data[i - j]] << j over the last 32 bytes, by doubling the span five times."""
    h = GEAR[data]
    for shift in (1, 2, 4, 8, 16):
        h[shift:] = h[shift:] + (h[:-shift] << np.uint32(shift))
    return h


def boundaries(body: bytes) -> list[int]:
    """Ends of the chunks, in bytes; never inside a character."""
    n, ends, at = len(body), [], 0
    data = np.frombuffer(body, np.uint8)
    marks: list[np.ndarray] = []
    for s in range(0, n, _TEMP):  # long texts in bounded memory; each part sees the 31 bytes before it
        back = min(s, 31)
        h = gear(data[s - back : s + _TEMP])[back:]
        marks.append(np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + s + 1)
    whole = np.concatenate(marks) if marks else np.empty(0, np.int64)
    inside = whole[whole < n]
    whole = inside[(data[inside] & 0xC0) != 0x80]  # the next byte begins a character
    for end in whole.tolist():
        if end - at < LEAST:
            continue
        while end - at > MOST:
            at = _whole(body, at + MOST)
            ends.append(at)
        if end - at >= LEAST:
            ends.append(end)
            at = end
    while n - at > MOST:
        at = _whole(body, at + MOST)
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def _whole(body: bytes, at: int) -> int:
    while body[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _chunk_batches(batches):
    digest = xxhash.xxh3_128_digest
    for batch in pieces(batches):
        out: tuple[list, ...] = ([], [], [], [], [])
        for d, k, b in zip(batch.column("doc_id").to_pylist(), batch.column("body_id").to_pylist(), batch.column("body"), strict=True):
            body = b.as_py()
            ends = boundaries(body or b"")
            starts = [0, *ends[:-1]]
            out[0].extend([d] * len(ends))
            out[1].extend([k] * len(ends))
            out[2].extend(starts[: len(ends)])
            out[3].extend(ends)
            out[4].extend([digest(body[s:e]) for s, e in zip(starts, ends, strict=False)])
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.binary())], names=["doc_id", "body_id", "start", "end", "digest"])


def chunks(docs: DataFrame) -> DataFrame:
    """doc_id, body_id (digest of the text), start, end (bytes), digest for every chunk of docs (doc_id, text)."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("body_id"), F.col("text").cast("binary").alias("body"))
    return slim.mapInArrow(_chunk_batches, "doc_id long, body_id long, start int, end int, digest binary")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, body_id, repeated (start, end, later of the chunks that stand elsewhere too; later: not their first occurrence).

    Only texts with a repeated chunk have a row; rows that are repeated have one together. Of a digest's occurrences the first
    by doc_id and start stays. Counting combines before it shuffles, so a chunk in a third of all texts is one row a task, and
    the join with the first occurrences can be split.
    """
    rows = chunks(docs)
    # in one number, so that a hash aggregation can keep it; null for a null doc_id
    place = F.expr("cast(cast(doc_id as decimal(20,0)) * 4294967296 + start as decimal(31,0))")
    often = rows.select("digest", place.alias("place")).groupBy("digest").agg(F.count("*").alias("n"), F.min("place").alias("first")).filter("n > 1").select("digest", "first")
    each = F.struct("start", "end", (~place.eqNullSafe(F.col("first"))).alias("later"))
    return beside(rows, often, "digest").groupBy("doc_id", "body_id").agg(F.array_sort(F.collect_set(each)).alias("repeated"))


def runs(chunks_: list[dict]) -> list[dict]:
    """Adjoining chunks as one span each (start, end, n chunks), of those at least RUN long."""
    out: list[dict] = []
    for x in chunks_:
        if out and out[-1]["end"] == x["start"]:
            out[-1]["end"] = x["end"]
            out[-1]["n"] += 1
        else:
            out.append({"start": x["start"], "end": x["end"], "n": 1})
    return [x for x in out if x["end"] - x["start"] >= RUN]


def _cut_batches(batches):
    for batch in pieces(batches):
        rows = []
        for r in batch.to_pylist():
            body, at, parts, repeated = r["body"], 0, [], r["repeated"] or []
            spans = runs([x for x in repeated if x["later"]])
            for s in spans:
                parts.append(body[at : s["start"]])
                at = s["end"]
            text = None if body is None else b"".join([*parts, body[at:]]).decode()
            rows.append({"doc_id": r["doc_id"], "n_bytes": len(body or b""), "n_repeated": sum(x["n"] for x in runs(repeated)), "spans": [{"start": s["start"], "end": s["end"]} for s in spans], "text": text})
        yield pa.RecordBatch.from_pylist(rows, schema=_KEPT)


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_repeated", pa.int64()), ("spans", _SPAN), ("text", pa.string())])


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_repeated, spans (removed bytes, end exclusive), text (what is left) for every row of docs.

    n_repeated counts the chunks in runs of at least RUN bytes of chunks that stand elsewhere too, first occurrences included;
    what is shorter is a common phrase. A null text stays null, an empty one has no chunks. Rows that share doc_id are one
    document for the order: what stands first in it stays in each of them. Rows without doc_id come last, and of a passage that
    stands in such rows alone every copy stays. Repeated rows come back as often. An exact copy of an earlier text loses
    everything but a last run shorter than RUN.
    """
    spans = repeated_spans(docs).select(F.col("doc_id").alias("d"), F.col("body_id").alias("b"), "repeated")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("body_id"), F.col("text").cast("binary").alias("body"))
    both = slim.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("body_id") == F.col("b")), "left")
    return both.select("doc_id", "body", "repeated").mapInArrow(_cut_batches, "doc_id long, n_bytes long, n_repeated long, spans array<struct<start:int,end:int>>, text string")

"""Benchmark decontamination with a generalised suffix automaton over the test items.

The automaton is built once from the normalised items (bounded shards, one after the other if there are very many), sent to
the executors, and every text streams through it: at each word it gives the longest suffix that occurs in some item.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, pieces

WINDOW = 10
#: Most words of benchmark items in one automaton (about 300 bytes a word, so 75 MB in each Python worker); more items make more passes.
SHARD_WORDS = 250_000
#: A pipeline stage drops a document when more than this share of its words is hit.
COVERAGE = 0.5

#: Bytes as they are matched: A-Z in lower case, every ASCII byte that is no letter or digit a space.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(body: bytes | None) -> list[bytes]:
    return (body or b"").translate(_TABLE).split()


class Automaton:
    """Suffix automaton of all items; windows and short items are looked up by the state that spells them."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window, self.vocabulary = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for name, words in items if words]
        for _, tokens in coded:
            at = 0
            for t in tokens:
                at = self._extend(at, t)
        self.shortest = min((min(len(t), window) for _, t in coded), default=window)
        self.owners: dict[int, set[str | None]] = {}
        self.short: dict[int, dict[int, set[str | None]]] = {}
        for name, tokens in coded:
            at = 0
            for i, t in enumerate(tokens):
                at = self.next[at][t]
                if i + 1 >= window:
                    self.owners.setdefault(self._of(at, window), set()).add(name)
            if len(tokens) < window:
                self.short.setdefault(self._of(at, len(tokens)), {}).setdefault(len(tokens), set()).add(name)
        #: For each state, the nearest one up its links (itself included) that ends a short item, else -1.
        self.up = [-1] * len(self.next)
        for s in sorted(range(len(self.next)), key=self.length.__getitem__):
            self.up[s] = s if s in self.short else self.up[self.link[s]] if self.link[s] >= 0 else -1

    def _of(self, state: int, n: int) -> int:
        """The state of the last n words of what state spells."""
        while self.link[state] >= 0 and self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def _copy(self, p: int, t: int, q: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(t) == q:
            self.next[p][t] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, t: int) -> int:
        q = self.next[last].get(t)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._copy(last, t, q)
        new, p = len(self.next), last
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        while p >= 0 and t not in self.next[p]:
            self.next[p][t] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][t]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._copy(p, t, q)
        return new

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set, int]:
        """Which words are hit, the items whose windows occur, and the longest match in words."""
        n = len(words)
        hit, found, longest = np.zeros(n, bool), set(), 0
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), np.int32, n)
        known = np.flatnonzero(np.diff(np.r_[False, ids >= 0, False]))
        for s, e in zip(known[::2].tolist(), known[1::2].tolist(), strict=True):
            if e - s < self.shortest:
                continue  # no window fits between words that no item has
            state = matched = 0
            for i, t in enumerate(ids[s:e].tolist(), s):
                while state and t not in self.next[state]:
                    state = self.link[state]
                    matched = self.length[state]
                if t not in self.next[state]:
                    continue
                state, matched = self.next[state][t], matched + 1
                longest = max(longest, matched)
                if matched >= self.window:
                    hit[i + 1 - self.window : i + 1] = True
                    found |= self.owners[self._of(state, self.window)]
                up = self.up[state]
                while up >= 0:
                    for k, names in self.short[up].items():
                        if k <= matched:
                            hit[i + 1 - k : i + 1] = True
                            found |= names
                    up = self.up[self.link[up]] if self.link[up] >= 0 else -1
        return hit, found, longest


@dataclass(frozen=True)
class Limits:
    """What is removed: the hit spans of at least min_words words; the whole document beyond the coverage."""

    min_words: int = 1
    coverage: float = COVERAGE


def shards(benchmark: DataFrame, most: int = SHARD_WORDS):
    """Lists of (item id as a string or None, words), each of at most `most` words unless one item alone is longer."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("binary").alias("b")).orderBy("i", "b")
    held, size = [], 0
    for row in rows.toLocalIterator():
        words = words_of(row.b)
        if held and size + len(words) > most:
            yield held
            held, size = [], 0
        held.append((row.i, words))
        size += len(words)
    yield held


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.r_[False, hit, False]))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


_FOUND = "doc_id long, body binary, n_words long, longest long, spans array<struct<start:long,end:long>>, items array<string>"


def annotate(docs: DataFrame, benchmark: DataFrame, most: int = SHARD_WORDS) -> DataFrame:
    """doc_id, n_words, longest (longest match in words), spans (hit runs of words, end exclusive), items (sorted ids).

    docs: doc_id, text; a null text has no words. benchmark: item_id, text; items without words match nothing, an item
    without an id hits words but isn't named, rows that share an item_id are one item with several texts. Repeated rows of
    docs come back as often. Each pass over the texts holds one bounded automaton.
    """
    spark, window = docs.sparkSession, WINDOW
    kind = T._parse_datatype_string(_FOUND)
    out = None
    for items in shards(benchmark, most):
        shared = spark.sparkContext.broadcast(Automaton(items, window))

        def go(batches, shared=shared):
            machine = shared.value
            for batch in pieces(batches):
                rows = []
                for r in batch.to_pylist():
                    words = words_of(r["body"])
                    hit, found, longest = machine.scan(words)
                    for span in r["spans"] or ():
                        hit[span["start"] : span["end"]] = True
                    names = sorted({x for x in found if x is not None} | set(r["items"] or ()))
                    rows.append(r | {"n_words": len(words), "longest": max(longest, r["longest"]), "spans": [{"start": s, "end": e} for s, e in _runs(hit)], "items": names})
                yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)

        if out is None:
            body = F.col("text").cast("binary")
            out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("body"), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("longest"), F.lit(None).cast(kind["spans"].dataType).alias("spans"), F.lit(None).cast(kind["items"].dataType).alias("items"))
        else:
            out = cut(out)
        out = out.mapInArrow(go, kind)
    return out.drop("body")


def digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(names).encode()).hexdigest()


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs."""
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    out = annotate(docs, benchmark).withColumn("n_hit", hits)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _without(body: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without these spans of words."""
    places = [m.span() for m in _WORD.finditer(body.translate(_TABLE))]
    at, parts = 0, []
    for s, e in spans:
        parts.append(body[at : places[s][0]])
        at = places[e - 1][1]
    return b"".join([*parts, body[at:]])


def cleaned(body: bytes, machine: Automaton, limits: Limits) -> bytes | None:
    """The text without its hit spans, until none is left; None where they cover too much of it."""
    words = words_of(body)
    total, removed = len(words), 0
    while True:
        hit, _, _ = machine.scan(words)
        spans = [(s, e) for s, e in _runs(hit) if e - s >= limits.min_words]
        if not spans:
            return body
        removed += sum(e - s for s, e in spans)
        if removed > limits.coverage * total:
            return None
        body = _without(body, spans)
        words = words_of(body)


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _replaced(batch: pa.RecordBatch, name: str, values: list) -> pa.RecordBatch:
    at = batch.schema.get_field_index(name)
    columns = batch.columns
    columns[at] = pa.array(values, batch.schema.field(at).type)
    return pa.RecordBatch.from_arrays(columns, schema=batch.schema)


def _marked(docs: DataFrame, shared) -> DataFrame:
    """docs with this automaton's hits added to __spans."""

    def go(batches):
        machine = shared.value
        for batch in pieces(batches):
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("__spans").to_pylist(), strict=True):
                hit, _, _ = machine.scan(words_of(None if text is None else text.encode()))
                for s in spans:
                    hit[s["start"] : s["end"]] = True
                out.append([{"start": s, "end": e} for s, e in _runs(hit)])
            yield _replaced(batch, "__spans", out)

    return docs.mapInArrow(go, docs.schema)


def _shortened(docs: DataFrame, limits: Limits) -> DataFrame:
    """docs without the texts' __spans; __removed counts them, __state is 0 where there were none, 1 after a cut, 2 beyond the coverage."""

    def go(batches):
        for batch in pieces(batches):
            texts, removed, states = [], [], []
            names = ("text", "__spans", "__total", "__removed")
            for text, spans, total, before in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                body = None if text is None else text.encode()
                total = len(words_of(body)) if total is None else total
                cuts = [(s["start"], s["end"]) for s in spans if s["end"] - s["start"] >= limits.min_words]
                gone = before + sum(e - s for s, e in cuts)
                state = 0 if not cuts else 2 if gone > limits.coverage * total else 1
                texts.append(_without(body, cuts).decode() if state == 1 else text)
                removed.append((total, gone))
                states.append(state)
            for name, values in (("text", texts), ("__spans", [[]] * len(texts)), ("__total", [t for t, _ in removed]), ("__removed", [g for _, g in removed]), ("__state", states)):
                batch = _replaced(batch, name, values)
            yield batch

    return docs.mapInArrow(go, docs.schema)


def _over_shards(docs: DataFrame, benchmark: DataFrame, limits: Limits, most: int) -> DataFrame:
    """What cleaned() does with one automaton of all items: a round marks the hits of every shard, then cuts; rounds go on until none hits."""
    spark = docs.sparkSession
    started = {"__total": F.lit(None).cast("long"), "__removed": F.lit(0).cast("long"), "__state": F.lit(1)}
    live = docs.withColumns(started | {"__spans": F.array().cast(_SPANS)})
    done = None
    while True:
        for items in shards(benchmark, most):
            live = cut(_marked(live, spark.sparkContext.broadcast(Automaton(items))))
        live = cut(_shortened(live, limits))
        ready = live.filter("__state = 0")
        done = ready if done is None else done.unionByName(ready)
        live = live.filter("__state = 1")
        if live.isEmpty():
            return done.select(*docs.columns)


def decontaminate(docs: DataFrame, benchmark: DataFrame, limits: Limits = Limits(), most: int = SHARD_WORDS) -> DataFrame:
    """docs with the same columns: hit spans cut out of text (n_chars follows, where there is one), documents beyond the coverage limit left out.

    Null texts stay null. Rows are independent of each other: those without doc_id and repeated ones are treated like any. An
    empty table stays empty. The result doesn't depend on how many shards the items make.
    """
    spark = docs.sparkSession
    each = shards(benchmark, most)
    items = next(each)
    if next(each, None) is not None:
        out = _over_shards(docs, benchmark, limits, most)
    else:
        shared = spark.sparkContext.broadcast(Automaton(items))

        def go(batches):
            machine = shared.value
            for batch in pieces(batches):
                old = [None if x is None else x.encode() for x in batch.column("text").to_pylist()]
                new = [None if b is None else cleaned(b, machine, limits) for b in old]
                keep = pa.array([b is not None or a is None for a, b in zip(old, new, strict=True)])
                yield _replaced(batch, "text", [None if b is None else b.decode() for b in new]).filter(keep)

        out = docs.mapInArrow(go, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return out

"""SimHash near-duplicates by pigeonring filtering.

A 64-bit fingerprint is cut into a ring of eight segments of eight bits. If two fingerprints differ in at most three bits,
then from some segment on every chain of l consecutive segments differs in at most 3 * l / 8 bits: none in the first two
segments, at most one in the first five, at most two in the first seven. So two exact segments and two more of the next
three make an equality key of 32 bits (24 keys a fingerprint); only fingerprints that share one meet, and a pair must keep
within the chain's budgets before the full Hamming distance is taken.

The corpus stage takes fingerprints of its own shingles and finds what is within three bits the same way. Texts with a Jaccard
similarity of 0.8 differ in some ten of 64 bits, often in fifteen; no key that such a budget leaves is selective. So the stage
adds candidates from bands of minima over the same shingles, and compares the candidates of both exactly.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, components, cut, pieces, release

SEGMENTS, BUDGET = 8, 3
#: A key shared by more fingerprints than this is made longer twice, and then dealt out as pairs of blocks of this size.
BLOCK = 4096
#: Most texts that are looked up by sending their digests to every executor.
BROADCAST_IDS = 500_000
_SEED = 42


def _ring(first: int, which: tuple[int, ...]) -> int:
    """Mask of the segments first + w on the ring."""
    return sum(0xFF << 8 * ((first + w) % SEGMENTS) for w in which)


#: Key k belongs to the chains that start at segment k // 3.
KEY_MASKS = [_ring(i, (0, 1, *two)) for i in range(SEGMENTS) for two in ((2, 3), (2, 4), (3, 4))]
#: By first segment: (mask of the chain of l segments, bits that may differ in it), where a longer chain doesn't imply it.
CHAINS = [[(_ring(i, tuple(range(n))), n * BUDGET // SEGMENTS) for n in (2, 5, 7, 8)] for i in range(SEGMENTS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(body: bytes | None) -> int:
    """64-bit SimHash of the text's 3-word shingles (all of them, repeats included), 0 for a text without words."""
    words = (body or b"").lower().split()
    n = len(words)
    if n < 3:
        return xxhash.xxh64_intdigest(b" ".join(words), _SEED) if n else 0
    text = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n - 2, 65536):  # long texts in bounded memory
        to = min(at + 65536, n - 2)
        counts += _ones(np.fromiter((digest(text[s : e - 1], _SEED) for s, e in zip(starts[at:to], ends[at + 2 : to + 2], strict=True)), np.uint64, to - at))
    return _majority(counts, n - 2)


def _ones(hashes: np.ndarray) -> np.ndarray:
    """In how many of the hashes each of the 64 bits is set."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _majority(counts: np.ndarray, n: int) -> int:
    """The bits set in over half of n hashes."""
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprint_batches(batches):
    for batch in pieces(batches, 2048):
        marks = np.fromiter((_signed(fingerprint(b.as_py())) for b in batch.column("body")), np.int64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(marks)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (bigint) for every row of docs (doc_id, text; other columns are ignored). A null text has no words."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("body"))
    return slim.mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def _within(x: np.ndarray, chains) -> np.ndarray:
    """Which differences keep every budget of the chains; the last of them is the full Hamming check."""
    good = np.ones(len(x), bool)
    for mask, most in chains:
        live = np.flatnonzero(good)
        if not len(live):
            break
        good[live] = np.bitwise_count(x[live] & np.uint64(mask)) <= most
    return good


def _span(values: np.ndarray, chains, out: list) -> None:
    """Adds links that span every component of a run: each value is compared once with those not yet reached."""
    left = values.astype(np.uint64)
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            one = queue.pop()
            near = _within(left ^ one, chains)
            if near.any():
                found = left[near]
                out.append((np.full(len(found), one), found))
                queue.extend(found)
                left = left[~near]


def _linked(batches):
    rest_k, rest_f = np.empty(0, np.int64), np.empty(0, np.int64)

    def runs(k, f):
        out: list = []
        edges = np.flatnonzero(np.r_[True, k[1:] != k[:-1], True])
        sizes = np.diff(edges)
        for s, n in zip(edges[:-1][sizes > 1], sizes[sizes > 1], strict=True):
            _span(np.unique(f[s : s + n]), CHAINS[(int(k[s]) & 31) // 3], out)
        if out:
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        k = np.concatenate([rest_k, batch.column("key").to_numpy(zero_copy_only=False)])
        f = np.concatenate([rest_f, batch.column("fp").to_numpy(zero_copy_only=False)])
        if not len(k):
            continue
        last = int(np.searchsorted(k, k[-1]))  # rows come sorted by key; the last run may go on
        rest_k, rest_f = k[last:], f[last:]
        yield from runs(k[:last], f[:last])
    yield from runs(rest_k, rest_f)


def _pieces(mask: int) -> list[int]:
    """The mask's bits in BUDGET + 1 parts; three differing bits leave one of them alike."""
    bits = [b for b in range(64) if mask >> b & 1]
    n = len(bits)
    return [sum(1 << b for b in bits[n * j // (BUDGET + 1) : n * (j + 1) // (BUDGET + 1)]) for j in range(BUDGET + 1)]


def _longer(keys: DataFrame, masks: list[int]) -> DataFrame:
    """fp, key, at for each part of what a key hasn't used yet. at: which part a key took last; masks: by at, the parts to choose from."""
    table = F.array(*(F.array(*(F.lit(_signed(x)) for x in _pieces(m))) for m in masks))
    each = keys.select("fp", "key", "at", F.posexplode(F.get(table, F.col("at"))).alias("j", "mask"))
    key = F.xxhash64("key", "j", F.col("fp").bitwiseAND(F.col("mask"))).bitwiseAND(F.lit(-32)).bitwiseOR(F.col("key").bitwiseAND(F.lit(31)))
    return each.select("fp", key.alias("key"), (F.col("at") * (BUDGET + 1) + F.col("j")).alias("at"))


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between different fingerprints at most three bits apart, enough of them to join all that are linked.

    prints: one column fp, distinct. What a frequent key hasn't used is cut into four parts of which a link leaves one alike; so
    it becomes four longer keys, and each of these once more. A key of 46 bits that is still frequent holds at most 2 ** 18
    fingerprints and is dealt out as pairs of blocks, so no task holds it alone.
    """
    tagged = [F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(_signed(m)))).bitwiseAND(F.lit(-32)).bitwiseOR(F.lit(k)) for k, m in enumerate(KEY_MASKS)]
    keys = prints.select("fp", F.posexplode(F.array(*tagged)).alias("at", "key")).select("fp", "key", "at")
    masks, done = [~m & (1 << 64) - 1 for m in KEY_MASKS], []
    for _ in range(2):
        heavy = cut(keys.groupBy("key").count().filter(F.col("count") > BLOCK))
        if heavy.isEmpty():
            break
        few = F.broadcast(heavy.select("key")) if heavy.count() <= BROADCAST_IDS else heavy.select("key")
        done.append(keys.join(few, "key", "left_anti").select("fp", "key"))
        keys = cut(_longer(keys.join(few, "key", "left_semi"), masks))
        masks = [m & ~x for m in masks for x in _pieces(m)]
    else:
        heavy = cut(keys.groupBy("key").count().filter(F.col("count") > BLOCK))
        if not heavy.isEmpty():
            blocks = F.ceil(F.col("count") / BLOCK).cast("int")
            own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
            spread = keys.join(heavy, "key", "left").select("fp", "key", blocks.alias("n"), own.alias("own"))
            pairs = F.when(F.col("n").isNull(), F.array(F.lit(-1))).otherwise(F.expr("sequence(0, n - 1)"))
            spread = spread.select("fp", "key", "own", F.explode(pairs).alias("other"))
            mixed = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).bitwiseAND(F.lit(-32)).bitwiseOR(F.col("key").bitwiseAND(F.lit(31)))
            keys = spread.select("fp", F.when(F.col("other") < 0, F.col("key")).otherwise(mixed).alias("key"))
    keys = reduce(DataFrame.union, [*done, keys.select("fp", "key")])
    return keys.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_linked, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs (doc_id, text).

    Fingerprints link at three or fewer differing bits; component_id is the smallest doc_id that links reach, the row's own
    included (nulls don't count; null if there is no other). Empty and null texts share fingerprint zero. Repeated rows come
    back as often as they came in. Exact copies share a fingerprint and are joined by it, never paired.
    """
    marks = cut(fingerprints(docs))
    first = marks.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(first.select("fp")))
    placed = cut(first.join(roots, first.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    final = beside(placed, least, "root").select("fp", "component_id")
    return marks.join(final, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: The corpus stage: words in a shingle, and the least Jaccard similarity of the texts' sets of shingles.
WIDTH, SIMILAR = 5, 0.8
#: Texts meet that agree in all minima of a band. At a similarity of 0.8 no band agrees with probability 6e-5, at 0.9 with 1e-10.
BANDS, MINIMA = 32, 6
#: Most texts of a candidate group that one task compares with each other; larger groups are dealt out.
GROUP = 256
#: Most heads of larger groups whose texts are sent to every executor; more are joined by a shuffle.
BROADCAST_HEADS = 2_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = np.random.default_rng(_SEED).integers(0, 1 << 64, (2, BANDS * MINIMA), np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x = (x ^ y) * _STEP
    return x ^ x >> np.uint64(32)


def shingles(body: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted 64-bit digests of the text's different shingles; of a text with fewer words, one of all of them."""
    words = (body or b"").lower().split()
    n = len(words) - width + 1
    if n < 1:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), _SEED)] if words else [], np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = _mixed(out, h[k : n + k])
    return np.unique(out)


def set_fingerprint(held: np.ndarray) -> int:
    """64-bit SimHash of a set of shingles as shingles() gives it, 0 for an empty one."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(held), 65536):
        counts += _ones(held[at : at + 65536])
    return _majority(counts, len(held))


def _bands(held: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A key for each of so many bands of minima of the set; none for an empty set."""
    if not len(held) or not bands:
        return np.empty(0, np.int64)
    least = np.full(bands * MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(held), 2048):  # long texts in bounded memory
        least = np.minimum(least, ((held[at : at + 2048, None] ^ _FACTORS[1, : len(least)]) * _FACTORS[0, : len(least)]).min(axis=0))
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for column in least.reshape(bands, MINIMA).T:
        key = _mixed(key, column)
    return key.view(np.int64)


def alike(a: np.ndarray, b: np.ndarray, similar: float) -> bool:
    """Whether two sets' Jaccard similarity is at least `similar`."""
    if min(len(a), len(b)) < similar * max(len(a), len(b)) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similar * (len(a) + len(b) - both) - 1e-9


def _sketches(width: int, bands: int):
    def go(batches):
        for batch in pieces(batches, 1024):
            sets, marks, keys = [], [], []
            for b in batch.column("body"):
                body = b.as_py()
                held = shingles(body, width)
                sets.append(_signed(xxhash.xxh64_intdigest(b" ".join((body or b"").lower().split()), _SEED)))
                marks.append(_signed(set_fingerprint(held)))
                keys.append(_bands(held, bands))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("raw"), pa.array(sets, pa.int64()), pa.array(marks, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "raw", "set_id", "fp", "keys"])

    return go


def _near_head(width: int, similar: float):
    def go(batches):
        last, head = None, None
        for batch in pieces(batches):
            near = []
            for r in batch.to_pylist():
                if r["root"] != last:
                    last, head = r["root"], shingles(r["head"], width)
                near.append(alike(head, shingles(r["body"], width), similar))
            yield pa.RecordBatch.from_arrays([batch.column("root"), batch.column("node"), pa.array(near, pa.bool_())], names=["root", "node", "near"])

    return go


def _alike_batches(width: int, similar: float):
    """Links that span what is alike in each run of rows with one key; every text is compared once with those not yet reached."""

    def span(held):
        out, left = [], list(held)
        while left:
            queue, left = [left[0]], left[1:]
            while queue and left:
                one, rest = queue.pop(), []
                for x in left:
                    if alike(held[one], held[x], similar):
                        out.append((one, x))
                        queue.append(x)
                    else:
                        rest.append(x)
                left = rest
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    def go(batches):
        last, held = None, {}
        for batch in pieces(batches):
            for r in batch.to_pylist():
                if r["key"] != last:
                    yield span(held)
                    last, held = r["key"], {}
                if r["node"] not in held:
                    held[r["node"]] = shingles(r["body"], width)
        yield span(held)

    return go


def similar_links(held: DataFrame, width: int = WIDTH, similar: float = SIMILAR) -> DataFrame:
    """Links (a, b) that join all texts of a group that are alike. held: root (the group, its smallest node), node, body, one row a node.

    A group of more than GROUP texts is first compared with its head; only texts that aren't alike to it are then compared
    with all others, in pairs of blocks. A group of near copies thus costs one comparison a text, however large it is.
    """
    sizes = cut(held.groupBy("root").count().filter(F.col("count") > GROUP))
    verify = _alike_batches(width, similar)
    small = held.join(F.broadcast(sizes), "root", "left_anti").select(F.col("root").alias("key"), "node", "body")
    out = small.repartition("key").sortWithinPartitions("key").mapInArrow(verify, "a long, b long")
    many = sizes.count()
    if not many:
        return out
    large = held.join(F.broadcast(sizes), "root")
    heads = large.filter("node = root").select("root", F.col("body").alias("head"))
    with_head = large.filter("node <> root").join(F.broadcast(heads) if many <= BROADCAST_HEADS else heads, "root").select("root", "node", "body", "head")
    checked = cut(with_head.mapInArrow(_near_head(width, similar), "root long, node long, near boolean"))
    out = out.unionByName(checked.filter("near").select(F.col("node").alias("a"), F.col("root").alias("b")))
    left = checked.filter(~F.col("near")).select("root", "node")
    deal = cut(left.groupBy("root").agg(F.count("*").alias("n_left")).join(sizes, "root").select("root", F.ceil(F.col("n_left") / GROUP).cast("int").alias("nl"), F.ceil(F.col("count") / GROUP).cast("int").alias("na")))
    own_left, own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("nl")).cast("int"), F.pmod(F.xxhash64("node"), F.col("na")).cast("int")
    dealt = large.select("root", "node", "body").join(F.broadcast(deal), "root")
    every = dealt.select("root", "node", "body", F.explode(F.expr("sequence(0, nl - 1)")).alias("i"), own.alias("j"))
    some = dealt.join(left.select("node"), "node", "left_semi").select("root", "node", "body", own_left.alias("i"), F.explode(F.expr("sequence(0, na - 1)")).alias("j"))
    blocks = every.unionByName(some).select(F.xxhash64("root", "i", "j").alias("key"), "node", "body")
    return out.unionByName(blocks.repartition("key").sortWithinPartitions("key").mapInArrow(verify, "a long, b long"))


def _near_prints(first: DataFrame) -> DataFrame:
    """Links (a, b) between sets whose fingerprints are at most three bits apart, by links(). first: set_id, fp, one row a set."""
    of_print = cut(first.groupBy("fp").agg(F.min("set_id").alias("low")))
    same = beside(first.select("set_id", "fp"), of_print, "fp").filter("set_id <> low").select(F.col("set_id").alias("a"), F.col("low").alias("b"))
    side = lambda x: of_print.select(F.col("fp").alias(x), F.col("low").alias(f"set_{x}"))
    near = links(of_print.select("fp")).distinct().join(side("a"), "a").join(side("b"), "b")
    return same.unionByName(near.select(F.col("set_a").alias("a"), F.col("set_b").alias("b")))


def _grouped(docs: DataFrame, width: int, similar: float, bands: int = BANDS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, raw, set_id of every row; set_id, of, first of every set of shingles): of names the group, first is its first row (none, doc_id, raw), ids before nulls."""
    body = F.col("text").cast("binary")
    raw = F.xxhash64("text").alias("raw")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw, body.alias("body"))
    release(docs.sparkSession)
    marks = cut(slim.mapInArrow(_sketches(width, bands), "doc_id long, raw long, set_id long, fp long, keys array<long>"))
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "raw")
    first = cut(marks.groupBy("set_id").agg(F.min(row).alias("first"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    keys = first.select("set_id", F.explode("keys").alias("key"))
    low = keys.groupBy("key").agg(F.min("set_id").alias("low"), F.count("*").alias("n")).filter("n > 1").drop("n")
    banded = beside(keys, low, "key").filter("set_id <> low").select(F.col("set_id").alias("a"), F.col("low").alias("b"))
    met = components(_near_prints(first.select("set_id", "fp")).unionByName(banded))
    wanted = cut(met.join(first.select("set_id", F.col("first.raw").alias("wanted")), F.col("node") == F.col("set_id")).select("root", "node", "wanted"))
    release(docs.sparkSession)
    small = wanted.count() <= BROADCAST_IDS
    texts = docs.select(raw, body.alias("body")).join(F.broadcast(wanted) if small else wanted, F.col("raw") == F.col("wanted"))
    held = cut(texts.groupBy("root", "node").agg(F.min("body").alias("body")))
    roots = components(similar_links(held, width, similar)).withColumnRenamed("root", "of")
    return marks, cut(first.select("set_id", "first").join(roots, F.col("set_id") == F.col("node"), "left").select("set_id", F.coalesce("of", "set_id").alias("of"), "first"))


def similar_groups(docs: DataFrame, width: int = WIDTH, similar: float = SIMILAR, bands: int = BANDS) -> DataFrame:
    """doc_id, component_id (the smallest doc_id that links reach, null if there's none) for every row of docs (doc_id, text).

    Two texts link when their sets of shingles of `width` words have a Jaccard similarity of at least `similar`:
    fingerprints within three bits and `bands` bands of minima (none: fingerprints alone) propose groups, and exact comparison decides. Texts of the same words are one set and never compared; texts without
    words are one set too.
    """
    marks, sets = _grouped(docs, width, similar, bands)
    least = sets.groupBy("of").agg(F.min("first.doc_id").alias("component_id"))
    final = beside(sets.select("set_id", "of"), least, "of").select("set_id", "component_id")
    return beside(marks.select("doc_id", "set_id"), final, "set_id").select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, width: int = WIDTH, similar: float = SIMILAR) -> DataFrame:
    """docs (any columns; doc_id, text needed) with one row of each group of similar_groups().

    It's the row with the smallest doc_id; of rows that share it, or have none, the one with the smallest digest of its text;
    rows without doc_id stand behind all others. Of rows with the same doc_id and text one stays. A table may be empty.
    """
    marks, sets = _grouped(docs, width, similar)
    kept = sets.groupBy("of").agg(F.min("first").alias("row")).select(F.col("row.doc_id").alias("__id"), F.col("row.raw").alias("__raw"))
    again = marks.groupBy(F.col("doc_id").alias("__again"), F.col("raw").alias("__of")).count().filter("count > 1")
    once = F.col("__again").eqNullSafe(F.col("__id")) & F.col("__of").eqNullSafe(F.col("__raw"))
    kept = cut(kept.join(again, once, "left").select("__id", "__raw", F.col("count").isNotNull().alias("__more")))
    here = docs["doc_id"].cast("long").eqNullSafe(F.col("__id")) & F.xxhash64(docs["text"]).eqNullSafe(F.col("__raw"))
    single = docs.join(kept.filter("not __more"), here, "left_semi")
    more = kept.filter("__more")
    return single if more.isEmpty() else single.unionByName(docs.join(more, here).dropDuplicates(["__id", "__raw"]).select(docs.columns))

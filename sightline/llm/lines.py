"""Line dedup by a segment-partition edit join, in DataFrame functions only.

Two different lines link when their edit distance is within the bound for the shorter one. A line of n characters with bound t
is cut into t + 1 segments; t edits leave one of them whole, so a longer or equal line within reach holds that segment at a
place that the lengths allow. The index has a line's segments under (segment number, length); the probe takes only the
substrings whose place the edits left and right of it permit. Pairs that share one and whose character counts are close enough
are verified by a banded bit-parallel edit distance.

Lines made from one template share a segment by the thousand. Such a dense key makes no pairs. Its lines lose the segment they
share, and what is left of them, still within t edits, is cut into t + 1 segments anew, where the lines of that key differ;
those make longer keys, and so on while that saves more pairs than it makes keys.

Near copies of one text that differ in some words share segments as well, by the dozen, without being within the bound. So the
first join makes no pairs: it only keeps the keys that meet another line's. Their lines, few beside all, are looked up, and the
pairs are made with the lines' character counts at hand; one whose counts are too far apart isn't made.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, components, cut, fresh, let, release

#: (shortest line in characters, edits allowed); the shorter line of a pair decides. Shorter lines match only exactly.
BOUNDS = ((16, 1), (64, 2))
#: Characters whose counts are compared before texts are, sixteen in a number.
LETTERS = ("etaoinshrlducmfw", "ypgbvk0123456789")
#: Most rows of a table that is sent to every executor (about 30 bytes each); larger ones are joined by a shuffle.
BROADCAST_IDS = 500_000
#: A key is dense if at least so many lines hold it, as index and as probe.
DENSE = 16
#: Dense keys are looked for in about one of so many lines, by digest, of which so many must hold one. One that is missed is joined as it is: slower, with the same pairs.
SAMPLE, SAMPLED = 16, 3
#: Of texts of at most so many bytes some are looked through for dense keys, of longer ones some lines.
SHORT = 32_768
#: Stretches of a line in which its key's lines are compared to find where they differ.
STRETCHES = 16
#: A key is made longer only if that saves so many pairs for each row that it makes.
ROW = 8
#: Dense keys that together make at most so many pairs are joined as they are.
FEW_PAIRS = 100_000


def _edits(n: Column) -> Column:
    out = F.lit(0)
    for low, t in BOUNDS:
        out = F.when(n >= low, F.lit(t)).otherwise(out)
    return out


def _shifts(t: int, less: int, i: int) -> range:
    """Where segment i of a line that is `less` characters shorter can lie: i edits at most before it, t - i at most after it."""
    return range(max(-i, less - (t - i)), min(i, less + (t - i)) + 1)


def _variants() -> list[tuple[int, int, int, int, int]]:
    """All (kind, edits, less, segment, shift) by which a line makes keys.

    Kind 1 is a line's own segment: an entry of the index, and what an equally long line probes at no shift. Kind 0 only probes.
    Two equally long lines within two edits probe each other, and what one finds at shift -1 the other finds at shift 1.
    """
    one_way = lambda t, less, shift: t == 2 and less == 0 and shift < 0
    return [(int(less == shift == 0), t, less, i, shift) for _, t in BOUNDS for less in range(t + 1) for i in range(t + 1) for shift in _shifts(t, less, i) if not one_way(t, less, shift)]


def _located(each: DataFrame) -> DataFrame:
    """Adds at and size: the substring that a variant takes. each: n (the line's length), kind, t, less, i, shift, and m = n - less."""
    # of t + 1 segments the last m % (t + 1) are one character longer
    each = each.withColumn("short", F.expr("cast(m div (t + 1) as int)")).withColumn("first_long", F.expr("t + 1 - (m - short * (t + 1))"))
    each = each.withColumn("at", F.expr("short * i + greatest(i - first_long, 0) + 1 + shift")).withColumn("size", F.expr("short + if(i >= first_long, 1, 0)"))
    return each.filter("at >= 1 and at + size - 1 <= n").drop("short", "first_long")


#: Where characters are bytes, those are cut without counting characters first; the digest is the same.
_KEY = "xxhash64(i, m, if(octet_length(line) = n, substring(cast(line as binary), at, size), cast(substring(line, at, size) as binary)))"


def _keyed(lines: DataFrame, *more: str) -> DataFrame:
    """key, id, facts and more columns of every variant that applies. lines: id, line, n. facts: the length, and kind in the lowest bit.

    One short expression makes any variant's key, so that it stays within compiled code, and both sides of the join read the
    same rows.
    """
    names = ("kind", "t", "less", "i", "shift")
    table = F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(v, names, strict=True))) for v in _variants()))
    each = lines.select("*", F.explode(table).alias("v")).select(*lines.columns, "v.*")
    each = each.withColumn("m", F.col("n") - F.col("less")).filter(F.col("t") == _edits(F.col("m")))
    return _located(each).select(F.expr(_KEY).alias("key"), "id", F.expr("n * 2 + kind").alias("facts"), *more)


def _often(line: Column, c: str) -> Column:
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))


def _counts(line: Column) -> list[Column]:
    """c0, c1, ...: how often the line holds each of LETTERS, modulo 16, four bits each."""
    out = []
    for k, letters in enumerate(LETTERS):
        packed = F.lit(0).cast("long")
        for i, c in enumerate(letters):
            packed = packed.bitwiseOR(F.shiftleft(_often(line, c).bitwiseAND(F.lit(15)).cast("long"), 4 * i))
        out.append(packed.alias(f"c{k}"))
    return out


_COUNTS = [f"c{k}" for k in range(len(LETTERS))]


def _near_counts(a: str, b: str, edits: str) -> str:
    """SQL: whether the counts a.c0, ... and b.c0, ... allow so many edits.

    They are known modulo 16, so their circular distance is a lower bound of the true one; an edit changes two at most by one.
    """
    gap = lambda c, s: f"abs((({a}{c} >> {s}) & 15) - (({b}{c} >> {s}) & 15))"
    apart = [f"least({gap(c, s)}, 16 - {gap(c, s)})" for c in _COUNTS for s in range(0, 64, 4)]
    return f"{' + '.join(apart)} <= 2 * {edits}"


def _meeting(keyed: DataFrame, dense: DataFrame) -> DataFrame:
    """key, id, facts of the rows of keyed whose key another line holds too, one of the two as an entry of the index; facts is -1 for a line with a dense key, whose key here is its own.

    As many rows at most as go in, however many lines share a key. What is asked of one side alone is put as a comparison of
    both, so that it's not pushed below the exchange, which both sides share.
    """
    told = keyed.join(_small(dense.withColumn("dense", F.lit(True))), "key", "left")
    # rows of dense keys are spread and meet themselves
    told = told.select(F.expr("if(dense is null, key, xxhash64(key, id))").alias("key"), "id", F.expr("if(dense is null, facts, -1)").alias("facts"))
    asked = "a.key = b.key and (a.facts + b.facts < 0 or a.id <> b.id and (a.facts & 1) + (b.facts & 1) > 0)"
    # no new names, or the sides would differ and the keys be made twice
    return told.alias("a").join(told.alias("b"), F.expr(asked), "left_semi")


def _joined(keyed: DataFrame) -> DataFrame:
    """a, b (a > b) of all rows of keyed (key, id, facts, counts, t) that share a key, one of them as an entry of the index, and whose counts are close enough."""
    side = lambda x: keyed.select("key", F.col("id").alias(x), F.col("facts").alias(f"f{x}"), *(F.col(c).alias(f"{x}{c}") for c in [*_COUNTS, "t"]))
    asked = F.expr("(fa & 1) < (fb & 1) * 3 and a <> b and (fa & 1 < fb & 1 or a > b)") & F.expr(_near_counts("a", "b", "bt"))
    return side("a").join(side("b"), "key").filter(asked).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def within(a: Column, b: Column, most: int) -> Column:
    """Edit distance of two arrays of characters if at most `most`, else null.

    Bit k of s[d] after j characters of b: the first j - most + k characters of a turn into them with at most d edits. Only
    that band of 2 * most + 1 diagonals is kept, and one step moves all of it.
    """
    width = 2 * most + 1
    full = (1 << width) - 1
    start = F.struct(*(F.lit(((1 << d + 1) - 1) << most & full).alias(f"s{d}") for d in range(most + 1)))

    def step(s, pair):
        hit = F.lit(0)
        for k in range(width):
            hit = hit.bitwiseOR(F.when(F.get(a, pair["j"] - most + k) == pair["c"], F.lit(1 << k)).otherwise(F.lit(0)))
        return let(hit, lambda m: _advance(s, m))

    def _advance(s, m):
        rows, low = [s["s0"].bitwiseAND(m)], s["s0"].bitwiseAND(m)
        for d in range(1, most + 1):
            old = s[f"s{d - 1}"]
            low = s[f"s{d}"].bitwiseAND(m).bitwiseOR(old).bitwiseOR(F.shiftright(old, 1)).bitwiseOR(F.shiftleft(low, 1)).bitwiseAND(F.lit(full))
            rows.append(low)
        return F.struct(*(r.alias(f"s{d}") for d, r in enumerate(rows)))

    steps = F.transform(b, lambda c, j: F.struct(c.alias("c"), j.alias("j")))
    last = F.call_function("shiftleft", F.lit(1), F.size(a) - F.size(b) + most)

    def read(s):
        out = F.lit(None).cast("int")
        for d in range(most, -1, -1):
            out = F.when(s[f"s{d}"].bitwiseAND(last) != 0, F.lit(d)).otherwise(out)
        return out

    return F.when(F.abs(F.size(a) - F.size(b)) <= most, let(F.aggregate(steps, start, step), read))


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, body (digest of the text), line_no, line for every line of every text; null texts have none."""
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("body"), F.split("text", "\n").alias("lines"))
    return split.select("doc_id", "body", F.posexplode("lines").alias("line_no", "line"))


def _worded(line: Column) -> Column:
    return F.octet_length(F.ltrim(line, F.lit(" \t\n\x0b\f\r"))) > 0


def _id(line: Column) -> list[Column]:
    """low, high: what stands for a line, two 64-bit digests from different seeds."""
    return [F.xxhash64(line).alias("low"), F.xxhash64(F.lit(1), line).alias("high")]


_ID = ["low", "high"]


#: Lines of a text that a place in the corpus can tell apart.
_LINES = 1 << 32
_PLACE = "decimal(31,0)"
#: doc_id and line number in one number that sorts like them; null for a null doc_id.
_AT = f"cast(cast(doc_id as decimal(20,0)) * {_LINES} + line_no as {_PLACE})"


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_IDS else table


def dense_keys(docs: DataFrame) -> DataFrame:
    """key of the keys that many lines share, found in a part of docs (text): one in SAMPLE of the short texts, and one in SAMPLE lines of the long ones."""
    chosen = lambda c: F.xxhash64(F.lit("dense"), c).bitwiseAND(F.lit(SAMPLE - 1)) == 0
    size = F.octet_length("text")
    short, long = docs.filter(size <= SHORT).filter(chosen(F.col("text"))), docs.filter(size > SHORT)
    some = _long_enough(short).union(_long_enough(long).filter(chosen(F.col("line")))).distinct()
    counts = _keyed(_named(some)).groupBy("key").agg(F.count("*").alias("held"), F.sum(F.col("facts").bitwiseAND(F.lit(1))).alias("own"))
    return cut(counts.filter((F.col("held") >= SAMPLED) & (F.col("own") >= SAMPLED)).select("key"))


def _long_enough(docs: DataFrame) -> DataFrame:
    """line: those that may have a partner other than copies."""
    return docs.select(F.explode(F.split("text", "\n")).alias("line")).filter(F.length("line") >= BOUNDS[0][0]).filter(_worded(F.col("line")))


def _named(lines: DataFrame) -> DataFrame:
    return lines.select("line", F.xxhash64("line").alias("id"), F.length("line").alias("n"))


def _without(line: str) -> Column:
    return F.expr(f"concat(substring({line}, 1, at - 1), substring({line}, at + size))")


def _held(lines: DataFrame, dense: DataFrame) -> DataFrame:
    """key, id, facts, t, less, m, counts, rest of all lines with a dense key: m is the length of the index's rest, rest the line without what it shares.

    lines: line, id, n, repeats allowed; dense: key.
    """
    held = _keyed(lines, "t", "less", "m", "at", "size", "line").join(_small(dense), "key", "left_semi").distinct()
    return cut(held).select("key", "id", "facts", "t", "less", F.expr("m - size").alias("m"), *_counts(F.col("line")), _without("line").alias("rest"))


def _cuts(rows: DataFrame) -> DataFrame:
    """key, cuts (t ascending places between 0 and m): where to cut the rests of a dense key, so that each segment has its share of what tells them apart."""
    places = [F.expr(f"cast({j} * m div {STRETCHES} as int)") for j in range(STRETCHES + 1)]
    kinds = [F.approx_count_distinct(F.substring(F.col("rest"), places[j] + 1, places[j + 1] - places[j]), 0.1) for j in range(STRETCHES)]
    told = rows.filter("facts & 1 = 1").groupBy("key", "t", "m").agg(F.array(*(F.log2(k.cast("double")) + 0.001 for k in kinds)).alias("weights"))
    sums = F.transform(F.sequence(F.lit(1), F.lit(STRETCHES)), lambda j: F.aggregate(F.slice("weights", 1, j), F.lit(0.0), lambda x, w: x + w))
    told = told.select("key", "t", "m", "weights", sums.alias("sums"))

    def place(k):
        target = F.element_at("sums", -1) * k / (F.col("t") + 1)
        full = F.size(F.filter("sums", lambda x: x < target))
        inside = (target - F.when(full > 0, F.element_at("sums", F.greatest(full, F.lit(1)))).otherwise(F.lit(0.0))) / F.get("weights", full)
        return F.least(F.greatest(F.round((full + inside) * F.col("m") / STRETCHES).cast("int"), k), F.col("m") - F.col("t") - 1 + k)

    # no two places alike
    rising = F.aggregate(F.transform(F.sequence(F.lit(1), F.col("t")), place), F.array().cast("array<int>"), lambda seen, x: F.concat(seen, F.array(F.greatest(x, F.coalesce(F.try_element_at(seen, F.lit(-1)), F.lit(0)) + 1))))
    return cut(told.select("key", rising.alias("cuts")))


def _longer(rows: DataFrame, cuts: DataFrame, small) -> DataFrame:
    """The same columns as rows (see _held()) with a longer key for each segment of the rests, and parent, the key before."""
    shifts = "flatten(transform(sequence(0, t), i -> transform(sequence(greatest(-i, less - t + i), least(i, less + t - i)), s -> named_struct('i', i, 'shift', s))))"
    each = rows.join(small(cuts), "key").select("*", F.expr(shifts).alias("vs")).select("*", F.explode("vs").alias("v")).select(*rows.columns, "cuts", "v.*")
    each = each.withColumn("start", F.expr("if(i = 0, 0, get(cuts, i - 1))")).withColumn("size", F.expr("if(i = t, m, get(cuts, i)) - start")).withColumn("at", F.expr("start + 1 + shift"))
    each = each.filter("at >= 1 and at + size - 1 <= length(rest)")
    facts = F.expr("if(facts & 1 = 1 and shift <> 0, facts - 1, facts)").alias("facts")
    return each.select(F.col("key").alias("parent"), F.expr("xxhash64(key, i, substring(rest, at, size))").alias("key"), "id", facts, "t", "less", F.expr("m - size").alias("m"), *_COUNTS, _without("rest").alias("rest"))


def _of_dense_keys(rows: DataFrame) -> DataFrame:
    """a, b of all rows (see _held()) that a dense key brings together, by longer keys."""
    own = F.sum(F.col("facts").bitwiseAND(F.lit(1)))
    meeting = []
    while True:
        rows = fresh(rows)
        tally = rows.groupBy("key").agg(own.alias("own"), F.count("*").alias("held"), F.max(F.col("m") > F.col("t")).alias("more"))
        dense = cut(tally.filter((F.col("own") >= DENSE) & (F.col("held") >= DENSE) & F.col("more")).select("key", (F.col("own") * F.col("held")).alias("before")))
        n, pairs = dense.agg(F.count("*"), F.sum("before")).first()
        if not n or pairs <= FEW_PAIRS:
            return _joined(reduce(DataFrame.union, [*meeting, rows]).select("key", "id", "facts", *_COUNTS, "t"))
        small = F.broadcast if n <= BROADCAST_IDS else lambda table: table  # what is derived from dense has no more rows
        top = cut(rows.join(small(dense.select("key")), "key", "left_semi"))
        longer = cut(_longer(top, _cuts(top), small))
        # only keys that a line and a line of the index hold can bring anything together
        useful = cut(longer.groupBy("parent", "key").agg(own.alias("own"), F.count("*").alias("held")).filter("own > 0 and held > 1"))
        after = useful.groupBy("parent").agg(F.sum(F.expr(f"own * held + {ROW} * held")).alias("after"))
        weighed = cut(dense.join(after, F.col("key") == F.col("parent"), "left").select("key", (F.coalesce("after", F.lit(0)) < F.col("before")).alias("saves")))
        done = rows.join(small(weighed.filter("saves").select("key")), "key", "left_anti")
        meeting.append(done)
        going = useful.join(small(weighed.filter("saves").select(F.col("key").alias("parent"))), "parent", "left_semi").select("key")
        rows = longer.join(_small(cut(going)), "key", "left_semi").drop("parent")


def candidates(docs: DataFrame) -> DataFrame:
    """a, b (64-bit digests, a > b): all pairs of different lines of docs (text) that the keys bring together."""
    return _candidates(docs, _long_enough(docs).select("line", *_id(F.col("line"))))[0]


def _candidates(docs: DataFrame, rows: DataFrame, *more: Column) -> tuple[DataFrame, DataFrame]:
    """candidates(docs), and their lines as looked_up() gives them; rows (line, low, high) has all lines of docs.

    Repeated lines are combined before the shuffle, the only one that moves texts. Lines shorter than the first bound have no
    partner.
    """
    dense = dense_keys(docs)
    # through a generator of one row, or compiled code would put off the digest until each of a line's keys asks for it
    named = _named(_long_enough(docs).distinct()).select(F.explode(F.array(F.struct("line", "id", "n"))).alias("x")).select("x.*")
    meeting = cut(_meeting(_keyed(named), dense))
    release(docs.sparkSession)
    texts = looked_up(rows, cut(meeting.select("id").distinct()), *more)
    counts = texts.select(F.col("low").alias("id"), *_COUNTS)
    # the shorter line of a pair is the one in the index, whose length is in its facts
    pairs = _joined(meeting.filter("facts >= 0").join(counts, "id").withColumn("t", _edits(F.shiftright("facts", 1))))
    held = cut(meeting.filter("facts < 0").select("id").distinct())
    if not held.isEmpty():
        of_dense = texts.join(held, F.col("low") == F.col("id"), "left_semi").select("line", F.col("low").alias("id"), "n")
        pairs = pairs.union(_of_dense_keys(_held(of_dense, dense)))
    return cut(pairs.distinct()), texts


def looked_up(rows: DataFrame, ids: DataFrame, *more: Column) -> DataFrame:
    """low, high, n, counts, line and more aggregates for the lines whose low is one of ids (id), from another pass over rows (line, low, high); they are few beside all."""
    held = rows.join(_small(ids), F.col("low") == F.col("id"), "left_semi").groupBy(*_ID).agg(F.min("line").alias("line"), *more)
    return cut(cut(held).select("*", F.length("line").alias("n"), *_counts(F.col("line"))))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b (structs of low and high), edits: the pairs within the bounds. pairs: a, b (low); texts as looked_up() gives them."""
    side = lambda x: texts.select(F.col("low").alias(x), F.struct(*_ID).alias(f"id{x}"), F.col("n").alias(f"n{x}"), *(F.col(c).alias(f"{x}{c}") for c in _COUNTS))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("t", _edits(F.least("na", "nb")))
    both = cut(both.filter(F.expr(_near_counts("a", "b", "t"))).select("ida", "idb", "t"))
    chars = lambda x: texts.select(F.struct(*_ID).alias(f"id{x}"), F.split("line", "").alias(f"c{x}"))
    edits = F.lit(None).cast("int")
    for _, t in BOUNDS:
        edits = F.when(F.col("t") == t, within(F.col("ca"), F.col("cb"), t)).otherwise(edits)
    found = both.join(chars("a"), "ida").join(chars("b"), "idb")
    return found.select(F.col("ida").alias("a"), F.col("idb").alias("b"), edits.alias("edits")).filter("edits is not null")


def line_classes(docs: DataFrame) -> DataFrame:
    """One row per line of docs: doc_id, body, line_no, n_chars, class_doc, class_line, n_links, kept.

    A class is all lines that links join, exact copies included; (class_doc, class_line) is its first occurrence by doc_id
    and line number, which alone is kept. n_links counts the different lines the line is linked with. Lines without a word
    are in no class (nulls, 0) and are kept. Rows of docs (doc_id, text) that share doc_id are one document for the order, and
    repeated rows come back as often; a null doc_id comes last. An empty table has no lines. A line that a third of all rows
    hold is one row before anything is joined to it.
    """
    every = occurrences(docs)
    worded = every.filter(_worded(F.col("line")))
    pairs, texts = _candidates(docs, worded.select("line", *_id(F.col("line")), F.expr(_AT).alias("place")), F.min("place").alias("first"))
    links = cut(verified(pairs, texts))
    degree = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count("*").alias("n_links"))
    # only linked lines have a head other than their own first occurrence
    near = cut(components(links).join(texts.select(F.struct(*_ID).alias("node"), "first"), "node"))
    heads = near.groupBy("root").agg(F.min("first").alias("head"))
    special = beside(near, heads, "root").join(degree, "node")
    release(docs.sparkSession)
    special = cut(special.select(F.col("node.low").alias("low_of"), F.col("node.high").alias("high_of"), "head", "n_links"))
    firsts = worded.select(*_id(F.col("line")), F.expr(_AT).alias("place")).groupBy(*_ID).agg(F.min("place").alias("first"))
    rows = every.select("doc_id", "body", "line_no", F.length("line").alias("n_chars"), *(F.when(_worded(F.col("line")), x).alias(c) for x, c in zip(_id(F.col("line")), _ID, strict=True)))
    of_line = (F.col("low") == F.col("low_of")) & (F.col("high") == F.col("high_of"))
    both = beside(rows, firsts, _ID, "left").join(special, of_line, "left").withColumn("of", F.col("low_of"))
    head = F.when(F.col("of").isNull(), F.col("first")).otherwise(F.col("head"))
    placed = both.select("doc_id", "body", F.col("line_no").cast("long").alias("line_no"), F.col("n_chars").cast("long").alias("n_chars"), "low", head.alias("head"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    doc = F.expr(f"cast(floor(head / {_LINES}) as bigint)")
    line = F.expr(f"cast(pmod(head, {_LINES}) as bigint)")
    return placed.select("doc_id", "body", "line_no", "n_chars", doc.alias("class_doc"), line.alias("class_line"), "n_links", (F.col("low").isNull() | F.expr(_AT).eqNullSafe(F.col("head"))).alias("kept"))


def drop_repeated_lines(docs: DataFrame, whole_share: float = 1.0) -> DataFrame:
    """docs with the same columns, without the lines that aren't kept (n_chars follows, where there is one).

    A document that loses all its lines goes with them. With a whole_share below 1, a document that would lose more than this
    share of its characters is left as it is. Null texts stay; rows without doc_id come last in the order of occurrences, and
    of a line that stands in such rows alone every copy stays. Repeated rows lose the same lines each; tables may be empty.
    """
    rows = line_classes(docs)
    lost = rows.groupBy("doc_id", "body").agg(
        F.sum("n_chars").alias("total"), F.sum(F.when(~F.col("kept"), F.col("n_chars")).otherwise(0)).alias("lost"), F.collect_set(F.when(~F.col("kept"), F.col("line_no").cast("int"))).alias("gone")
    )
    lost = lost.filter((F.col("lost") > 0) & (F.col("lost") <= whole_share * F.col("total"))).select(F.col("doc_id").alias("__d"), F.col("body").alias("__b"), F.col("gone").alias("__gone"))
    here = docs.doc_id.cast("long").eqNullSafe(F.col("__d")) & (F.xxhash64(docs.text) == F.col("__b"))
    both = docs.join(lost, here, "left")

    def rest(lines):
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))
        return F.when(F.size(places) > 0, F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n"))

    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(let(F.split("text", "\n"), rest))
    out = both.withColumn("__text", text).filter("__gone is null or __text is not null")
    new = {"text": F.col("__text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("__gone").isNull(), F.col("n_chars")).otherwise(F.length("__text")).cast(docs.schema["n_chars"].dataType)
    return out.select(*(new.get(c, F.col(c)).alias(c) for c in docs.columns))

"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once and leaves one bit in `fails` beside the measurements it used. A policy is a versioned mask over
those bits, so a new policy, or the question what a rule costs, is bitwise arithmetic on the ledger and never reads texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, let

#: Words in a window of the repetition measure.
SPAN = 5

#: Rule name and the condition under which a document fails it; the bit is the place in this list. Rules are only appended.
RULES: list[tuple[str, str]] = [
    ("too_few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols_per_word", "10 * n_symbols > n_words"),
    ("repeated_lines", "10 * n_dup_lines > 4 * n_lines"),
    ("word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 12 * n_words)"),
    ("upper_case", "n_words >= 10 and 2 * n_upper > word_chars"),
]


@dataclass(frozen=True)
class Policy:
    """Which rules count, under a name and a version."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        bits = {rule: 1 << i for i, (rule, _) in enumerate(RULES)}
        return sum(bits[r] for r in self.rules)


BASE = Policy("base", 1, ("too_few_words", "repeated_windows"))
CURRENT = Policy("prose", 2, tuple(name for name, _ in RULES))
POLICIES = (BASE, CURRENT)

MEASURES = ("n_words", "n_lines", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper")


def _repeated(words: Column) -> Column:
    """Words that stand in a window found twice or more; windows are compared by 64-bit digests within one text."""

    def marked(hashes):
        n = F.size(hashes)

        def places(sorted_):
            twin = lambda k, by: F.coalesce(F.get(sorted_, k + by)["h"] == F.get(sorted_, k)["h"], F.lit(False))
            twice = F.filter(F.sequence(F.lit(0), n - 1), lambda k: twin(k, -1) | twin(k, 1))
            return F.sort_array(F.transform(twice, lambda k: F.get(sorted_, k)["i"]))

        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
        step = lambda acc, p: F.struct((p + SPAN).alias("end"), (acc["total"] + p + SPAN - F.greatest(acc["end"], p)).alias("total"))
        slow = let(pairs, lambda s: F.aggregate(places(s), zero, step)["total"])
        return F.when(F.size(F.array_distinct(hashes)) == n, F.lit(0)).otherwise(slow)

    def windows(w):
        return F.transform(F.sequence(F.lit(0), F.size(w) - SPAN), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(SPAN))))

    return F.when(F.size(words) < SPAN + 1, F.lit(0)).otherwise(let(words, lambda w: let(windows(w), marked))).cast("long")


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and fails (bigint, bit i set where rule i fails) for every row of docs (doc_id, text).

    A word is a run of characters other than ASCII white space; a null text has none, and all its measurements are zero.
    n_dup_lines counts lines with a word that equal an earlier line of the text. Rows are independent: repeated rows and
    null ids come back as they are. No shuffle.
    """
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    split = text.select(
        "doc_id",
        "text",
        F.array_remove(F.split("text", f"[{WHITE}]+"), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\f\r"))) > 0).alias("lines"),
        F.length(F.regexp_replace("text", f"[{WHITE}]++", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]++", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("text", r"[^\p{Lu}]++", "")).cast("long").alias("n_upper"),
    )
    measured = split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("words")).alias("n_repeat_words"),
        "n_upper",
    )
    bits = " + ".join(f"CASE WHEN {rule} THEN {1 << i}L ELSE 0L END" for i, (_, rule) in enumerate(RULES))
    return measured.select("doc_id", *MEASURES, F.expr(bits).alias("fails"))


def kept(policy: Policy) -> Column:
    """Whether a row of the ledger passes the policy."""
    return F.col("fails").bitwiseAND(F.lit(policy.mask)) == 0


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: n_failed (documents it fails), n_only (it alone fails), kept_with and kept_without it.

    The ledger is first counted by bit pattern (at most 2 ** rules rows), so this costs one small aggregation.
    """
    counts = rows.groupBy(F.col("fails").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, (name, _) in enumerate(RULES) if name in policy.rules))
    each = counts.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.rule", "r.bit")
    total = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("long")
    failed, others = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits").bitwiseAND(F.bitwise_not("bit"))
    return each.groupBy("rule").agg(
        total(failed).alias("n_failed"), total(F.col("bits") == F.col("bit")).alias("n_only"), total(F.col("bits") == 0).alias("kept_with"), total(others == 0).alias("kept_without")
    )


def judged(docs: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """The digest of the ledger under a policy: the base measurements, base_failed and kept."""
    base = ~kept(BASE)
    return ledger(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (kept(BASE) & kept(policy)).alias("kept"), "fails")

"""The registered queries of the text operators, and their DuckDB SQL where SQL can say what they compute."""

from __future__ import annotations

import logging
import os

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives, chat, chunks, decontaminate, licenses, lines, mixing, rules, simhash, toxicity
from .common import cut, scratch

#: A tokenizers JSON file; where there is none, code points are the tokens.
TOKENIZER = os.environ.get("SIGHTLINE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")


def _tokenizer() -> str | None:
    if os.path.exists(TOKENIZER):
        return TOKENIZER
    logging.getLogger(__name__).warning("there is no tokenizer at %s; code points are the tokens", TOKENIZER)
    return None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats all conversations and one that is made of control strings, and reads the digests back from the tree."""
    control = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    given = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    nodes, members = chat.prefix_tree(given.unionByName(probe), _tokenizer())
    return chat.read_back(nodes, members)


def op2_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.convert(_table(spark, sf_dir, "pages"), scratch(spark, "archives"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of every document in its new place. Whole documents are copied, shuffled and written; the columns are read from that."""
    mixed = cut(mixing.replicate(_table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "source", "n_chars", F.col("replica").cast("long").alias("replica"), F.round("rate", 9).alias("rate"), "mix_key")


def op8_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What substring dedup removes from each document, and a digest of what it leaves."""
    out = chunks.dedup_substrings(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", "n_repeated", F.size("spans").cast("long").alias("n_removed"), removed.alias("removed_bytes"), "spans", F.length("text").cast("long").alias("kept_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document with its class, the number of lines it's linked with, and whether it stays."""
    return lines.line_classes(_table(spark, sf_dir, "documents")).drop("body")


QUERIES = {
    f.__name__: f for f in (op1_prefix_tree, op2_rule_ledger, op3_toxicity, op4_archives, op5_licenses, op6_simhash, op7_poisson_mix, op8_chunk_dedup, op9_decontaminate, op10_line_dedup)
} | {"pipeline": corpus_pipeline.run}

_OP1 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(role) + length(role) - length(replace(role, '\', '')) + len(regexp_extract_all(role, '<\||<s>|</s>|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]'))
    + length(role) - length(replace(role, chr(10), '')) + length(text) + length(text) - length(replace(text, '\', ''))
    + len(regexp_extract_all(text, '<\||<s>|</s>|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]')) + 17 AS chars FROM t),
p AS (SELECT conv_id, list(sha256(role) || sha256(text)) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS path FROM t),
n AS (SELECT conv_id, count(*) FILTER (held > 1) AS n_shared FROM (SELECT conv_id, count(*) OVER (PARTITION BY path) AS held FROM p) GROUP BY conv_id)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars, CAST(any_value(n_shared) AS BIGINT) AS n_shared_turns, TRUE AS positions_count_up, TRUE AS attends_to_its_past
FROM e JOIN n USING (conv_id) GROUP BY conv_id
"""

_OP2 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT rid, unnest(range(1, len(words) - 3)) AS i, words FROM w WHERE len(words) >= 5),
h AS (SELECT rid, i, array_to_string(words[i:i+4], ' ') AS win FROM g),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM h) WHERE n > 1),
c AS (SELECT rid, count(DISTINCT i + k) AS n FROM r, range(0, 5) AS x(k) GROUP BY rid),
m AS (SELECT w.doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        coalesce(c.n, 0) AS n_repeat_words, length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) AS n_upper
      FROM w LEFT JOIN c USING (rid)),
f AS (SELECT *, CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
        + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 10 * n_dup_lines > 4 * n_lines THEN 8 ELSE 0 END
        + CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 12 * n_words) THEN 16 ELSE 0 END
        + CASE WHEN n_words >= 10 AND 2 * n_upper > word_chars THEN 32 ELSE 0 END AS fails FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, fails & 3 <> 0 AS base_failed, fails = 0 AS kept,
  CAST(fails AS BIGINT) AS fails FROM f
"""

_OP4 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM top THEN top END AS refers_to FROM q
"""


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _op5() -> str:
    templates = ", ".join(f"({i}, {_sql_text(label)}, {_sql_text(t)}, {licenses._size(t)})" for i, (label, t) in enumerate(licenses.TEMPLATES))
    phrases = ", ".join(f"({_sql_text(label)}, string_split({_sql_text(p)}, ' '))" for p, label in licenses.PHRASES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS words FROM documents),
t AS (SELECT i, label, list_distinct(string_split(body, ' ')) AS held, size FROM (VALUES {templates}) AS x(i, label, body, size)),
p AS (SELECT * FROM (VALUES {phrases}) AS x(label, parts)),
live AS (SELECT rid, words FROM d WHERE list_has_any(words, (SELECT list_distinct(flatten(list(held))) FROM t))),
b AS (SELECT rid, i, label, held, list_distinct(words[s + 1 : s + 2 * size]) AS block FROM (SELECT rid, words, t.*, unnest(range(0, len(words), size)) AS s FROM live, t)),
c AS (SELECT rid, label, len(list_intersect(held, block)) / len(held) AS containment, len(list_intersect(held, block)) AS shared, len(held) AS n FROM b),
m AS (SELECT rid, list(DISTINCT label) AS met, max(containment) AS containment FROM c WHERE shared >= ceil({licenses.CONTAINMENT} * n - 1e-9) GROUP BY rid),
f AS (SELECT rid, label, unnest(list_filter(range(0, len(words) - len(parts) + 1), lambda k: words[k + 1 : k + len(parts)] = parts)) AS pos FROM d, p),
g AS (SELECT rid, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS base FROM f GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(met, [])))), ','), '') AS labels,
  greatest(coalesce(containment, 0.0), CASE WHEN n_base > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS score
FROM d LEFT JOIN m USING (rid) LEFT JOIN g USING (rid)
"""


def _poisson_sql(table: str, columns: str, rate: str = "rate", seed: int = 7) -> str:
    """Copies of the rows of table (doc_id, source); columns go along."""
    return rf"""
sizes AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, {mixing.TEMPERATURE}) AS weight FROM {table} GROUP BY source),
rates AS (SELECT source, weight * (SELECT sum(n)::DOUBLE FROM sizes) / ((SELECT sum(weight) FROM sizes) * n) AS rate FROM sizes),
cdf AS (SELECT source, k, parts, sum(exp(-(rate / parts)) * pow(rate / parts, k) / gamma(k + 1.0)) OVER (PARTITION BY source ORDER BY k) AS p
        FROM (SELECT source, rate, greatest(ceil(rate / {mixing.PART}), 1) AS parts FROM rates), range(0, {mixing.TERMS + 1}) AS x(k)),
draws AS (SELECT d.*, {rate} AS rate, parts, unnest(range(1, CAST(parts AS BIGINT) + 1)) AS part FROM {table} d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source
        JOIN (SELECT DISTINCT source, parts FROM cdf) s ON d.source IS NOT DISTINCT FROM s.source),
ones AS (SELECT {columns}, rate, part, ('0x' || substr(md5('copies{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || part), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM draws),
counts AS (SELECT {columns}, rate, CAST(sum((SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM ones.source AND p <= u)) AS BIGINT) AS copies FROM ones GROUP BY ALL),
copied AS (SELECT {columns}, rate, unnest(range(0, copies)) AS replica FROM counts)
"""


_OP7 = f"""
WITH {_poisson_sql("documents", "doc_id, source, n_chars")}
SELECT doc_id, source, n_chars, replica, round(rate, 9) AS rate, md5('order7:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || replica) AS mix_key FROM copied
"""

_OP9 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS words FROM benchmark),
w AS (SELECT DISTINCT item_id, k, array_to_string(words[i : i + k - 1], ' ') AS win FROM (SELECT item_id, words, least(10, len(words)) AS k, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS i FROM b WHERE len(words) > 0)),
g AS (SELECT rid, i, k, array_to_string(words[i : i + k - 1], ' ') AS win FROM (SELECT rid, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM w) ks WHERE len(words) >= k)),
h AS (SELECT rid, i, g.k, item_id FROM g JOIN w USING (k, win)),
n AS (SELECT rid, count(DISTINCT i + j) AS n_hit FROM (SELECT DISTINCT rid, i, k FROM h) x, range(0, 10) AS y(j) WHERE j < k GROUP BY rid),
m AS (SELECT rid, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM h GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN m USING (rid)
"""

ORACLE = {"op1_prefix_tree": _OP1, "op2_rule_ledger": _OP2, "op4_archives": _OP4, "op5_licenses": _op5(), "op7_poisson_mix": _OP7, "op9_decontaminate": _OP9}
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL

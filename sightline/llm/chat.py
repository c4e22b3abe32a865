"""Chat formatting as a prefix tree.

Conversations that begin with the same turns share those turns' nodes. A node is known by a digest of all turns up to it and
belongs to the smallest conversation through it. What a conversation owns is a chain at its end, and the path to it is a short
list of (owner, depth) steps; sorted by those, the chains come in depth-first order. Each node's formatted text and tokens are
emitted once, with the place in its tree, position ids that count along the conversation, and the intervals of the tree's
sequence that its ancestors fill - what attention may see. No tree is ever gathered: places are sums in two levels.
"""

from __future__ import annotations

import hashlib
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import beside, cut, pieces

#: Strings that a template gives a meaning; texts must not bring them in.
CONTROL = ("<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")
OPEN, CLOSE = "<|turn|>", "<|end|>\n"
TRAINED = "assistant"

_CODES = {"\\": "\\\\", "<": "\\l", "[": "\\b", "\n": "\\n"}
_ESCAPED = re.compile(r"\\|(?:" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL) + ")")
_TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*)" + re.escape(CLOSE), re.S)


def escape(text: str) -> str:
    """The text without any control string: a backslash is doubled, a control string's first character becomes a backslash and a letter."""
    return _ESCAPED.sub(lambda m: _CODES[m[0]], text)


def unescape(text: str) -> str:
    """What escape() made the text from."""
    back = {v[1]: k for k, v in _CODES.items()}
    return re.sub(r"\\(.)", lambda m: back[m[1]], text, flags=re.S)


def _escape_role(role: str) -> str:
    return escape(role).replace("\n", _CODES["\n"])


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn's formatted text, and where in it the characters of the trained text start and end (0, 0 if none)."""
    head, body = f"{OPEN}{_escape_role(role)}\n", escape(text)
    span = (len(head), len(head) + len(body)) if role == TRAINED else (0, 0)
    return head + body + CLOSE, *span


def parse_turn(segment: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    m = _TURN.fullmatch(segment)
    if not m:
        raise ValueError(f"not a turn: {segment[:40]!r}")
    return unescape(m[1]), unescape(m[2])


_NODE = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("node_id", pa.string()), ("parent_id", pa.string()), ("segment", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
_NODE_DDL = "conv_id long, depth long, node_id string, parent_id string, segment string, loss_start long, loss_end long"


def _node_batches(batches):
    conv, depth, parent = None, 0, ""
    for batch in pieces(batches, 1024):
        columns: tuple[list, ...] = ([], [], [], [], [], [], [])
        for c, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text")), strict=True):
            if c != conv:
                conv, depth, parent = c, 0, ""
            segment, start, end = format_turn(role, text)
            node = hashlib.sha256(f"{parent}\n{segment}".encode()).hexdigest()[:32]
            for column, value in zip(columns, (conv, depth, node, parent or None, segment, start, end), strict=True):
                column.append(value)
            depth, parent = depth + 1, node
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _NODE, strict=True)], schema=_NODE)


def _token_batches(vocabulary):
    kind = pa.list_(pa.int32())

    def go(batches):
        if vocabulary is None:
            encode = lambda texts: [[ord(c) for c in t] for t in texts]
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker for each core already
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_str(vocabulary.value)
            tokenizer.encode_special_tokens = True
            encode = lambda texts: [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        for batch in pieces(batches):
            kept = [batch.column(c) for c in ("conv_id", "depth", "node_id")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(encode(batch.column("segment").to_pylist()), kind)], names=["conv_id", "depth", "node_id", "tokens"])

    return go


def _two_level_offsets(chains: DataFrame) -> DataFrame:
    """Adds place: the sum of n over the chains before, in order of path within a tree. A tree may span many tasks."""
    ranged = cut(chains.repartitionByRange("tree", "path").withColumn("part", F.spark_partition_id()))
    within = Window.partitionBy("part", "tree").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("inner", F.coalesce(F.sum("n").over(within), F.lit(0)))
    totals = ranged.groupBy("tree", "part").agg(F.sum("n").alias("all"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("tree", "part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("outer"))
    return local.join(starts, ["tree", "part"]).select("conv_id", "tree", "path", (F.col("outer") + F.col("inner")).alias("place"))


def prefix_tree(conversations: DataFrame, tokenizer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and members of the prefix trees of conversations (conv_id, turn, role, text; one row a turn).

    nodes: tree (smallest conversation with the first turn), node_id, parent_id, depth, segment (formatted turn), loss_start,
    loss_end (its trained characters), tokens, n_conversations, place (of its first token in the tree's depth-first
    sequence), position_ids, ancestors (intervals of that sequence its tokens may attend to besides their own past).
    members: conv_id, depth, node_id: each conversation as a path.

    tokenizer: path of a tokenizers JSON file on the driver, sent along (some megabytes); None: code points are the tokens.
    Null roles and texts are empty. Turns are ordered by turn, then role and text; repeated rows are turns of their own. A
    row without conv_id belongs to no conversation. A conversation streams through one task in bounded memory.
    """
    spark = conversations.sparkSession
    vocabulary = spark.sparkContext.broadcast(open(tokenizer, encoding="utf-8").read()) if tokenizer else None
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", empty("role"), empty("text"))
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    rows = cut(ordered.mapInArrow(_node_batches, _NODE_DDL))
    owners = rows.groupBy("node_id").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_conversations"))
    slim = cut(beside(rows.select("conv_id", "depth", "node_id"), owners, "node_id"))
    # a shared turn is tokenised once, where its owner has it
    first = rows.join(slim.filter("owner = conv_id").select("conv_id", "depth"), ["conv_id", "depth"], "left_semi")
    tokens = cut(first.select("conv_id", "depth", "node_id", "segment").mapInArrow(_token_batches(vocabulary), "conv_id long, depth long, node_id string, tokens array<int>"))
    path = Window.partitionBy("conv_id").orderBy("depth")
    before = path.rowsBetween(Window.unboundedPreceding, -1)
    owned = beside(slim, tokens.select("node_id", F.size("tokens").cast("long").alias("n")), "node_id")
    owned = cut(owned.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("last_owner", F.lag("owner").over(path)))
    # where a conversation's path enters another chain: always at that chain's first node
    steps = owned.filter("last_owner is null or last_owner <> owner").select("conv_id", "depth", "owner", "start")
    tails = owned.filter("owner = conv_id").groupBy("conv_id").agg(F.sum("n").alias("n"), F.min("start").alias("tail_start"))
    # deeper branches come first after a chain's end, then smaller conversations
    paths = steps.join(tails, "conv_id").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("depth", (-F.col("depth")).alias("up"), "owner"))).alias("steps"), F.first("n").alias("n"))
    chains = paths.select("conv_id", "n", F.col("steps")[0]["owner"].alias("tree"), F.transform("steps", lambda s: F.struct(s["up"].alias("up"), s["owner"].alias("owner"))).alias("path"))
    places = cut(_two_level_offsets(chains))
    # what of each chain the path runs through: from its first node to where the path leaves it
    nexts = Window.partitionBy("conv_id").orderBy("depth")
    through = steps.withColumn("leave", F.lead("start").over(nexts)).filter("leave is not null").join(tails.select("conv_id"), "conv_id", "left_semi")
    through = through.join(places.select(F.col("conv_id").alias("owner"), F.col("place").alias("from")), "owner")
    seen = through.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("from").alias("start"), (F.col("from") + F.col("leave") - F.col("start")).alias("end")))).alias("seen"))
    own = owned.filter("owner = conv_id").select("conv_id", "depth", "node_id", "n_conversations", "start", "n")
    placed = own.join(tails.select("conv_id", "tail_start"), "conv_id").join(places.select("conv_id", "tree", F.col("place").alias("chain")), "conv_id").join(seen, "conv_id", "left")
    place = F.col("chain") + F.col("start") - F.col("tail_start")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    mine = F.when(place > F.col("chain"), F.array(F.struct(F.col("chain").alias("start"), place.alias("end")))).otherwise(none)
    placed = placed.select("conv_id", "depth", "tree", "n_conversations", place.alias("place"), "start", "n", F.concat(F.coalesce("seen", none), mine).alias("ancestors"))
    # made last, so that no shuffle carries them
    positions = F.when(F.col("n") > 0, F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).otherwise(F.array().cast("array<bigint>"))
    nodes = rows.join(placed, ["conv_id", "depth"]).join(tokens.drop("node_id"), ["conv_id", "depth"]).select("tree", "node_id", "parent_id", "depth", "segment", "loss_start", "loss_end", "tokens", "n_conversations", "place", positions.alias("position_ids"), "ancestors")
    return nodes, rows.select("conv_id", "depth", "node_id")


_READ = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
    ("n_shared_turns", pa.int64()), ("positions_count_up", pa.bool_()), ("attends_to_its_past", pa.bool_()),
])
_READ_DDL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_shared_turns long, positions_count_up boolean, attends_to_its_past boolean"


def _merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same places as ascending intervals that neither touch nor overlap."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(x for x in intervals if x[0] < x[1]):
        if out and out[-1][1] >= start:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


class _Read:
    """A conversation as it's read back, turn by turn."""

    def __init__(self, conv_id: int) -> None:
        self.conv_id, self.turns, self.loss = conv_id, hashlib.sha256(), hashlib.sha256()
        self.n = self.chars = self.formatted = self.shared = self.tokens = 0
        self.counts_up = self.attends = True
        self.past: list[tuple[int, int]] = []

    def turn(self, r: dict) -> None:
        segment = r["segment"]
        role, text = parse_turn(segment)
        trained = unescape(segment[r["loss_start"] : r["loss_end"]])
        self.n += 1
        self.turns.update(f"{role}\n{text}\n".encode())
        self.chars += len(trained)
        self.loss.update(trained.encode())
        self.formatted += len(segment)
        self.shared += r["n_conversations"] > 1
        n = r["n_positions"]
        self.counts_up &= n == 0 or (r["first"], r["last"]) == (self.tokens, self.tokens + n - 1)
        self.attends &= _merged([(a["start"], a["end"]) for a in r["ancestors"]]) == self.past
        self.past = _merged([*self.past, (r["place"], r["place"] + n)])
        self.tokens += n

    def row(self) -> tuple:
        return self.conv_id, self.n, self.turns.hexdigest(), self.chars, self.loss.hexdigest(), self.formatted, self.shared, self.counts_up, self.attends


def _read_batches(batches):
    conv, done = None, []

    def out():
        held = pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*done, strict=True), _READ, strict=True)], schema=_READ)
        done.clear()
        return held

    for batch in pieces(batches):
        for r in batch.to_pylist():
            if conv is None or r["conv_id"] != conv.conv_id:
                if conv:
                    done.append(conv.row())
                conv = _Read(r["conv_id"])
            conv.turn(r)
        if done:
            yield out()
    if conv:
        done.append(conv.row())
        yield out()


def read_back(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of every conversation, from the formatted nodes alone, and what the tree says of it.

    n_shared_turns: turns whose node another conversation has too; positions_count_up: along the conversation the nodes' position
    ids are 0, 1, 2, ..., one a token; attends_to_its_past: each node's ancestor intervals are the places of exactly the
    conversation's tokens before it. Without conversations there are no rows.
    """
    ids, n = F.col("position_ids"), F.size("position_ids")
    each = nodes.select(
        "node_id", "segment", "loss_start", "loss_end", "n_conversations", "place", "ancestors", n.alias("n_positions"),
        F.try_element_at(ids, F.lit(1)).alias("first"), F.try_element_at(ids, F.lit(-1)).alias("last"),
    )
    ordered = beside(members, each, "node_id").repartition("conv_id").sortWithinPartitions("conv_id", "depth").drop("node_id", "depth")
    return ordered.mapInArrow(_read_batches, _READ_DDL)

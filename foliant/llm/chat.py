"""Chat formatting as prefix trees: shared first turns are emitted once, depth first.

Conversations that begin with the same turns share the nodes of these turns. A tree
is laid out as one run of tokens (code points of the formatted text): every node
stands once, before its children. A token's position is its place in its own
conversation, and a node attends to itself and to the intervals of its ancestors.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from typing import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.shared import empty_if_null, written

# Control strings of chat templates, which texts may not hold unescaped.
CONTROLS = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TAIL = "<|end|>\n"
TURN = re.compile(r"<\|(.*?)\|>\n(.*)<\|end\|>\n", re.DOTALL)


def escaped(text: Column) -> Column:
    """A backslash within every control string; backslashes are doubled first, so that this can be undone."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROLS:
        out = F.replace(out, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return out


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


@dataclass
class Trees:
    """``nodes``: tree, node, parent, depth, start, stop (in the tree), position, ancestors (array of [start, stop)),
    loss_start, loss_stop (in the tree), text. ``paths``: conv_id, depth, node, a row for each turn."""

    nodes: DataFrame
    paths: DataFrame


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names each turn by all turns up to it; rows come by conversation and turn."""
    conv, parent, root, depth, position = object(), b"", b"", 0, 0
    for batch in batches:
        rows = []
        for key, role, text, size in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "role", "body", "size")]):
            if key != conv:
                conv, parent, root, depth, position = key, b"", b"", 0, 0
            node = hashlib.blake2b(parent + len(role).to_bytes(8, "little") + role.encode() + text.encode(), digest_size=16).digest()
            root = root or node
            rows.append((root, node, parent or None, depth, position))
            parent, depth, position = node, depth + 1, position + size
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays([*columns, *batch.columns], names=["tree", "node", "parent", "depth", "position", *batch.schema.names])


def format_conversations(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text") -> Trees:
    """Prefix trees of all conversations.

    Turns are ordered by turn, then role, then text; repeated rows are turns of their
    own. Null roles and texts count as empty, and rows without a conversation id are
    one conversation. Control strings in roles and texts are escaped. Only texts of
    the role ``assistant`` are under the loss mask. An empty table gives empty trees.
    """
    head = F.concat(F.lit("<|"), escaped(F.col("role")), F.lit("|>\n"))
    turns = conversations.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), empty_if_null(F.col(role_col)).alias("role"),
        empty_if_null(F.col(text_col)).alias("body"))
    turns = turns.select("*", head.alias("head"), escaped(F.col("body")).alias("safe"))
    turns = turns.select("conv_id", "turn", "role", "body", F.concat("head", "safe", F.lit(TAIL)).alias("text"), F.char_length("head").alias("open"),
                         F.when(F.col("role") == "assistant", F.char_length("safe")).otherwise(0).alias("loss"))
    turns = turns.withColumn("size", F.char_length("text"))
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "body")
    chained = written(ordered.mapInArrow(
        _chained, "tree binary, node binary, parent binary, depth long, position long, conv_id long, turn " + turns.schema["turn"].dataType.simpleString()
        + ", role string, body string, text string, open int, loss int, size int").drop("turn", "role", "body"))
    paths = chained.select("conv_id", "depth", "node")

    # Depth-first order is the order of the paths. Each different path gets a rank that keeps this order.
    whole = paths.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "node"))), lambda x: x["node"]).alias("path"))
    leaves = whole.groupBy(F.element_at("path", -1).alias("leaf")).agg(F.first("path").alias("path")).select("path")
    count = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = written(leaves.repartitionByRange(count, "path").sortWithinPartitions("path").select("path", F.monotonically_increasing_id().alias("rank")))
    steps = ranked.select("rank", F.posexplode("path").alias("depth", "node"))

    # A node belongs to the first path that passes it.
    owner = steps.groupBy("node").agg(F.min("rank").alias("rank"))
    unique = chained.groupBy("node").agg(*[F.first(c).alias(c) for c in ("tree", "parent", "depth", "position", "text", "open", "loss", "size")])
    owned = written(unique.join(owner, "node"))

    # Starts: running sizes within a path's own nodes, within the paths of a range of ranks, and over the ranges.
    own = owned.groupBy("rank").agg(F.sum("size").alias("own")).withColumn("range", F.shiftrightunsigned("rank", 33))
    ranges = own.groupBy("range").agg(F.sum("own").alias("own"))  # a row for each partition
    before = ranges.select("range", (F.sum("own").over(Window.orderBy("range")) - F.col("own")).alias("before"))
    begins = own.join(before, "range").select(
        "rank", (F.col("before") + F.sum("own").over(Window.partitionBy("range").orderBy("rank")) - F.col("own")).alias("begin"))
    placed = owned.join(begins, "rank").withColumn(
        "start", F.col("begin") + F.sum("size").over(Window.partitionBy("rank").orderBy("depth")) - F.col("size"))
    placed = written(placed.withColumn("stop", F.col("start") + F.col("size")))
    firsts = placed.groupBy("tree").agg(F.min("start").alias("base"))

    # What a path shares with earlier ones is a run for each of these: whole stretches of nodes that stand together.
    shared = steps.join(placed.select("node", F.col("rank").alias("owner"), "start", "stop"), "node").where("owner <> rank")
    runs = shared.groupBy("rank", "owner").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    runs = runs.groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("runs"))
    chain = F.when(F.col("start") > F.col("begin"), F.array(F.struct(F.col("begin").alias("start"), F.col("start").alias("stop"))))
    none = F.array().cast("array<struct<start: bigint, stop: bigint>>")
    nodes = placed.join(runs, "rank", "left").join(firsts, "tree").select(
        "tree", "node", "parent", "depth", (F.col("start") - F.col("base")).alias("start"), (F.col("stop") - F.col("base")).alias("stop"), "position",
        F.transform(F.concat(F.coalesce("runs", none), F.coalesce(chain, none)), lambda x: F.struct(
            (x["start"] - F.col("base")).alias("start"), (x["stop"] - F.col("base")).alias("stop"))).alias("ancestors"),
        F.when(F.col("loss") > 0, F.col("start") - F.col("base") + F.col("open")).alias("loss_start"),
        F.when(F.col("loss") > 0, F.col("start") - F.col("base") + F.col("open") + F.col("loss")).alias("loss_stop"), "text")
    return Trees(nodes, paths)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns and losses of each conversation from its nodes, which come by conversation and depth."""
    conv, state = object(), None
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "positions_sha256", "attended_chars"]

    def closed(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string() if i in (2, 4, 6) else pa.int64()) for i in range(8)], names=names)

    def line():
        return conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5].hexdigest(), state[6]

    for batch in batches:
        rows = []
        for key, text, start, lo, hi, position, attended in zip(*[batch.column(c).to_pylist() for c in (
                "conv_id", "text", "start", "loss_start", "loss_stop", "position", "attended")]):
            if state is None or key != conv:
                if state is not None:
                    rows.append(line())
                conv, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, body = TURN.fullmatch(text).groups()
            state[0] += 1
            state[1].update(f"{unescaped(role)}\n{unescaped(body)}\n".encode())
            if lo is not None:
                learnt = unescaped(text[lo - start: hi - start])
                state[2] += len(learnt)
                state[3].update(learnt.encode())
            state[4] += len(text)
            state[5].update(f"{position},".encode())
            state[6] += attended
        yield closed(rows)
    if state is not None:
        yield closed([line()])


def read_back(trees: Trees) -> DataFrame:
    """A row for each conversation, read from the trees alone: conv_id, n_turns, turns_sha256 (role, newline, text, newline
    for each turn), loss_chars and loss_sha256 (all text under the loss mask, unescaped), formatted_chars,
    positions_sha256 (each turn's first position id and a comma) and attended_chars (the tokens that the attention
    intervals of its turns cover, summed over the turns)."""
    attended = F.aggregate("ancestors", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    columns = ["text", "start", "loss_start", "loss_stop", "position", "attended"]
    nodes = trees.nodes.withColumn("attended", attended).select("node", *columns)
    turns = trees.paths.join(nodes, "node").select("conv_id", "depth", *columns)
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "depth").mapInArrow(
        _read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
        "positions_sha256 string, attended_chars long")

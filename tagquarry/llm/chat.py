"""Chat formatting: reply trees to formatted conversations.

Iterative self-joins (pointer doubling) score every root-to-leaf path of any depth, branches are ranked
by score and each chosen path becomes one formatted conversation with its loss mask.

Defined cases: a null text or role is an empty string; a null score counts 0; rows without tree or
node id are left out; a parent that does not exist makes its child a root; nodes on a cycle belong
to no path; repeated (tree, node) rows count once (smallest role, then text); ties between branches
go to the smaller leaf id; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagquarry.functions.tables import global_index

from .common import bound_batches, materialize

# Fixed values of the template: how each role's turn begins and ends.
TURNS = {
    "user": ("[INST] ", " [/INST]"),
    "system": ("[SYS] ", " [/SYS]"),
    "assistant": ("<s> ", " </s>"),
}
OTHER = ("[ROLE] ", " [/ROLE] ", " [END]")
CONTROL = re.compile(r"(<)(\\*)(/?s>)|(\[)(\\*)(/?(?:INST|SYS|ROLE|END)\])")
ESCAPED = re.compile(r"(<)\\(\\*/?s>)|(\[)\\(\\*/?(?:INST|SYS|ROLE|END)\])")
TURN = re.compile(
    r"\[INST\] (?P<user>.*?) \[/INST\]|\[SYS\] (?P<system>.*?) \[/SYS\]|<s> (?P<assistant>.*?) </s>"
    r"|\[ROLE\] (?P<role>.*?) \[/ROLE\] (?P<other>.*?) \[END\]",
    re.S,
)


def escape(text: str) -> str:
    """One backslash more inside each control string, so that none is left; unescape takes it away."""
    return CONTROL.sub(lambda m: (m[1] or m[4]) + "\\" + (m[2] or m[5] or "") + (m[3] or m[6]), text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: (m[1] or m[3]) + (m[2] or m[4]), text)


def format_turns(turns) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the code-point spans under the loss mask."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        body = escape(text)
        if role in TURNS:
            before, after = TURNS[role]
        else:
            before, after = OTHER[0] + escape(role) + OTHER[1], OTHER[2]
        if role == "assistant":
            spans.append((at + len(before), at + len(before) + len(body)))
        parts += (before, body, after)
        at += len(before) + len(body) + len(after)
    return "".join(parts), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, read from the formatted conversation."""
    out = []
    for m in TURN.finditer(formatted):
        kind = m.lastgroup
        if kind == "other":
            out.append((unescape(m["role"]), unescape(m["other"])))
        else:
            out.append((kind, unescape(m[kind])))
    return out


def best_scores(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Leaves (tree_id, leaf_id, score of the whole path) and the jump tables, by pointer doubling.

    Jump table r has (tree_id, node_id, jump): the node 2^r above, where there is one. After round r each
    node knows the score of the 2^r nodes above it, so a tree of depth d takes log2(d) self-joins, each
    on the unique (tree_id, node_id) and of the unfinished nodes only. No path is longer than its tree
    has nodes; what is unfinished beyond that hangs on a cycle.
    """
    known = nodes.select("tree_id", "node_id").withColumnRenamed("node_id", "parent_id")
    seg = nodes.select("tree_id", "node_id", "parent_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    seg = (
        seg.join(known.withColumn("known", F.lit(True)), ["tree_id", "parent_id"], "left")
        .select("tree_id", "node_id", F.when(F.col("known"), F.col("parent_id")).alias("jump"), "score")
    )
    parents = nodes.select("tree_id", F.col("parent_id").alias("node_id")).where("node_id IS NOT NULL").distinct()
    seg = materialize(seg.join(parents.withColumn("inner", F.lit(True)), ["tree_id", "node_id"], "left"))
    largest = seg.groupBy("tree_id").count().agg(F.max("count")).first()[0] or 0
    whole, open_, reach, jumps = seg.where("jump IS NULL"), seg.where("jump IS NOT NULL"), 1, []
    while reach < largest and not open_.isEmpty():
        jumps.append(open_.select("tree_id", "node_id", "jump"))
        up = whole.unionByName(open_).select(
            "tree_id", F.col("node_id").alias("jump"), F.col("jump").alias("next"), F.col("score").alias("up_score")
        )
        grown = materialize(
            open_.join(up, ["tree_id", "jump"]).select(
                "tree_id",
                "node_id",
                F.col("next").alias("jump"),
                (F.col("score") + F.col("up_score")).alias("score"),
                "inner",
            )
        )
        whole, open_ = whole.unionByName(grown.where("jump IS NULL")), grown.where("jump IS NOT NULL")
        reach *= 2
    return whole.where("inner IS NULL").select("tree_id", F.col("node_id").alias("leaf_id"), "score"), jumps


def path_steps(leaves: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """(columns of leaves, node_id, up): the nodes on the path of each leaf and their distance from it.

    From the longest jump to the shortest, each known node adds the one that far above it, so that only
    paths of the given leaves are written, one row per node.
    """
    steps = leaves.withColumn("node_id", F.col("leaf_id")).withColumn("up", F.lit(0).cast("long"))
    for r in reversed(range(len(jumps))):
        here = F.struct("node_id", "up")
        above = F.struct(F.col("jump").alias("node_id"), (F.col("up") + (1 << r)).alias("up"))
        both = F.when(F.col("jump").isNull(), F.array(here)).otherwise(F.array(here, above))
        steps = steps.join(jumps[r], ["tree_id", "node_id"], "left").select(*leaves.columns, F.explode(both).alias("_s"))
        steps = steps.select(*leaves.columns, "_s.node_id", "_s.up")
        if r % 6 == 0 and r:
            steps = materialize(steps)
    return steps


def enumerate_paths(nodes: DataFrame) -> DataFrame:
    """Root-to-leaf paths: (tree_id, leaf_id, score, path array<node_id>)."""
    leaves, jumps = best_scores(nodes)
    paths = path_steps(leaves, jumps).groupBy("tree_id", "leaf_id", "score")
    paths = paths.agg(F.sort_array(F.collect_list(F.struct("up", "node_id")), asc=False).alias("path"))
    return paths.withColumn("path", F.col("path.node_id"))


def _format(batches):
    for b in batches:
        made = [format_turns([(t["role"], t["text"]) for t in turns]) for turns in b["turns"]]
        yield pd.DataFrame(
            {
                "tree_id": b["tree_id"],
                "leaf_id": b["leaf_id"],
                "branch": b["branch"],
                "formatted": [m[0] for m in made],
                "loss_spans": [[{"start": s, "end": e} for s, e in m[1]] for m in made],
            }
        )


def format_reply_trees(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """The `branches` best paths of each tree, formatted.

    nodes: tree_id long, node_id long, parent_id long, role string, text string, score double.
    Returns tree_id, leaf_id, branch (1 is best), formatted, loss_spans array<struct<start,end>>
    (code points of `formatted` that carry loss: the assistant texts).
    """
    bound_batches(nodes.sparkSession)
    nodes = nodes.where("tree_id IS NOT NULL AND node_id IS NOT NULL")
    nodes = nodes.groupBy("tree_id", "node_id").agg(
        F.min(
            F.struct(
                F.coalesce("role", F.lit("")).alias("role"),
                F.coalesce("text", F.lit("")).alias("text"),
                "parent_id",
                "score",
            )
        ).alias("n")
    ).select("tree_id", "node_id", "n.role", "n.text", "n.parent_id", "n.score")
    best = Window.partitionBy("tree_id").orderBy(F.desc("score"), "leaf_id")
    leaves, jumps = best_scores(nodes)
    chosen = leaves.withColumn("branch", F.row_number().over(best)).where(F.col("branch") <= branches)
    turns = (
        path_steps(chosen.drop("score"), jumps)
        .join(nodes.select("tree_id", "node_id", "role", "text"), ["tree_id", "node_id"])
        .groupBy("tree_id", "leaf_id", "branch")
        .agg(F.sort_array(F.collect_list(F.struct("up", "role", "text")), asc=False).alias("turns"))
    )
    return turns.mapInPandas(
        _format,
        "tree_id long, leaf_id long, branch int, formatted string, loss_spans array<struct<start:long,end:long>>",
    )


def conversation_nodes(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as trees of one branch; order: turn, then role, then text.

    Rows are numbered over range partitions, so that a conversation of very many rows is no single task.
    """
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("tree_id"), "turn", "role", "text")
    rows = global_index(rows, ["tree_id", "turn", "role", "text"], "i", deal=3)
    first = rows.groupBy("tree_id").agg((F.min("i") - 1).alias("before"))
    at = F.col("i") - F.col("before")
    return rows.join(first, "tree_id").select(
        "tree_id",
        at.alias("node_id"),
        F.nullif(at - 1, F.lit(0).cast("long")).alias("parent_id"),
        "role",
        "text",
        F.lit(0.0).alias("score"),
    )


def _digest(batches):
    for b in batches:
        rows = []
        for tree, formatted, spans in zip(b["tree_id"], b["formatted"], b["loss_spans"]):
            turns = parse_turns(formatted)
            loss = "".join(unescape(formatted[s["start"] : s["end"]]) for s in spans)
            said = "".join(f"{role}\n{text}\n" for role, text in turns)
            rows.append(
                (
                    tree,
                    len(turns),
                    hashlib.sha256(said.encode()).hexdigest(),
                    len(loss),
                    hashlib.sha256(loss.encode()).hexdigest(),
                    len(formatted),
                )
            )
        yield pd.DataFrame(
            rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        )


def read_back(formatted: DataFrame) -> DataFrame:
    """What a reader finds in the formatted conversations, as digests."""
    return formatted.select("tree_id", "formatted", "loss_spans").mapInPandas(
        _digest,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )

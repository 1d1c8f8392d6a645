"""Conversation prefix trie: what conversations share from their first turn on, as one row per node.

The prefix of d turns has a digest: the sum of 128-bit hashes of its first d (position, role, text), kept in four lanes,
so that a prefix's digest is a running sum and its parent's digest one subtraction away. A count-min sketch
of all prefix digests screens them: an estimate of one proves that a prefix belongs to a single
conversation. Such tails are emitted where they are; only prefixes that may be shared, and the first one below them,
are shuffled for exact grouping.

Subtrees are summed up without walking the tree level by level: each node counts for the smallest
conversation that has it. What lies below a node of depth d is then what its members count for at depth d or more,
and that is a running sum over each member's own turns.

Conversations of any length are cut in blocks of `BLOCK` turns for running sums, so that no task needs a whole one.

Defined cases: a null role or text is empty; rows without conv_id belong to no conversation; turns sort by turn (null first),
then role, then text, so that ties have an order and repeated rows are repeated turns; no rows, no nodes; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagquarry.functions.tables import global_index

from . import cells
from .common import materialize

BLOCK = 512
#: Conversation ids of one range of 2^14 are joined to one string at a time.
ID_BITS = 14
LANES = ("p0", "p1", "p2", "p3")
EMPTY = hashlib.sha256(b"").hexdigest()


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, bytes, turn hash) with a global pos; a conversation may hold any share of the rows. Texts end here."""
    rows = conversations.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    # Ranges by (conversation, turn): the bounds hold no texts, and a long conversation is cut.
    numbered = global_index(rows, ["conv_id", "turn", "role", "text"], "pos", deal=2)
    said = F.md5(F.encode(F.concat_ws("\x00", F.char_length("role").cast("string"), "role", "text"), "UTF-8"))
    return materialize(numbered.select("conv_id", "pos", F.octet_length("text").cast("long").alias("bytes"), said.alias("said")))


def conversation_sizes(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.min("pos").alias("first"), F.count("*").alias("n"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, d from 1, n of the conversation, bytes, h0..h3) and conversations (conv_id, n), rebuilt.

    Conversation c begins with the first h turns of conversation c - c % 5 and goes on with its own turns
    after its first h; h = crc32(c) % 9. For negative c the remainder is the one from 0 to 4.
    """
    turns = numbered_turns(conversations)
    sizes = conversation_sizes(turns)
    h = F.crc32(F.col("conv_id").cast("string")) % 9
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(5))
    known = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = sizes.select("conv_id", "first", "n", h.alias("h"), base.alias("base")).join(known, "base", "left")
    head = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = materialize(convs.select("conv_id", "first", "h", head.alias("head"), (head + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n")))
    placed = materialize(turns.join(convs, "conv_id").withColumn("pos", F.col("pos") - F.col("first")).drop("first"))
    own = placed.where("pos >= h").select("conv_id", (F.col("head") + F.col("pos") - F.col("h") + 1).alias("d"), "n", "bytes", "said")
    # The first eight turns of a base are all that others can begin with; at most five conversations each.
    lent = placed.where("pos < 8 AND pmod(conv_id, 5) = 0").select(
        F.explode(F.sequence(F.col("conv_id"), F.col("conv_id") + 4)).alias("conv_id"), "pos", "bytes", "said"
    )
    lent = lent.where(F.col("pos") < h).join(convs.select("conv_id", "n"), "conv_id")
    lent = lent.select("conv_id", (F.col("pos") + 1).alias("d"), "n", "bytes", "said")
    named = F.md5(F.concat_ws(":", F.col("d").cast("string"), "said"))
    both = own.unionByName(lent).select("conv_id", "d", "n", "bytes", named.alias("hash"))
    lanes = [F.conv(F.substr("hash", F.lit(8 * i + 1), F.lit(8)), 16, 10).cast("long").alias(f"h{i}") for i in range(4)]
    return both.select("conv_id", "d", "n", "bytes", *lanes), convs.select("conv_id", "n")


def running(rows: DataFrame, key: list[str], position: str, made: dict[str, tuple[str, str]], down: bool = False) -> DataFrame:
    """rows with running aggregates by key in the order of `position` (from 1, distinct): name -> (sum or max, column).

    down: from each row on to the last, else from the first on. A key's rows are cut in blocks of positions; the
    aggregates of whole blocks, one row each, are carried over only where a key has more than one block.
    """
    rows = materialize(rows.withColumn("_block", F.floor((F.col(position) - 1) / BLOCK)))
    order = F.desc if down else F.asc
    inside = Window.partitionBy(*key, "_block").orderBy(order(position)).rowsBetween(Window.unboundedPreceding, 0)
    do = {"sum": F.sum, "max": F.max}
    done = rows.withColumns({name: do[kind](column).over(inside) for name, (kind, column) in made.items()})
    longer = rows.where("_block > 0").select(*key).distinct()
    before = Window.partitionBy(*key).orderBy(order("_block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.join(longer, key, "left_semi").groupBy(*key, "_block").agg(*(do[kind](column).alias(name) for name, (kind, column) in made.items()))
    carried = blocks.select(*key, "_block", *(do[kind](name).over(before).alias(f"_{name}") for name, (kind, _) in made.items()))
    done = done.join(carried, [*key, "_block"], "left")
    for name, (kind, _) in made.items():
        more = F.coalesce(f"_{name}", F.lit(0))
        done = done.withColumn(name, F.col(name) + more if kind == "sum" else F.greatest(name, more))
    return done.drop("_block", *(f"_{name}" for name in made))


def _digest(lanes) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", *(lane.cast("string") for lane in lanes))))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, d, n, bytes, digest, parent, h, parent_h): every prefix of at least one turn, by conversation."""
    summed = running(turns, ["conv_id"], "d", {p: ("sum", f"h{i}") for i, p in enumerate(LANES)})
    parents = [F.col(p) - F.col(f"h{i}") for i, p in enumerate(LANES)]
    named = summed.select(
        "conv_id", "d", "n", "bytes", _digest([F.col(p) for p in LANES]).alias("digest"),
        F.when(F.col("d") > 1, _digest(parents)).alias("parent"),
    )
    return named.withColumn("h", F.xxhash64("digest")).withColumn("parent_h", F.xxhash64("parent"))


def ends_digests(ends: DataFrame, key: str = "digest") -> DataFrame:
    """(key, ends_sha256) of rows (key, conv_id): SHA-256 of the ids in order, comma-joined.

    Ids of a range of 2^14 become one string, in many tasks. A group of one range is hashed there; the strings of
    a larger one are hashed in order as they stream by, since SHA-256 needs them one after another.
    """
    listed = ends.groupBy(key, F.shiftright("conv_id", ID_BITS).alias("range")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    listed = materialize(listed.select(key, "range", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids")))
    ranges = listed.groupBy(key).agg(F.count("*").alias("ranges"))
    single = listed.join(ranges.where("ranges = 1").select(key), key).select(key, F.sha2(F.encode("ids", "UTF-8"), 256).alias("ends_sha256"))
    many = listed.join(ranges.where("ranges > 1").select(key), key)

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for batch in batches:
            for own, ids in zip(batch[key], batch["ids"], strict=True):
                if own != at:
                    if state:
                        yield pd.DataFrame({key: [at], "ends_sha256": [state.hexdigest()]})
                    at, state = own, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if state:
            yield pd.DataFrame({key: [at], "ends_sha256": [state.hexdigest()]})

    kind = dict(ends.dtypes)[key]
    streamed = many.repartition(key).sortWithinPartitions(key, "range").mapInPandas(stream, f"{key} {kind}, ends_sha256 string")
    return single.unionByName(streamed)


def prefix_trie(conversations: DataFrame, max_cells: int = cells.MAX_CELLS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    turns, convs = rebuilt(conversations)
    rows = materialize(prefixes(turns))
    sketch = cells.build(rows.select("h"), cells.sketch_cells(rows.count(), max_cells))
    test = cells.tester(spark, sketch.twice, sketch.rows)
    # The root (parent null) needs no screening: it is one row, made last.
    rows = materialize(rows.withColumn("shared", test("h")).withColumn("below", test("parent_h") & F.col("parent").isNotNull()).drop("h", "parent_h"))

    # Proved singletons: everything about them is in their own row, but for the first one's parent.
    ended = F.col("d") == F.col("n")
    alone = rows.where("NOT shared").select(
        "conv_id", F.col("d").alias("depth"), "parent", "below", F.lit(1).cast("long").alias("n_convs"), (~ended).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(ended, F.sha2(F.encode(F.col("conv_id").cast("string"), "UTF-8"), 256)).otherwise(EMPTY).alias("ends_sha256"),
    )
    maybe = rows.where("shared")
    nodes = materialize(maybe.groupBy("digest").agg(
        F.min("conv_id").alias("least"), F.count("*").alias("n_convs"), F.max("n").alias("longest"), F.max("bytes").alias("size"),
        F.max("d").alias("depth"), F.max("parent").alias("parent"), F.max("below").alias("below"),
    ))
    # What each conversation counts for at each depth, and whether a leaf lies below it that counts for it.
    counted = maybe.join(nodes.select("digest", "least", "n_convs", "longest"), "digest")
    first = F.col("conv_id") == F.col("least")
    counted = counted.select(
        "conv_id", "d", "digest", F.when(first, (F.col("n_convs") - 1) * F.col("bytes")).otherwise(0).alias("own"),
        (first & ended & (F.col("longest") == F.col("d"))).cast("int").alias("leaf"),
    )
    edge = rows.where("NOT shared AND below").select("conv_id", "d", F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("own"), F.lit(1).alias("leaf"))
    summed = running(counted.unionByName(edge), ["conv_id"], "d", {"saved": ("sum", "own"), "leaves": ("max", "leaf")}, down=True)
    subtrees = summed.where("digest IS NOT NULL").groupBy("digest").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    children = nodes.select("parent").unionByName(alone.where("below").select("parent")).where("parent IS NOT NULL")
    children = children.groupBy(F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"))
    ends = ends_digests(maybe.where(ended).select("digest", "conv_id"))
    whole = nodes.join(subtrees, "digest").join(children, "digest", "left").join(ends, "digest", "left").select(
        F.col("least").alias("conv_id"), "depth", "parent", "below", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )
    whole = materialize(whole)
    # The parent's smallest conversation: looked up below prefixes that may be shared, the node's own elsewhere.
    parents = nodes.select(F.col("digest").alias("parent"), F.col("least").alias("parent_conv_id"))
    looked = materialize(whole.where("below").unionByName(alone.where("below"))).join(parents, "parent").drop("parent", "below")
    local = whole.where("NOT below").unionByName(alone.where("NOT below")).withColumn("parent_conv_id", F.when(F.col("parent").isNotNull(), F.col("conv_id")))
    inner = materialize(looked.unionByName(local.drop("parent", "below")))

    everyone = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    below_root = inner.agg(
        F.count_if(F.col("depth") == 1).alias("n_children"), F.count_if(F.col("n_children") == 0).alias("n_leaves"), F.coalesce(F.sum(F.when(F.col("depth") == 1, F.col("saved_tokens"))), F.lit(0)).alias("saved_tokens")
    )
    silent = ends_digests(convs.where("n = 0").select(F.lit(b"").alias("digest"), "conv_id")).agg(F.max("ends_sha256").alias("ends_sha256"))
    root = everyone.where("n_convs > 0").crossJoin(F.broadcast(below_root)).crossJoin(F.broadcast(silent)).select(  # one row each
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children",
        F.greatest("n_leaves", F.lit(1).cast("long")).alias("n_leaves"), "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )
    # Nodes of depth one hang on the root, whose smallest conversation is everyone's.
    top = everyone.select(F.col("conv_id").alias("_root"))
    inner = inner.crossJoin(F.broadcast(top)).withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_root")).drop("_root")
    order = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return root.select(order).unionByName(inner.select(order))

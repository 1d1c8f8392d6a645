"""Paths to tags: tokens, stop words, prefixes with counts, and tag text forms."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Path parts that never become tags.
STOP_TOKENS = "usr bin proc sys etc local src dev home root lib pkg sbin share cache".split()
MIN_LENGTH = 3
#: Tags that a task hands on at a time.
BATCH = 100_000


def tokenize_paths(changes: DataFrame) -> DataFrame:
    """(changeset_id, token) for each part of each path."""
    return changes.select("changeset_id", F.explode(F.split("path", "/")).alias("token"))


def drop_stop_tokens(tokens: DataFrame, stop_tokens=STOP_TOKENS) -> DataFrame:
    """Exact, case-sensitive, before cleaning."""
    return tokens.where(~F.col("token").isin(*stop_tokens))


def clean_tokens(tokens: DataFrame) -> DataFrame:
    """Without ':' and '|'; tokens left with fewer than three characters go."""
    cleaned = tokens.withColumn("token", F.translate("token", ":|", ""))
    return cleaned.where(F.char_length("token") >= MIN_LENGTH)


def expand_prefixes(tokens: DataFrame) -> DataFrame:
    """Each token's prefixes of three characters and more, with the next character (null at the end)."""
    size = F.char_length("token")
    long = tokens.withColumn("length", F.explode(F.sequence(F.lit(MIN_LENGTH), size)))
    keep = [c for c in tokens.columns if c != "token"]
    return long.select(
        *keep,
        F.substring("token", F.lit(1), F.col("length")).alias("prefix"),
        F.when(F.col("length") < size, F.substring("token", F.col("length") + 1, F.lit(1))).alias("next"),
    )


def drop_common_tags(tags: DataFrame, stop_tags: DataFrame) -> DataFrame:
    """Without the tags of the one-column table stop_tags (tag)."""
    return tags.join(stop_tags.select("tag").distinct(), "tag", "left_anti")


def extract_tags(
    changes: DataFrame, freq_threshold: int = 2, stop_tokens=STOP_TOKENS, stop_tags: DataFrame | None = None
) -> DataFrame:
    """(instance_id, tag, cnt): prefixes with at least freq_threshold distinct continuations.

    cnt is the number of token occurrences with the prefix. Equal tokens of a changeset are counted
    before the expansion, which then makes a row per distinct token and length. A token and all its prefixes
    share its first characters: one exchange on those serves both aggregations, and splits large changesets.
    """
    tokens = clean_tokens(drop_stop_tokens(tokenize_paths(changes), stop_tokens))
    dealt = tokens.withColumn("head", F.left("token", F.lit(MIN_LENGTH))).repartition("changeset_id", "head")
    counted = dealt.groupBy("changeset_id", "head", "token").agg(F.count("*").alias("n"))
    code = F.ascii("next")
    if freq_threshold <= 1:  # plain numbers keep the aggregation in hash maps
        enough = F.count(code) >= freq_threshold
    elif freq_threshold == 2:
        enough = F.min(code) < F.max(code)
    else:
        enough = F.size(F.collect_set("next")) >= freq_threshold
    tags = (
        expand_prefixes(counted)
        .groupBy("changeset_id", "head", "prefix")
        .agg(F.sum("n").alias("cnt"), enough.alias("enough"))
        .where("enough")
        .select(F.col("changeset_id").alias("instance_id"), F.col("prefix").alias("tag"), "cnt")
    )
    return drop_common_tags(tags, stop_tags) if stop_tags is not None else tags


def _prefix_counts(paths, threshold: int, stops: frozenset) -> dict[str, int]:
    """The tags of one changeset's paths."""
    tokens, freq, nexts = Counter(), Counter(), defaultdict(set)
    for path in paths:
        if path is not None:
            tokens.update(path.split("/"))
    for token, n in tokens.items():
        if token not in stops:
            token = token.replace(":", "").replace("|", "")
            for k in range(MIN_LENGTH, len(token) + 1):
                freq[token[:k]] += n
                if k < len(token):
                    nexts[token[:k]].add(token[k])
    return {p: n for p, n in freq.items() if len(nexts.get(p, ())) >= threshold}


def extract_tags_of_lists(
    changesets: DataFrame, freq_threshold: int = 2, stop_tokens=STOP_TOKENS, stop_tags: DataFrame | None = None
) -> DataFrame:
    """extract_tags of whole changesets (changeset_id, changes array<string>), one row each: nothing is exchanged.

    A changeset that comes as one value fits in a task, and so do its prefixes; where paths come as rows, extract_tags
    spreads a large changeset over many tasks.
    """
    kind, stops = dict(changesets.dtypes)["changeset_id"], frozenset(stop_tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, ids, names, counts = batch.column(0).to_pylist(), [], [], []
            for i, paths in enumerate(batch.column(1)):
                found = _prefix_counts(paths.as_py() or (), freq_threshold, stops)
                ids += [own[i]] * len(found)
                names += found
                counts += found.values()
                if len(ids) >= BATCH or i == len(own) - 1:
                    columns = [pa.array(ids, batch.schema.field(0).type), pa.array(names, pa.string()), pa.array(counts, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["instance_id", "tag", "cnt"])
                    ids, names, counts = [], [], []

    tags = changesets.select("changeset_id", "changes").mapInArrow(run, f"instance_id {kind}, tag string, cnt long")
    return drop_common_tags(tags, stop_tags) if stop_tags is not None else tags


def format_tags(tags: DataFrame, with_count: bool = True) -> DataFrame:
    """(instance_id, text): "tag:count", or the tag alone."""
    text = F.concat_ws(":", "tag", F.col("cnt").cast("string")) if with_count else F.col("tag")
    return tags.select("instance_id", text.alias("text"))


def parse_tags(texts: DataFrame) -> DataFrame:
    """The inverse of format_tags; tags hold no colon."""
    parts = F.split("text", ":")
    return texts.select("instance_id", parts[0].alias("tag"), F.get(parts, F.lit(1)).cast("long").alias("cnt"))


def sum_tags(tags: DataFrame) -> DataFrame:
    return tags.groupBy("instance_id", "tag").agg(F.sum("cnt").alias("cnt"))


def presence(tags: DataFrame) -> DataFrame:
    """Every tag counted once, as for requests that list tags only."""
    return tags.select("instance_id", "tag", F.lit(1).cast("long").alias("cnt"))

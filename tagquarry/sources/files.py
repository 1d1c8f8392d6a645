"""File forms of changesets, tagsets, costs, logs and archives."""

from __future__ import annotations

import io
import json
import re
import tarfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import discard, materialize

CHANGESET = "path string, labels array<string>, changes array<string>, error string"
TAGSET = "path string, id string, labels array<string>, tags map<string,long>, error string"
#: Characters of documents that a task hands on at a time.
PIECE = 4_000_000


def _whole_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def _documents(text: str) -> list[str]:
    """The YAML documents of a file: one, or many between lines of ---."""
    parts = [text] if re.search(r"(?m)^%", text) else re.split(r"(?m)^---[ \t\r]*$", text)
    return [p for p in parts if re.search(r"(?m)^[ \t]*[^\s#]", p)] or [text]


def _number(text: str):
    """A number with a fraction or an exponent as YAML takes it: 1e5 is text there."""
    return float(text) if re.fullmatch(r"-?\d+\.\d+([eE][-+]\d+)?", text) else text


def _parsed(text):
    import yaml

    try:  # JSON text is YAML as well, and read much faster; but YAML folds some characters that JSON keeps
        found = json.loads(text, parse_float=_number, parse_constant=str) if text.lstrip()[:1] == "{" else None
    except ValueError:
        found = None
    if found is None:
        found = yaml.load(text, getattr(yaml, "CSafeLoader", yaml.SafeLoader))
    labels = found.get("labels") or ([found["label"]] if found.get("label") is not None else None)
    if labels is not None:  # YAML reads label: 3.10 as a number, and labels: x as one string
        labels = [str(x) for x in (labels if isinstance(labels, list) else [labels])]
    return found, labels


def _changeset(text):
    found, labels = _parsed(text)
    return labels, [str(c) for c in found["changes"]]


def _tagset(text):
    found, labels = _parsed(text)
    tags = found["tags"]
    if not isinstance(tags, dict):
        pairs = [t.rsplit(":", 1) if ":" in t else (t, 1) for t in map(str, tags)]
        tags = {}
        for k, v in pairs:
            tags[k] = tags.get(k, 0) + int(v)
    own = found.get("id")
    return None if own is None else str(own), labels, {str(k): int(v) for k, v in tags.items()}


def _read(spark: SparkSession, path: str, parse, schema: str) -> DataFrame:
    """One row per document: its file, what parse makes of it, and the error where it fails."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        rows, size = [], 0
        for b in batches:
            for file, value in zip(b["path"], b["value"]):
                for text in _documents(value):
                    try:
                        rows.append((file, *parse(text), None))
                    except Exception as e:  # a bad document is reported, not fatal
                        rows.append((file, *[None] * (len(names) - 2), repr(e)))
                    size += len(text)
                    if size > PIECE:
                        yield pd.DataFrame(rows, columns=names)
                        rows, size = [], 0
        yield pd.DataFrame(rows, columns=names)

    return _whole_files(spark, path).mapInPandas(run, schema)


def read_changesets(spark: SparkSession, path: str) -> DataFrame:
    """One row per YAML document; error is set where it cannot be read as a changeset.

    A file holds one document or many, between lines of ---: small changesets need no file of their own. Spark hands a
    file over as one value, so that files are limited to 2 GB each.
    """
    return _read(spark, path, _changeset, CHANGESET)


def read_tagsets(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(tagsets, rejects): YAML documents as in read_changesets, with map or list tags, label or labels, and an id or none."""
    rows = _read(spark, path, _tagset, TAGSET)
    return rows.where("error IS NULL").drop("error"), rows.where("error IS NOT NULL").select("path", "error")


def write_documents(texts: DataFrame, path: str, most: int = 1_000) -> None:
    """The texts (value), each a YAML document, as files of at most so many documents between lines of ---."""
    texts.select("value").write.option("lineSep", "\n---\n").option("maxRecordsPerFile", most).text(path)


def select_files(files: DataFrame, suffix: str = "tag", names: list[str] | None = None, without: list[str] = ()) -> DataFrame:
    """Files (name) that end in .suffix, whose name up to the last dash is in names (unless that is empty)
    and that start with none of the prefixes in without."""
    kept = files.where(F.endswith("name", F.lit("." + suffix)))
    if names:
        kept = kept.where(F.regexp_extract("name", r"^(.*)-", 1).isin(*names))
    for prefix in without:
        kept = kept.where(~F.startswith("name", F.lit(prefix)))
    return kept


#: Members that are handed on at a time.
MEMBERS = 10_000


def _members(batches):
    names = ["archive", "path", "is_dir", "is_file", "mtime", "error"]
    for b in batches:
        for path, content in zip(b["path"], b["content"]):
            rows = []
            try:
                with tarfile.open(fileobj=io.BytesIO(content), mode="r|*") as tar:  # headers only, one after another
                    for m in tar:
                        tar.members = []
                        rows.append((path, m.name, m.isdir(), m.isfile(), m.mtime, None))
                        if len(rows) >= MEMBERS:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
            except Exception as e:  # a bad archive is reported, not fatal
                rows.append((path, None, None, None, None, repr(e)))
            yield pd.DataFrame(rows, columns=names)


def list_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, path, is_dir, is_file, mtime in seconds, error): the members of each tar file, directories included.

    A file that is no archive, or breaks off, has a row with its error after the members read so far.
    Spark hands a file over as one value, so that archives are limited to 2 GB each.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(_members, "archive string, path string, is_dir boolean, is_file boolean, mtime double, error string")


MANIFEST = "Config string, Layers array<string>"
CONFIG = "history array<struct<created:string,created_by:string,empty_layer:boolean>>"


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """(file, config, k, layer) from image manifests (a JSON array of objects)."""
    rows = spark.read.schema(MANIFEST).json(path, multiLine=True).withColumn("file", F.col("_metadata.file_path"))
    return rows.select("file", F.col("Config").alias("config"), F.posexplode("Layers").alias("k", "layer"))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, created, created_by, empty_layer); empty_layer is null where the key is absent."""
    rows = spark.read.schema(CONFIG).json(path, multiLine=True).withColumn("file", F.col("_metadata.file_path"))
    return rows.select("file", F.posexplode("history").alias("pos", "h")).select(
        "file", "pos", F.col("h.created").cast("timestamp").alias("created"), "h.created_by", "h.empty_layer"
    )


def write_tagsets(tags: DataFrame, instance_label: DataFrame, path: str) -> None:
    """One JSON record per instance: instance_id, labels, tags."""
    sets = tags.groupBy("instance_id").agg(F.map_from_entries(F.collect_list(F.struct("tag", "cnt"))).alias("tags"))
    named = instance_label.groupBy("instance_id").agg(F.sort_array(F.collect_set("label")).alias("labels"))
    sets.join(named, "instance_id", "left").write.mode("append").json(path)


def read_tagset_records(spark: SparkSession, path: str) -> DataFrame:
    schema = "instance_id long, labels array<string>, tags map<string,long>"
    return spark.read.schema(schema).json(path)


def skip_existing(changes: DataFrame, done: DataFrame) -> DataFrame:
    """Changesets without output yet; done: (instance_id)."""
    return changes.join(done.select(F.col("instance_id").alias("changeset_id")).distinct(), "changeset_id", "left_anti")


def write_predictions(predictions: DataFrame, path: str) -> None:
    predictions.groupBy("instance_id").agg(F.sort_array(F.collect_list("label")).alias("labels")).write.json(path)


def dump_predictions(predictions: DataFrame, instances: DataFrame, path: str) -> None:
    """Three outputs: path/lists, path/labels and path/names; instances: (instance_id, name).

    lists has a line ['label', …] for each instance, names its name, both in the order of instance_id, labels a record
    (instance_id, labels). Instances without a label have an empty list.
    """
    said = predictions.groupBy("instance_id").agg(F.sort_array(F.collect_list("label")).alias("labels"))
    none = F.array().cast("array<string>")
    rows = materialize(instances.join(said, "instance_id", "left").withColumn("labels", F.coalesce("labels", none)))
    listed = F.concat(F.lit("["), F.array_join(F.transform("labels", lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))
    rows.orderBy("instance_id").select(listed.alias("value")).write.text(f"{path}/lists")
    rows.orderBy("instance_id").select(F.col("name").alias("value")).write.text(f"{path}/names")
    rows.select("instance_id", "labels").write.json(f"{path}/labels")
    discard(rows)


def learner_lines(tags: DataFrame, instance_label: DataFrame, label_index: DataFrame, classes: int = 3000) -> DataFrame:
    """(instance_id, line): "1:cost 2:cost … | tag tag", cost 0.0 for own labels, padded with 1.0.

    The index starts at 1. Every instance has `classes` costs, as the form demands.
    """
    own = instance_label.join(label_index, "label").groupBy("instance_id").agg(F.collect_set("idx").alias("own"))
    words = tags.groupBy("instance_id").agg(F.array_join(F.sort_array(F.collect_list("tag")), " ").alias("words"))
    cost = F.transform(
        F.sequence(F.lit(1), F.lit(classes)),
        lambda i: F.concat(i.cast("string"), F.when(F.array_contains("own", i.cast("long")), ":0.0").otherwise(":1.0")),
    )
    return words.join(own, "instance_id").select("instance_id", F.concat(F.array_join(cost, " "), F.lit(" | "), "words").alias("line"))


def label_lines(tags: DataFrame, label: DataFrame) -> DataFrame:
    """(instance_id, line): "label | tag:count …"."""
    words = tags.groupBy("instance_id").agg(
        F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "tag", F.col("cnt").cast("string")))), " ").alias("words")
    )
    return words.join(label, "instance_id").select("instance_id", F.concat("label", F.lit(" | "), "words").alias("line"))


def parse_costs(lines: DataFrame) -> DataFrame:
    """(instance_id, line) to (instance_id, label_idx, cost)."""
    token = F.explode(F.split("line", " "))
    parts = F.split("token", ":")
    return lines.select("instance_id", token.alias("token")).select(
        "instance_id", parts[0].cast("long").alias("label_idx"), F.get(parts, F.lit(1)).cast("double").alias("cost")
    )


def training_times(lines: DataFrame) -> DataFrame:
    """(seconds) of the lines "Training took x secs"."""
    found = F.regexp_extract("value", r"Training took ([\d.]+) secs", 1)
    return lines.select(found.alias("s")).where("s <> ''").select(F.col("s").cast("double").alias("seconds"))


def metric_lines(lines: DataFrame, series: dict[str, str]) -> DataFrame:
    """(run, series, value): "key: value" lines whose key starts with a prefix of `series` (prefix to name)."""
    parts = F.split("value", ": ", 2)
    name = F.lit(None).cast("string")
    for prefix, known in sorted(series.items(), key=lambda x: len(x[0])):
        name = F.when(F.startswith("key", F.lit(prefix)), F.lit(known)).otherwise(name)
    rows = lines.select("run", parts[0].alias("key"), F.get(parts, F.lit(1)).alias("text"))
    return rows.select("run", name.alias("series"), F.expr("try_cast(text AS double)").alias("value")).where("series IS NOT NULL AND value IS NOT NULL")


def missing_runs(expected: DataFrame, found: DataFrame) -> DataFrame:
    return expected.select("run").distinct().join(found.select("run"), "run", "left_anti")


def _grams(text, q: int):
    """The distinct runs of q characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(text) - q + 1), lambda i: F.substring(text, i, F.lit(q))))


#: Longer tags are looked up by the rarest of their runs of so many characters, shorter ones by themselves.
GRAM = 3


def holding_any(features: DataFrame, tags: DataFrame) -> DataFrame:
    """The distinct values (feature) that hold any tag (tag) as a substring; an empty tag is in every feature.

    An index of character runs: each tag is looked up by its rarest run only, and what is found is verified.
    """
    known = features.select("feature").where("feature IS NOT NULL").distinct()
    asked = tags.select("tag").where("tag IS NOT NULL").distinct()
    sized = [(q, known.where(F.char_length("feature") >= q).select("feature", F.explode(_grams("feature", q)).alias("gram"))) for q in range(1, GRAM + 1)]
    postings = sized[0][1]
    for _, more in sized[1:]:
        postings = postings.unionByName(more)
    own = F.when(F.char_length("tag") >= GRAM, _grams("tag", GRAM)).otherwise(F.array("tag"))
    wanted = asked.where("tag <> ''").select("tag", F.explode(own).alias("gram"))
    # Only runs that some tag has are kept; their counts tell which run of a tag is the rarest.
    postings = materialize(postings.join(wanted.select("gram").distinct(), "gram", "left_semi"))
    counts = postings.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = wanted.join(counts, "gram", "left").groupBy("tag").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
    looked = rarest.where("r.n > 0").select("tag", F.col("r.gram").alias("gram"))
    found = postings.join(looked, "gram").where(F.contains("feature", F.col("tag"))).select("feature").distinct()
    return found if asked.where("tag = ''").isEmpty() else known


def matching_weights(lines: DataFrame, tags: DataFrame, classifier: int) -> DataFrame:
    """(feature, weight): the lines (value: "feature[class]:weight") of one class whose feature holds any of the tags.

    A line is returned once, however many tags it holds.
    """
    pattern = r"^(.*)\[(\d+)\]:(.*)$"
    weight = F.element_at(F.split("value", ":"), -1).cast("double").alias("weight")
    rows = lines.select(F.regexp_extract("value", pattern, 1).alias("feature"), F.regexp_extract("value", pattern, 2).alias("class"), weight)
    own = rows.where(F.col("class") == str(classifier)).drop("class")
    return own.join(holding_any(own, tags), "feature", "left_semi")


def readable_weights(lines: DataFrame, tags: DataFrame, classifier: int) -> DataFrame:
    """One row (n, total, positives, weights) of the matching weights; weights: the array of all of them, ascending.

    Equal weights are counted first, so that only distinct ones meet in a task and the answer alone holds them all.
    Where that is too long for one row, `matching_weights` has them as rows.
    """
    counts = matching_weights(lines, tags, classifier).groupBy("weight").agg(F.count("*").alias("n"))
    known = F.sort_array(F.collect_list(F.when(F.col("weight").isNotNull(), F.struct("weight", "n"))))
    each = F.transform(known, lambda x: F.array_repeat(x["weight"], x["n"].cast("int")))
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.sum(F.col("weight") * F.col("n")).alias("total"),
        F.coalesce(F.sum(F.when(F.col("weight") > 0, F.col("n"))), F.lit(0)).alias("positives"),
        F.flatten(each).alias("weights"),
    )

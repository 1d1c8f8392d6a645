"""Views of the test tables in the shapes that the operators take, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.tables import table
from .operators import split, tags


def changes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("changeset_id"), F.explode(F.split("text", "\n")).alias("l")).select(
        "changeset_id", F.translate("l", " ", "/").alias("path")
    )


def instance_label(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("instance_id"), F.concat("lang", F.lit("=="), "source").alias("label"))


def multi_label(spark: SparkSession, d: str) -> DataFrame:
    own = instance_label(spark, d)
    return own.select(F.floor(F.col("instance_id") / 2).alias("instance_id"), "label").distinct()


def instance_tag(spark: SparkSession, d: str, threshold: int = 2) -> DataFrame:
    return tags.extract_tags(changes(spark, d), threshold)


def history(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations")
    return rows.select(
        F.col("conv_id").alias("image"), F.col("turn").alias("pos"), F.col("role").alias("created_by"),
        F.when(F.col("turn") % 3 == 2, F.lit(True)).alias("empty_layer"),
    )


def layers(spark: SparkSession, d: str) -> DataFrame:
    real = table(spark, d, "conversations").where("turn % 3 <> 2")
    k = F.col("turn") - F.floor(F.col("turn") / 3)
    return real.select(F.col("conv_id").alias("image"), k.alias("k"), F.concat_ws(":", F.lit("sha256"), "conv_id", "turn").alias("layer"))


def costs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    return rows.groupBy(F.col("l_orderkey").alias("instance_id"), F.col("l_suppkey").alias("label_idx")).agg(
        F.min("l_discount").cast("double").alias("cost")
    )


def true_class(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    return rows.groupBy(F.col("l_orderkey").alias("instance_id")).agg(F.min("l_suppkey").alias("true_idx"))


def _flags(spark, d, low, high):
    rows = table(spark, d, "lineitem").where(F.col("l_linenumber").between(low, high))
    return rows.select(F.col("l_orderkey").alias("instance_id"), F.concat("l_returnflag", "l_linestatus").alias("label")).distinct()


def truth(spark: SparkSession, d: str) -> DataFrame:
    return _flags(spark, d, 1, 3)


def pred(spark: SparkSession, d: str) -> DataFrame:
    return _flags(spark, d, 2, 99)


def vec(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"), F.posexplode("embedding").alias("idx", "e"))
    cnt = F.round(4 * F.abs("e")).cast("int")
    return rows.select(F.col("vec_id").alias("instance_id"), "label", "idx", cnt.alias("cnt")).where("cnt > 0")


def epoch_load(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    epoch = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400)
    return rows.groupBy(F.col("event_type").alias("model_id"), epoch.alias("epoch")).agg(F.count("*").alias("load"))


def stages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.concat_ws("-", F.lit("run"), F.col("user_id").cast("string"), "event_type").alias("name"), "ts", F.col("value").alias("seconds")
    )


def model_label(spark: SparkSession, d: str, n_models: int = 4) -> DataFrame:
    return split.random_groups(instance_label(spark, d), n_models, 4)


def stumps(spark: SparkSession, d: str, own_tags: DataFrame | None = None) -> DataFrame:
    """Fixed stumps: of each (model, label) the ten most frequent tags (of own_tags, where they are at hand)."""
    from pyspark.sql import Window

    own = instance_label(spark, d).join(model_label(spark, d), "label")
    n = (instance_tag(spark, d) if own_tags is None else own_tags).join(own, "instance_id").groupBy("model_id", "label", "tag").agg(F.count("*").alias("n"))
    order = Window.partitionBy("model_id", "label").orderBy(F.desc("n"), "tag")
    top = n.withColumn("round", F.row_number().over(order)).where("round <= 10")
    return top.select(
        "model_id", "label", "round", "tag", F.lit(1).cast("long").alias("cut"), F.lit(-0.1).alias("leaf_low"),
        F.lit(0.4).alias("leaf_high"), F.lit(-0.1).alias("leaf_default"),
    )


#: The same views for DuckDB, each as (names it needs, body).
STOPS = ", ".join(f"'{t}'" for t in tags.STOP_TOKENS)
CTE = {
    "changes": ((), "SELECT doc_id AS changeset_id, translate(l, ' ', '/') AS path FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents)"),
    "tokens": (("changes",), "SELECT changeset_id, unnest(string_split(path, '/')) AS token FROM changes"),
    "cleaned": (("tokens",), f"SELECT * FROM (SELECT changeset_id, translate(token, ':|', '') AS token FROM tokens WHERE token NOT IN ({STOPS})) WHERE len(token) >= 3"),
    "prefixes": (("cleaned",), "SELECT changeset_id, left(token, n) AS prefix, CASE WHEN n < len(token) THEN token[n + 1] END AS next FROM (SELECT changeset_id, token, unnest(range(3, len(token) + 1)) AS n FROM cleaned)"),
    "tags1": (("prefixes",), "SELECT changeset_id AS instance_id, prefix AS tag, count(*) AS cnt FROM prefixes GROUP BY ALL HAVING count(DISTINCT next) >= 1"),
    "tags": (("prefixes",), "SELECT changeset_id AS instance_id, prefix AS tag, count(*) AS cnt FROM prefixes GROUP BY ALL HAVING count(DISTINCT next) >= 2"),
    "il": ((), "SELECT doc_id AS instance_id, concat(lang, '==', source) AS label FROM documents"),
    "ml": ((), "SELECT DISTINCT doc_id // 2 AS instance_id, concat(lang, '==', source) AS label FROM documents"),
    "combos": (("il",), "SELECT instance_id, string_agg(DISTINCT label, '&&' ORDER BY label) AS label_key, count(DISTINCT label) AS n_labels FROM il GROUP BY 1"),
    "mcombos": (("ml",), "SELECT instance_id, string_agg(DISTINCT label, '&&' ORDER BY label) AS label_key, count(DISTINCT label) AS n_labels FROM ml GROUP BY 1"),
    "tagdf": (("tags", "combos"), "SELECT tag, count(DISTINCT label_key) AS n_labels FROM tags JOIN combos USING (instance_id) GROUP BY 1"),
    "vocab": (("tags",), "SELECT tag, row_number() OVER (ORDER BY tag) - 1 AS idx FROM (SELECT DISTINCT tag FROM tags)"),
    "lidx": (("il",), "SELECT label, row_number() OVER (ORDER BY label) - 1 AS idx FROM (SELECT DISTINCT label FROM il)"),
    "models": (("il",), "SELECT label, CAST(floor((row_number() OVER (ORDER BY md5(concat('4', label)), label) - 1) / greatest(1, floor(count(*) OVER () / 4))) AS BIGINT) AS model_id FROM (SELECT DISTINCT label FROM il)"),
    "mtags": (("tags", "il", "models"), "SELECT model_id, label, tag, count(*) AS n FROM tags JOIN il USING (instance_id) JOIN models USING (label) GROUP BY ALL"),
    "stumps": (("mtags",), "SELECT model_id, label, tag, 1 AS cut, -0.1::DOUBLE AS leaf_low, 0.4::DOUBLE AS leaf_high, -0.1::DOUBLE AS leaf_default FROM mtags QUALIFY row_number() OVER (PARTITION BY model_id, label ORDER BY n DESC, tag) <= 10"),
    "used": (("stumps",), "SELECT DISTINCT model_id, tag FROM stumps"),
    "selected": (("tags", "used"), "SELECT model_id, instance_id, tag, cnt FROM tags JOIN used USING (tag)"),
    "scored": (("selected", "stumps"), """SELECT a.model_id, a.instance_id, b.label, b.base + coalesce(m.moved, 0) AS margin
      FROM (SELECT DISTINCT model_id, instance_id FROM selected) a
      JOIN (SELECT model_id, label, sum(leaf_default) AS base FROM stumps GROUP BY 1, 2) b USING (model_id)
      LEFT JOIN (SELECT model_id, instance_id, label, sum(CASE WHEN cnt >= cut THEN leaf_high ELSE leaf_low END - leaf_default) AS moved
                 FROM selected JOIN stumps USING (model_id, tag) GROUP BY 1, 2, 3) m
      ON m.model_id = a.model_id AND m.instance_id = a.instance_id AND m.label = b.label"""),
    "costs": ((), "SELECT l_orderkey AS instance_id, l_suppkey AS label_idx, CAST(min(l_discount) AS DOUBLE) AS cost FROM lineitem GROUP BY 1, 2"),
    "tclass": ((), "SELECT l_orderkey AS instance_id, min(l_suppkey) AS true_idx FROM lineitem GROUP BY 1"),
    "truth": ((), "SELECT DISTINCT l_orderkey AS instance_id, concat(l_returnflag, l_linestatus) AS label FROM lineitem WHERE l_linenumber <= 3"),
    "pred": ((), "SELECT DISTINCT l_orderkey AS instance_id, concat(l_returnflag, l_linestatus) AS label FROM lineitem WHERE l_linenumber >= 2"),
    "sides": (("truth", "pred"), "SELECT coalesce(t.instance_id, p.instance_id) AS instance_id, coalesce(t.label, p.label) AS label, t.label IS NOT NULL AS t, p.label IS NOT NULL AS p FROM truth t FULL JOIN pred p ON t.instance_id = p.instance_id AND t.label = p.label"),
    "report": (("sides",), """SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
      CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1 FROM (
      SELECT label, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t) AS fp, count(*) FILTER (NOT p) AS fn, count(*) FILTER (t) AS support FROM sides GROUP BY 1)"""),
    "sets": (("truth", "pred"), """SELECT instance_id, coalesce(t, '') AS t, coalesce(p, '') AS p, coalesce(n, 0) AS n FROM
      (SELECT instance_id, string_agg(label, ',' ORDER BY label) AS t FROM truth GROUP BY 1) FULL JOIN
      (SELECT instance_id, string_agg(label, ',' ORDER BY label) AS p, count(*) AS n FROM pred GROUP BY 1) USING (instance_id)"""),
    "vec": ((), """SELECT vec_id AS instance_id, CAST(label AS VARCHAR) AS label, p AS idx, CAST(round(4 * abs(e)) AS INT) AS cnt
      FROM (SELECT vec_id, label, unnest(range(len(embedding))) AS p, unnest(embedding) AS e FROM embeddings) WHERE round(4 * abs(e)) > 0"""),
    "means": (("vec",), """SELECT block, idx, round_even(s / n, 0) AS mean FROM
      (SELECT instance_id // 5 AS block, idx, sum(cnt) AS s FROM vec GROUP BY 1, 2) JOIN
      (SELECT instance_id // 5 AS block, count(DISTINCT instance_id) AS n FROM vec GROUP BY 1) USING (block) WHERE round_even(s / n, 0) > 0"""),
    "cosine": (("means",), """SELECT a.block AS a, b.block AS b, sum(a.mean * b.mean) / any_value(na.n * nb.n) AS cosine FROM means a JOIN means b ON a.idx = b.idx AND a.block < b.block
      JOIN (SELECT block, sqrt(sum(mean * mean)) AS n FROM means GROUP BY 1) na ON na.block = a.block
      JOIN (SELECT block, sqrt(sum(mean * mean)) AS n FROM means GROUP BY 1) nb ON nb.block = b.block GROUP BY 1, 2"""),
    "load": ((), "SELECT event_type AS model_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS epoch, count(*) AS load FROM events GROUP BY 1, 2"),
    "stage": ((), "SELECT concat('run-', user_id, '-', event_type) AS name, ts, value AS seconds FROM events"),
    "history": ((), "SELECT conv_id AS image, turn AS pos, role AS created_by, CASE WHEN turn % 3 = 2 THEN true END AS empty_layer FROM conversations"),
    "layers": ((), "SELECT conv_id AS image, turn - turn // 3 AS k, concat('sha256:', conv_id, ':', turn) AS layer FROM conversations WHERE turn % 3 <> 2"),
    "versions": ((), "SELECT DISTINCT p_brand AS package, concat(p_size, '.0') AS version, p_size AS pos FROM part"),
}


def sql(names: str, body: str) -> str:
    """A query with the CTEs that it names (space-separated) and those they need, each made once.

    A body may go on with CTEs of its own: it then starts with a comma.
    """
    order: list[str] = []

    def need(n):
        if n not in order:
            for m in CTE[n][0]:
                need(m)
            order.append(n)

    for n in names.split():
        need(n)
    known = ",\n".join(f"{n} AS MATERIALIZED ({CTE[n][1]})" for n in order)
    return f"WITH {known}{'' if body.lstrip().startswith(',') else chr(10)}{body}"

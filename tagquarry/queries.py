"""One registered query per operator over the fixture views, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from .fixtures import sql
from .functions.tables import global_index, materialize, scratch, table
from .operators import catalog, encode, experts, filters, labels, layers, metrics, rank, similarity, split, stats, tags, train, trees
from .sources import files
from .streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register the function under its name; oracle is the SQL of the same rows."""

    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return keep


# Tags ------------------------------------------------------------------------------------------


@query(sql("tags", "SELECT * FROM tags"))
def a1_extract_tags(s, d):
    return tags.extract_tags(fx.changes(s, d), 2)


@query(sql("tags1", "SELECT * FROM tags1 WHERE tag NOT IN ('the', 'tion', 'and')"))
def a1_extract_tags_threshold_1(s, d):
    stop = s.createDataFrame([("the",), ("tion",), ("and",)], "tag string")
    return tags.extract_tags(fx.changes(s, d), 1, stop_tags=stop)


@query(sql("tokens", "SELECT changeset_id, token, count(*) AS n FROM tokens GROUP BY ALL"))
def p1_tokenize_paths(s, d):
    return tags.tokenize_paths(fx.changes(s, d)).groupBy("changeset_id", "token").agg(F.count("*").alias("n"))


@query(sql("tokens", "SELECT changeset_id, count(*) AS n FROM tokens WHERE token NOT IN ('the', 'of', 'usr') GROUP BY ALL"))
def p2_stop_tokens(s, d):
    kept = tags.drop_stop_tokens(tags.tokenize_paths(fx.changes(s, d)), ["the", "of", "usr"])
    return kept.groupBy("changeset_id").agg(F.count("*").alias("n"))


@query(sql("tokens", "SELECT token, count(*) AS n FROM (SELECT translate(token, ':|', '') AS token FROM tokens) WHERE len(token) >= 3 GROUP BY ALL"))
def p3_clean_tokens(s, d):
    return tags.clean_tokens(tags.tokenize_paths(fx.changes(s, d))).groupBy("token").agg(F.count("*").alias("n"))


@query(sql("prefixes", "SELECT prefix, next, count(*) AS n FROM prefixes GROUP BY ALL"))
def p4_expand_prefixes(s, d):
    cleaned = tags.clean_tokens(tags.drop_stop_tokens(tags.tokenize_paths(fx.changes(s, d))))
    return tags.expand_prefixes(cleaned).groupBy("prefix", "next").agg(F.count("*").alias("n"))


@query(sql("tags", "SELECT * FROM tags WHERE tag NOT IN (SELECT DISTINCT lower(p_brand) FROM part) AND tag NOT IN ('the', 'and')"))
def p5_drop_common_tags(s, d):
    stop = table(s, d, "part").select(F.lower("p_brand").alias("tag")).union(s.createDataFrame([("the",), ("and",)], "tag string"))
    return tags.drop_common_tags(fx.instance_tag(s, d), stop)


@query(sql("tags", "SELECT instance_id, concat(tag, ':', cnt) AS text FROM tags"))
def p6_format_tags(s, d):
    return tags.format_tags(fx.instance_tag(s, d))


@query(sql("tags", "SELECT * FROM tags"))
def p7_parse_tags(s, d):
    return tags.parse_tags(tags.format_tags(fx.instance_tag(s, d)))


@query(sql("tags", "SELECT instance_id // 2 AS instance_id, tag, CAST(sum(cnt) AS BIGINT) AS cnt FROM tags GROUP BY 1, 2"))
def a2_sum_tags(s, d):
    return tags.sum_tags(fx.instance_tag(s, d).withColumn("instance_id", F.floor(F.col("instance_id") / 2)))


@query(sql("tags", "SELECT instance_id, tag, CAST(1 AS BIGINT) AS cnt FROM tags"))
def p18_presence(s, d):
    return tags.presence(fx.instance_tag(s, d))


# Labels ----------------------------------------------------------------------------------------


@query("SELECT doc_id AS instance_id, CASE WHEN doc_id % 2 = 0 THEN concat(lang, ',', source) ELSE lang END AS labels FROM documents")
def p8_unify_labels(s, d):
    docs = table(s, d, "documents")
    rows = docs.select(
        F.col("doc_id").alias("instance_id"), F.when(F.col("doc_id") % 2 == 0, F.array("lang", "source")).alias("labels"), F.col("lang").alias("label")
    )
    return labels.unify_labels(rows).select("instance_id", F.array_join("labels", ",").alias("labels"))


_VERSIONED = "(SELECT doc_id, concat(lang, '==', source, '.1') AS label, lang FROM documents)"


@query(f"SELECT doc_id, replace(replace(label, '==', '_v'), '.', '_') AS name, concat(replace(replace(label, '==', '_v'), '.', '_'), '_p_', lang) AS joined, replace(replace(concat('ubuntu:', doc_id, '.04'), ':', ''), '.', '_') AS base FROM {_VERSIONED}")
def p9_normalise(s, d):
    rows = table(s, d, "documents").select("doc_id", F.concat("lang", F.lit("=="), "source", F.lit(".1")).alias("label"), "lang")
    base = F.concat(F.lit("ubuntu:"), F.col("doc_id").cast("string"), F.lit(".04"))
    return rows.select(
        "doc_id", labels.normalise(F.col("label")).alias("name"), labels.join_names(F.array("label", "lang")).alias("joined"), labels.base_image_name(base).alias("base")
    )


@query("SELECT doc_id, concat(lang, '==', replace(source, '_', '.'), ',', lang, '==3.1') AS found FROM documents")
def p10_denormalise(s, d):
    name = F.concat(F.lit("a.b."), "lang", F.lit("_v"), "source", F.lit("_p_"), "lang", F.lit("_v3_1.tag"))
    return table(s, d, "documents").select("doc_id", F.array_join(labels.denormalise(name), ",").alias("found"))


@query(sql("il", "SELECT instance_id, split_part(label, '==', 1) AS package, split_part(label, '==', 2) AS version FROM il"))
def p11_package_version(s, d):
    return fx.instance_label(s, d).select("instance_id", labels.package(F.col("label")).alias("package"), labels.version(F.col("label")).alias("version"))


@query("SELECT doc_id, concat(source, '-', doc_id) AS label, concat(lang, '.', source) AS package, lang AS program FROM documents")
def p12_file_fields(s, d):
    name = F.concat("lang", F.lit("."), "source", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".tag"))
    return table(s, d, "documents").select("doc_id", labels.file_fields(name).alias("f")).select("doc_id", "f.label", "f.package", "f.program")


@query(sql("mcombos", "SELECT * FROM mcombos"))
def p13_combinations(s, d):
    return labels.combinations(fx.multi_label(s, d)).withColumn("n_labels", F.col("n_labels").cast("long"))


@query(sql("truth", "SELECT instance_id, min(label) AS label FROM truth GROUP BY 1 HAVING count(*) = 1"))
def p20_single_label(s, d):
    return labels.single_label(fx.truth(s, d))


@query(sql("layers", "SELECT concat(image, '_layer_idx_', k) AS instance_id, image, layer FROM layers"))
def p21_flatten_images(s, d):
    images = fx.layers(s, d).groupBy("image").agg(F.sort_array(F.collect_list(F.struct("k", "layer"))).alias("l"))
    return labels.flatten_images(images.select("image", F.col("l.layer").alias("layers")))


# Filters ---------------------------------------------------------------------------------------


@query(sql("tagdf", "SELECT t.* FROM tags t LEFT JOIN tagdf d USING (tag) WHERE coalesce(d.n_labels, 0) < 5"))
def p14_filter_by_frequency(s, d):
    own = materialize(fx.instance_tag(s, d))
    return filters.filter_by_frequency(own, filters.tag_label_frequency(own, fx.instance_label(s, d)), 5)


@query(sql("tagdf", "SELECT DISTINCT instance_id FROM tags ANTI JOIN (SELECT t.instance_id FROM tags t LEFT JOIN tagdf d USING (tag) WHERE coalesce(d.n_labels, 0) < 5) USING (instance_id)"))
def p14_emptied_instances(s, d):
    own = materialize(fx.instance_tag(s, d))
    return filters.emptied_instances(own, filters.filter_by_frequency(own, filters.tag_label_frequency(own, fx.instance_label(s, d)), 5))


@query("SELECT changeset_id, path FROM (SELECT doc_id AS changeset_id, translate(l, ' ', '/') AS path FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents)) WHERE contains(path, 'the/') AND NOT contains(path, 'tion/')")
def p17_site_package_files(s, d):
    return filters.site_package_files(fx.changes(s, d), "the/", ("tion/",))


@query("SELECT doc_id AS archive, path FROM (SELECT doc_id, translate(l, ' ', '/') AS path FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents)) WHERE contains(path, 'the/') AND NOT contains(path, 'tion/') AND len(path) % 3 <> 0")
def p17_regular_files(s, d):
    """Archive members: a third are no regular files."""
    members = fx.changes(s, d).select(F.col("changeset_id").alias("archive"), "path", (F.char_length("path") % 3 != 0).alias("is_file"))
    return filters.site_package_files(members, "the/", ("tion/",)).drop("is_file")


@query(sql("costs", "SELECT * FROM costs WHERE cost <= 0.05"))
def p19_cost_positive(s, d):
    return filters.cost_positive(fx.costs(s, d), 0.05)


@query(sql("tagdf", "SELECT * FROM tagdf"))
def a4_tag_label_frequency(s, d):
    return filters.tag_label_frequency(fx.instance_tag(s, d), fx.instance_label(s, d))


@query(sql("tags il", "SELECT tags.* FROM tags ANTI JOIN (SELECT tag FROM tags JOIN il USING (instance_id) GROUP BY 1 HAVING count(DISTINCT label) > 10) USING (tag)"))
def a10_remove_tags_of_many_labels(s, d):
    return filters.remove_tags_of_many_labels(materialize(fx.instance_tag(s, d)), fx.instance_label(s, d), 10)


@query(sql("tags", "SELECT tags.* FROM tags ANTI JOIN (SELECT tag FROM tags GROUP BY 1 HAVING sum(cnt) > 100) USING (tag)"))
def a11_remove_tags_by_total(s, d):
    return filters.remove_tags_by_total(materialize(fx.instance_tag(s, d)), 100)


@query(sql("tags il", "SELECT DISTINCT tag FROM (SELECT label, tag FROM tags JOIN il USING (instance_id) GROUP BY 1, 2 HAVING count(DISTINCT instance_id) < 5)"))
def a33_noise_tags(s, d):
    return filters.noise_tags(materialize(fx.instance_tag(s, d)), fx.instance_label(s, d))


_SHARED = "SELECT DISTINCT tag FROM tags JOIN il USING (instance_id) WHERE label = 'en==src0' INTERSECT SELECT DISTINCT tag FROM tags JOIN il USING (instance_id) WHERE label <> 'en==src0'"


@query(sql("tags il", _SHARED))
def u6_shared_with_label(s, d):
    return filters.shared_with_label(materialize(fx.instance_tag(s, d)), fx.instance_label(s, d), "en==src0")


@query(sql("tags il", f"SELECT tags.* FROM tags ANTI JOIN ({_SHARED}) USING (tag)"))
def u6_remove_shared_with_label(s, d):
    return filters.remove_shared_with_label(materialize(fx.instance_tag(s, d)), fx.instance_label(s, d), "en==src0")


# Encoding --------------------------------------------------------------------------------------


@query(sql("tags", "SELECT DISTINCT tag FROM tags"))
def a3_vocabulary(s, d):
    return encode.vocabulary(fx.instance_tag(s, d))


@query(sql("vocab", "SELECT * FROM vocab"))
def w5_assign_index(s, d):
    return encode.assign_index(fx.instance_tag(s, d), "tag")


@query(sql("tags", """, known AS (SELECT tag, row_number() OVER (ORDER BY tag) - 1 AS idx FROM (SELECT DISTINCT tag FROM tags WHERE instance_id % 2 = 0)),
fresh AS (SELECT DISTINCT tag FROM tags WHERE tag NOT IN (SELECT tag FROM known))
SELECT tag, idx FROM known UNION ALL SELECT tag, (SELECT max(idx) FROM known) + row_number() OVER (ORDER BY tag) FROM fresh"""))
def w6_append_index(s, d):
    own = materialize(fx.instance_tag(s, d))
    return encode.append_index(encode.assign_index(own.where("instance_id % 2 = 0"), "tag"), own, "tag")


@query(sql("vocab", "SELECT instance_id, tag, cnt, idx FROM tags JOIN (SELECT * FROM vocab WHERE idx % 3 = 0) USING (tag)"))
def j3_look_up(s, d):
    own = materialize(fx.instance_tag(s, d))
    return encode.look_up(own, encode.assign_index(own, "tag").where("idx % 3 = 0"), "tag").select("instance_id", "tag", "cnt", "idx")


@query(sql("lidx ml", "SELECT DISTINCT label FROM ml WHERE label NOT IN (SELECT label FROM lidx WHERE idx % 3 = 0)"))
def j4_unseen_labels(s, d):
    index = encode.assign_index(fx.instance_label(s, d), "label").where("idx % 3 = 0")
    return encode.unseen(fx.multi_label(s, d), index, "label")


@query(sql("vocab", ", n AS (SELECT greatest(1, count(*) // 4) AS size FROM vocab) SELECT instance_id, idx % size AS idx, CAST(arg_max(cnt, idx) AS DOUBLE) AS value FROM tags JOIN vocab USING (tag), n GROUP BY 1, 2"))
def m1_encode_features(s, d):
    own = materialize(fx.instance_tag(s, d))
    return encode.encode_features(own, encode.assign_index(own, "tag"), compact_factor=4)


@query(sql("lidx ml", "SELECT instance_id, idx, 1 AS value FROM ml JOIN lidx USING (label)"))
def m2_encode_labels(s, d):
    return encode.encode_labels(fx.multi_label(s, d), encode.assign_index(fx.instance_label(s, d), "label"))


_BAG = ", ".join(f"coalesce(CAST(sum(cnt) FILTER (tag = '{t}') AS DOUBLE), 0) AS {t}" for t in ("the", "ing"))


@query(sql("tags", f"SELECT instance_id, {_BAG} FROM tags GROUP BY 1"))
def m2b_bag_of_words(s, d):
    from pyspark.ml.functions import vector_to_array

    v = vector_to_array("features")
    return encode.bag_of_words(fx.instance_tag(s, d), ["the", "ing"]).select("instance_id", v[0].alias("the"), v[1].alias("ing"))


@query(sql("vocab", "SELECT * FROM vocab"))
def s8_save_and_load_index(s, d):
    path = scratch(s)
    encode.save_index(encode.assign_index(fx.instance_tag(s, d), "tag"), path, "m0")
    return encode.load_index(s, path, "m0")


@query(sql("vocab lidx", "SELECT 'm0' AS model_id, tag AS value, idx FROM vocab UNION ALL SELECT 'm1', label, idx FROM lidx"))
def s8_save_index_again(s, d):
    """Saving a model's index again replaces it and touches no other."""
    path, found = scratch(s), materialize(fx.instance_tag(s, d))
    first = encode.assign_index(found.where("cnt > 2"), "tag").withColumnRenamed("tag", "value")
    encode.save_index(first, path, "m0")
    encode.save_index(encode.assign_index(fx.instance_label(s, d), "label").withColumnRenamed("label", "value"), path, "m1")
    for _ in range(2):
        encode.save_index(encode.assign_index(found, "tag").withColumnRenamed("tag", "value"), path, "m0")
    return s.read.parquet(path).select("model_id", "value", "idx")


# Splits and groups -----------------------------------------------------------------------------

_R = "row_number() OVER (PARTITION BY label ORDER BY instance_id) - 1 AS r"


@query(sql("il", f"SELECT instance_id, label FROM (SELECT *, {_R} FROM il) WHERE r < 3"))
def w1_first_per_label(s, d):
    return split.first_per_label(fx.instance_label(s, d), 3)


@query(sql("il", f"SELECT instance_id, label, r >= 2 AND r < 4 AS is_test FROM (SELECT *, {_R} FROM il) WHERE r < 8"))
def w2_rotating_split(s, d):
    return split.rotating_split(fx.instance_label(s, d), 8, 0.25, 1)


@query(sql("il", f"SELECT instance_id, label, CAST(r % 3 AS INTEGER) AS fold FROM (SELECT *, {_R} FROM il)"))
def w3_stratified_folds(s, d):
    return split.stratified_folds(fx.instance_label(s, d), 3)


@query(sql("il", "SELECT instance_id, label, CAST((row_number() OVER (ORDER BY md5(concat('7', instance_id)), instance_id) - 1) % 3 AS INTEGER) AS fold FROM il"))
def w4_random_folds(s, d):
    return split.random_folds(fx.instance_label(s, d), 3, 7)


@query(sql("models", "SELECT label, model_id FROM models"))
def w9_random_groups(s, d):
    return split.random_groups(fx.instance_label(s, d), 4, 4)


@query(sql("il", ", p AS (SELECT DISTINCT split_part(label, '==', 1) AS package FROM il), g AS (SELECT package, CAST(floor((row_number() OVER (ORDER BY md5(concat('4', package)), package) - 1) / greatest(1, floor(count(*) OVER () / 2))) AS BIGINT) AS model_id FROM p) SELECT DISTINCT label, model_id FROM il JOIN g ON split_part(label, '==', 1) = package"))
def w10_version_packed_groups(s, d):
    return split.version_packed_groups(fx.instance_label(s, d), 2, 4)


@query("SELECT source AS group_id, (row_number() OVER (ORDER BY source) - 1) % least(7, count(*) OVER ()) AS model_id FROM (SELECT DISTINCT source FROM documents)")
def w11_round_robin_groups(s, d):
    return split.round_robin_groups(table(s, d, "documents").select(F.col("source").alias("group_id")), 7)


@query(sql("il", "SELECT instance_id, label, CAST(floor((row_number() OVER (ORDER BY instance_id) - 1) / greatest(1, floor(count(*) OVER () / 6))) AS BIGINT) AS batch FROM il"))
def w15_slices(s, d):
    return split.slices(fx.instance_label(s, d), 6)


@query("SELECT concat(lang, '.', source, '-', doc_id, '.tag') AS name, row_number() OVER (ORDER BY concat(lang, '.', source, '-', doc_id, '.tag')) - 1 AS idx FROM documents")
def w16_sort_by_name(s, d):
    name = F.concat("lang", F.lit("."), "source", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".tag"))
    return global_index(table(s, d, "documents").select(name.alias("name")), ["name"])


@query(sql("il", "SELECT instance_id, label, unnest([1, 2, 3]) AS copy FROM il"))
def w19_oversample(s, d):
    return split.oversample(fx.instance_label(s, d), 3)


@query(sql("il", f"SELECT instance_id, label, k, concat(label, '.', k) AS name FROM (SELECT instance_id, label, CAST(r + CASE WHEN label = 'en==src0' THEN 5 ELSE 0 END AS BIGINT) AS k FROM (SELECT instance_id, label, {_R} FROM il))"))
def w20_number_samples(s, d):
    used = s.createDataFrame([("en==src0", 4)], "label string, k int")
    return split.number_samples(fx.instance_label(s, d), used).withColumn("k", F.col("k").cast("long"))


@query(sql("il", f", c AS (SELECT least(25, min(n)) AS cap FROM (SELECT count(*) AS n FROM il GROUP BY label)) SELECT instance_id, label FROM (SELECT *, {_R} FROM il), c WHERE r < cap"))
def w21_equal_groups(s, d):
    return split.equal_groups(fx.instance_label(s, d))


@query(sql("il", f"SELECT instance_id, label, CASE WHEN r < 2 THEN 'test' ELSE 'train' END AS part FROM (SELECT *, {_R} FROM il) WHERE r < 32"))
def s16_stratified_copy(s, d):
    return split.stratified_copy(fx.instance_label(s, d))


@query(sql("il", f"SELECT instance_id, label, CASE WHEN r < 2 THEN 'test' ELSE 'train' END AS part FROM (SELECT *, {_R} FROM il) WHERE r < 32"))
def s16_write_stratified(s, d):
    path = scratch(s)
    split.write_stratified(fx.instance_label(s, d), path)
    return s.read.parquet(f"{path}/test").withColumn("part", F.lit("test")).unionByName(s.read.parquet(f"{path}/train").withColumn("part", F.lit("train")))


@query(sql("il", f"SELECT instance_id, label FROM (SELECT *, {_R} FROM il) WHERE NOT (r < 8 AND r >= 2 AND r < 4)"))
def u4_train_rows(s, d):
    own = fx.instance_label(s, d)
    return split.train_rows(own, split.rotating_split(own, 8, 0.25, 1).where("is_test"))


# Experts ---------------------------------------------------------------------------------------


@query(sql("selected", "SELECT * FROM selected"))
def j5_select_experts(s, d):
    own = materialize(fx.instance_tag(s, d))
    return experts.select_experts(own, experts.used_tags(fx.stumps(s, d, own)))


@query(sql("used il tags models", "SELECT m.model_id, i.instance_id, count(t.tag) AS n_tags FROM (SELECT DISTINCT model_id FROM models) m CROSS JOIN (SELECT DISTINCT instance_id FROM il) i LEFT JOIN (SELECT * FROM tags JOIN used USING (tag)) t ON t.model_id = m.model_id AND t.instance_id = i.instance_id GROUP BY 1, 2"))
def j6_fan_out(s, d):
    own = materialize(fx.instance_tag(s, d))
    return experts.fan_out(fx.instance_label(s, d), fx.model_label(s, d), own, experts.used_tags(fx.stumps(s, d, own)))


@query(sql("lidx ml", "SELECT instance_id, label FROM ml"))
def j7_decode(s, d):
    index = materialize(encode.assign_index(fx.instance_label(s, d), "label"))
    return experts.decode(encode.encode_labels(fx.multi_label(s, d), index), index)


@query(sql("truth pred", "SELECT instance_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT * FROM truth UNION ALL SELECT * FROM pred) GROUP BY 1"))
def j8_merge_predictions(s, d):
    return experts.merge_predictions(fx.truth(s, d), fx.pred(s, d)).select("instance_id", F.array_join("labels", ",").alias("labels"))


@query(sql("pred", "SELECT instance_id, string_agg(label, ',' ORDER BY label) AS labels FROM pred GROUP BY 1"))
def j8_merge_by_row_map(s, d):
    own = fx.pred(s, d).withColumn("model_id", F.ascii("label") % 3)
    rows = global_index(own.select("model_id", "instance_id").distinct(), ["model_id", "instance_id"], "row")
    local = own.join(rows, ["model_id", "instance_id"]).select("model_id", "row", "label")
    return experts.merge_predictions(experts.to_instances(local, rows)).select("instance_id", F.array_join("labels", ",").alias("labels"))


@query(sql("truth pred", "SELECT i.instance_id, l.label, CASE WHEN p.label IS NULL THEN 0 ELSE 1 END AS value FROM (SELECT DISTINCT instance_id FROM truth) i CROSS JOIN (SELECT DISTINCT label FROM truth) l LEFT JOIN pred p ON p.instance_id = i.instance_id AND p.label = l.label"))
def j9_re_expand(s, d):
    t = fx.truth(s, d)
    return experts.re_expand(t, t, fx.pred(s, d))


@query(sql("scored", "SELECT model_id, instance_id, label, round(1 / (1 + exp(-margin)), 6) AS p FROM scored WHERE round(margin, 9) > 0"))
def m5_expert_inference(s, d):
    own = materialize(fx.instance_tag(s, d))
    st = materialize(fx.stumps(s, d, own))
    scored = experts.score_stumps(experts.select_experts(own, experts.used_tags(st)), st)
    found = experts.predict_labels(scored.withColumn("margin", F.round("margin", 9)))
    return found.withColumn("p", F.round("p", 6))


@query(sql("used", "SELECT * FROM used"))
def m6_used_tags(s, d):
    return experts.used_tags(fx.stumps(s, d))


@query(sql("scored", "SELECT instance_id, string_agg(label, ',' ORDER BY label) AS labels FROM scored WHERE round(margin, 9) > 0 GROUP BY 1"))
def m7_on_demand_inference(s, d):
    own = materialize(fx.instance_tag(s, d))
    st = materialize(fx.stumps(s, d, own))
    scored = experts.score_stumps(experts.select_experts(own, experts.used_tags(st)), st)
    found = experts.predict_labels(scored.withColumn("margin", F.round("margin", 9)))
    return experts.merge_predictions(found.select("instance_id", "label")).select("instance_id", F.array_join("labels", ",").alias("labels"))


@query(sql("used", "SELECT count(*) AS n_tags, count(*) FILTER (n > 1) AS n_shared, round(100 * count(*) FILTER (n > 1) / count(*), 6) AS share FROM (SELECT tag, count(DISTINCT model_id) AS n FROM used GROUP BY 1)"))
def a21_shared_tags(s, d):
    return experts.shared_tags(experts.used_tags(fx.stumps(s, d))).withColumn("share", F.round("share", 6))


@query(sql("selected", "SELECT model_id, count(DISTINCT instance_id) AS n_instances FROM selected GROUP BY 1"))
def a22_expert_usage(s, d):
    own = materialize(fx.instance_tag(s, d))
    return experts.expert_usage(own, experts.used_tags(fx.stumps(s, d, own)))


@query(sql("load", ", m AS (SELECT model_id, CAST(sum(load) AS BIGINT) AS n FROM load GROUP BY 1) SELECT model_id, n, n > (SELECT avg(n) + stddev_pop(n) FROM m) AS heavy FROM m"))
def a23_heavy_models(s, d):
    return experts.heavy_models(fx.epoch_load(s, d).withColumnRenamed("load", "n"))


@query(sql("selected", ", u AS (SELECT model_id, count(DISTINCT instance_id) AS n_instances FROM selected GROUP BY 1) SELECT model_id, n_instances, round(sum(n_instances) OVER (ORDER BY n_instances, model_id ROWS UNBOUNDED PRECEDING) / sum(n_instances) OVER (), 9) AS share FROM u"))
def w12_usage_cdf(s, d):
    own = materialize(fx.instance_tag(s, d))
    usage = experts.expert_usage(own, experts.used_tags(fx.stumps(s, d, own)))
    return experts.usage_cdf(usage).withColumn("share", F.round("share", 9))


@query(sql("ml models", "SELECT DISTINCT model_id, instance_id FROM ml JOIN models USING (label)"))
def j10_route_by_label(s, d):
    return experts.route_by_label(fx.multi_label(s, d), fx.model_label(s, d))


@query(sql("ml models", "SELECT DISTINCT instance_id FROM ml WHERE instance_id NOT IN (SELECT instance_id FROM ml WHERE label NOT IN (SELECT label FROM models WHERE model_id < 3))"))
def j12_eligible(s, d):
    return experts.eligible(fx.multi_label(s, d), fx.model_label(s, d).where("model_id < 3"))


@query(sql("models", "SELECT DISTINCT model_id FROM models WHERE model_id % 2 = 1"))
def j14_missing_models(s, d):
    expected = fx.model_label(s, d)
    return experts.missing_models(expected, expected.where("model_id % 2 = 0"))


# Ranking ---------------------------------------------------------------------------------------


@query(sql("costs", ", k AS (SELECT l_orderkey AS instance_id, count(DISTINCT l_linestatus) AS k FROM lineitem GROUP BY 1) SELECT instance_id, label_idx, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY cost, label_idx) AS rank FROM costs) JOIN k USING (instance_id) WHERE rank <= k"))
def w7_top_k_labels(s, d):
    sizes = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("instance_id")).agg(F.count_distinct("l_linestatus").alias("k"))
    return rank.top_k_labels(fx.costs(s, d), sizes)


@query(sql("costs", """, g AS (SELECT *, coalesce(CAST(cost - lag(cost) OVER w > 0.015 AS INT), 0) AS gap FROM costs WINDOW w AS (PARTITION BY instance_id ORDER BY cost, label_idx)),
c AS (SELECT *, sum(gap) OVER (PARTITION BY instance_id ORDER BY cost, label_idx ROWS UNBOUNDED PRECEDING) AS cid FROM g),
p AS (SELECT instance_id, cid, cid * count(*) AS weight FROM c GROUP BY 1, 2),
b AS (SELECT instance_id, cid AS best FROM p QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY weight DESC, cid DESC) = 1)
SELECT instance_id, label_idx FROM c JOIN b USING (instance_id) WHERE cid < best"""))
def w8_density_cut(s, d):
    return rank.density_cut(fx.costs(s, d), 0.015)


# Metrics ---------------------------------------------------------------------------------------

_ROUNDED = "round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1"


def _round(df, *names, places=9):
    return df.withColumns({n: F.round(n, places) for n in names})


@query(sql("report", f"SELECT label, tp, fp, fn, support, {_ROUNDED} FROM report"))
def a15_label_report(s, d):
    return _round(metrics.label_report(fx.truth(s, d), fx.pred(s, d)), "precision", "recall", "f1")


@query(sql("report", "SELECT " + ", ".join(f"round(sum({m} * support) / sum(support), 9) AS {m}_weighted, round(avg({m}), 9) AS {m}_macro" for m in ("precision", "recall", "f1")) + ", round(sum(tp) / (sum(tp) + sum(fp)), 9) AS precision_micro, round(sum(tp) / (sum(tp) + sum(fn)), 9) AS recall_micro, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 9) AS f1_micro FROM report"))
def a14_averages(s, d):
    out = metrics.averages(metrics.label_report(fx.truth(s, d), fx.pred(s, d)))
    return _round(out, *out.columns)


@query(sql("sets report", "SELECT (SELECT count(*) FROM sets) AS n, round((SELECT count(*) FILTER (t = p) / count(*) FROM sets), 9) AS accuracy, round((SELECT sum(fp) + sum(fn) FROM report) / ((SELECT count(*) FROM sets) * (SELECT count(*) FROM report)), 9) AS hamming"))
def a16_set_scores(s, d):
    return _round(metrics.set_scores(fx.truth(s, d), fx.pred(s, d)), "accuracy", "hamming")


@query(sql("sets", "SELECT CASE WHEN n > 1 THEN 'multi' ELSE 'single' END AS kind, count(*) AS n, round(100 * count(*) FILTER (t = p) / count(*), 9) AS accuracy FROM sets GROUP BY 1"))
def a17_exact_match(s, d):
    return _round(metrics.exact_match(fx.truth(s, d), fx.pred(s, d)), "accuracy")


@query(sql("sides", "SELECT count(*) FILTER (t AND p) AS hits, count(*) FILTER (p AND NOT t) AS misses FROM sides"))
def a18_hits(s, d):
    return metrics.hits(fx.truth(s, d), fx.pred(s, d))


@query(sql("truth pred", "SELECT t.label AS true_label, p.label AS pred_label, count(*) AS n FROM (SELECT instance_id, min(label) AS label FROM truth GROUP BY 1) t JOIN (SELECT instance_id, max(label) AS label FROM pred GROUP BY 1) p USING (instance_id) GROUP BY 1, 2"))
def a19_confusion(s, d):
    t = fx.truth(s, d).groupBy("instance_id").agg(F.min("label").alias("label"))
    return metrics.confusion(t, fx.pred(s, d).groupBy("instance_id").agg(F.max("label").alias("label")))


@query(sql("truth pred", """, pp AS (SELECT instance_id, label, 1 AS param FROM pred UNION ALL SELECT instance_id, label, 2 FROM pred WHERE instance_id % 3 <> 0 UNION ALL SELECT instance_id, label, 3 FROM pred),
tt AS (SELECT *, unnest([1, 2, 3]) AS param FROM truth),
r AS (SELECT coalesce(t.param, p.param) AS param, coalesce(t.label, p.label) AS label, count(*) FILTER (t.label IS NOT NULL AND p.label IS NOT NULL) AS tp, count(t.label) AS s, count(p.label) AS said FROM tt t FULL JOIN pp p ON t.param = p.param AND t.instance_id = p.instance_id AND t.label = p.label GROUP BY 1, 2),
f AS (SELECT param, sum(2 * tp / (s + said) * s) / sum(s) AS f1 FROM r GROUP BY 1)
SELECT param, param AS ord, round(f1, 9) AS f1 FROM f ORDER BY f1 DESC, param LIMIT 1"""))
def a20_best_parameter(s, d):
    p = fx.pred(s, d)
    runs = p.withColumn("param", F.lit(1)).unionByName(p.where("instance_id % 3 <> 0").withColumn("param", F.lit(2))).unionByName(p.withColumn("param", F.lit(3)))
    scores = _round(metrics.by_parameter(fx.truth(s, d), runs), "f1").withColumn("ord", F.col("param"))
    return metrics.best_parameter(scores)


@query(sql("truth pred", "SELECT label FROM truth UNION SELECT label FROM pred"))
def u5_all_labels(s, d):
    return metrics.all_labels(fx.truth(s, d), fx.pred(s, d))


@query(sql("pred", "SELECT instance_id % 3 AS fold, label, count(*) AS n FROM pred GROUP BY 1, 2"))
def a32_predictions_of_folds(s, d):
    p = fx.pred(s, d).withColumn("fold", F.col("instance_id") % 3)
    folds = [p.where(F.col("fold") == i) for i in range(3)]
    return metrics.predictions_of_folds(*folds).groupBy("fold", "label").agg(F.count("*").alias("n"))


@query(sql("truth", "SELECT DISTINCT label, instance_id AS line FROM truth"))
def j15_true_lines(s, d):
    return metrics.true_lines(fx.truth(s, d))


# Statistics ------------------------------------------------------------------------------------


@query(sql("tagdf", "SELECT n_labels AS k, count(*) AS n_tags, round(100 * count(*) / sum(count(*)) OVER (), 2) AS share FROM tagdf GROUP BY 1"))
def a5_recurrence_histogram(s, d):
    return stats.recurrence_histogram(filters.tag_label_frequency(fx.instance_tag(s, d), fx.instance_label(s, d)))


@query(sql("mcombos", "SELECT n_labels, count(*) AS n FROM mcombos GROUP BY 1"))
def a6_combination_lengths(s, d):
    return stats.combination_lengths(fx.multi_label(s, d)).withColumn("n_labels", F.col("n_labels").cast("long"))


@query(sql("mcombos", "SELECT label_key, count(*) AS n FROM mcombos GROUP BY 1"))
def a7_combination_counts(s, d):
    return stats.combination_counts(fx.multi_label(s, d))


@query(sql("combos tags", "SELECT label_key, round(avg(coalesce(n, 0)), 9) AS mean_tags FROM combos LEFT JOIN (SELECT instance_id, count(*) AS n FROM tags GROUP BY 1) USING (instance_id) GROUP BY 1"))
def a8_mean_tags_per_combination(s, d):
    return _round(stats.mean_tags_per_combination(fx.instance_tag(s, d), fx.instance_label(s, d)), "mean_tags")


@query(sql("tags il models", ", f AS (SELECT model_id, tag, count(DISTINCT label) AS k FROM tags JOIN il USING (instance_id) JOIN models USING (label) GROUP BY 1, 2) SELECT model_id, k, count(*) AS n_tags, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY model_id), 2) AS share FROM f GROUP BY 1, 2"))
def a9_recurrence_per_model(s, d):
    return stats.recurrence_per_model(fx.instance_tag(s, d), fx.instance_label(s, d), fx.model_label(s, d))


@query(sql("vec", "SELECT i AS idx, count(DISTINCT label) AS n_labels FROM (SELECT unnest(range((SELECT min(idx) FROM vec), (SELECT max(idx) FROM vec) + 1)) AS i) LEFT JOIN vec ON idx = i GROUP BY 1").replace("SELECT i AS idx", "SELECT CAST(i AS INTEGER) AS idx"))
def a13_feature_occurrence(s, d):
    return stats.feature_occurrence(fx.vec(s, d))


def _high(s, d):
    """Features that stand out: counts less one."""
    return fx.vec(s, d).withColumn("cnt", F.col("cnt") - 1)


_OCCURRENCE = ", f AS (SELECT idx, count(DISTINCT label) FILTER ({}) AS n FROM vec GROUP BY 1)"


@query(sql("vec", _OCCURRENCE.format("cnt > 1") + """, h AS (SELECT unnest(range((SELECT min(n) FROM f), (SELECT max(n) FROM f) + 1)) AS k)
SELECT k AS n_labels, (SELECT count(*) FROM f WHERE n = k) AS n_features FROM h"""))
def a13_occurrence_histogram(s, d):
    return stats.occurrence_histogram(stats.feature_occurrence(_high(s, d)))


@query(sql("vec", _OCCURRENCE.format("cnt > 1 AND label IN ('1', '3', '4')") + " SELECT n AS n_labels, count(*) AS n_features FROM f GROUP BY 1"))
def a13_chosen_labels(s, d):
    chosen = s.createDataFrame([("1",), ("3",), ("4",)], "label string")
    return stats.occurrence_histogram(stats.feature_occurrence(_high(s, d), chosen), fill=False)


_TRIALS = "(SELECT model_id AS key, CAST(load AS DOUBLE) AS value FROM load)"


@query(sql("load", f"SELECT key, round(avg(value), 6) AS mean, round(2 * stddev_pop(value), 6) AS two_std, round(1.96 * stddev_pop(value) / sqrt(count(*)), 6) AS confidence FROM {_TRIALS} GROUP BY 1"))
def a24_trial_stats(s, d):
    rows = fx.epoch_load(s, d).select(F.col("model_id").alias("key"), F.col("load").cast("double").alias("value"))
    return stats.trial_stats(rows).select("key", *(F.round(c, 6).alias(c) for c in ("mean", "two_std", "confidence")))


@query(sql("load", f"SELECT round(sqrt(sum(e * e / 4)), 6) AS error FROM (SELECT 2 * stddev_pop(value) AS e FROM {_TRIALS} GROUP BY key)"))
def a24_combined_error(s, d):
    rows = fx.epoch_load(s, d).select(F.col("model_id").alias("key"), F.col("load").cast("double").alias("value"))
    return stats.combined_error(stats.trial_stats(rows)).select(F.round("error", 6).alias("error"))


@query(sql("costs tclass", "SELECT true_idx, label_idx, min(cost) AS low, max(cost) AS high FROM costs JOIN tclass USING (instance_id) GROUP BY 1, 2"))
def a25_cost_range(s, d):
    return stats.cost_range(fx.costs(s, d), fx.true_class(s, d))


@query(sql("costs tclass", "SELECT true_idx, round(avg(cost) FILTER (label_idx < true_idx), 9) AS left_mean, round(avg(cost) FILTER (label_idx = true_idx), 9) AS true_mean, round(avg(cost) FILTER (label_idx > true_idx), 9) AS right_mean FROM costs JOIN tclass USING (instance_id) GROUP BY 1"))
def a26_left_true_right(s, d):
    return _round(stats.left_true_right(fx.costs(s, d), fx.true_class(s, d)), "left_mean", "true_mean", "right_mean")


@query(sql("costs tclass", "SELECT true_idx, label_idx, round(avg(cost), 9) AS mean_cost FROM costs JOIN tclass USING (instance_id) GROUP BY 1, 2"))
def a27_cost_matrix(s, d):
    return _round(stats.cost_matrix(fx.costs(s, d), fx.true_class(s, d)), "mean_cost")


@query(sql("stage", "SELECT CAST(floor(epoch(ts)) - floor(epoch((SELECT min(ts) FROM stage))) AS BIGINT) AS \"offset\", count(*) AS n FROM stage GROUP BY 1"))
def a28_change_histogram(s, d):
    return stats.change_histogram(fx.stages(s, d))


#: The kinds of events in the test tables.
_EVENTS = ("click", "error", "purchase", "signup", "view")


@query("SELECT concat('-', event_type) AS stage, count(value) FILTER (user_id % 7 <> 0) AS n, round(avg(value) FILTER (user_id % 7 <> 0), 6) AS mean_seconds, count(*) FILTER (user_id % 7 = 0) AS unfinished FROM events GROUP BY 1")
def a29_stage_durations(s, d):
    rows = table(s, d, "events").select(
        F.concat_ws("-", F.lit("run"), F.col("user_id").cast("string"), "event_type").alias("name"), F.when(F.col("user_id") % 7 != 0, F.col("value")).alias("seconds")
    )
    return stats.stage_durations(rows, [f"-{k}" for k in _EVENTS]).withColumn("mean_seconds", F.round("mean_seconds", 6))


_PHASES = "['Succeeded', 'Failed', 'Running', 'Pending']"


@query(f"""WITH p AS (SELECT concat('-', event_type) AS stage, ({_PHASES})[1 + event_id % 4] AS phase, CASE WHEN user_id % 11 <> 0 THEN ts END AS t0, CASE WHEN user_id % 7 <> 0 THEN ts + to_milliseconds(CAST(floor(value * 1000) AS BIGINT)) END AS t1 FROM events),
q AS (SELECT stage, CASE WHEN phase IN ('Succeeded', 'Failed') AND t0 IS NOT NULL AND t1 IS NOT NULL THEN (epoch_us(t1) - epoch_us(t0)) / 1000000 END AS s FROM p)
SELECT stage, count(s) AS n, round(avg(s), 6) AS mean_seconds, count(*) FILTER (s IS NULL) AS unfinished FROM q GROUP BY 1""")
def a29_run_seconds(s, d):
    at = F.col("ts").cast("timestamp")
    phase = F.get(F.array(*(F.lit(p) for p in ("Succeeded", "Failed", "Running", "Pending"))), (F.col("event_id") % 4).cast("int"))
    pods = table(s, d, "events").select(
        F.concat_ws("-", F.lit("run"), F.col("user_id").cast("string"), "event_type").alias("name"), phase.alias("phase"), F.when(F.col("user_id") % 11 != 0, at).alias("start"),
        F.when(F.col("user_id") % 7 != 0, F.timestamp_micros(F.unix_micros(at) + 1000 * F.floor(F.col("value") * 1000))).alias("end"),
    )
    return _round(stats.stage_durations(stats.run_seconds(pods), [f"-{k}" for k in _EVENTS]), "mean_seconds", places=6)


@query(sql("load", "SELECT key, string_agg(CAST(total AS VARCHAR), ',' ORDER BY trial) AS totals FROM (SELECT model_id AS key, epoch % 5 AS trial, CAST(sum(load) AS BIGINT) AS total FROM load GROUP BY 1, 2) GROUP BY 1"))
def a31_runtime_rollup(s, d):
    rows = fx.epoch_load(s, d).select(F.col("model_id").alias("key"), (F.col("epoch") % 5).alias("trial"), F.col("load").alias("value"))
    return stats.runtime_rollup(rows)


def _ewma_sql(old: bool) -> str:
    w, base = "0.3::DOUBLE", "r.a" if old else "(0.7::DOUBLE * r.a + 0.3::DOUBLE * o.load)"
    return f"""WITH RECURSIVE {sql("load", "").removeprefix("WITH ")},
o AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY epoch) AS n FROM load),
r AS (SELECT model_id, n, {w} * load AS a, {w} * abs(load - {"0" if old else f"{w} * load"}) AS d FROM o WHERE n = 1
  UNION ALL SELECT o.model_id, o.n, (1 - {w}) * r.a + {w} * o.load, (1 - {w}) * r.d + {w} * abs(o.load - {base}) FROM r JOIN o ON o.model_id = r.model_id AND o.n = r.n + 1)
SELECT model_id, CAST(n AS INTEGER) AS n_epochs, round(a, 6) AS avg, round(d, 6) AS dev, round(a + 3 * d, 6) AS threshold FROM r QUALIFY n = max(n) OVER (PARTITION BY model_id)"""


@query(_ewma_sql(False))
def w14_ewma_forecast(s, d):
    out = stats.ewma_forecast(fx.epoch_load(s, d), 0.3, 3.0)
    return out.select("model_id", "n_epochs", *(F.round(c, 6).alias(c) for c in ("avg", "dev", "threshold")))


@query(_ewma_sql(True))
def w14_ewma_forecast_old(s, d):
    out = stats.ewma_forecast(fx.epoch_load(s, d), 0.3, 3.0, "old")
    return out.select("model_id", "n_epochs", *(F.round(c, 6).alias(c) for c in ("avg", "dev", "threshold")))


@query("SELECT p_size AS value, count(*) AS n, round(sum(count(*)) OVER (ORDER BY p_size) / sum(count(*)) OVER (), 9) AS cdf FROM part GROUP BY 1")
def w12_empirical_cdf(s, d):
    return _round(stats.empirical_cdf(table(s, d, "part").select(F.col("p_size").alias("value"))), "cdf")


@query("WITH q AS (SELECT quantile_cont(CAST(n_chars AS DOUBLE), [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS c FROM documents) SELECT CAST(len(list_filter(c, lambda x: x < n_chars)) AS INTEGER) AS bin, count(*) AS n, CAST(min(n_chars) AS DOUBLE) AS low, CAST(max(n_chars) AS DOUBLE) AS high FROM documents, q GROUP BY 1")
def w13_decile_bins(s, d):
    return stats.decile_bins(table(s, d, "documents").select(F.col("n_chars").cast("double").alias("value")))


@query("SELECT model_id, value, round(cume_dist() OVER (ORDER BY value), 9) AS cdf FROM (SELECT user_id AS model_id, round(sum(value), 4) AS value FROM events GROUP BY 1) ORDER BY value DESC, model_id LIMIT 20")
def w17_slowest_models(s, d):
    times = table(s, d, "events").groupBy(F.col("user_id").alias("model_id")).agg(F.round(F.sum("value"), 4).alias("value"))
    return _round(stats.slowest_models(times), "cdf")


def _halves(s, d):
    own = materialize(fx.instance_tag(s, d))
    return own.where("instance_id % 2 = 0").select("tag"), own.where("instance_id % 2 = 1").select("tag")


@query(sql("tags", "SELECT DISTINCT tag FROM tags"))
def u1_vocabulary_union(s, d):
    return stats.vocabulary_union(*_halves(s, d))


@query(sql("tags", "SELECT tag, count(*) AS n FROM tags GROUP BY 1"))
def u1_vocabulary_bag(s, d):
    return stats.vocabulary_union(*_halves(s, d), bag=True).groupBy("tag").agg(F.count("*").alias("n"))


@query(sql("tags", "SELECT tag FROM tags WHERE instance_id % 2 = 0 EXCEPT SELECT tag FROM tags WHERE instance_id % 2 = 1"))
def u2_vocabulary_difference(s, d):
    return stats.vocabulary_difference(*_halves(s, d))


@query(sql("tags", "SELECT tag FROM tags WHERE instance_id % 2 = 0 INTERSECT SELECT tag FROM tags WHERE instance_id % 2 = 1"))
def u3_tag_intersection(s, d):
    return stats.tag_intersection(*_halves(s, d))


# Similarity ------------------------------------------------------------------------------------


@query(sql("means", "SELECT block, idx, mean FROM means"))
def a12_label_means(s, d):
    return similarity.label_means(fx.vec(s, d), 5)


def _means(s, d):
    return similarity.label_means(fx.vec(s, d), 5).select(F.col("block").alias("id"), "idx", F.col("mean").alias("value"))


@query(sql("cosine", "SELECT a, b, round(cosine, 9) AS cosine FROM cosine"))
def j11_cosine_pairs(s, d):
    return _round(similarity.cosine_pairs(_means(s, d)), "cosine")


@query(sql("cosine", "SELECT n, round(2 * (SELECT sum(cosine) FROM cosine) / (n * (n - 1)), 9) AS mean_cosine FROM (SELECT count(DISTINCT block) AS n FROM means)"))
def a30_mean_similarity(s, d):
    rows = _means(s, d)
    return _round(similarity.mean_similarity(rows, rows), "mean_cosine")


_LEADERS = """, c AS MATERIALIZED (SELECT a, b FROM cosine WHERE round(cosine, 9) > 0.75),
ids AS MATERIALIZED (SELECT block AS id, row_number() OVER (ORDER BY block) AS n FROM (SELECT DISTINCT block FROM means)),
near AS MATERIALIZED (SELECT id, n, coalesce((SELECT list(a) FROM c WHERE b = id), []) AS smaller FROM ids),
walk AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS leaders
  UNION ALL SELECT near.n, CASE WHEN list_has_any(smaller, leaders) THEN leaders ELSE list_append(leaders, id) END FROM walk JOIN near ON near.n = walk.n + 1),
l AS MATERIALIZED (SELECT unnest(leaders) AS leader FROM walk WHERE n = (SELECT max(n) FROM ids)),
clusters AS MATERIALIZED (SELECT id, min(leader) AS leader FROM (SELECT id, leader FROM near JOIN l ON list_contains(smaller, leader) OR leader = id) GROUP BY 1)"""


def _clusters_sql(body: str) -> str:
    return sql("cosine", _LEADERS + body).replace("WITH ", "WITH RECURSIVE ", 1)


@query(_clusters_sql(" SELECT id, leader FROM clusters"))
def m11_leader_clusters(s, d):
    return similarity.row_leaders(materialize(_means(s, d)), 0.75)


@query(_clusters_sql(""" SELECT leader, n, round(CASE WHEN n > 1 THEN 2 * coalesce(s, 0) / (n * (n - 1)) ELSE 1.0 END, 9) AS mean_similarity
FROM (SELECT leader, count(*) AS n FROM clusters GROUP BY 1) LEFT JOIN
(SELECT x.leader, sum(cosine) AS s FROM cosine JOIN clusters x ON x.id = a JOIN clusters y ON y.id = b WHERE x.leader = y.leader GROUP BY 1) USING (leader)"""))
def m12_cluster_labels(s, d):
    return _round(similarity.cluster_labels(fx.vec(s, d), 5, 0.75), "mean_similarity")


# Layers and catalogue --------------------------------------------------------------------------


@query(sql("history layers", "SELECT image, k, layer, created_by FROM layers LEFT JOIN (SELECT image, row_number() OVER (PARTITION BY image ORDER BY pos) - 1 AS k, created_by FROM history WHERE empty_layer IS NULL) USING (image, k)"))
def j1_align_history(s, d):
    return layers.align_history(fx.layers(s, d), fx.history(s, d))


@query(sql("history layers", "SELECT image, k, layer FROM layers JOIN (SELECT image, count(*) AS n FROM history WHERE empty_layer IS NULL AND pos < 4 GROUP BY 1) USING (image) WHERE k >= n"))
def j1_unaligned_layers(s, d):
    return layers.unaligned_layers(fx.layers(s, d), fx.history(s, d).where("pos < 4"))


@query(sql("layers changes", "SELECT image, k, path FROM layers JOIN changes ON changeset_id = image"))
def j2_layer_changesets(s, d):
    order = fx.layers(s, d).withColumnRenamed("layer", "digest")
    archive = F.concat(F.replace("digest", F.lit(":"), F.lit("_")), F.lit(".tar.gz")).alias("archive")
    content = order.select(F.col("image").alias("changeset_id"), archive).join(fx.changes(s, d), "changeset_id").select("archive", "path")
    return layers.layer_changesets(order, content)


@query("SELECT project, CAST(row_number() OVER (ORDER BY pos) AS INTEGER) AS rank FROM (SELECT p_brand AS project, min(p_partkey) AS pos FROM part WHERE p_brand NOT LIKE '%1' GROUP BY 1) ORDER BY pos LIMIT 10")
def s10_package_rank(s, d):
    part = table(s, d, "part")
    path = scratch(s)
    part.select(F.col("p_brand").alias("project"), F.col("p_partkey").alias("pos")).write.json(path)
    rows = s.read.schema("project string, pos long").json(path)
    return catalog.package_rank(rows, rows.where("project LIKE '%1'"), 10)


_VTEXT = "concat('0.0 ', p_size, '.1 ', p_partkey, '.2.3 x ', p_size, '.4 ', p_partkey, '.5 ', p_size, '.6')"


@query(f"SELECT p_partkey AS id, array_to_string(v[2:len(v) - 2], ',') AS versions FROM (SELECT p_partkey, regexp_extract_all({_VTEXT}, '\\d+\\.\\d+(?:\\.\\d+)*') AS v FROM part)")
def p15_extract_versions(s, d):
    texts = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.expr(_VTEXT).alias("text"))
    return catalog.extract_versions(texts).select("id", F.array_join("versions", ",").alias("versions"))


def _versions(s, d):
    part = table(s, d, "part")
    return part.select(F.col("p_brand").alias("package"), F.concat(F.col("p_size").cast("string"), F.lit(".0")).alias("version"), F.col("p_size").alias("pos")).distinct()


@query(sql("versions", "SELECT package, version, CAST(r AS INTEGER) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY package ORDER BY pos, version) AS r FROM versions WHERE pos <> 2) WHERE r <= 3 QUALIFY count(*) OVER (PARTITION BY package) = 3"))
def p16_three_versions(s, d):
    found = _versions(s, d)
    return catalog.three_versions(found, found.where("pos = 2"))


@query(sql("versions", "SELECT package, count(*) AS n FROM versions WHERE pos <= 4 GROUP BY 1 HAVING count(*) < 3"))
def p16_short_packages(s, d):
    return catalog.short_packages(_versions(s, d).where("pos <= 4"))


@query(sql("versions", """, l AS (SELECT DISTINCT concat(package, '==', version) AS label, package FROM versions), b AS (SELECT DISTINCT p_type AS base FROM part)
SELECT x.label || ',' || y.label AS labels, base FROM l x JOIN l y ON x.label < y.label AND x.package <> y.package CROSS JOIN b ORDER BY labels, base LIMIT 2000"""))
def j13_combinations(s, d):
    own = _versions(s, d).select(F.concat_ws("==", "package", "version").alias("label"))
    return catalog.combinations(own, table(s, d, "part").select(F.col("p_type").alias("base")), 2, 2000)


# Training --------------------------------------------------------------------------------------


def _few(s, d):
    """Labels by language only, so that each model has several instances per label."""
    own = table(s, d, "documents").select(F.col("doc_id").alias("instance_id"), F.col("lang").alias("label"))
    return own, own.select("label", F.lit(0).cast("long").alias("model_id")).distinct()


def _round_ctes(r: int) -> str:
    """CTEs of boosting round r: margins m{r} before it, its best stumps b{r}, and margins m{r + 1} after it."""
    return f""", g{r} AS (SELECT instance_id, label, 1 / (1 + exp(-margin)) - y AS g, (1 / (1 + exp(-margin))) * (1 - 1 / (1 + exp(-margin))) AS h FROM m{r}),
t{r} AS (SELECT label, sum(g) AS "G", sum(h) AS "H" FROM g{r} GROUP BY 1),
p{r} AS (SELECT label, tag, cnt AS cut, sum(g) AS g, sum(h) AS h FROM tags JOIN g{r} USING (instance_id) GROUP BY 1, 2, 3),
c{r} AS (SELECT label, tag, cut, sum(g) OVER (PARTITION BY label, tag ORDER BY cut DESC ROWS UNBOUNDED PRECEDING) AS gh, sum(h) OVER (PARTITION BY label, tag ORDER BY cut DESC ROWS UNBOUNDED PRECEDING) AS hh,
  sum(g) OVER (PARTITION BY label, tag) AS gp, sum(h) OVER (PARTITION BY label, tag) AS hp FROM p{r}),
s{r} AS (SELECT label, tag, cut, m, gh + CASE WHEN m THEN "G" - gp ELSE 0 END AS gr, hh + CASE WHEN m THEN "H" - hp ELSE 0 END AS hr,
  gp - gh + CASE WHEN m THEN 0 ELSE "G" - gp END AS gl, hp - hh + CASE WHEN m THEN 0 ELSE "H" - hp END AS hl, "G", "H"
  FROM c{r} JOIN t{r} USING (label) CROSS JOIN (SELECT unnest([false, true]) AS m)),
w{r} AS (SELECT *, round(gl * gl / (hl + 1) + gr * gr / (hr + 1) - "G" * "G" / ("H" + 1), 9) AS gain FROM s{r} WHERE hl >= 1 AND hr >= 1),
b{r} AS MATERIALIZED (SELECT label, {r} AS "round", tag, cut, gain, -0.1::DOUBLE * gl / (hl + 1) AS leaf_low, -0.1::DOUBLE * gr / (hr + 1) AS leaf_high, -0.1::DOUBLE * CASE WHEN m THEN gr / (hr + 1) ELSE gl / (hl + 1) END AS leaf_default
  FROM w{r} WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY label ORDER BY gain DESC, tag, cut, m) = 1),
m{r + 1} AS MATERIALIZED (SELECT m.instance_id, m.label, y, margin + coalesce(CASE WHEN t.cnt IS NULL THEN leaf_default WHEN t.cnt >= cut THEN leaf_high ELSE leaf_low END, 0) AS margin
  FROM m{r} m LEFT JOIN b{r} b ON b.label = m.label LEFT JOIN tags t ON t.instance_id = m.instance_id AND t.tag = b.tag)"""


_MARGINS = ", m1 AS MATERIALIZED (SELECT a.doc_id AS instance_id, b.lang AS label, CASE WHEN a.lang = b.lang THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y, 0.0::DOUBLE AS margin FROM documents a CROSS JOIN (SELECT DISTINCT lang FROM documents) b)"
_LEAVES = ", ".join(f"round({c}, 9) AS {c}" for c in ("leaf_low", "leaf_high", "leaf_default"))


def _stumps_sql(rounds: int) -> str:
    made = " UNION ALL ".join(f"SELECT * FROM b{r}" for r in range(1, rounds + 1))
    body = "".join(map(_round_ctes, range(1, rounds + 1)))
    return sql("tags", f'{_MARGINS}{body} SELECT CAST(0 AS BIGINT) AS model_id, label, CAST("round" AS INTEGER) AS round, tag, cut, {_LEAVES} FROM ({made})')


_ROUND_SQL = f"{_MARGINS}{_round_ctes(1)} SELECT CAST(0 AS BIGINT) AS model_id, label, tag, cut, gain, {_LEAVES} FROM b1"


def _cost_ctes(rows: str, rate: float, rounds: int, logistic: bool = False, start: str = "", name: str = "v") -> str:
    """CTEs of gradient rounds over the instances of `rows` (instance_id, label): weights {name}1, {name}2, …"""
    own, other = (1.0, 0.0) if logistic else (0.0, 1.0)
    out = f", {name}y AS MATERIALIZED (SELECT a.instance_id, b.label, CASE WHEN a.label = b.label THEN {own}::DOUBLE ELSE {other}::DOUBLE END AS y FROM {rows} a CROSS JOIN (SELECT DISTINCT label FROM {rows}) b)"
    for r in range(1, rounds + 1):
        before = start if r == 1 else f"{name}{r - 1}"
        score = f"(SELECT instance_id, w.label, sum(x * v) AS s FROM x JOIN {before} w USING (tag) GROUP BY 1, 2)" if before else "(SELECT 0 AS instance_id, '' AS label, 0.0 AS s WHERE false)"
        said = "1 / (1 + exp(-coalesce(s, 0)))" if logistic else "coalesce(s, 0)"
        keep = f"SELECT label, tag, v FROM {before} UNION ALL " if before else ""
        out += f""", {name}e{r} AS (SELECT q.instance_id, q.label, {said} - q.y AS e FROM {name}y q LEFT JOIN {score} z ON z.instance_id = q.instance_id AND z.label = q.label),
{name}{r} AS MATERIALIZED (SELECT label, tag, sum(v) AS v FROM ({keep}SELECT label, tag, -{rate}::DOUBLE * sum(e * x) / sum(x) AS v FROM x JOIN {name}e{r} USING (instance_id) GROUP BY 1, 2) GROUP BY 1, 2)"""
    return out


_X = ", x AS MATERIALIZED (SELECT instance_id, tag, cnt / sqrt(sum(cnt * cnt) OVER (PARTITION BY instance_id)) AS x FROM tags), rows AS MATERIALIZED (SELECT doc_id AS instance_id, lang AS label FROM documents)"
#: Wide enough that no two tags share a slot in the test tables, so that SQL may name slots by tags.
_BITS = 40


@query(sql("tags", _ROUND_SQL))
def m3_boosting_round(s, d):
    own, models = _few(s, d)
    margins = train.targets(own, models).withColumn("margin", F.lit(0.0))
    return _round(train.best_stumps(fx.instance_tag(s, d), margins), "leaf_low", "leaf_high", "leaf_default")


@query(_stumps_sql(3))
def m3_train_stumps(s, d):
    own, models = _few(s, d)
    return _round(train.train_stumps(materialize(fx.instance_tag(s, d)), own, models, rounds=3), "leaf_low", "leaf_high", "leaf_default")


@query(_stumps_sql(2))
def m4_continue_boosting(s, d):
    own, models = _few(s, d)
    found = materialize(fx.instance_tag(s, d))
    start = train.train_stumps(found, own, models, rounds=1)
    return _round(train.train_stumps(found, own, models, rounds=1, start=start), "leaf_low", "leaf_high", "leaf_default")


@query(sql("tags", """, w AS (SELECT instance_id, tag, cnt / sqrt(sum(cnt * cnt) OVER (PARTITION BY instance_id)) AS x FROM tags),
y AS (SELECT a.doc_id AS instance_id, b.lang AS label, CASE WHEN a.lang = b.lang THEN 0.0 ELSE 1.0 END AS y FROM documents a CROSS JOIN (SELECT DISTINCT lang FROM documents) b)
SELECT label, count(*) AS n_slots, round(sum(v), 6) AS total FROM (SELECT label, tag, 0.5::DOUBLE * sum(y * x) / sum(x) AS v FROM w JOIN y USING (instance_id) GROUP BY 1, 2) GROUP BY 1"""))
def m8_cost_round(s, d):
    own, _ = _few(s, d)
    x = train.hashed_features(fx.instance_tag(s, d), 40)  # wide enough that no two tags share a slot here
    w = train.gradient_round(x, train.cost_targets(own, own), None, 0.5)
    return w.groupBy("label").agg(F.count("*").alias("n_slots"), F.round(F.sum("w"), 6).alias("total"))


@query(sql("tags", _X + _cost_ctes("rows", 0.05, 2, logistic=True) + """, s AS (SELECT instance_id, label, round(coalesce(sum(x * v), 0), 9) AS s FROM x JOIN v2 USING (tag) GROUP BY 1, 2)
SELECT instance_id, label FROM s QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY s DESC, label) = 1"""))
def m9_best_label(s, d):
    own, _ = _few(s, d)
    x = materialize(train.hashed_features(fx.instance_tag(s, d), _BITS))
    return train.best_label(_round(train.predict_costs(x, train.train_costs(x, own, rounds=2, rate=0.05, loss="logistic")), "score"))


_HALVES = ", r0 AS (SELECT * FROM rows WHERE instance_id % 2 = 0), r1 AS (SELECT * FROM rows WHERE instance_id % 2 = 1)"


@query(sql("tags", _X + _HALVES + _cost_ctes("r0", 0.5, 1, name="v") + _cost_ctes("r1", 0.5, 1, start="v1", name="u") + " SELECT label, count(*) AS n_slots, round(sum(v), 6) AS total, round(sum(v * v), 6) AS squares FROM u1 GROUP BY 1"))
def m10_incremental_batches(s, d):
    own, _ = _few(s, d)
    batches = own.select("instance_id", (F.col("instance_id") % 2).alias("batch"))
    w = train.incremental_batches(fx.instance_tag(s, d), own, batches, rounds=1, bits=_BITS)
    square = F.col("w") * F.col("w")
    return w.groupBy("label").agg(F.count("*").alias("n_slots"), F.round(F.sum("w"), 6).alias("total"), F.round(F.sum(square), 6).alias("squares"))


def _drawn(share: float, *parts: str) -> str:
    return "true" if share >= 1 else f"CAST('0x' || left(md5(concat_ws(':', {', '.join(parts)})), 8) AS BIGINT) < {int(share * 2**32)}"


def _tree_ctes(r: int, depth: int, rate: float = 0.1, rows: float = 1, tree: float = 1, level: float = 1, limits: str = "") -> str:
    """CTEs of the trees of round r from features feat and margins mt{r}: splits b{r}_{d}, leaves l{r}, margins mt{r + 1}.

    limits: a table (model_id, depth, rounds).
    """
    allowed = f"JOIN {limits} USING (model_id)" if limits else ""
    out = f""", n{r}_0 AS MATERIALIZED (SELECT model_id, instance_id, label, y, margin, 1 / (1 + exp(-margin)) - y AS g, (1 / (1 + exp(-margin))) * (1 - 1 / (1 + exp(-margin))) AS h,
  1::BIGINT AS node, {_drawn(rows, "0", "'row'", str(r), "instance_id")} AS drawn FROM mt{r})"""
    for d in range(depth):
        also = f"AND depth > {d} AND rounds >= {r}" if limits else ""
        asked = _drawn(tree, "0", "'tree'", str(r), "tag") + " AND " + _drawn(level, "0", "'level'", str(r), str(d), "tag")
        out += f""",
o{r}_{d} AS MATERIALIZED (SELECT model_id, label, instance_id, node, g, h FROM n{r}_{d} {allowed} WHERE drawn AND node >= {1 << d} {also}),
t{r}_{d} AS (SELECT model_id, label, node, sum(g) AS tg, sum(h) AS th FROM o{r}_{d} GROUP BY ALL),
p{r}_{d} AS (SELECT model_id, label, node, tag, cnt AS cut, sum(g) AS g, sum(h) AS h FROM (SELECT * FROM feat WHERE {asked}) JOIN o{r}_{d} USING (instance_id) GROUP BY ALL),
c{r}_{d} AS (SELECT *, sum(g) OVER up AS gh, sum(h) OVER up AS hh, sum(g) OVER whole AS gp, sum(h) OVER whole AS hp FROM p{r}_{d}
  WINDOW up AS (PARTITION BY model_id, label, node, tag ORDER BY cut DESC ROWS UNBOUNDED PRECEDING), whole AS (PARTITION BY model_id, label, node, tag)),
s{r}_{d} AS (SELECT model_id, label, node, tag, cut, m, gh + CASE WHEN m THEN tg - gp ELSE 0 END AS gr, hh + CASE WHEN m THEN th - hp ELSE 0 END AS hr,
  gp - gh + CASE WHEN m THEN 0 ELSE tg - gp END AS gl, hp - hh + CASE WHEN m THEN 0 ELSE th - hp END AS hl, tg, th
  FROM c{r}_{d} JOIN t{r}_{d} USING (model_id, label, node) CROSS JOIN (SELECT unnest([false, true]) AS m)),
b{r}_{d} AS MATERIALIZED (SELECT model_id, label, {r} AS "round", node, tag, cut, m AS miss_high, round(gl * gl / (hl + 1) + gr * gr / (hr + 1) - tg * tg / (th + 1), 9) AS gain
  FROM s{r}_{d} WHERE hl >= 1 AND hr >= 1 AND gain > 0 QUALIFY row_number() OVER (PARTITION BY model_id, label, node ORDER BY gain DESC, tag, cut, m) = 1),
n{r}_{d + 1} AS MATERIALIZED (SELECT n.* REPLACE (CASE WHEN b.tag IS NULL THEN n.node ELSE 2 * n.node + CAST(CASE WHEN f.cnt IS NULL THEN miss_high ELSE f.cnt >= cut END AS BIGINT) END AS node)
  FROM n{r}_{d} n LEFT JOIN b{r}_{d} b USING (model_id, label, node) LEFT JOIN feat f ON f.instance_id = n.instance_id AND f.tag = b.tag)"""
    return out + f""",
l{r} AS MATERIALIZED (SELECT model_id, label, {r} AS "round", node, -{rate}::DOUBLE * sum(g) / (sum(h) + 1) AS leaf FROM n{r}_{depth} WHERE drawn AND node > 1 GROUP BY ALL),
mt{r + 1} AS MATERIALIZED (SELECT n.model_id, n.instance_id, n.label, n.y, n.margin + coalesce(leaf, 0) AS margin FROM n{r}_{depth} n LEFT JOIN l{r} USING (model_id, label, node))"""


def _forest(rounds: list[tuple[int, int]]) -> str:
    """The rows of the trees of rounds (round, depth)."""
    inner = [f"SELECT model_id, label, round, node, tag, cut, miss_high, NULL::DOUBLE AS leaf FROM b{r}_{d}" for r, depth in rounds for d in range(depth)]
    ends = [f"SELECT model_id, label, round, node, NULL, NULL, NULL, leaf FROM l{r}" for r, _ in rounds]
    return " UNION ALL ".join(inner + ends)


_FIRST = _MARGINS + ", feat AS (SELECT * FROM tags), mt1 AS (SELECT CAST(0 AS BIGINT) AS model_id, * FROM m1)"
_NODES = "SELECT model_id, label, round, node, tag, cut, miss_high, round(leaf, 9) AS leaf FROM ({})"


def _nodes(made):
    return _round(made.drop("gain"), "leaf")


@query(sql("tags", _FIRST + _tree_ctes(1, 2) + _tree_ctes(2, 2) + _NODES.format(_forest([(1, 2), (2, 2)]))))
def m3_train_trees(s, d):
    own, models = _few(s, d)
    return _nodes(trees.train_trees(materialize(fx.instance_tag(s, d)), own, models, rounds=2, depth=2))


_SAMPLES = {"subsample": 0.8, "colsample_tree": 0.8, "colsample_level": 0.8}


@query(sql("tags", _FIRST + _tree_ctes(1, 1) + _tree_ctes(2, 10, rows=0.8, tree=0.8, level=0.8) + _NODES.format(_forest([(1, 1), (2, 10)]))))
def m4_continue_trees(s, d):
    """Stored stumps, continued with deep trees on samples of rows and columns."""
    own, models = _few(s, d)
    found = materialize(fx.instance_tag(s, d))
    start = trees.trees_of_stumps(train.train_stumps(found, own, models, rounds=1))
    return _nodes(trees.train_trees(found, own, models, rounds=1, depth=10, start=start, **_SAMPLES))


@query(sql("tags", _FIRST + _tree_ctes(1, 3) + " SELECT instance_id, label, round(1 / (1 + exp(-margin)), 6) AS p FROM mt2 SEMI JOIN (SELECT instance_id FROM tags JOIN (" + _forest([(1, 3)]) + ") USING (tag)) USING (instance_id) WHERE round(margin, 9) > 0"))
def m5_tree_inference(s, d):
    own, models = _few(s, d)
    found = materialize(fx.instance_tag(s, d))
    made = trees.train_trees(found, own, models, rounds=1, depth=3)
    scored = trees.score_trees(experts.select_experts(found, trees.used_tags(made)), made)
    return _round(experts.predict_labels(_round(scored, "margin")), "p", places=6).select("instance_id", "label", "p")


#: n_models, freq, rounds, depth, n_samples, batch, shuffle, grouping, input_size, compact_factor of each run.
_GRID = [
    {"n_models": 1, "rounds": 1, "depth": 2},
    {"n_models": 2, "freq": 3, "rounds": 2, "grouping": "random", "batch": 1},
    {"n_models": 3, "rounds": 1, "compact_factor": 4, "shuffle": 9, "batch": 2},
    {"n_models": 2, "rounds": 1, "depth": 2, "input_size": 500, "batch": 3, "n_samples": 30},
]
_USUAL = {"freq": None, "rounds": 1, "depth": 1, "n_samples": None, "batch": 0, "shuffle": 4, "grouping": "packed", "input_size": None, "compact_factor": 1}


def _literal(v) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)


_ASKED = ", ".join("(" + ", ".join(map(_literal, [run, *((_USUAL | g)[k] for k in train.SETTING)])) + ")" for run, g in enumerate(_GRID))
_WALK = "".join(
    f""", w{r}_0 AS (SELECT model_id, instance_id, label, 1::BIGINT AS node FROM reached)""" + "".join(f""",
w{r}_{d + 1} AS MATERIALIZED (SELECT w.* REPLACE (CASE WHEN b.tag IS NULL THEN w.node ELSE 2 * w.node + CAST(CASE WHEN f.cnt IS NULL THEN miss_high ELSE f.cnt >= cut END AS BIGINT) END AS node)
  FROM w{r}_{d} w LEFT JOIN b{r}_{d} b USING (model_id, label, node) LEFT JOIN probe f ON f.model_id = w.model_id AND f.instance_id = w.instance_id AND f.tag = b.tag)""" for d in range(2))
    for r in (1, 2)
)
_CV_SQL = sql("tags", f"""
, asked(run_id, {", ".join(train.SETTING)}) AS MATERIALIZED (VALUES {_ASKED}),
rows AS MATERIALIZED (SELECT doc_id AS instance_id, concat(lang, '==', doc_id % 2) AS label FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY instance_id) - 1 AS r, count(*) OVER (PARTITION BY label) AS every FROM rows),
splits AS MATERIALIZED (SELECT run_id, instance_id, label, r >= floor(batch * coalesce(n_samples, every) * 0.25::DOUBLE) AND r < floor((batch + 1) * coalesce(n_samples, every) * 0.25::DOUBLE) AS is_test
  FROM placed CROSS JOIN asked WHERE r < coalesce(n_samples, every)),
named AS (SELECT DISTINCT run_id, label, n_models, shuffle, CASE WHEN grouping = 'packed' THEN split_part(label, '==', 1) ELSE label END AS unit FROM splits JOIN asked USING (run_id) WHERE NOT is_test),
units AS (SELECT run_id, unit, run_id * 1048576 + (row_number() OVER (PARTITION BY run_id ORDER BY md5(concat(shuffle, unit)), unit) - 1) // greatest(1, count(*) OVER (PARTITION BY run_id) // n_models) AS model_id
  FROM (SELECT DISTINCT run_id, unit, n_models, shuffle FROM named)),
groups AS MATERIALIZED (SELECT run_id, label, model_id FROM named JOIN units USING (run_id, unit)),
common AS (SELECT run_id, tag FROM tags JOIN (SELECT run_id, instance_id, label FROM splits WHERE NOT is_test) USING (instance_id) JOIN asked USING (run_id) GROUP BY run_id, tag, freq HAVING count(DISTINCT label) >= freq),
held AS MATERIALIZED (SELECT run_id, model_id, instance_id, tag, cnt FROM tags JOIN (SELECT DISTINCT run_id, model_id, instance_id FROM splits JOIN groups USING (run_id, label) WHERE NOT is_test) USING (instance_id) ANTI JOIN common USING (run_id, tag)),
words AS (SELECT run_id, model_id, tag, row_number() OVER (PARTITION BY model_id ORDER BY tag) - 1 AS idx, count(*) OVER (PARTITION BY model_id) AS n FROM (SELECT DISTINCT run_id, model_id, tag FROM held)),
vocabulary AS MATERIALIZED (SELECT run_id, model_id, tag, idx, lpad(CAST(idx % greatest(1, coalesce(input_size, n // compact_factor)) AS VARCHAR), 12, '0') AS slot FROM words JOIN asked USING (run_id)),
feat AS MATERIALIZED (SELECT concat(model_id, ':', instance_id) AS instance_id, slot AS tag, max_by(cnt, idx) AS cnt FROM held JOIN vocabulary USING (model_id, tag) GROUP BY model_id, held.instance_id, slot),
mt1 AS MATERIALIZED (SELECT o.model_id, concat(o.model_id, ':', o.instance_id) AS instance_id, g.label, CASE WHEN o.label = g.label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y, 0.0::DOUBLE AS margin
  FROM (SELECT run_id, model_id, instance_id, label FROM splits JOIN groups USING (run_id, label) WHERE NOT is_test) o JOIN groups g ON g.model_id = o.model_id),
bounds AS (SELECT DISTINCT model_id, depth, rounds FROM groups JOIN asked USING (run_id)){_tree_ctes(1, 2, limits="bounds")}{_tree_ctes(2, 2, limits="bounds")},
forest AS MATERIALIZED ({_forest([(1, 2), (2, 2)])}),
probe AS MATERIALIZED (SELECT model_id, instance_id, slot AS tag, max_by(cnt, idx) AS cnt FROM tags JOIN (SELECT DISTINCT run_id, instance_id FROM splits WHERE is_test) USING (instance_id) JOIN vocabulary USING (run_id, tag) GROUP BY ALL),
reached AS MATERIALIZED (SELECT * FROM (SELECT DISTINCT model_id, instance_id FROM probe SEMI JOIN forest USING (model_id, tag)) JOIN (SELECT DISTINCT model_id, label FROM forest) USING (model_id)){_WALK},
margins AS (SELECT model_id, instance_id, label, sum(leaf) AS margin FROM (
  SELECT model_id, instance_id, label, leaf FROM w1_2 JOIN l1 USING (model_id, label, node) UNION ALL SELECT model_id, instance_id, label, leaf FROM w2_2 JOIN l2 USING (model_id, label, node)) GROUP BY ALL),
pred AS (SELECT model_id // 1048576 AS run_id, instance_id, label FROM margins WHERE margin > 0),
sides AS (SELECT coalesce(t.run_id, p.run_id) AS run_id, coalesce(t.label, p.label) AS label, t.label IS NOT NULL AS t, p.label IS NOT NULL AS p
  FROM (SELECT run_id, instance_id, label FROM splits WHERE is_test) t FULL JOIN pred p ON p.run_id = t.run_id AND p.instance_id = t.instance_id AND p.label = t.label),
report AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1
  FROM (SELECT run_id, label, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t) AS fp, count(*) FILTER (NOT p) AS fn, count(*) FILTER (t) AS support FROM sides GROUP BY ALL))
SELECT CAST(run_id AS INTEGER) AS run_id, {", ".join(f"round(sum({m} * support) / sum(support), 6) AS {m}_weighted, round(avg({m}), 6) AS {m}_macro" for m in ("precision", "recall", "f1"))},
  round(CASE WHEN sum(tp + fp) > 0 THEN sum(tp) / sum(tp + fp) ELSE 0.0 END, 6) AS precision_micro, round(CASE WHEN sum(tp + fn) > 0 THEN sum(tp) / sum(tp + fn) ELSE 0.0 END, 6) AS recall_micro,
  round(CASE WHEN sum(2 * tp + fp + fn) > 0 THEN 2 * sum(tp) / sum(2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1_micro
FROM report GROUP BY run_id""")


@query(_CV_SQL)
def m13_cross_validate(s, d):
    """Four settings over all rows: depth, trees, filter, grouping, shuffle, compaction, input size and hold-out vary."""
    own = table(s, d, "documents").select(F.col("doc_id").alias("instance_id"), F.concat("lang", F.lit("=="), (F.col("doc_id") % 2).cast("string")).alias("label"))
    out = train.cross_validate(materialize(fx.instance_tag(s, d)), own, _GRID, share=0.25, rounds=1)
    return _round(out, *(c for c in out.columns if c != "run_id"), places=6)


_FOLDS = ", folds AS MATERIALIZED (SELECT instance_id, label, (row_number() OVER (PARTITION BY label ORDER BY instance_id) - 1) % 3 AS fold FROM rows), train AS (SELECT instance_id, label FROM folds WHERE fold <> 0)"


@query(sql("tags", _X + _FOLDS + _cost_ctes("train", 0.01, 2) + """, z AS (SELECT instance_id, label, sum(x * v) AS s FROM x JOIN v2 USING (tag) GROUP BY 1, 2)
SELECT i.instance_id, l.label, round(coalesce(s, 0), 6) + 0.0::DOUBLE AS score FROM (SELECT DISTINCT instance_id FROM x JOIN folds USING (instance_id) WHERE fold = 0) i CROSS JOIN (SELECT DISTINCT label FROM train) l LEFT JOIN z ON z.instance_id = i.instance_id AND z.label = l.label"""))
def m14_fold_scores(s, d):
    own, _ = _few(s, d)
    x = materialize(train.hashed_features(fx.instance_tag(s, d), _BITS))
    folds = materialize(split.stratified_folds(own, 3))
    w = train.train_costs(x, folds.where("fold <> 0").drop("fold"), rounds=2, rate=0.01)
    asked = x.join(folds.where("fold = 0").select("instance_id"), "instance_id", "left_semi")
    return train.predict_costs(asked, w).withColumn("score", F.round("score", 6) + F.lit(0.0))  # no -0


# Sources and sinks over derived files ----------------------------------------------------------


@query(sql("tags il", "SELECT instance_id, label, tag, cnt FROM tags JOIN il USING (instance_id)"))
def s6_write_tagsets(s, d):
    path = scratch(s)
    files.write_tagsets(fx.instance_tag(s, d), fx.instance_label(s, d), path)
    rows = files.read_tagset_records(s, path)
    return rows.select("instance_id", F.explode("labels").alias("label"), "tags").select("instance_id", "label", F.explode("tags").alias("tag", "cnt"))


@query(sql("changes", "SELECT * FROM changes WHERE changeset_id % 3 <> 0 OR changeset_id NOT IN (SELECT changeset_id FROM changes)"))
def s7_skip_existing(s, d):
    own = fx.changes(s, d)
    return files.skip_existing(own, own.where("changeset_id % 3 = 0").select(F.col("changeset_id").alias("instance_id")))


@query(sql("pred", "SELECT instance_id, string_agg(label, ',' ORDER BY label) AS labels FROM pred GROUP BY 1"))
def s9_write_predictions(s, d):
    path = scratch(s)
    files.write_predictions(fx.pred(s, d), path)
    rows = s.read.schema("instance_id long, labels array<string>").json(path)
    return rows.select("instance_id", F.array_join("labels", ",").alias("labels"))


@query(sql("pred", """, i AS (SELECT doc_id AS instance_id, concat(lang, '-', doc_id, '.tag') AS name FROM documents),
l AS (SELECT instance_id, list(label ORDER BY label) AS ls FROM pred GROUP BY 1)
SELECT 'names' AS part, name AS line FROM i
UNION ALL SELECT 'lists', '[' || coalesce(array_to_string(list_transform(ls, lambda x: chr(39) || x || chr(39)), ', '), '') || ']' FROM i LEFT JOIN l USING (instance_id)
UNION ALL SELECT 'labels', i.instance_id || '=' || coalesce(array_to_string(ls, ','), '') FROM i LEFT JOIN l USING (instance_id)"""))
def s9_dump_predictions(s, d):
    path = scratch(s)
    names = table(s, d, "documents").select(F.col("doc_id").alias("instance_id"), F.concat("lang", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".tag")).alias("name"))
    files.dump_predictions(fx.pred(s, d), names, path)
    records = s.read.schema("instance_id long, labels array<string>").json(f"{path}/labels")
    lines = [s.read.text(f"{path}/{part}").select(F.lit(part).alias("part"), F.col("value").alias("line")) for part in ("names", "lists")]
    return lines[0].union(lines[1]).union(records.select(F.lit("labels"), F.concat_ws("=", F.col("instance_id").cast("string"), F.array_join("labels", ","))))


@query(sql("tags lidx", "SELECT t.instance_id, concat(c.costs, ' | ', t.words) AS line FROM (SELECT instance_id, string_agg(tag, ' ' ORDER BY tag) AS words FROM tags GROUP BY 1) t JOIN (SELECT instance_id, string_agg(concat(i, CASE WHEN i = idx + 1 THEN ':0.0' ELSE ':1.0' END), ' ' ORDER BY i) AS costs FROM il JOIN lidx USING (label), (SELECT unnest(range(1, 101)) AS i) GROUP BY 1) c USING (instance_id)"))
def s11_learner_lines(s, d):
    own = fx.instance_label(s, d)
    return files.learner_lines(fx.instance_tag(s, d), own, encode.assign_index(own, "label", 1), 100)


@query(sql("tags il", "SELECT instance_id, concat(any_value(label), ' | ', string_agg(concat(tag, ':', cnt), ' ' ORDER BY concat(tag, ':', cnt))) AS line FROM tags JOIN il USING (instance_id) GROUP BY 1"))
def s11_label_lines(s, d):
    return files.label_lines(fx.instance_tag(s, d), fx.instance_label(s, d))


@query(sql("costs", "SELECT * FROM costs"))
def s12_parse_costs(s, d):
    path = scratch(s)
    pairs = F.sort_array(F.collect_list(F.concat_ws(":", F.col("label_idx").cast("string"), F.col("cost").cast("string"))))
    fx.costs(s, d).groupBy("instance_id").agg(F.array_join(pairs, " ").alias("line")).write.parquet(path)
    return files.parse_costs(s.read.parquet(path))


@query("SELECT count(*) AS n, round(sum(round(value, 2)), 2) AS total FROM events WHERE event_id % 2 = 0")
def s13_training_times(s, d):
    path = scratch(s)
    line = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Training took "), F.format_string("%.2f", F.round("value", 2)), F.lit(" secs"))).otherwise("idle")
    table(s, d, "events").select(line.alias("value")).write.text(path)
    return files.training_times(s.read.text(path)).agg(F.count("*").alias("n"), F.round(F.sum("seconds"), 2).alias("total"))


@query("SELECT user_id AS run, CASE WHEN event_type = 'click' THEN 'clicks' ELSE 'views' END AS series, round(sum(round(value, 2)), 2) AS total FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2")
def s14_metric_lines(s, d):
    line = F.concat("event_type", F.lit("_seconds: "), F.format_string("%.2f", F.round("value", 2)))
    rows = table(s, d, "events").select(F.col("user_id").alias("run"), line.alias("value"))
    found = files.metric_lines(rows, {"click": "clicks", "view": "views"})
    return found.groupBy("run", "series").agg(F.round(F.sum("value"), 2).alias("total"))


@query("SELECT DISTINCT user_id AS run FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'click' AND user_id % 3 = 0)")
def s14_missing_runs(s, d):
    rows = table(s, d, "events").select(F.col("user_id").alias("run"), "event_type")
    return files.missing_runs(rows, rows.where("event_type = 'click' AND run % 3 = 0"))


@query("SELECT feature, CAST(w AS DOUBLE) AS weight, count(*) AS n FROM (SELECT p_name AS feature, p_size - 25 AS w FROM part WHERE p_partkey % 2 = 1) WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT substr(p_name, 3, 6) AS tag FROM part WHERE p_partkey % 50 = 7 UNION SELECT 'q' UNION SELECT 'bl') WHERE contains(feature, tag)) GROUP BY 1, 2")
def s15_matching_weights(s, d):
    line = F.concat("p_name", F.lit("["), (F.col("p_partkey") % 2).cast("string"), F.lit("]:"), (F.col("p_size") - 25).cast("string"))
    asked = table(s, d, "part").where("p_partkey % 50 = 7").select(F.substring("p_name", 3, 6).alias("tag")).union(s.createDataFrame([("q",), ("bl",)], "tag string"))
    return files.matching_weights(table(s, d, "part").select(line.alias("value")), asked, 1).groupBy("feature", "weight").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, CAST(sum(w) AS DOUBLE) AS total, count(*) FILTER (w > 0) AS positives, string_agg(CAST(w AS VARCHAR), ',' ORDER BY w) AS weights FROM (SELECT p_name AS feature, p_size - 25 AS w FROM part WHERE p_partkey % 2 = 1) WHERE contains(feature, 'a') OR contains(feature, 'green')")
def s15_readable_weights(s, d):
    line = F.concat("p_name", F.lit("["), (F.col("p_partkey") % 2).cast("string"), F.lit("]:"), (F.col("p_size") - 25).cast("string"))
    asked = s.createDataFrame([("a",), ("green",)], "tag string")
    out = files.readable_weights(table(s, d, "part").select(line.alias("value")), asked, 1).withColumn("total", F.round("total", 4))
    text = F.array_join(F.col("weights").cast("array<int>").cast("array<string>"), ",")
    return out.withColumn("weights", F.when(F.size("weights") > 0, text))


@query("SELECT concat(lang, '.', source, '-', doc_id, CASE WHEN doc_id % 4 = 0 THEN '.yaml' ELSE '.tag' END) AS name FROM documents WHERE doc_id % 4 <> 0 AND concat(lang, '.', source) IN ('en.src0', 'de.src1') AND NOT starts_with(concat(lang, '.', source, '-', doc_id), 'de.src1-1')")
def s3_select_files(s, d):
    end = F.when(F.col("doc_id") % 4 == 0, ".yaml").otherwise(".tag")
    name = F.concat("lang", F.lit("."), "source", F.lit("-"), F.col("doc_id").cast("string"), end)
    return files.select_files(table(s, d, "documents").select(name.alias("name")), "tag", ["en.src0", "de.src1"], without=["de.src1-1"])


@query(sql("changes", "SELECT changeset_id, path, count(*) AS n FROM changes GROUP BY ALL"))
def s1_read_changesets(s, d):
    path = scratch(s)
    # JSON text is YAML as well
    record = F.to_json(F.struct(F.array("label").alias("labels"), "changes"))
    own = fx.changes(s, d).groupBy("changeset_id").agg(F.collect_list("path").alias("changes"))
    named = own.withColumn("label", F.col("changeset_id").cast("string"))
    files.write_documents(named.select(record.alias("value")), path)
    rows = files.read_changesets(s, path)
    return rows.select(F.col("labels")[0].cast("long").alias("changeset_id"), F.explode("changes").alias("path")).groupBy("changeset_id", "path").agg(F.count("*").alias("n"))


@query(sql("tags il", "SELECT instance_id, label, tag, cnt FROM tags JOIN il USING (instance_id)"))
def s2_read_tagsets(s, d):
    path = scratch(s)
    pairs = F.struct("tag", "cnt")
    own = fx.instance_tag(s, d).groupBy("instance_id").agg(F.collect_list(pairs).alias("p")).join(fx.instance_label(s, d), "instance_id")
    as_list = F.to_json(F.struct(F.transform("p", lambda x: F.concat_ws(":", x["tag"], x["cnt"].cast("string"))).alias("tags"), "label", F.col("instance_id").alias("id")))
    as_map = F.to_json(F.struct(F.map_from_entries("p").alias("tags"), F.array("label").alias("labels"), F.col("instance_id").alias("id")))
    text = F.when(F.col("instance_id") % 2 == 0, as_list).otherwise(as_map)
    files.write_documents(own.select(text.alias("value")), path)
    rows, _ = files.read_tagsets(s, path)
    return rows.select(F.col("id").cast("long").alias("instance_id"), F.explode("labels").alias("label"), "tags").select("instance_id", "label", F.explode("tags").alias("tag", "cnt"))


def _archives(batches):
    """Layer archives as text: their headers and names are plain characters."""
    import io
    import tarfile

    import pandas as pd

    for b in batches:
        made = []
        for image, members in zip(b["image"], b["members"]):
            held = io.BytesIO()
            with tarfile.open(fileobj=held, mode="w") as tar:
                for name in members:
                    info = tarfile.TarInfo(name.rstrip("/"))
                    info.type = tarfile.DIRTYPE if name.endswith("/") else tarfile.REGTYPE
                    tar.addfile(info)
            made.append("no archive" if image % 50 == 0 else held.getvalue().decode())
        yield pd.DataFrame({"value": made, "part": b["image"]})


@query(sql("layers", """SELECT image, concat('layer', k) AS path, true AS is_dir, false AS bad FROM layers WHERE image % 50 <> 0
UNION ALL SELECT image, concat('layer', k, '/', replace(layer, ':', '_')), false, false FROM layers WHERE image % 50 <> 0
UNION ALL SELECT DISTINCT image, NULL, NULL, true FROM layers WHERE image % 50 = 0"""))
def s4_list_archives(s, d):
    path = scratch(s)
    folder = F.concat(F.lit("layer"), F.col("k").cast("string"))
    members = F.array(F.concat(folder, F.lit("/")), F.concat(folder, F.lit("/"), F.replace("layer", F.lit(":"), F.lit("_"))))
    own = fx.layers(s, d).groupBy("image").agg(F.flatten(F.collect_list(members)).alias("members"))
    own.mapInPandas(_archives, "value string, part long").write.partitionBy("part").text(path)
    at = F.regexp_extract("archive", r"part=(\d+)", 1).cast("long").alias("image")
    return files.list_archives(s, path).select(at, "path", "is_dir", F.col("error").isNotNull().alias("bad"))


@query(sql("layers", "SELECT image, concat('config', image) AS config, CAST(row_number() OVER (PARTITION BY image ORDER BY k) - 1 AS INTEGER) AS k, layer FROM layers"))
def s5_read_manifests(s, d):
    path = scratch(s)
    own = fx.layers(s, d).groupBy("image").agg(F.sort_array(F.collect_list(F.struct("k", "layer"))).alias("l"))
    config = F.concat(F.lit("config"), F.col("image").cast("string")).alias("Config")
    record = F.to_json(F.array(F.struct(config, F.col("l.layer").alias("Layers"))))
    own.select(record.alias("value"), F.col("image").alias("part")).write.partitionBy("part").text(path)
    at = F.regexp_extract("file", r"part=(\d+)", 1).cast("long").alias("image")
    return files.read_manifests(s, path).select(at, "config", "k", "layer")


@query(sql("history", "SELECT image, CAST(row_number() OVER (PARTITION BY image ORDER BY pos, created_by) - 1 AS INTEGER) AS pos, created_by, empty_layer FROM history"))
def s5_read_history(s, d):
    path = scratch(s)
    entries = F.sort_array(F.collect_list(F.struct("pos", "created_by", "empty_layer")))
    own = fx.history(s, d).groupBy("image").agg(entries.alias("history"))
    own.select(F.to_json(F.struct("history")).alias("value"), F.col("image").alias("part")).write.partitionBy("part").text(path)
    at = F.regexp_extract("file", r"part=(\d+)", 1).cast("long").alias("image")
    return files.read_history(s, path).select(at, "pos", "created_by", "empty_layer")


# Streaming -------------------------------------------------------------------------------------


def _changeset_files(s, d):
    path = scratch(s)
    fx.changes(s, d).groupBy("changeset_id").agg(F.collect_list("path").alias("changes")).write.parquet(path)
    return s.readStream.schema("changeset_id long, changes array<string>").option("maxFilesPerTrigger", 4).parquet(path)


@query(sql("tags", "SELECT * FROM tags"))
def t2_extract_stream(s, d):
    """Every changeset arrives twice."""
    out, stream = scratch(s), _changeset_files(s, d)
    jobs.extract_stream(stream.unionByName(_changeset_files(s, d)), out, scratch(s)).awaitTermination()
    return s.read.parquet(out).drop("batch")


def _sample_files(s, d, own=None):
    path = scratch(s)
    sets = (fx.instance_tag(s, d) if own is None else own).groupBy("instance_id").agg(F.map_from_entries(F.collect_list(F.struct("tag", "cnt"))).alias("tags"))
    sets.write.parquet(path)
    return s.readStream.schema("instance_id long, tags map<string,long>").option("maxFilesPerTrigger", 4).parquet(path)


@query(sql("scored", "SELECT model_id, instance_id, label, round(1 / (1 + exp(-margin)), 6) AS p FROM scored WHERE round(margin, 9) > 0"))
def t1_score_stream(s, d):
    out = scratch(s)
    own = materialize(fx.instance_tag(s, d))  # for the samples and for the stumps
    # All sums of leaves first, so that one of zero is told from one beside it by rounding, as in m5.
    jobs.score_stream(_sample_files(s, d, own), materialize(fx.stumps(s, d, own)), out, scratch(s), threshold=0.0).awaitTermination()
    margin = F.round(F.ln(F.col("p") / (1 - F.col("p"))), 9)
    return s.read.parquet(out).drop("batch").where(margin > 0).withColumn("p", F.round("p", 6))


def _finish(stream, mode):
    """Run a streaming aggregation over all that is there; the last result."""
    out = scratch(stream.sparkSession)

    def each(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", scratch(stream.sparkSession))
    writer.trigger(availableNow=True).start().awaitTermination()
    rows = stream.sparkSession.read.parquet(out)
    return rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0]).drop("batch")


@query("SELECT event_type AS model_id, CAST(floor(epoch(ts) / 900) AS BIGINT) AS epoch, count(*) AS load FROM events GROUP BY 1, 2")
def t3_epoch_load(s, d):
    path = scratch(s)
    table(s, d, "events").select(F.col("event_type").alias("model_id"), F.col("ts").cast("timestamp").alias("ts")).write.parquet(path)
    stream = s.readStream.schema("model_id string, ts timestamp").parquet(path)
    out = _finish(jobs.epoch_load(stream), "complete")
    return out.select("model_id", F.floor(F.unix_seconds("epoch_start") / 900).alias("epoch"), "load")


@query("""WITH RECURSIVE per AS MATERIALIZED (SELECT event_type AS model_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS epoch, count(*) AS load FROM events GROUP BY 1, 2),
closed AS (SELECT CAST(floor((epoch(max(ts)) - 3600) / 86400) AS BIGINT) - 1 AS e FROM events),
f AS (
  SELECT model_id, epoch, load, 0.3::DOUBLE * load AS avg, 0.3::DOUBLE * abs(load - 0.3::DOUBLE * load) AS dev FROM (SELECT *, min(epoch) OVER (PARTITION BY model_id) AS first FROM per), closed WHERE epoch = first AND epoch <= e
  UNION ALL
  SELECT model_id, epoch, x, a, 0.7::DOUBLE * dev + 0.3::DOUBLE * abs(x - a) FROM (
    SELECT f.model_id, f.epoch + 1 AS epoch, coalesce(p.load, 0) AS x, 0.7::DOUBLE * f.avg + 0.3::DOUBLE * coalesce(p.load, 0) AS a, f.dev
    FROM f CROSS JOIN closed LEFT JOIN per p ON p.model_id = f.model_id AND p.epoch = f.epoch + 1 WHERE f.epoch + 1 <= e)
)
SELECT model_id, epoch, load, round(avg, 6) AS avg, round(dev, 6) AS dev, round(avg + 3 * dev, 6) AS threshold FROM f""")
def t3_load_thresholds(s, d):
    path, out = scratch(s), scratch(s)
    table(s, d, "events").select(F.col("event_type").alias("model_id"), F.col("ts").cast("timestamp").alias("ts")).write.parquet(path)
    jobs.threshold_stream(s.readStream.schema("model_id string, ts timestamp").parquet(path), out, scratch(s), 86400).awaitTermination()
    return _round(s.read.parquet(out).drop("batch"), "avg", "dev", "threshold", places=6)


@query(sql("selected", "SELECT model_id, count(DISTINCT instance_id) AS n_instances FROM selected GROUP BY 1"))
def t4_usage_within(s, d):
    """Every sample comes twice, within the time that pairs are remembered."""
    own = materialize(fx.instance_tag(s, d))  # for the samples and for the stumps
    used = materialize(experts.used_tags(fx.stumps(s, d, own)))
    path = scratch(s)
    sets = own.groupBy("instance_id").agg(F.map_from_entries(F.collect_list(F.struct("tag", "cnt"))).alias("tags"))
    sets = materialize(sets.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod("instance_id", F.lit(3600)))))
    sets.unionByName(sets).write.parquet(path)
    stream = s.readStream.schema("instance_id long, tags map<string,long>, ts timestamp").parquet(path)
    return _finish(jobs.usage_counts(stream, used, "ts", "2 hours"), "complete")


@query(sql("selected", "SELECT model_id, count(DISTINCT instance_id) AS n_instances FROM selected GROUP BY 1"))
def t4_usage_counts(s, d):
    used = materialize(experts.used_tags(fx.stumps(s, d)))
    return _finish(jobs.usage_counts(_sample_files(s, d), used), "complete")

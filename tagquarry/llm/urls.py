"""URL filters: allow and block rules, and a character language-model ratio for all other URLs.

The URLs that rules accept and reject train two variable-order Markov models with Witten-Bell
smoothing: counts of all character runs of 1 to ORDER characters, gathered over the whole table with
map-side combining. With N occurrences and T distinct continuations of a context, a character has probability
(n + T * P(character after the context without its first character)) / (N + T), down to 1 / V for the V characters seen in
training and one for all others, so that the probabilities of a context sum to 1. The score of a URL is
the difference of both log likelihoods, divided by its length; the threshold is calibrated on a fifth
of the ruled URLs, held out by a hash, for the best balanced accuracy.

A log likelihood is a sum over the runs of a text: each run that the model has seen adds its gain over
the back-off, and each context its back-off weight. The model is therefore one number per run, a Spark table
(it grows with the corpus) that is joined to the URLs' runs, of which only ids and sums move on. Runs of
one and two characters are few and hot; the model's rows for them are repeated under SALTS salts.

Defined cases: a null URL or one without :// has empty host and path, fits no rule, and is scored as
the empty text if null (score 0, so allowed only if the threshold is not above 0); rules win by length, and
on equal length a block wins; without ruled URLs of both kinds the threshold is 0; a URL's end counts as
the character U+0003, also where a URL holds one; URLs of any length are scored whole; repeated rows
repeat; an empty table gives an empty result; other columns pass through unless named host, path,
rule, score or verdict, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, lower_ascii, materialize

ORDER = 4
END = "\x03"
SALTS = 16
#: Long URLs are cut into stretches of so many characters before their runs are taken.
STRETCH = 1_000
#: Rules are driver configuration; larger lists should be refused rather than inlined.
MAX_RULES = 1000

#: A fifth of the texts, by their hash.
HELD_OUT = "CAST(conv(left(md5(text), 8), 16, 10) AS BIGINT) % 5 = 0"

# The rules of the production query, (verdict, host, path).
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    host = lower_ascii(F.regexp_extract(after, r"^([^/?#]*)", 1))
    return host, F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, or null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    found = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def dealt(texts: DataFrame) -> DataFrame:
    """texts evenly over the session's shuffle partitions: a number of their own, so that few bytes of text, which runs
    expand to many rows, are not merged into one task. Runs stream through a task and are counted there first."""
    return texts.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def runs(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, k and run: the last k characters up to each position; END follows the last."""
    whole = F.concat("text", F.lit(END))
    starts = F.sequence(F.lit(1), F.char_length(whole), F.lit(STRETCH))
    cut = texts.select(*keys, whole.alias("whole"), F.explode(starts).alias("start"))
    first = F.greatest(F.lit(1), F.col("start") - (ORDER - 1))
    cut = cut.select(
        *keys,
        (F.col("start") - first + 1).alias("own"),  # the first position of the stretch that is not its neighbour's
        F.substr("whole", first, F.col("start") - first + STRETCH).alias("part"),
    )
    at = cut.select(*keys, "part", F.explode(F.sequence(F.col("own"), F.char_length("part"))).alias("pos"))
    at = at.withColumn("k", F.explode(F.sequence(F.lit(1), F.least(F.lit(ORDER), F.col("pos")))))
    return at.select(*keys, "k", F.substr("part", F.col("pos") - F.col("k") + 1, F.col("k")).alias("run"))


def train(labelled: DataFrame) -> DataFrame:
    """(run, k, d): what a run adds to the log likelihood ratio of a text; the empty run's row is for each character.

    labelled: (text, verdict).
    """
    counts = runs(dealt(labelled), ["verdict"]).groupBy("k", "run").agg(
        F.count_if(F.col("verdict") == "allow").alias("n_allow"), F.count_if(F.col("verdict") == "block").alias("n_block")
    )
    counts = materialize(counts.withColumn("context", F.expr("left(run, k - 1)")))
    sides = ("allow", "block")
    sums = [f(s) for s in sides for f in (lambda s: F.sum(f"n_{s}").alias(f"c_{s}"), lambda s: F.count_if(F.col(f"n_{s}") > 0).alias(f"t_{s}"))]
    contexts = materialize(counts.groupBy("context").agg(*sums))
    log_backoff = lambda s: F.when(F.col(f"t_{s}") > 0, F.log(F.col(f"t_{s}") / (F.col(f"c_{s}") + F.col(f"t_{s}")))).otherwise(0.0)
    weights = contexts.select(F.col("context").alias("run"), *(log_backoff(s).alias(f"w_{s}") for s in sides))
    # Level by level: a run's probability needs that of its last k - 1 characters.
    empty = contexts.where("context = ''").select(F.lit("").alias("run"), *((-F.log(F.col(f"t_{s}") + 1)).alias(f"p_{s}") for s in sides))
    level, gains = empty, []
    for k in range(1, ORDER + 1):
        shorter = level.select(F.col("run").alias("suffix"), *(F.col(f"p_{s}").alias(f"q_{s}") for s in sides))
        own = counts.where(F.col("k") == k).withColumn("suffix", F.expr("substr(run, 2)"))
        own = own.join(contexts, "context").join(shorter, "suffix")
        p = lambda s: F.when(
            F.col(f"n_{s}") > 0,
            F.log((F.col(f"n_{s}") + F.col(f"t_{s}") * F.exp(f"q_{s}")) / (F.col(f"c_{s}") + F.col(f"t_{s}"))),
        )
        gain = lambda s: F.coalesce(p(s) - F.col(f"q_{s}") - log_backoff(s), F.lit(0.0))
        level = materialize(own.select("run", *(p(s).alias(f"p_{s}") for s in sides), (gain("allow") - gain("block")).alias("g")))
        gains.append(level.select("run", F.lit(k).alias("k"), "g"))
    base = empty.select("run", F.lit(0).alias("k"), (F.col("p_allow") - F.col("p_block")).alias("g"))
    for g in gains:
        base = base.unionByName(g)
    added = F.col("g") + F.coalesce(F.col("w_allow") - F.col("w_block"), F.lit(0.0))
    return base.join(weights, "run", "left").select("run", "k", added.alias("d"))


def score(texts: DataFrame, model: DataFrame) -> DataFrame:
    """(text, score) of distinct texts: mean log likelihood ratio per character, above 0 for accepted."""
    texts = materialize(texts.select("text").distinct().withColumn("row", F.monotonically_increasing_id()))
    salted = F.when(F.col("k") <= 2, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    known = model.where("k > 0").select("run", F.explode(salted).alias("salt"), "d")
    salt = F.when(F.col("k") <= 2, F.pmod("row", F.lit(SALTS))).otherwise(0).cast("int")
    at = runs(dealt(texts.select("text", "row")), ["row"]).withColumn("salt", salt)
    sums = at.join(known, ["run", "salt"]).groupBy("row").agg(F.sum("d").alias("d"))
    each = model.where("k = 0").agg(F.coalesce(F.max("d"), F.lit(0.0)).alias("each"))
    ratio = F.coalesce("d", F.lit(0.0)) / (F.char_length("text") + 1) + F.col("each")
    # One row on the right side.
    return texts.join(sums, "row", "left").crossJoin(F.broadcast(each)).select("text", ratio.alias("score"))


def calibrate(held: DataFrame) -> float:
    """The threshold of best balanced accuracy, from at most 2001 bins of rows (score, verdict)."""
    bins = held.groupBy(F.least(F.lit(1000), F.greatest(F.lit(-1000), F.floor(F.col("score") * 100))).alias("bin")).agg(
        F.count_if(F.col("verdict") == "allow").alias("allow"), F.count_if(F.col("verdict") == "block").alias("block")
    )
    rows = sorted(map(tuple, bins.collect()))
    allow, block = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not allow or not block:
        return 0.0
    best, at, above, below = 0.0, 0.0, allow, 0
    for b, a, r in rows:
        if (value := above / allow + below / block) > best:
            best, at = value, b / 100
        above, below = above - a, below + r
    return at


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages with host, path, rule, score (null where a rule decides) and verdict."""
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "score", "verdict")]
    text = F.coalesce("url", F.lit(""))
    host, path = host_and_path(F.col("url"))
    judged = pages.select(F.struct(*columns(own)).alias("page"), text.alias("text"), host.alias("host"), path.alias("path"))
    fit = fitting_rule(F.col("host"), F.col("path"), rules)
    judged = judged.withColumn("fit", fit).select("page", "text", "host", "path", "fit.rule", F.col("fit.verdict").alias("ruled"))
    texts = materialize(judged.select("text", F.col("ruled").alias("verdict")).distinct())
    ruled = texts.where("verdict IS NOT NULL")
    model = materialize(train(ruled.where(f"NOT ({HELD_OUT})")))
    scored = materialize(score(texts.where(f"verdict IS NULL OR {HELD_OUT}").select("text"), model))
    threshold = calibrate(scored.join(ruled, "text"))
    own_score = F.when(F.col("ruled").isNull(), F.when(F.col("text") == "", F.lit(0.0)).otherwise(F.col("score")))
    judged = judged.join(scored, "text", "left").withColumn("score", own_score)
    by_score = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return judged.select(
        *(F.col("page").getField(c).alias(c) for c in own), "host", "path", "rule", "score", F.coalesce("ruled", by_score).alias("verdict")
    )

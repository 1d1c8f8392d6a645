"""The thin queries over the training-data operators, and their SQL where it exists."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, jaccard, line_dedup, mixing, phrases, pieces, secrets, tokenfile, topk, toxicity, trie, urls
from .common import checkpoint_dir, sha256_text, table


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_reply_trees(chat.conversation_nodes(rows)))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", sha256_text("text").alias("kept_sha256")
    )


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return topk.top_k(rows, rows.where("id % 50 = 0"), k=10)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_exact(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pieces.encode_and_decode(docs, tokenizer_path("piece_bpe_32k.model"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        sha256_text(pieces.joined_ids("ids")).alias("ids_sha256"),
        sha256_text("decoded").alias("decoded_sha256"),
    )


def op8_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    tokenfile.write_token_file(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"))
    return tokenfile.document_digests(tokenfile.read_token_file(spark, path))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return docs.withColumn("score", toxicity.scorer(spark, model)("text")).select(
        "doc_id",
        F.coalesce(F.expr("crc32(CAST(doc_id AS STRING)) % 5 = 0"), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("times")


def op11_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    own = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *(F.size(own(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        sha256_text(secrets.span_list("spans", ("assign", "access", "hex"))).alias("base_sha256"),
        secrets.span_list("spans").alias("spans"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_line_dedup": op2_line_dedup,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_top_k": op4_top_k,
    "op5_url_filter": op5_url_filter,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_token_file": op8_token_file,
    "op9_toxicity": op9_toxicity,
    "op10_mixing": op10_mixing,
    "op11_secret_scans": op11_secret_scans,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_phrase_mining": op13_phrase_mining,
}

OP1_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), m AS (
  SELECT *, len(text) + len(regexp_extract_all(text, '<\\*/?s>')) + len(regexp_extract_all(text, '\[\\*/?(?:INST|SYS|ROLE|END)\]')) AS body,
    len(role) + len(regexp_extract_all(role, '<\\*/?s>')) + len(regexp_extract_all(role, '\[\\*/?(?:INST|SYS|ROLE|END)\]')) AS named
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(body + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 9 ELSE 22 + named END) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""

OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), often AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE len(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.doc_id, k.pos, k.line, (o.key IS NOT NULL AND o.keeper <> k.doc_id) AS gone
  FROM keyed k LEFT JOIN often o ON o.key = k.key AND len(k.key) >= 20
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP6_SQL = r"""
WITH t AS (
  SELECT doc_id, len(coalesce(text, '')) AS n, translate(coalesce(text, ''),
    ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS s FROM documents
), h AS (SELECT doc_id, n, sha256(s) AS text_sha256 FROM t),
w AS (
  SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
    first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id FROM h
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""

OP4_SQL = """
WITH c AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x > 0) AS b FROM embeddings),
d AS (
  SELECT q.id AS query_id, r.id, CAST(list_sum(list_transform(range(1, len(q.b) + 1), lambda i: CASE WHEN q.b[i] <> r.b[i] THEN 1 ELSE 0 END)) AS BIGINT) AS distance
  FROM c q JOIN c r ON q.id <> r.id WHERE q.id % 50 = 0
)
SELECT query_id, id, distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank
FROM d QUALIFY rank <= 10
"""

_RULES = sorted(urls.RULES, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1] + r[2]))
_FITS = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for v, h, p in _RULES]
_RULE, _RULED = (f"CASE {' '.join(f"WHEN {f[0]} THEN '{f[i]}'" for f in _FITS)} END" for i in (1, 2))


def _side(s: str) -> str:
    """The probabilities p_{s}1 to p_{s}4 of a position after contexts of 0 to 3 characters, or fewer at the start."""
    out, before = [], f"1.0::DOUBLE / (1 + z_{s})"
    for k in range(1, urls.ORDER + 1):
        known = f"(coalesce(r{k}.n_{s}, 0) + c{k}.t_{s} * {before}) / (c{k}.n_{s} + c{k}.t_{s})"
        out.append(f"CASE WHEN c{k}.t_{s} > 0 THEN {known} ELSE {before} END AS p_{s}{k}")
        before = f"p_{s}{k}"
    return ", ".join(out)


_LOOK_UPS = " ".join(
    f"LEFT JOIN counts r{k} ON pos >= {k} AND r{k}.run = substr(whole, pos - {k - 1}, {k}) LEFT JOIN contexts c{k} ON pos >= {k} AND c{k}.context = substr(whole, pos - {k - 1}, {k - 1})"
    for k in range(1, urls.ORDER + 1)
)
OP5_SQL = f"""
WITH parts AS (
  SELECT page_id, coalesce(url, '') AS text, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), named AS (
  SELECT page_id, text, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM parts
), judged AS MATERIALIZED (SELECT *, {_RULE} AS rule, {_RULED} AS ruled FROM named),
texts AS MATERIALIZED (SELECT *, CAST('0x' || left(md5(text), 8) AS BIGINT) % 5 = 0 AS held FROM (SELECT DISTINCT text, ruled FROM judged)),
marks AS (SELECT text, ruled, text || chr(3) AS whole, unnest(range(1, len(text) + 2)) AS pos FROM texts WHERE ruled IS NOT NULL AND NOT held),
counts AS MATERIALIZED (
  SELECT run, left(run, len(run) - 1) AS context, count(*) FILTER (ruled = 'allow') AS n_a, count(*) FILTER (ruled = 'block') AS n_b
  FROM (SELECT ruled, whole, pos, unnest(range(1, least({urls.ORDER}, pos) + 1)) AS k FROM marks) CROSS JOIN LATERAL (SELECT substr(whole, pos - k + 1, k) AS run) GROUP BY 1
), contexts AS MATERIALIZED (
  SELECT context, CAST(sum(n_a) AS BIGINT) AS n_a, count(*) FILTER (n_a > 0) AS t_a, CAST(sum(n_b) AS BIGINT) AS n_b, count(*) FILTER (n_b > 0) AS t_b FROM counts GROUP BY 1
), places AS (SELECT text, text || chr(3) AS whole, unnest(range(1, len(text) + 2)) AS pos FROM texts WHERE ruled IS NULL OR held),
zero AS (SELECT coalesce(max(t_a) FILTER (context = ''), 0) AS z_a, coalesce(max(t_b) FILTER (context = ''), 0) AS z_b FROM contexts),
chances AS (SELECT text, {_side("a")}, {_side("b")} FROM places CROSS JOIN zero {_LOOK_UPS}),
scores AS MATERIALIZED (SELECT text, avg(ln(p_a{urls.ORDER}) - ln(p_b{urls.ORDER})) AS score FROM chances GROUP BY 1),
bins AS MATERIALIZED (
  SELECT least(1000, greatest(-1000, floor(score * 100))) AS bin, count(*) FILTER (ruled = 'allow') AS a, count(*) FILTER (ruled = 'block') AS b
  FROM scores JOIN texts USING (text) WHERE ruled IS NOT NULL GROUP BY 1
), worth AS (
  SELECT bin, (sum(a) OVER (ORDER BY bin DESC)) / (SELECT sum(a) FROM bins) + coalesce(sum(b) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / (SELECT sum(b) FROM bins) AS value FROM bins
), threshold AS (
  SELECT coalesce((SELECT bin / 100 FROM worth WHERE value = (SELECT max(value) FROM worth) ORDER BY bin LIMIT 1), 0.0) AS t
)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN (CASE WHEN text = '' THEN 0.0 ELSE score END) >= t THEN 'allow' ELSE 'block' END) AS verdict
FROM judged LEFT JOIN scores USING (text), threshold
"""

# A linked pair shares one of the first n // 5 + 1 shingles of either set, in any one order: here the rarest come first.
OP3_SQL = r"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i : least(i + 4, len(w))], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
ranked AS MATERIALIZED (
  SELECT doc_id, s, n, row_number() OVER (PARTITION BY doc_id ORDER BY held, s) AS r
  FROM shingles JOIN sizes USING (doc_id) JOIN (SELECT s, count(*) AS held FROM shingles GROUP BY 1) USING (s)
), met AS MATERIALIZED (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS n, b.n AS m FROM ranked a JOIN ranked b ON a.s = b.s AND a.doc_id < b.doc_id
  WHERE a.r <= a.n // 5 + 1 AND b.r <= b.n // 5 + 1 AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
), links AS MATERIALIZED (
  SELECT a, b FROM met JOIN shingles x ON x.doc_id = a JOIN shingles y ON y.doc_id = b AND y.s = x.s
  GROUP BY a, b, n, m HAVING 100 * count(*) >= 80 * (n + m - count(*))
), sides AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, other) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT reach.id, sides.b FROM reach JOIN sides ON sides.a = reach.other)
SELECT w.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id
FROM words w LEFT JOIN sizes s USING (doc_id) LEFT JOIN (SELECT id, min(other) AS component_id FROM reach GROUP BY 1) c ON c.id = w.doc_id
"""

_BASE = {"assign": (secrets.ASSIGN, 2, secrets.LEAST_ASSIGNED), "access": (secrets.ACCESS, 0, secrets.LEAST_ACCESS), "hex": (secrets.HEX, 0, secrets.LEAST_HEX)}


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _matches(kind: str, pattern: str, group: int, least: int) -> str:
    """Rows (id, kind, start, match) of a pattern: what lies before a match are the pieces and matches before it."""
    q = _quoted(pattern)
    return f"""SELECT id, '{kind}' AS kind, m[i] AS match, CAST(list_sum(list_transform(p[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) AS BIGINT) AS start
  FROM (SELECT id, m, g, p, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT id, regexp_extract_all(text, {q}) AS m, regexp_extract_all(text, {q}, {group}) AS g, regexp_split_to_array(text, {q}) AS p FROM docs WHERE regexp_matches(text, {q})
  )) WHERE len(g[i]) >= {least}"""


_RUNS = [(f"[{c.chars}]{{{c.window},}}", c, i) for i, c in enumerate(secrets.CLASSES)]
_ALLOWED = " OR ".join(f"regexp_matches(match, {_quoted(a)})" for a in secrets.ALLOW_LIST)
_MIXES = " WHEN ".join(f"'{i}' THEN " + " AND ".join(f"regexp_matches(part, '[{m}]')" for m in c.mixes) + f" AND weight <= {secrets.most_weight(c.window, c.bits)}" for _, c, i in _RUNS)
OP11_SQL = rf"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
base AS MATERIALIZED ({" UNION ALL ".join(_matches(k, *v) for k, v in _BASE.items())}),
runs AS MATERIALIZED ({" UNION ALL ".join(_matches(str(i), p, 0, c.window) for p, c, i in _RUNS)}),
windows AS MATERIALIZED (
  SELECT id, kind, start + i - 1 AS start, substr(match, i, {secrets.CLASSES[0].window}) AS part
  FROM (SELECT *, unnest(range(1, len(match) - {secrets.CLASSES[0].window} + 2)) AS i FROM runs WHERE NOT ({_ALLOWED}))
), weighed AS (
  SELECT id, kind, start, part, sum(CAST(round(c * log2(c) * {secrets.MILLIONTHS}) AS BIGINT)) AS weight
  FROM (SELECT id, kind, start, part, ch, count(*) AS c FROM (SELECT *, unnest(string_split(part, '')) AS ch FROM windows) GROUP BY ALL) GROUP BY ALL
), high AS (
  SELECT id, start, start + {secrets.CLASSES[0].window} AS "end", max(start + {secrets.CLASSES[0].window}) OVER (PARTITION BY id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM weighed WHERE CASE kind WHEN {_MIXES} END
), islands AS (
  SELECT id, min(start) AS start, max("end") AS "end" FROM (SELECT *, count(*) FILTER (reach IS NULL OR start > reach) OVER (PARTITION BY id ORDER BY start ROWS UNBOUNDED PRECEDING) AS island FROM high) GROUP BY id, island
), spans AS (
  SELECT id, kind, start, start + len(match) AS "end" FROM base
  UNION ALL SELECT id, 'entropy', start, "end" FROM islands i WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.id = i.id AND b.start <= i.start AND i."end" <= b.start + len(b.match))
), listed AS (SELECT *, kind || ':' || start || ':' || "end" AS said, list_position(['assign', 'access', 'hex', 'entropy'], kind) AS place FROM spans)
SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(said, ',' ORDER BY start, place) FILTER (kind <> 'entropy'), '')) AS base_sha256,
  coalesce(string_agg(said, ',' ORDER BY start, place), '') AS spans
FROM docs LEFT JOIN listed USING (id) GROUP BY id, doc_id
"""

# The checksum's bits, one step of eight per character: DuckDB has no crc32.
OP12_SQL = r"""
WITH turns AS MATERIALIZED (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS MATERIALIZED (
  SELECT c, c - ((c % 5) + 5) % 5 AS base, count(*) AS n,
    xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda ch: [CAST(ascii(ch) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
      lambda x, y: xor(xor(x, y) >> 1, (xor(x, y) & 1) * 3988292384)), 4294967295) % 9 AS h
  FROM turns GROUP BY c
), heads AS MATERIALIZED (SELECT k.*, least(h, coalesce((SELECT b.n FROM convs b WHERE b.c = k.base), 0)) AS head FROM convs k),
rebuilt AS MATERIALIZED (
  SELECT k.c, t.pos + 1 AS d, t.role, t.text FROM heads k JOIN turns t ON t.c = k.base AND t.pos < k.h
  UNION ALL SELECT k.c, k.head + t.pos - k.h + 1, t.role, t.text FROM heads k JOIN turns t ON t.c = k.c AND t.pos >= k.h
), sizes AS (SELECT c, head + greatest(n - h, 0) AS n FROM heads),
prefixes AS MATERIALIZED (
  SELECT c, d, sha256(string_agg(len(role) || ':' || len(text) || ':' || role || text, '' ) OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING)) AS p, octet_length(encode(text)) AS bytes FROM rebuilt
  UNION ALL SELECT c, 0, '', 0 FROM convs
), nodes AS MATERIALIZED (
  SELECT p, d AS depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS own,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = n), '')) AS ends_sha256
  FROM prefixes JOIN sizes USING (c) GROUP BY p, d
), above AS MATERIALIZED (  -- a node's prefixes are those of any of its members
  SELECT n.p, n.own, a.p AS top, a.d AS top_depth, n.depth FROM nodes n JOIN prefixes a ON a.c = n.conv_id AND a.d <= n.depth
), inner_nodes AS (SELECT DISTINCT top AS p FROM above WHERE top_depth = depth - 1),
sums AS (
  SELECT top AS p, count(*) FILTER (top_depth = depth - 1) AS n_children, count(*) FILTER (i.p IS NULL) AS n_leaves, sum(own) AS saved_tokens
  FROM above a LEFT JOIN inner_nodes i ON i.p = a.p GROUP BY top
)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, s.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s USING (p) LEFT JOIN above a ON a.p = n.p AND a.top_depth = n.depth - 1 LEFT JOIN nodes u ON u.p = a.top
"""

OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece FROM documents
), listed AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ 	]+'), lambda w: w <> '') AS w FROM pieces),
grams AS MATERIALIZED (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM listed)),
f1 AS MATERIALIZED (SELECT lang, x, count(*) AS f FROM grams GROUP BY ALL),
f2 AS MATERIALIZED (SELECT lang, x, y, count(*) AS f FROM grams WHERE y IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS MATERIALIZED (SELECT lang, x, y, z, count(*) AS f FROM grams WHERE z IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
longer AS (SELECT lang, x, y, max(f) AS f FROM (SELECT lang, x, y, f FROM f3 UNION ALL SELECT lang, y, z, f FROM f3) GROUP BY ALL),
cuts AS (
  SELECT p.lang, p.x || ' ' || p.y AS phrase, p.f AS a, 1 AS k, v.f AS l, w.f AS r
  FROM f2 p JOIN f1 v ON v.lang = p.lang AND v.x = p.x JOIN f1 w ON w.lang = p.lang AND w.x = p.y LEFT JOIN longer g ON g.lang = p.lang AND g.x = p.x AND g.y = p.y
  WHERE g.f IS NULL OR 100 * g.f < 50 * p.f
  UNION ALL SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.f, 1, v.f, p.f FROM f3 t JOIN f1 v ON v.lang = t.lang AND v.x = t.x JOIN f2 p ON p.lang = t.lang AND p.x = t.y AND p.y = t.z
  UNION ALL SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.f, 2, p.f, v.f FROM f3 t JOIN f1 v ON v.lang = t.lang AND v.x = t.z JOIN f2 p ON p.lang = t.lang AND p.x = t.x AND p.y = t.y
), scored AS (SELECT *, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest QUALIFY rank <= 2000)
SELECT lang, rank, phrase, a, l, r, (SELECT CAST(sum(f) AS BIGINT) FROM f1 WHERE f1.lang = ranked.lang) AS n, score FROM ranked
"""

SQL = {"op11_secret_scans": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_phrase_mining": OP13_SQL, "op5_url_filter": OP5_SQL, "op3_jaccard_join": OP3_SQL, "op4_top_k": OP4_SQL, "op1_chat_formatting": OP1_SQL, "op2_line_dedup": OP2_SQL, "op6_exact_dedup": OP6_SQL}

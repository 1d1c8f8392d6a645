"""Each operator against a brute-force version, on small tables with nulls, repeats and odd texts."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagquarry.llm import chat, components, exact_dedup, jaccard, line_dedup, mixing, pieces, queries, tokenfile, topk, toxicity, urls
from tagquarry.llm.chunks import ChunkTable

WS = " \t\n\x0b\x0c\r"
DOC = "doc_id long, text string, source string, n_lines string, ids string, score string"


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def frame(spark, texts, sources=None):
    rows = [(i, t, sources[i] if sources else "s", "x", "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ODD = ["", None, " \t\n ", "\n\n", "a", LONG, "ÄÖ é\u0301 \U0001f600\x00\n\u2028x\x85y", "tail \r\n"]


# Chat formatting -------------------------------------------------------------------------------


def test_escape_is_reversible():
    r = random.Random(1)
    bits = ["<", ">", "s>", "/s>", "[", "]", "INST]", "/INST]", "[INST]", "</s>", "\\", " ", "x", "[ROLE]", "END]", "<\\s>"]
    for _ in range(3000):
        t = "".join(r.choice(bits) for _ in range(r.randint(0, 12)))
        e = chat.escape(t)
        assert chat.unescape(e) == t
        assert not re.search(r"</?s>|\[/?(INST|SYS|ROLE|END)\]", e)
        turns = [("user", t), ("assistant", t), (t, t), ("system", t)]
        text, spans = chat.format_turns(turns)
        assert chat.parse_turns(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in spans] == [t]


def brute_paths(nodes):
    kids, by = defaultdict(list), {n[:2]: n for n in nodes}
    for t, n, p, *_ in nodes:
        kids[t, p if (t, p) in by else None].append(n)
    out = {}

    def walk(t, n, path, score):
        path, score = [*path, n], score + (by[t, n][5] or 0.0)
        if not kids[t, n]:
            out[t, n] = (path, score)
        for k in kids[t, n]:
            walk(t, k, path, score)

    for t in {n[0] for n in nodes}:
        for root in kids[t, None]:
            walk(t, root, [], 0.0)
    return out


def test_reply_trees(spark):
    r = random.Random(2)
    nodes = [(t, n, r.choice([None, *range(n)]) if n else None, r.choice(["user", "assistant", None]), r.choice(["hi", None, "[INST]"]), r.choice([None, 1.0, 2.5])) for t in range(6) for n in range(r.randint(1, 25))]
    nodes += [(9, 1, 2, "user", "loop", 0.0), (9, 2, 1, "user", "loop", 0.0), (8, 5, 77, "user", "orphan", 1.0)]
    schema = "tree_id long, node_id long, parent_id long, role string, text string, score double"
    df = spark.createDataFrame([*nodes, (None, 1, None, "user", "x", 0.0), (1, None, None, "user", "x", 0.0)], schema)
    want = brute_paths([n for n in nodes if n[0] != 9])
    got = {(x.tree_id, x.leaf_id): (x.path, x.score) for x in chat.enumerate_paths(df.where("tree_id IS NOT NULL AND node_id IS NOT NULL")).collect()}
    assert got == want
    best = {x.tree_id: x.leaf_id for x in chat.format_reply_trees(df.withColumn("branch", F.lit("clash")).withColumn("path", F.lit(1))).collect()}
    assert best == {t: min((-s, leaf) for (u, leaf), (_, s) in want.items() if u == t)[1] for t in {k[0] for k in want}}
    assert chat.format_reply_trees(df.limit(0)).count() == 0


def test_conversations_with_nulls_and_repeats(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (2, 0, None, "t"), (None, 0, "user", "x"), (3, 5, "tool", "[ROLE] </s>"), (4, 0, "assistant", LONG)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_reply_trees(chat.conversation_nodes(df))).collect()}
    assert set(got) == {1, 2, 3, 4} and got[1].n_turns == 3 and got[4].loss_sha256 == sha(LONG)
    assert got[1].turns_sha256 == sha("user\n\nassistant\na\nassistant\na\n") and got[1].loss_sha256 == sha("aa")
    assert got[2].turns_sha256 == sha("\nt\n") and got[3].turns_sha256 == sha("tool\n[ROLE] </s>\n") and got[3].loss_chars == 0


def test_a_chain_longer_than_65536_turns(spark):
    n = (1 << 16) + 5
    long = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    short = spark.createDataFrame([(2, 0, "user", "t")], "conv_id long, turn long, role string, text string")
    rows = chat.read_back(chat.format_reply_trees(chat.conversation_nodes(long.unionByName(short))))
    got = {x.conv_id: (x.n_turns, x.turns_sha256) for x in rows.collect()}
    assert got == {1: (n, sha("".join(f"user\n{i}\n" for i in range(n)))), 2: (1, sha("user\nt\n"))}


# Line dedup ------------------------------------------------------------------------------------


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def brute_lines(docs):
    key = lambda line: lower(line.strip(WS))
    held = defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            held[key(line)].add(d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 20 or len(held[key(x)]) < 3 or max(held[key(x)]) == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_line_dedup(spark):
    r = random.Random(3)
    pool = ["Exactly twenty chars", "nineteen characters", "  a LONGER line that repeats \t", "a longer line that repeats", "É unique line of more than twenty", "", "x"]
    texts = ["\n".join(r.choice(pool) for _ in range(r.randint(1, 7))) for _ in range(25)] + ODD
    df = frame(spark, texts)
    got = sorted((x.doc_id, x.n_lines, x.n_dropped, x.text) for x in line_dedup.dedup_lines(df).collect())
    assert got == brute_lines(list(enumerate(texts)))
    both = df.unionByName(df.where("doc_id < 5")).unionByName(df.where("doc_id = 6").withColumn("text", F.lit(pool[2])))
    rows = [(x.doc_id, x.text) for x in both.collect()]
    assert sorted((x.doc_id, x.n_lines, x.n_dropped, x.text) for x in line_dedup.dedup_lines(both).collect()) == brute_lines(rows)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
    null = df.limit(3).withColumn("doc_id", F.lit(None).cast("long"))
    assert line_dedup.dedup_lines(df.unionByName(null)).where("doc_id IS NULL AND n_dropped > 0").count() == 0


# Exact dedup -----------------------------------------------------------------------------------


@pytest.mark.parametrize("bits", [1 << 27, 64])
def test_exact_dedup(spark, bits):
    texts = ["a b", "ab", " a  b ", "c", None, "", "\t", "d", "d", *ODD]
    df = frame(spark, texts)
    squeeze = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for d, t in enumerate(texts):
        groups[squeeze(t)].append((-len(t or ""), d))
    want = sorted((d, min(groups[squeeze(t)])[1], len(groups[squeeze(t)]), min(groups[squeeze(t)])[1] == d, sha(squeeze(t))) for d, t in enumerate(texts))
    out = exact_dedup.dedup_exact(df, max_filter_bits=bits)
    assert sorted(map(tuple, out.collect())) == want
    twice = exact_dedup.dedup_exact(df.where("doc_id = 3").unionByName(df.where("doc_id = 3")), max_filter_bits=bits).collect()
    assert sorted(r.kept for r in twice) == [False, True] and {r.group_size for r in twice} == {2}
    assert exact_dedup.dedup_exact(df.limit(0)).count() == 0
    null = df.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long"))
    assert {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.dedup_exact(df.where("doc_id = 3").unionByName(null)).collect()} == {(3, 3, True), (None, 3, False)}


# Jaccard join ----------------------------------------------------------------------------------


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(docs):
    sets = {d: shingle_set(t) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in sets}


def near_copies(r, base, n, most):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(r.randint(0, most)):
            i = r.randrange(len(words))
            change = r.random()
            if change < 0.4:
                words[i] = f"new{r.randrange(10**6)}"
            elif change < 0.8 and len(words) > 3:
                del words[i]
            else:
                words[i] = words[i].upper()
        out.append(r.choice([" ", "\n", "  "]).join(words))
    return out


def test_jaccard_join(spark):
    r = random.Random(4)
    vocabulary = [f"v{i}" for i in range(400)]
    texts = []
    for size, n, most in ((6, 20, 2), (12, 30, 3), (40, 40, 4), (146, 150, 7), (700, 12, 30), (9, 3, 1)):
        texts += near_copies(r, [r.choice(vocabulary) for _ in range(size)], n, most)
    shared = " ".join(vocabulary[:8])
    texts += [shared + " " + " ".join(r.choice(vocabulary) for _ in range(r.randint(2, 12))) for _ in range(60)]
    texts += [" ".join(f"t{r.randrange(3)}" for _ in range(r.randint(1, 8))) for _ in range(40)] + ODD + texts[:5]
    df = frame(spark, texts).withColumn("component_id", F.lit("clash")).withColumn("key", F.lit(1))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_join(df).collect()}
    assert got == brute_components(list(enumerate(texts)))
    null = df.where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long"))
    few = df.where("doc_id < 3").unionByName(null).unionByName(df.where("doc_id = 0"))
    rows = jaccard.jaccard_join(few).collect()
    assert len(rows) == 5 and [x.component_id for x in rows if x.doc_id is None] == [None]
    assert jaccard.jaccard_join(df.limit(0)).count() == 0


def test_jaccard_join_of_large_groups_and_popular_passages(spark):
    r = random.Random(1847)
    word = lambda: f"w{r.randrange(10**6)}"
    base = [word() for _ in range(260)]
    tail = [word() for _ in range(60)]
    texts = [" ".join([f"g{k}", *base[1:]]) for k in range(20)] + [" ".join(["gx", *base[1:], *tail])]
    passage, other = [word() for _ in range(60)], [word() for _ in range(40)]
    texts += [" ".join([*passage, *(word() for _ in range(r.randint(5, 60)))]) for _ in range(60)]
    texts += [" ".join([*passage, *other, *(word() for _ in range(r.randint(0, 12)))]) for _ in range(60)]
    for n, most in ((90, 6), (40, 9)):
        texts += near_copies(r, [word() for _ in range(150)], n, most)
    r.shuffle(texts)
    sets = list(jaccard.batch_sets(pa.array(texts)))
    held = Counter(k for s in sets for k in jaccard.set_keys(s).tolist())
    assert max(held.values()) > jaccard.CROWD
    for crowd, hubs in ((jaccard.CROWD, 8), (2, 1)):
        jaccard.CROWD, kept, jaccard.HUBS, k = crowd, jaccard.CROWD, hubs, jaccard.HUBS
        try:
            got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_join(frame(spark, texts)).collect()}
        finally:
            jaccard.CROWD, jaccard.HUBS = kept, k
        assert got == brute_components(list(enumerate(texts)))


def test_linked_sets_of_any_size_share_a_key():
    r = np.random.RandomState(11)
    for n in (4, 5, 6, 9, 12, 31, 60, 150, 400, 900, 3000, 9000):
        for _ in range(30):
            a = np.unique(r.randint(0, 2**62, n).astype(np.uint64))
            out = r.randint(0, len(a) // 5 + 1)
            more = (len(a) - out) * 5 // 4 - len(a)  # so that 0.8 is just reached
            b = np.unique(np.r_[r.permutation(a)[out:], r.randint(0, 2**62, max(0, more)).astype(np.uint64)])
            common = len(np.intersect1d(a, b))
            if 100 * common >= 80 * (len(a) + len(b) - common) and common < max(len(a), len(b)):
                assert set(jaccard.set_keys(a).tolist()) & set(jaccard.set_keys(b).tolist())


def test_hamming_never_exceeds_the_difference():
    r = np.random.RandomState(5)
    for _ in range(200):
        a = np.unique(r.randint(0, 2**62, r.randint(1, 300)).astype(np.uint64))
        b = np.unique(np.concatenate([r.choice(a, r.randint(1, len(a) + 1)), r.randint(0, 2**62, r.randint(1, 60)).astype(np.uint64)]))
        d = len(np.setxor1d(a, b))
        assert jaccard.folded_hamming(jaccard.parity_sketch(a), jaccard.parity_sketch(b)) <= d
        wide = next(jaccard._wide([pd.DataFrame({"doc_id": [1, 2], "set": [a.tobytes(), b.tobytes()]})]))
        x, y = wide[[f"w{i}" for i in range(jaccard.WORDS)]].to_numpy()
        assert np.bitwise_count((x ^ y).view(np.uint64)).sum() <= d and list(wide["n"]) == [len(a), len(b)]


def test_streamed_postings_find_every_pair():
    import pyarrow as pa

    r = random.Random(6)
    rows = sorted([(r.choice([1, 2, 3, 50, 51]) if r.random() < 0.5 else r.randint(100, 160), d) for d in range(400)])
    runs = defaultdict(list)
    for k, d in rows:
        runs[k].append(d)
    want = {(min(p), max(p)) for v in runs.values() if len(v) <= jaccard.CROWD for p in itertools.combinations(v, 2)}
    crowd = {(d, k) for k, v in runs.items() if len(v) > jaccard.CROWD for d in v}
    for size in (1, 7, 64, 400):
        batches = [pa.RecordBatch.from_pylist([{"key": k, "doc_id": d} for k, d in rows[i : i + size]]) for i in range(0, len(rows), size)]
        dealt = [jaccard._dealt(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        merged = sorted(((x["direct"], x["key"], x["doc_id"]) for b in dealt for x in b.to_pylist()))
        batches = [
            pa.RecordBatch.from_pylist([{"key": k, "doc_id": d, "direct": x} for x, k, d in merged[i : i + size]])
            for i in range(0, len(merged), size)
        ]
        out = [x for b in jaccard._runs(iter(batches)) for x in b.to_pylist()]
        assert {(x["a"], x["b"]) for x in out if x["b"] is not None} == want
        assert {(x["a"], x["key"]) for x in out if x["b"] is None} == crowd


def test_components(spark):
    r = random.Random(7)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1060)] + [(None, 3), (5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent)}


# Top k -----------------------------------------------------------------------------------------


def brute_top_k(rows, asked, k):
    full = {(i, *e) for i, e in rows if i is not None and e}
    want = []
    for q in asked:
        code = min(((len(e), e) for i, *e in full if i == q), key=lambda x: (x[0], segments(x[1])))[1]
        best = {}
        for i, *e in full:
            if i != q and len(e) == len(code):
                best[i] = min(best.get(i, 99), sum((a > 0) != (b > 0) for a, b in zip(code, e)))
        want += [(q, i, d, n + 1) for n, (d, i) in enumerate(sorted((d, i) for i, d in best.items())[:k])]
    return sorted(want)


def segments(e, width=7):
    return [sum((x > 0) << j for j, x in enumerate(e[at : at + width])) for at in range(0, len(e), width)]


def test_top_k(spark, monkeypatch):
    r = random.Random(8)
    code = lambda n: [r.choice([-1.0, 1.0]) for _ in range(n)]
    rows = [(i, code(20) if i % 3 else [1.0] * 20) for i in range(80)] + [(100, None), (101, []), (102, [1.0]), (103, [-1.0]), (None, [1.0] * 20), (5, None)]
    rows += [(200 + i, code(9)) for i in range(15)] + [(7, code(20)), (7, code(20)), (14, code(20)), rows[9]]
    df = spark.createDataFrame(rows, "id long, embedding array<double>").withColumn("code", F.lit("clash")).withColumn("bits", F.lit(1))
    asked = sorted({i for i, e in rows if i is not None and e and i % 7 == 0})
    assert sorted(map(tuple, topk.top_k(df, df.where("id % 7 = 0"), 5).collect())) == brute_top_k(rows, asked, 5)
    monkeypatch.setattr(topk, "BLOCK", 5)  # far neighbours are found by comparing with all codes
    assert sorted(map(tuple, topk.top_k(df, df.where("id % 7 = 0"), 60).collect())) == brute_top_k(rows, asked, 60)
    few = topk.top_k(df.where("id < 3"), df.where("id = 0"), 5)
    assert sorted(x.id for x in few.collect()) == [1, 2]
    assert topk.top_k(df.limit(0), df.limit(0), 5).count() == 0


def test_top_k_over_chunks_and_blocks(spark, monkeypatch):
    r = random.Random(11)
    base = [[r.choice([-1.0, 1.0]) for _ in range(40)] for _ in range(30)]
    near = lambda e: [-x if r.random() < 0.1 else x for x in e]
    rows = [(i, near(r.choice(base))) for i in range(240)] + [(300 + i, base[0]) for i in range(30)]
    rows[3:5] = [(3, [float("nan"), None] * 20), (4, [1.0, -1.0] * 20)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(5)
    for name, value in (("CHUNK", 40), ("BLOCK", 6), ("STEP", 64)):  # many small tasks, whose results are merged
        monkeypatch.setattr(topk, name, value)
    plain = [(i, [1.0 if x is not None and (x > 0 or x != x) else -1.0 for x in e]) for i, e in rows]
    asked = [i for i, _ in rows if i % 3 == 0]
    assert sorted(map(tuple, topk.top_k(df, df.where("id % 3 = 0"), 10).collect())) == brute_top_k(plain, asked, 10)


def test_top_k_compares_few_codes(monkeypatch):
    """A task looks segments up: of 65,536 codes it compares a small part with each query."""
    import numpy as np

    rng, seen = np.random.default_rng(2), []
    raw, ids = rng.integers(0, 256, (1 << 16, 8), dtype=np.uint8), np.arange(1 << 16)
    own = raw[:50] ^ (np.uint8(1) << np.uint8(3))
    add = topk._Nearest.add
    monkeypatch.setattr(topk._Nearest, "add", lambda self, q, c, d: (seen.append(len(c)), add(self, q, c, d)))
    near = topk.search(10, 64, ids, raw, -1 - np.arange(50), own)
    apart = np.bitwise_count(own[:, None, :] ^ raw[None]).sum(axis=2, dtype=int)
    want = [(q, d, i) for q in range(50) for d, i in sorted(zip(apart[q].tolist(), ids.tolist()))[:10]]
    assert list(zip(near.q.tolist(), near.d.tolist(), near.i.tolist())) == want
    assert sum(seen) < 50 * len(ids) / 4


# URL filters -----------------------------------------------------------------------------------


def split_url(u):
    after = u.split("://", 1)[1] if u and "://" in u else ""
    host = re.split(r"[/?#]", after, maxsplit=1)[0]
    return lower(host), re.split(r"[?#]", after[len(host) :], maxsplit=1)[0]


def brute_rule(host, path):
    fits = [(len(h + p), v, h + p) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


class WittenBell:
    def __init__(self, texts):
        self.n, self.after = Counter(), defaultdict(Counter)
        for t in texts:
            t += urls.END
            for i, c in enumerate(t):
                for k in range(min(urls.ORDER, i + 1)):
                    self.after[t[i - k : i]][c] += 1
        self.seen = set(self.after[""])

    def p(self, context, c):
        """Of c after the context; all characters never seen count as one."""
        shorter = 1 / (len(self.seen) + 1) if not context else self.p(context[1:], c)
        n, t = sum(self.after[context].values()), len(self.after[context])
        return (self.after[context][c] + t * shorter) / (n + t) if t else shorter


def brute_scores(texts, model_texts):
    allow, block = (WittenBell([t for t, v in model_texts if v == side]) for side in ("allow", "block"))

    def score(t):
        t, total = t + urls.END, 0.0
        for i, c in enumerate(t):
            context = t[max(0, i - urls.ORDER + 1) : i]
            total += math.log(allow.p(context, c)) - math.log(block.p(context, c))
        return total / len(t)

    return {t: score(t) for t in texts}


def test_smoothed_probabilities_sum_to_one():
    r = random.Random(8)
    model = WittenBell(["".join(r.choice("abc/.") for _ in range(r.randint(0, 30))) for _ in range(20)])
    for context in ["", "a", "ab", "abc", "zzz", "c/", "...", "a.z"]:
        assert math.isclose(sum(model.p(context, c) for c in [*model.seen, "unseen"]), 1)


def test_url_filter(spark):
    r = random.Random(9)
    made = [f"http{r.choice(['', 's'])}://{r.choice(['a', 'www.b', 'Example', 'c.example'])}.{r.choice(['com', 'net', 'org', 'example.com', 'example.net'])}/{r.choice(['en', 'de', 'es', 'fr'])}/{r.randint(1, 99)}{r.choice(['', '?q=1', '#t'])}" for _ in range(150)]
    odd = [None, "", "no scheme", "x://", "x://H?p/en/", "http://com/en/1", "http://xcom/en/1", "http://a.com", "http://a.b://c/d", made[0], "http://é.net/de/" + "xé" * 3000, "http://h.xx/" + "ab/" * 1000, "data://" + "Qé+/" * 250_000, "e\x03f"]
    df = spark.createDataFrame(list(enumerate(made + odd)), "page_id long, url string").withColumn("verdict", F.lit("clash")).withColumn("rule", F.lit(1))
    df = df.withColumns({c: F.lit(i) for i, c in enumerate(("text", "fit", "page", "ruled", "run", "salt"))})
    found = urls.filter_urls(df)
    assert set(df.columns) <= set(found.columns)
    rows = {x.page_id: x for x in found.collect()}
    assert len(rows) == len(made + odd)
    texts = {u or "" for u in made + odd}
    ruled = {t: brute_rule(*split_url(t)) for t in texts}
    held = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 5 == 0
    scores = brute_scores(texts, [(t, v) for t, (v, _) in ruled.items() if v and not held(t)])
    bins = sorted((max(-1000, min(1000, math.floor(scores[t] * 100))), v) for t, (v, _) in ruled.items() if v and held(t))
    sides = Counter(v for _, v in bins)
    threshold = 0.0
    if len(sides) == 2:
        value = lambda x: sum(b >= x and v == "allow" for b, v in bins) / sides["allow"] + sum(b < x and v == "block" for b, v in bins) / sides["block"]
        best = max(value(b) for b, _ in bins)
        threshold = min(b for b, _ in bins if value(b) == best) / 100
    for i, u in enumerate(made + odd):
        host, path = split_url(u)
        verdict, rule = brute_rule(host, path)
        x = rows[i]
        assert (x.host, x.path, x.rule) == (host, path, rule)
        if verdict is None:
            s = scores[u] if u else 0.0
            assert math.isclose(x.score, s, abs_tol=1e-9)
            assert abs(s - threshold) < 1e-9 or x.verdict == ("allow" if s >= threshold else "block")
        else:
            assert x.verdict == verdict
    assert urls.filter_urls(df.limit(0)).count() == 0


# Tokenizers ------------------------------------------------------------------------------------

STRANGE = [t or "" for t in ODD] + ["\n\n", " a", "a  b\n c", "▁a ▁▁b", "</s> x<s>", "<|endoftext|> it's I'LL ΣΑΣ x<|startoftext|>y", "a\x1cb\x85c\u3000d"]
STRANGE += [chr(i) + "aB" + chr(i) + ". x" + chr(i) for i in range(32, 0x250)]


def test_pieces_match_the_library(spark):
    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    df = frame(spark, [*STRANGE, None]).withColumn("decoded", F.lit(1))
    rows = {x.doc_id: x for x in pieces.encode_and_decode(df, path).collect()}
    for i, t in enumerate([*STRANGE, ""]):
        assert rows[i].ids == sp.encode(t) and rows[i].decoded == sp.decode(sp.encode(t)) if t else rows[i].ids == [] and rows[i].decoded == ""
    assert pieces.encode_and_decode(df.limit(0), path).count() == 0


def test_token_file_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    name = queries.tokenizer_path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(name)
    texts = [*STRANGE, None]
    df = frame(spark, texts).withColumn("codes", F.lit("clash")).repartition(3)
    tokenfile.write_token_file(df.unionByName(df.where("doc_id = 7")), str(tmp_path / "t"), name)
    got = sorted(map(tuple, tokenfile.document_digests(tokenfile.read_token_file(spark, str(tmp_path / "t"))).collect()))
    start, want = 0, []
    for i, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for _ in range(2 if i == 7 else 1):
            want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
    assert got == want
    tokenfile.write_token_file(df.limit(0), str(tmp_path / "e"), name)
    assert tokenfile.document_digests(tokenfile.read_token_file(spark, str(tmp_path / "e"))).count() == 0
    tokenfile.write_token_file(df.where("doc_id < 2").withColumn("doc_id", F.lit(None).cast("long")), str(tmp_path / "n"), name)
    assert [x.doc_id for x in tokenfile.document_digests(tokenfile.read_token_file(spark, str(tmp_path / "n"))).collect()] == [None, None]


def test_token_file_cuts_each_distinct_word_once_and_as_the_library():
    import pyarrow as pa
    from tokenizers import Tokenizer

    tokenizer, r, seen = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json")), random.Random(31), []
    segment = tokenfile.segmenter(tokenizer)
    table = ChunkTable(lambda new: seen.extend(new) or segment(new))
    tokenfile.encode_texts(pa.array(["Word word, WORD$$$", None, "word. 'word'", "\u00c9t\u00e9, \u00e9t\u00e9!"]), table, bytes(4))
    assert sorted(seen) == sorted(["word", ",", "$$$", "", ".", "'word", "'", "\u00e9t\u00e9", "!"])
    some = [*"aAzZ  stTmM''.,,|<>$-09\n\t", "<|endoftext|>", *"\u00e9\u0301\u030cJ\u0338=\u00df\u00ff\u0178\u0130\u03a3\x1c\x1f\x85\xa0\u200b\u2028\ufb01\u0416\u4e2d\x00\u00bd\u00b5\u00aa"]
    for letters in (some, some[:24]):
        texts = ["".join(r.choices(letters, k=r.randint(0, 30))) for _ in range(3000)] + [None, "x" * 400 + ", y"]
        ids, ends = tokenfile.encode_texts(pa.array(texts), table, bytes(4))
        for text, at, to in zip(texts, [0, *ends], ends):
            assert ids[at:to].tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], text
    assert len(ids) == ends[-1] and max(map(len, table.table)) <= 256


def test_any_token_of_a_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "BLOCK_IDS", 50)
    name, r = queries.tokenizer_path("word_bpe_49k.json"), random.Random(12)
    df = frame(spark, ["w" + " x1" * r.randint(0, 60) for _ in range(80)] + [LONG[:4000]]).repartition(3)
    tokenfile.write_token_file(df, str(tmp_path / "t"), name)
    blocks = tokenfile.read_token_file(spark, str(tmp_path / "t"))
    whole = np.concatenate([tokenfile.Block(b.codes).all() for b in sorted(blocks.collect(), key=lambda b: b.start)])
    asked = spark.range(-3, len(whole) + 5).where("id % 3 <> 1")
    got = dict(map(tuple, tokenfile.tokens_at(blocks, asked.union(asked)).collect()))
    assert got == {i: int(t) for i, t in enumerate(whole) if i % 3 != 1}
    assert tokenfile.tokens_at(blocks, asked.limit(0)).count() == 0


def test_codes_give_random_access():
    r = np.random.RandomState(10)
    for most in (200, 60_000, 2**32 - 1):
        ids = r.randint(0, most, 3000, dtype=np.int64).astype(np.uint32)
        block = tokenfile.Block(tokenfile.pack(ids))
        assert (block.all() == ids).all() and len(block) == len(ids)
        assert [block.token(i) for i in range(0, 3000, 13)] == ids[::13].tolist()
        for _ in range(100):
            i = r.randint(0, 3001)
            n = r.randint(0, 3001 - i)
            assert (block.run(i, n) == ids[i : i + n]).all()
    assert len(tokenfile.Block(tokenfile.pack(np.zeros(0, np.uint32)))) == 0


def test_head_table_holds_the_frequent_words(spark, monkeypatch):
    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    with open(path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())
    df = frame(spark, ["often often\noften rare", "often seldom seldom", None, "y" * 100])
    made = pieces.head_table(df, model)
    assert {w: np.frombuffer(ids, "<i4").tolist() for w, ids in made.items()} == {f" {w}": sp.encode(w) for w in ("often", "rare", "seldom")}
    monkeypatch.setattr(pieces, "HEAD_ENTRIES", 1)
    assert set(pieces.head_table(df, model)) == {" often"}
    assert pieces.head_table(df.limit(0), model) == {}
    rows = pieces.encode_and_decode(df.union(df), path).collect()
    assert all(x.ids == sp.encode(x.text or "") for x in rows) and len(rows) == 8


def test_chunk_table_starts_anew(monkeypatch):
    monkeypatch.setattr("tagquarry.llm.chunks.MAX_ENTRIES", 3)
    monkeypatch.setattr("tagquarry.llm.chunks.MAX_CHARS", 4)
    t = ChunkTable(lambda new: [c.encode() for c in new], {"b": b"B"})
    texts = [[c, c + "x", c * 9] for c in "abcab"]
    assert [t.encode([x]) for x in texts] == [["".join(x).replace("b", "B", c == "b").encode()] for c, x in zip("abcab", texts)]
    assert len(t.table) <= 4 + 3


# Toxicity --------------------------------------------------------------------------------------


def brute_path(parts, kinds, weights):
    """The best sum over all ways through the transducers, one after another over the whole string."""
    strings = [(tuple(kinds), (1.0,) * len(kinds))]
    for part in parts:
        after = {}
        for symbols, factors in strings:
            ways = [(part.start, (), ())]
            for x, f in zip(symbols, factors):
                ways = [(to, (*out, y), (*fs, f * g)) for at, out, fs in ways for to, y, g in part.step(at, x)]
            for at, out, fs in ways:
                if part.final(at):
                    after[out, fs] = None
        strings = list(after)
    return max((sum(w * f for w, f in zip(weights, fs)) for _, fs in strings), default=0.0)


def brute_features(lexicon, text):
    def insult(w):
        return lexicon.get(w) or max((lexicon.get(w[:n] + "*", 0.0) for n in toxicity.STEMS if len(w) >= n), default=0.0)

    parts, found = toxicity.clause_parts(), []
    for clause in re.split(r"[.!?;:\n]+", (text or "").lower()):
        words = toxicity.WORD.findall(clause)
        kinds = [next((n for n, c in toxicity.CLASSES if w in c), "insult" if insult(w) else "word") for w in words]
        weights = [insult(w) if k == "insult" else toxicity.THREAT_WEIGHT if k == "threat" else 0.0 for w, k in zip(words, kinds)]
        if not any(weights):
            continue
        best = brute_path(parts, kinds, weights)
        alone = brute_path(parts[:2], kinds, [w if k == "insult" else 0.0 for w, k in zip(weights, kinds)])
        if best or alone:
            found.append((best, alone))
    counted = [best or (alone * toxicity.LOOSE_FACTOR if len(found) > 1 else 0.0) for best, alone in found]
    counted = [w for w in counted if w]
    return max(counted, default=0.0), math.log1p(sum(counted)), math.log1p(len(counted))


def test_composition_finds_the_best_of_all_paths():
    r = random.Random(31)
    parts, composed = toxicity.clause_parts(), toxicity.Grammar({}).composed
    kinds = ["word", "insult", "insult", "negation", "report", "target", "agent", "threat", "threat"]
    for _ in range(1500):
        k = [r.choice(kinds) for _ in range(r.randint(1, 7))]
        w = [float(r.randint(1, 9)) if x in ("insult", "threat") else 0.0 for x in k]
        assert math.isclose(sum(toxicity.best_path(composed, k, w)), brute_path(parts, k, w), abs_tol=1e-12)


def test_grammar_reads_clauses():
    g = toxicity.Grammar({"idiot": 4.0, "lowe*": 6.0})
    weight = lambda t: g.features(t)[0]
    assert weight("a fine day") == 0 and weight(None) == 0 and weight("") == 0
    assert weight("idiot") == weight("the idiot spoke") == weight("not an idiot") == 0  # isolated words
    assert weight("you idiot") == weight("idiot, you") == weight("idiot a b you") == 6.0
    assert weight("idiot a b c you") == 0 and weight("you are no idiot") == 1.5
    assert weight("that old idiot, clever idiot") == 4.0 * 1.5 + 4.0
    assert math.isclose(weight("somebody said: so. reported by some clever old idiot, that idiot"), (4.0 * 1.5 + 4.0 * 1.5) * 0.4)
    assert weight("kill the process") == weight("I will kill processes") == 0
    assert weight("they kill you") == 6.0 and weight("I will kill you") == 9.0
    assert weight("Loweischaft, du") == 9.0 and weight("low, you") == 0
    assert g.features("the idiot. an idiot") == (2.0, math.log1p(4), math.log1p(2))
    assert g.features("the idiot. you idiot") == (6.0, math.log1p(8), math.log1p(2))
    r = random.Random(32)
    bag = "you i will not said kill idiot lowerer a b c . \n said is".split(" ")
    for _ in range(300):
        text = " ".join(r.choice(bag) for _ in range(r.randint(0, 14)))
        assert np.allclose(g.features(text), brute_features(g.lexicon, text)), text


def test_toxicity_against_brute_force(spark):
    """Lexicon by plain counting, features over all paths, weights by gradient descent's optimum."""
    where = "/root/testdata/sf0.001"
    docs, labels = queries.table(spark, where, "documents"), queries.table(spark, where, "labels")
    rows = [(x.text, x.toxic) for x in toxicity.training_rows(docs, labels).collect()]
    n, pos, whole = Counter(), Counter(), sum(t for _, t in rows)
    for text, toxic in rows:
        words = set(toxicity.WORD.findall((text or "").lower()))
        for f in words | {w[:k] + "*" for w in words for k in toxicity.STEMS if len(w) >= k}:
            n[f] += 1
            pos[f] += toxic
    n = {f: c for f, c in n.items() if c >= 3}
    want, base = {w: v for w, v in toxicity.SEEDS.items() if w not in n}, whole / len(rows)
    for f, c in n.items():
        share = pos[f] / c
        bits = sum(x * math.log(x / y) for x, y in ((share, base), (1 - share, 1 - base)) if x)
        if share >= 0.8 and c * bits > math.log(len(n) / toxicity.CHANCE):
            want[f] = math.log((pos[f] + 0.1) / (whole + 0.2)) - math.log((c - pos[f] + 0.1) / (len(rows) - whole + 0.2))
    lexicon, weights = toxicity.learn(docs, labels)
    assert lexicon.keys() == want.keys() and all(math.isclose(lexicon[f], want[f]) for f in want)
    x = np.array([[1, *brute_features(want, t)] for t, _ in rows])
    y = np.array([t for _, t in rows], float)
    w, penalty = np.array(weights), 0.05 * np.array([0.01, 1, 1, 1])
    slope = x.T @ (1 / (1 + np.exp(-x @ w)) - y) + penalty * w
    assert np.abs(slope).max() < 1e-6  # the only minimum of a convex loss
    for r in queries.op9_toxicity(spark, where).join(docs.select("doc_id", "text"), "doc_id").collect():
        score = 1 / (1 + math.exp(-(weights[0] + np.dot(weights[1:], brute_features(want, r.text)))))
        assert math.isclose(r.score, score, abs_tol=1e-9) and r.predicted == (score >= 0.5)


def test_toxicity_of_odd_rows(spark):
    docs = frame(spark, [*ODD, "you idiot " * 3, "x" * 300_000]).withColumn("predicted", F.lit("clash"))
    docs = docs.unionByName(docs).unionByName(docs.withColumn("doc_id", F.lit(None).cast("long")))
    score = toxicity.scorer(spark, (toxicity.SEEDS, toxicity.DEFAULT))
    rows = docs.withColumn("score", score("text")).collect()
    assert len(rows) == 3 * (len(ODD) + 2) and all(0 <= x.score <= 1 and x.predicted == "clash" for x in rows)
    assert len({(x.text, x.score) for x in rows}) == len({x.text for x in rows})


def test_toxicity_learns_and_holds_out(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    labels = queries.table(spark, "/root/testdata/sf0.01", "labels")
    out = {r.doc_id: r for r in queries.op9_toxicity(spark, "/root/testdata/sf0.01").collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in out.items())
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [d for d in truth if out[d].held_out]
    assert sum(out[d].predicted == truth[d] for d in held) >= 0.9 * len(held)
    # labels of held-out rows do not matter
    turned = labels.withColumn("toxic", F.expr("CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 1 - toxic ELSE toxic END"))
    assert toxicity.learn(docs, turned) == toxicity.learn(docs, labels)
    odd = frame(spark, ODD)
    lexicon, weights = toxicity.learn(odd.limit(0), labels.limit(0))
    assert lexicon == toxicity.SEEDS and weights == toxicity.DEFAULT
    assert all(0 <= r.s <= 1 for r in odd.select(toxicity.scorer(spark, (lexicon, weights))("text").alias("s")).collect())


# Mixing ----------------------------------------------------------------------------------------


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    total, open_, target = float(sum(sizes.values())), set(order), {}
    while True:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 3 * sizes[s]}
        if not over:
            return target | share
        target |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over
        if not open_:
            return target


def test_mixing(spark):
    r = random.Random(11)
    sources = [r.choice(["a", "b", "c", None, "é", "z"]) for _ in range(900)]
    sources[:3] = ["tiny", "tiny2", "none"]
    texts = ["one two", "x", "", *(" ".join("w" * r.randint(0, 80)) for _ in range(897))]
    df = frame(spark, texts, sources).withColumn("target", F.lit("clash"))
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    sizes = defaultdict(int)
    for s, t in zip(sources, texts):
        sizes[s] += size(t)
    want = brute_targets(sizes)
    rows = mixing.mix_sources(df).collect()
    assert sorted(x.doc_id for x in rows) == list(range(900))
    taken = defaultdict(int)
    for x in rows:
        s = sources[x.doc_id]
        assert x.size == size(texts[x.doc_id]) and x.source_size == sizes[s] and math.isclose(x.target, want[s], rel_tol=1e-9)
        assert x.taken == x.times * x.size and x.times <= 3
        taken[s] += x.taken
    for s in ("a", "b", "c", None, "é", "z"):
        assert abs(taken[s] - want[s]) < 3
    again = mixing.mix_sources(df.repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    assert mixing.mix_sources(df.limit(0)).count() == 0
    odd = mixing.mix_sources(frame(spark, ODD).unionByName(frame(spark, ODD)))
    assert odd.count() == 2 * len(ODD)


def test_flight_keeps_both_totals():
    r = np.random.RandomState(12)
    p, size = r.random_sample(200), r.randint(0, 500, 200).astype(float)
    q = mixing.flight(p, size, r)
    assert ((q > 0) & (q < 1)).sum() <= 2
    assert math.isclose(q.sum(), p.sum(), abs_tol=1e-6) and math.isclose((q * size).sum(), (p * size).sum(), abs_tol=1e-3)

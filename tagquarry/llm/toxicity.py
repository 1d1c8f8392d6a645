"""Toxicity by a weighted finite-state pattern grammar.

A clause is read as a string of word classes by five weighted transducers in composition: negation and
reported speech weaken what stands in their scopes, target marks insults and threats next to a person
addressed (on either side), insult passes a marked insult, or plain ones if the clause has further evidence
(a second insult, or something aimed), and threat passes harm words that are aimed, more so after an agent
("I will ..."). The clause's weight is that of the best path. A lone insult that nothing
else in its clause supports scores nothing there; a sixth transducer over the clauses of the text counts such
loose clauses, at a lower weight, only where the text has another loose or a matched one. A document's
score is a logistic function of its strongest clause, of the sum over its clauses and of their number.

The insult lexicon is learned: words and word stems whose share of toxic training documents is
significantly high. Counting runs in Spark over a sample of at most MAX_LABELLED labelled documents,
which bounds the lexicon too; the logistic weights are fitted on those documents' features.

Defined cases: a null or empty text has no clause and the score of one; a null doc_id is scored but
never trains; repeated labels of a document train as its largest; labels of absent documents are
ignored; repeated rows score alike; without labels the seed lexicon and default weights hold; whole texts
of any length and words of any length are read; other columns are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches
from .shingles import batch_sets, mix

#: Most labelled documents that the lexicon and the logistic weights are learned from.
MAX_LABELLED = 12_000
STEMS = (4, 5, 6)
#: Expected number of lexicon entries that are there by chance.
CHANCE = 0.02

# Fixed values of the grammar: word classes, scopes in words, and factors.
SEEDS = {w: 3.0 for w in "idiot moron stupid loser scum pathetic worthless disgusting".split()}
THREATS = set("kill hurt destroy punch murder stab shoot strangle beat burn töten schlagen tuer frapper matar golpear".split())
TARGETS = set("you your yours u he she they him her them his their this that these those du ihr dich euch dein er sie vous tu toi te il elle ils usted tú él ella ellos".split())
NEGATIONS = set("not no never nobody none without cannot isn't aren't wasn't don't nicht kein keine nie ne pas jamais nunca jamás".split())
REPORTS = set("said says say wrote quoted quote quotes called claims claimed reported reportedly alleged alleges according sagte schrieb dit écrit dijo escribió".split())
AGENTS = set("i we i'll we'll i'm will shall gonna going ich wir werde werden je nous vais allons yo voy vamos nosotros".split())
THREAT_WEIGHT, TARGET_FACTOR, AGENT_FACTOR, NEGATION_FACTOR, REPORT_FACTOR, LOOSE_FACTOR = 4.0, 1.5, 1.5, 0.25, 0.4, 0.5
NEGATION_SCOPE, TARGET_SCOPE, AGENT_SCOPE = 4, 3, 4

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
CLAUSE = re.compile(r"[.!?;:\n]+")
DEFAULT = [-4.0, 0.8, 0.1, 0.5]


CLASSES = (("negation", NEGATIONS), ("report", REPORTS), ("target", TARGETS), ("agent", AGENTS), ("threat", THREATS))
SYMBOLS = ("word", "insult", "negation", "report", "target", "agent", "threat", "aimed insult", "aimed threat", "hit")


class Transducer:
    """A weighted transducer from state 0: arcs (state, symbol) -> [(state, output symbol, factor)].

    A symbol without arcs stays as it is, and so does the state. A path ends well in a state of `final`.
    """

    def __init__(self, arcs: dict, final):
        self.start, self.arcs, self.final = 0, arcs, final.__contains__

    def step(self, state, symbol: str):
        return self.arcs.get((state, symbol)) or [(state, symbol, 1.0)]


class Composition:
    """first, and then second on its output: pairs of states, factors multiplied. Arcs are made when first met."""

    def __init__(self, first, second):
        self.first, self.second, self.start, self.known = first, second, (first.start, second.start), {}

    def step(self, state, symbol: str):
        found = self.known.get((state, symbol))
        if found is None:
            a, b = state
            found = [
                ((to_a, to_b), out, f * g)
                for to_a, middle, f in self.first.step(a, symbol)
                for to_b, out, g in self.second.step(b, middle)
            ]
            self.known[state, symbol] = found
        return found

    def final(self, state) -> bool:
        return self.first.final(state[0]) and self.second.final(state[1])


def best_path(machine, symbols: list[str], weights: list[float]) -> list[float]:
    """The weights times the factors along the path with the largest sum; all 0 if no path ends well."""
    paths = {machine.start: (0.0, None)}
    for symbol, weight in zip(symbols, weights):
        after: dict = {}
        for state, path in paths.items():
            for to, _, factor in machine.step(state, symbol):
                total = path[0] + weight * factor
                if to not in after or total > after[to][0]:
                    after[to] = (total, (path, weight * factor))
        paths = after
    ended = [path for state, path in paths.items() if machine.final(state)]
    if not ended:
        return [0.0] * len(symbols)
    _, back = max(ended, key=lambda p: p[0])
    out = []
    while back is not None:
        out.append(back[1])
        back = back[0][1]
    return out[::-1]


def scope(opens: str, length: int, factor: float, symbols=("insult", "threat")) -> Transducer:
    """Weakens insults and threats among the `length` words after a word of class `opens`."""
    arcs: dict = {}
    for left in range(length + 1):
        for x in SYMBOLS:
            arcs[left, x] = [(max(0, left - 1), x, factor if left and x in symbols else 1.0)]
        arcs[left, opens] = [(length, opens, 1.0)]
    return Transducer(arcs, range(length + 1))


def reported() -> Transducer:
    """Weakens insults and threats from a word of speech to the end of the clause."""
    arcs: dict = {(0, "report"): [(1, "report", 1.0)]}
    for x in ("insult", "threat"):
        arcs[1, x] = [(1, x, REPORT_FACTOR)]
    return Transducer(arcs, (0, 1))


def target(length: int = TARGET_SCOPE) -> Transducer:
    """Marks insults and threats at most `length` words after a target, or as many before one.

    State (0, left): so many words may still be marked; state (owed, 0): a target must come within so
    many words. State 0 is (0, 0).
    """
    arcs: dict = {}
    name = lambda owed, left: (owed, left) if owed or left else 0
    for owed in range(length + 1):
        for left in range(length + 1):
            if owed and left:
                continue
            state, later = name(owed, left), name(0, max(0, left - 1))
            for x in SYMBOLS:
                to = [] if owed == 1 else [(name(owed - 1, 0) if owed else later, x, 1.0)]
                if x in ("insult", "threat"):
                    if left:
                        to = [(later, "aimed " + x, TARGET_FACTOR)]
                    elif owed != 1:
                        to.append((name(owed - 1 if owed else length, 0), "aimed " + x, TARGET_FACTOR))
                arcs[state, x] = to or [("lost", x, 0.0)]
            arcs[state, "target"] = [(name(0, length), "target", 1.0)]
    final = {name(0, left) for left in range(length + 1)}
    return Transducer(arcs, final)


def supported(open_: str, paid: tuple[str, ...], factor: float = 1.0) -> Transducer:
    """Passes `paid` symbols, and `open_` ones only if there is another of either; else they weigh nothing.

    States: 0 nothing yet, 1 one `open_` that still wants support, 2 supported.
    """
    arcs: dict = {(0, open_): [(1, "hit", factor), (0, "word", 0.0)]}
    for state in (1, 2):
        arcs[state, open_] = [(2, "hit", factor)]
    for state in (0, 1, 2):
        for x in paid:
            arcs[state, x] = [(2, x if x.endswith("threat") else "hit", 1.0)]
    return Transducer(arcs, (0, 2))


def threat(length: int = AGENT_SCOPE) -> Transducer:
    """Passes aimed threats, more heavily within `length` words after an agent; others weigh nothing."""
    arcs: dict = {}
    for left in range(length + 1):
        for x in SYMBOLS:
            arcs[left, x] = [(max(0, left - 1), x, 1.0)]
        arcs[left, "agent"] = [(length, "agent", 1.0)]
        arcs[left, "threat"] = [(max(0, left - 1), "word", 0.0)]
        arcs[left, "aimed threat"] = [(max(0, left - 1), "hit", AGENT_FACTOR if left else 1.0)]
    return Transducer(arcs, range(length + 1))


def clause_parts() -> list[Transducer]:
    """The transducers of a clause, in the order of their composition."""
    insult = supported("insult", ("aimed insult", "aimed threat"))
    return [scope("negation", NEGATION_SCOPE, NEGATION_FACTOR), reported(), target(), insult, threat()]


class Grammar:
    """The composed transducers over a lexicon of insult weights (whole words and stems "abcd*")."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.known = lexicon, {}
        parts = clause_parts()
        self.weak = Composition(parts[0], parts[1])
        self.composed = self.weak
        for part in parts[2:]:
            self.composed = Composition(self.composed, part)
        self.text = supported("loose", ("matched",), LOOSE_FACTOR)

    def insult(self, word: str) -> float:
        """The weight of a lower-case word."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 50_000:
                self.known.clear()
            lex = self.lexicon
            found = lex.get(word) or max((lex.get(word[:n] + "*", 0.0) for n in STEMS if len(word) >= n), default=0.0)
            if len(word) < 40:
                self.known[word] = found
        return found

    def kind(self, word: str) -> str:
        for name, words in CLASSES:
            if word in words:
                return name
        return "insult" if self.insult(word) else "word"

    def clause(self, words: list[str]) -> tuple[str, float]:
        """("matched", weight of the best path), ("loose", weight of its insults) or ("plain", 0)."""
        kinds = [self.kind(w) for w in words]
        if "insult" not in kinds and not ("threat" in kinds and "target" in kinds):
            return "plain", 0.0
        weights = [self.insult(w) if k == "insult" else THREAT_WEIGHT if k == "threat" else 0.0 for w, k in zip(words, kinds)]
        total = sum(best_path(self.composed, kinds, weights))
        if total > 0:
            return "matched", total
        loose = sum(x for x, k in zip(best_path(self.weak, kinds, weights), kinds) if k == "insult")
        return ("loose", loose) if loose > 0 else ("plain", 0.0)

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Strongest clause, log of the sum over clauses, and log of the number of clauses that count."""
        low = (text or "").lower()
        words = set(WORD.findall(low))
        if THREATS.isdisjoint(words) and not any(map(self.insult, words)):
            return 0.0, 0.0, 0.0
        found = [x for c in CLAUSE.split(low) if c and (x := self.clause(WORD.findall(c)))[1] > 0]
        weights = [w for w in best_path(self.text, [k for k, _ in found], [w for _, w in found]) if w > 0]
        return max(weights, default=0.0), math.log1p(sum(weights)), math.log1p(len(weights))


def _counts(batches):
    seen: dict = {}
    for b in batches:
        for text, toxic in zip(b["text"], b["toxic"]):
            words = set(WORD.findall((text or "").lower()))
            for f in words | {w[:n] + "*" for w in words for n in STEMS if len(w) >= n}:
                c = seen.setdefault(f, [0, 0])
                c[0] += 1
                c[1] += toxic
            if len(seen) > 150_000:
                yield pd.DataFrame([(k, *v) for k, v in seen.items()], columns=["feature", "n", "pos"])
                seen = {}
    yield pd.DataFrame([(k, *v) for k, v in seen.items()], columns=["feature", "n", "pos"])


def training_rows(documents: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """(text, toxic) of at most about `most` labelled documents whose crc32(doc_id) mod 5 is not 0."""
    own = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL AND crc32(CAST(doc_id AS STRING)) % 5 <> 0")
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, most / max(1, own.count()))
    own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    # The sample is bounded by `most`, whatever the size of the tables.
    rows = documents.select("doc_id", "text").join(F.broadcast(own), "doc_id")
    return rows.join(F.broadcast(distinct_rows(rows)), "doc_id").select("text", "toxic")


def _signatures(batches):
    for batch in batches:
        rows = []
        for s in batch_sets(batch.column(1)):
            rows.append([int(mix(s ^ np.uint64(i)).view(np.int64).min()) if len(s) else i for i in range(1, 5)])
        m = np.array(rows, np.int64).reshape(-1, 4)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(m[:, i]) for i in range(4))], names=["doc_id", "m0", "m1", "m2", "m3"])


def distinct_rows(rows: DataFrame) -> DataFrame:
    """(doc_id): one of each group that shares a min-hash of its shingles.

    Else the words of a document with many copies would look like a sign of its label. rows is the
    bounded sample, so that its signatures fit the driver.
    """
    signed = rows.mapInArrow(_signatures, "doc_id long, m0 long, m1 long, m2 long, m3 long").toPandas().sort_values("doc_id")
    for m in ("m0", "m1", "m2", "m3"):
        signed = signed.drop_duplicates(m)
    ids = [(int(i),) for i in signed["doc_id"].drop_duplicates()]
    return rows.sparkSession.createDataFrame(ids, "doc_id long")


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Words and stems of a significantly high toxic share, weighted by log odds."""
    whole = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("pos")).first()
    if not 0 < whole.pos < whole.n:
        return dict(SEEDS)
    counts = (
        rows.mapInPandas(_counts, "feature string, n long, pos long")
        .groupBy("feature")
        .agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
        .where("n >= 3")
        .cache()
    )
    base, features = whole.pos / whole.n, counts.count()
    share = F.col("pos") / F.col("n")
    log = lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(0.0)
    # n * KL(share || base) bounds the log probability of so high a share by chance.
    surprise = F.col("n") * (log(share, F.lit(base)) + log(1 - share, F.lit(1 - base)))
    weight = F.log((F.col("pos") + 0.1) / (whole.pos + 0.2)) - F.log((F.col("n") - F.col("pos") + 0.1) / (whole.n - whole.pos + 0.2))
    found = (
        counts.where((share >= 0.8) & (surprise > math.log(max(features, 1) / CHANCE)))
        .select("feature", weight.alias("w"))
        .collect()  # words of the bounded sample
    )
    judged = {r.feature for r in counts.where(F.col("feature").isin(*SEEDS)).collect()}
    counts.unpersist()
    return {w: v for w, v in SEEDS.items() if w not in judged} | {r.feature: float(r.w) for r in found}


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 40, ridge: float = 0.05) -> list[float]:
    """Ridge-penalised logistic weights (intercept first) by Newton steps."""
    if not 0 < y.sum() < len(y):
        return DEFAULT
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), ridge * np.r_[0.01, np.ones(x.shape[1] - 1)]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty) + 1e-9 * np.eye(len(w))
        w = w - np.linalg.solve(hess, grad)
    return [float(v) for v in w]


def learn(documents: DataFrame, labels: DataFrame) -> tuple[dict[str, float], list[float]]:
    """(lexicon, logistic weights), both from the bounded sample of labelled rows."""
    bound_batches(documents.sparkSession)
    rows = training_rows(documents, labels).cache()
    lexicon = learn_lexicon(rows)

    def features(batches):
        grammar = Grammar(lexicon)
        for b in batches:
            out = pd.DataFrame([grammar.features(t) for t in b["text"]], columns=["a", "b", "c"], dtype=float)
            yield out.assign(toxic=b["toxic"].to_numpy())

    # One row of three numbers and a count per distinct feature value of the bounded sample.
    made = rows.mapInPandas(features, "a double, b double, c double, toxic int")
    made = made.toPandas().sort_values(["a", "b", "c", "toxic"])
    rows.unpersist()
    weights = fit_logistic(made[["a", "b", "c"]].to_numpy(float), made["toxic"].to_numpy(float))
    return lexicon, weights


def scorer(spark, model: tuple[dict[str, float], list[float]]):
    """A column function: the score of a text, 0 to 1."""
    shared = spark.sparkContext.broadcast(model)
    grammars: dict = {}

    @F.pandas_udf("double")
    def toxic(texts: pd.Series) -> pd.Series:
        lexicon, w = shared.value
        grammar = grammars.setdefault(0, Grammar(lexicon))
        x = np.array([grammar.features(t) for t in texts]).reshape(-1, 3)
        return pd.Series(1 / (1 + np.exp(-np.clip(w[0] + x @ np.array(w[1:]), -30, 30))))

    return toxic

"""Secret scans: fixed patterns, and windows of high Shannon entropy.

A candidate is a maximal run of one character class that is at least a window long. A window slides over it;
each step adds one count and takes one away, and with them two entries of a table of c * log2(c), so that
the entropy costs the same at any window length. The table holds whole millionths of a bit: sums neither
drift nor depend on their order. Windows over the class's threshold that mix its kinds of characters are
merged to spans, unless the candidate is on the allow-list. Spans of the fixed patterns always stay.

One pass over the texts; nothing is shuffled, and each text is scanned in time linear in its length.

Defined cases: a null or empty text has no spans; a null doc_id is a document like any other; repeated rows
are scanned each; entropy spans that lie inside one span of a fixed pattern are left out; an empty table gives
an empty result; other columns pass through, but for one named spans, which is replaced.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

# The patterns of the three kinds, and what their matches need.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST_ASSIGNED, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

KINDS = ("assign", "access", "hex", "entropy")
SPANS = "array<struct<kind:string,start:int,end:int>>"


class CharacterClass(NamedTuple):
    """Runs of `chars`; a window of `window` characters counts from `bits` of entropy on and with one of each of `mixes`."""

    chars: str
    window: int
    bits: float
    mixes: tuple[str, ...]


CLASSES = (
    CharacterClass("0-9A-Fa-f", 20, 3.0, ("0-9", "A-Fa-f")),
    CharacterClass("0-9A-Z", 20, 3.4, ("0-9", "A-Z")),
    CharacterClass("0-9A-Za-z+/_=-", 20, 3.7, ("0-9", "A-Z", "a-z")),
)
#: Candidates that hold a placeholder or a counting row, or are made of whole words and short numbers.
ALLOW_LIST = (
    r"[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Ss][Aa][Mm][Pp][Ll][Ee]|[Dd][Uu][Mm][Mm][Yy]|[Cc][Hh][Aa][Nn][Gg][Ee]_?[Mm][Ee]|[Rr][Ee][Dd][Aa][Cc][Tt][Ee][Dd]",
    r"0123456789|1234567890|[Aa][Bb][Cc][Dd][Ee][Ff][Gg]",
    r"^(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,8})(?:[+/_=-]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,8}))*[+/_=-]*$",
)

MILLIONTHS = 1_000_000


def weight(c: int) -> int:
    """c * log2(c) in millionths of a bit."""
    return round(c * math.log2(c) * MILLIONTHS) if c else 0


def most_weight(window: int, bits: float) -> int:
    """The largest sum of weights of a window's counts at which its entropy is still `bits`."""
    return math.floor((window * math.log2(window) - window * bits) * MILLIONTHS)


class EntropyScanner:
    """Finds the spans of one character class."""

    def __init__(self, kind: CharacterClass):
        self.window, self.most = kind.window, most_weight(kind.window, kind.bits)
        self.run = re.compile(f"[{kind.chars}]{{{kind.window},}}")
        mixes = [re.compile(f"[{m}]") for m in kind.mixes]
        self.group = {chr(i): [k for k, m in enumerate(mixes) if m.match(chr(i))] for i in range(128)}
        self.groups = len(mixes)
        table = [weight(c) for c in range(self.window + 2)]
        self.up = [table[c + 1] - table[c] for c in range(self.window + 1)]

    def windows(self, text: str):
        """The starts of the windows that count."""
        counts, mixed, total, up, w = dict.fromkeys(text, 0), [0] * self.groups, 0, self.up, self.window
        for i, new in enumerate(text):
            total += up[counts[new]]
            counts[new] += 1
            for k in self.group[new]:
                mixed[k] += 1
            if i >= w:
                old = text[i - w]
                counts[old] -= 1
                total -= up[counts[old]]
                for k in self.group[old]:
                    mixed[k] -= 1
            if i >= w - 1 and total <= self.most and all(mixed):
                yield i - w + 1

    def spans(self, text: str, allowed: list[re.Pattern]) -> list[tuple[int, int]]:
        out = []
        for run in self.run.finditer(text):
            if any(a.search(run[0]) for a in allowed):
                continue
            for at in self.windows(run[0]):
                start = run.start() + at
                if out and start <= out[-1][1]:
                    out[-1] = (out[-1][0], start + self.window)
                else:
                    out.append((start, start + self.window))
        return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that touch joined."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


class SecretScanner:
    """text -> its spans as (start, place of the kind in KINDS, end), in order."""

    def __init__(self, classes=CLASSES, allow_list=ALLOW_LIST):
        self.scanners = [EntropyScanner(c) for c in classes]
        self.allowed = [re.compile(a) for a in allow_list]
        self.assign, self.access, self.hex = (re.compile(p) for p in (ASSIGN, ACCESS, HEX))
        # Whatever else counts lies in a run of this kind, so that one search finds the places to look at.
        self.any_run = re.compile(f"[0-9A-Za-z+/_=-]{{{min(LEAST_ACCESS, LEAST_HEX, *(c.window for c in classes))},}}")

    def __call__(self, text: str | None) -> list[tuple[int, int, int]]:
        if not text:
            return []
        base = [(m.start(), 0, m.end()) for m in self.assign.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
        found = []
        for run in self.any_run.finditer(text):
            at, part = run.start(), run[0]
            for k, pattern, least in ((1, self.access, LEAST_ACCESS), (2, self.hex, LEAST_HEX)):
                base += [(at + m.start(), k, at + m.end()) for m in pattern.finditer(part) if len(m[0]) >= least]
            found += [(at + a, at + b) for s in self.scanners for a, b in s.spans(part, self.allowed)]
        added = [(a, 3, b) for a, b in merged(found) if not any(s <= a and b <= e for s, _, e in base)]
        return sorted(base + added)


def find_secrets(documents: DataFrame, text: str = "text", classes=CLASSES, allow_list=ALLOW_LIST) -> DataFrame:
    """documents with spans: array of (kind, start, end) in code points, end exclusive, by start, then kind as in KINDS."""
    bound_batches(documents.sparkSession)

    @F.pandas_udf(SPANS)
    def scan(texts: pd.Series) -> pd.Series:
        scanner = SecretScanner(classes, allow_list)
        return pd.Series([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in scanner(t)] for t in texts])

    return documents.withColumn("spans", scan(F.col(f"`{text}`")))


def span_list(spans, kinds=KINDS) -> Column:
    """kind:start:end of the spans of these kinds, comma-joined."""
    own = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(documents: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """documents with spans, and every span of the text replaced by the mark; spans that touch become one."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, own in zip(texts, spans, strict=True):
            for a, b in reversed(merged([(s["start"], s["end"]) for s in own])):
                t = t[:a] + mark + t[b:]
            out.append(t)
        return pd.Series(out, dtype=object)

    return find_secrets(documents, text).withColumn(text, cut(F.col(f"`{text}`"), F.col("spans")))

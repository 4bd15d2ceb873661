"""Personal data by weak supervision.

Candidates are the matches of four exact patterns (the base: email, ip, card, phone), which always stay, and of broader
patterns for secrets, written-out addresses and numbers of other shape. Labelers vote on each candidate: patterns of known
formats, gazetteers of telling words, and the context on either side. Votes are counted by pattern over all rows in Spark;
expectation-maximisation over those counts (as many as there are distinct vote patterns, at most ``2 ** 14`` for each
kind) estimates how reliable each labeler is and how likely each pattern is personal data. A logistic classifier over votes
and shape features, trained on those estimates, decides the spans that the method adds.

Each text is read once: candidates, a small table, are kept in the shared folder between the passes.

Defined results: null and empty texts have no spans; repeated rows give repeated results; places are code points; a
candidate that overlaps a base span, or one before it, adds nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.cluster import ddl, map_text, stored

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "contact", "number")
KINDS = BASE + ADDED

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: No start inside a run of digits: the run's other starts end at the same place.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_BROAD = {
    # A long run with letters and digits; a value after a telling word.
    "secret": re.compile(r"(?<![A-Za-z0-9_/+=.@-])(?=[A-Za-z_/+=-]*[0-9])(?=[0-9_/+=-]*[A-Za-z])[A-Za-z0-9_/+=-]{12,}+(?![.@A-Za-z0-9])"),
    "contact": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+\s?(?:\(at\)|\[at\]|\{at\})\s?[A-Za-z0-9-]+(?:\s?(?:\(dot\)|\[dot\]|\{dot\}|\.)\s?[A-Za-z0-9-]+)+"),
    "number": re.compile(r"(?<![\w+.-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4})(?![\w-])"),
}
# Words before a value that tell what it is.
TELLING = {
    "email": "email e-mail mail contact write".split(),
    "ip": "ip host address server client".split(),
    "card": "card visa mastercard payment credit".split(),
    "phone": "phone tel telephone call mobile fax".split(),
    "secret": "password passwd pwd secret token key apikey api_key access auth bearer credential".split(),
    "contact": "email e-mail mail contact write".split(),
    "number": "ssn social phone tel telephone call mobile fax".split(),
}
_PREFIX = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}$|gh[pousr]_[A-Za-z0-9]{30,}$|sk[-_](?:live|test)?[-_A-Za-z0-9]{16,}$|xox[abp]-|eyJ[A-Za-z0-9_-]{10,}")
_HEX = re.compile(r"[0-9a-f]{16,}$|[0-9A-F]{16,}$")
_WORD = re.compile(r"[A-Za-z_-]+")
#: Votes, one bit each: known format, telling word close before, sign of assignment before, quoted, set apart by blanks, mixed characters.
VOTES = 6
#: Shape features, one bit each, for the classifier beside the votes.
SHAPES = 4


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in BASE, end) of the base's matches, in order."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if 12 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def described(text: str, start: int, end: int, kind: str) -> tuple[int, int]:
    """The labelers' votes on a span, and its shape features."""
    span, before = text[start:end], text[max(0, start - 40) : start]
    near = [w.lower().strip("-_") for w in _WORD.findall(before)][-3:]
    joint = before.rstrip(" \"'")
    votes = [
        bool(_PREFIX.match(span) or _HEX.match(span)) if kind == "secret" else True,
        any(t in w for w in near for t in TELLING[kind]),
        joint[-1:] in ("=", ":") and len(joint) > 0,
        before[-1:] in ("'", '"') and text[end : end + 1] in ("'", '"'),
        (not before or before[-1].isspace()) and (end >= len(text) or text[end].isspace() or text[end] in ".,;"),
        sum(any(f(c) for c in span) for f in (str.isdigit, str.islower, str.isupper)) >= 2 and sum(c.isdigit() for c in span) >= 3,
    ]
    digits = sum(c.isdigit() for c in span)
    shapes = [len(span) >= 16, len(span) >= 32, 3 * digits >= len(span), any(c.isupper() for c in span)]
    return sum(v << k for k, v in enumerate(votes)), sum(v << k for k, v in enumerate(shapes))


def candidates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key`` and ``found``, its base and broader candidates with votes and shapes, in order."""
    item = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("votes", pa.int32()), ("shape", pa.int32())])

    def run(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for t in part.column("text").to_pylist():
            t = t or ""
            base = base_spans(t)
            found = [(a, z, k) for a, k, z in base]
            broad = sorted((m.start(), m.end(), len(BASE) + k) for k, name in enumerate(ADDED) for m in _BROAD[name].finditer(t)) if t else []
            place, done = 0, 0
            ends = np.maximum.accumulate([z for _, _, z in base]).tolist() if base else []
            for a, z, k in broad:
                while place < len(base) and ends[place] <= a:
                    place += 1
                beside = place
                while beside < len(base) and base[beside][0] < z and base[beside][2] <= a:
                    beside += 1
                if a >= done and (beside == len(base) or base[beside][0] >= z):
                    found.append((a, z, k))
                    done = z
            rows.append([dict(zip(("start", "end", "kind", "votes", "shape"), (a, z, k, *described(t, a, z, KINDS[k])), strict=True)) for a, z, k in sorted(found, key=lambda s: (s[0], s[2]))])
        yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(rows, pa.list_(item))], [key, "found"])

    return map_text(df, key, text, run, f"`{key}` {ddl(df, key)}, found array<struct<start:bigint,`end`:bigint,kind:int,votes:int,shape:int>>")


@dataclass(frozen=True)
class Model:
    #: For each kind: how often each labeler votes for personal data and for other spans.
    reliability: dict[int, np.ndarray]
    prior: dict[int, float]
    #: The classifier: weights of votes and shapes for each kind, then the constant.
    weights: dict[int, np.ndarray]

    def probability(self, kind: int, votes: int, shape: int) -> float:
        w = self.weights.get(kind)
        return 0.5 if w is None else float(1 / (1 + np.exp(-(_features(np.array([votes]), np.array([shape])) @ w)[0])))


def _bits(x: np.ndarray, n: int) -> np.ndarray:
    return (x[:, None] >> np.arange(n)) & 1


def _features(votes: np.ndarray, shape: np.ndarray) -> np.ndarray:
    return np.hstack([_bits(votes, VOTES), _bits(shape, SHAPES), np.ones((len(votes), 1), np.int64)]).astype(float)


def fit(rows: DataFrame, steps: int = 50) -> Model:
    """EM and the classifier over the counts of vote and shape patterns of all rows of :func:`candidates`."""
    counts = rows.select(F.explode("found").alias("s")).groupBy("s.kind", "s.votes", "s.shape").agg(F.count("*").alias("n")).toPandas()
    reliability, prior, weights = {}, {}, {}
    for kind, part in counts.groupby("kind"):
        n, x = part["n"].to_numpy(float), _bits(part["votes"].to_numpy(), VOTES)
        # The first labeler knows a format and starts as the most reliable; base kinds start as nearly sure.
        p, share = np.tile([[0.2], [0.6]], (1, VOTES)), 0.9 if kind < len(BASE) else 0.5
        p[:, 0] = [0.05, 0.9]
        q = np.full(len(x), share)
        for _ in range(steps):
            like = [np.log(r) + (x * np.log(c) + (1 - x) * np.log(1 - c)).sum(1) for r, c in ((1 - share, p[0]), (share, p[1]))]
            q = 1 / (1 + np.exp(np.clip(like[0] - like[1], -50, 50)))
            share = float(np.clip((n @ q + 1) / (n.sum() + 2), 0.01, 0.99))
            for side, w in ((0, n * (1 - q)), (1, n * q)):
                start = np.where(np.arange(VOTES) == 0, (0.05, 0.9)[side], (0.2, 0.6)[side])
                p[side] = np.clip((w @ x + 4 * start) / (w.sum() + 4), 0.01, 0.99)
        reliability[int(kind)], prior[int(kind)] = p, share
        a = _features(part["votes"].to_numpy(), part["shape"].to_numpy())
        w, scale = np.zeros(a.shape[1]), n / n.sum()
        for _ in range(25):  # Newton steps with a small ridge
            y = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            h = (a * (scale * y * (1 - y) + 1e-9)[:, None]).T @ a + 1e-3 * np.eye(a.shape[1])
            w = w - np.linalg.solve(h, a.T @ (scale * (y - q)) + 1e-3 * w)
        weights[int(kind)] = w
    return Model(reliability, prior, weights)


def label(rows: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """``rows`` with ``spans``: the base's, and those candidates whose probability reaches ``least``; each with ``probability``."""
    known = {(k, v, s): model.probability(k, v, s) for k in model.weights for v in range(1 << VOTES) for s in range(1 << SHAPES)}
    key = rows.columns[0]
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("probability", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for found in batch.column("found").to_pylist():
                spans = [{"kind": KINDS[s["kind"]], "start": s["start"], "end": s["end"], "base": s["kind"] < len(BASE), "probability": known.get((s["kind"], s["votes"], s["shape"]), 0.5)} for s in found]
                out.append([s for s in spans if s["base"] or s["probability"] >= least])
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(out, pa.list_(item))], [key, "spans"])

    return rows.mapInArrow(run, f"`{key}` {ddl(rows, key)}, spans array<struct<kind:string,start:bigint,`end`:bigint,base:boolean,probability:double>>")


def find(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``df``: ``key`` and ``spans`` of personal data."""
    rows = stored(candidates(df, key, text), "pii-candidates")
    return label(rows, fit(rows))

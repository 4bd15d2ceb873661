"""Language identification as inference of a mixture of languages.

A language is a distribution over hashed letter trigrams, counted over all labelled training rows. A document's trigrams
are taken as drawn from a mixture of languages; expectation-maximisation estimates its proportions. Languages then join
the document's set in the order of their proportions as long as the penalised likelihood (BIC: half the log of the number
of trigrams for each further language) grows. The prediction is the language of largest proportion in the set.

Training data is reduced inside each task to counts by language and trigram; the model has ``BUCKETS`` figures for each
language, whatever the number of rows, and that is all that reaches the driver and the workers.

Defined results: a text that is null or has no letter is ``und`` with score 0 and no languages; so is any text if no
training row has a language; ties go to the language that sorts first; a repeated row gives a repeated result; columns
other than those named are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.cluster import cut, ddl, map_text, trimmed

#: Trigrams are hashed into this many buckets; weight of a bucket that a language lacks; steps of EM.
BUCKETS, SMOOTH, STEPS = 1 << 16, 0.5, 12
UNKNOWN = "und"
#: Bytes of text whose trigrams are held at once, in training and in prediction: a prediction holds some figures for each distinct trigram and language.
TRAIN_BYTES, PREDICT_BYTES = 1 << 18, 1 << 17


@lru_cache(1)
def letters() -> np.ndarray:
    """For each code point: its lower case if that is one letter, itself if it is a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        if unicodedata.category(c := chr(i))[0] == "L":
            out[i] = ord(low) if len(low := c.lower()) == 1 else i
    return out


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts, each over letters and single gaps, and the number of the text each belongs to."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    points = np.frombuffer(" ".join(f" {t}" for t in texts).encode("utf-32-le") + b" \0\0\0", np.uint32)
    letter = letters()[points]
    owner = np.repeat(np.arange(len(texts)), lengths)
    keep = letter > 0
    keep[1:] |= letter[:-1] > 0  # of each gap one place stays
    letter, owner = letter[keep], owner[keep]
    if len(letter) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # A gap before the first letter of each text.
    before = np.append(np.uint32(0), letter[:-1])
    after = np.append(letter[1:], np.uint32(0))
    mixed = before * np.uint32(0x9E3779B1) ^ (letter * np.uint32(0x85EBCA6B)) ^ (after * np.uint32(0xC2B2AE35))
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    real = letter > 0
    return (mixed[real] >> np.uint32(16)).astype(np.int64) & (BUCKETS - 1), owner[real]


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    #: A row for each bucket: the log probability in each language.
    logs: np.ndarray


def counts(df: DataFrame, text: str, lang: str) -> DataFrame:
    """Trigram counts by language over all rows of ``df``; each task sums before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in cut(batch, "text", TRAIN_BYTES):
                grams, owner = trigrams([t or "" for t in part.column("text").to_pylist()])
                names = pc.dictionary_encode(part.column("lang"))
                codes = names.indices.to_numpy(zero_copy_only=False)
                for code, name in enumerate(names.dictionary.to_pylist()):
                    got = np.bincount(grams[codes[owner] == code], minlength=BUCKETS)
                    sums[name] = sums[name] + got if name in sums else got
        trimmed()
        for name, got in sums.items():
            at = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(got[at], pa.int64())], ["lang", "gram", "n"])

    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(df: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """At most ``BUCKETS`` figures for each language come to the driver."""
    table = counts(df, text, lang).toPandas()
    names = tuple(sorted(table["lang"].unique()))
    sums = np.full((BUCKETS, len(names)), SMOOTH)
    np.add.at(sums, (table["gram"].to_numpy(np.int64), np.searchsorted(names, table["lang"]) if names else []), table["n"].to_numpy(float))
    return Model(names, np.log(sums / sums.sum(0)).astype(np.float32))


def _mixture(p: np.ndarray, n: np.ndarray, edges: np.ndarray, doc: np.ndarray, on: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM over all documents of a batch: p has a row for each distinct trigram of a document, n says how often it is there."""
    total = np.add.reduceat(n, edges)[:, None]
    for _ in range(STEPS):
        part = p * theta[doc]
        part *= (n / part.sum(1))[:, None]
        theta = np.add.reduceat(part, edges, 0) / total * on
    return theta, np.add.reduceat(n * np.log((p * theta[doc]).sum(1)), edges)


def infer(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (a row for each text, zero outside its set) and whether the text has any letter."""
    out, width = np.zeros((len(texts), len(model.languages)), np.float32), len(model.languages)
    grams, owner = trigrams(texts)
    if not len(grams) or not width:
        return out, np.zeros(len(texts), bool)
    distinct, n = np.unique(owner * BUCKETS + grams, return_counts=True)
    owner, grams, n = distinct // BUCKETS, distinct % BUCKETS, n.astype(np.float32)
    there, doc = np.unique(owner, return_inverse=True)
    edges = np.searchsorted(doc, np.arange(len(there)))
    logs = model.logs[grams]
    top = logs.max(1)
    p = np.exp(logs - top[:, None])
    base = np.add.reduceat(n * top, edges)
    full, _ = _mixture(p, n, edges, doc, np.ones((len(there), width), bool), np.full((len(there), width), 1 / width, np.float32))
    order, rank = np.argsort(-full, 1, kind="stable"), np.empty(full.shape, np.int64)
    np.put_along_axis(rank, order, np.arange(width)[None, :], 1)
    alone = np.add.reduceat(n[:, None] * logs, edges, 0)
    best = np.zeros(full.shape, np.float32)
    first = alone.argmax(1)
    best[np.arange(len(there)), first] = 1
    score = alone.max(1)
    penalty = 0.5 * np.log(np.maximum(np.add.reduceat(n, edges), 2))
    # The next language is tried only while the last one paid.
    growing = np.arange(len(there))
    for size in range(2, width + 1):
        if not len(growing):
            break
        rows = np.flatnonzero(np.isin(doc, growing))
        again, local = np.unique(doc[rows], return_inverse=True)
        on = rank[again] < size
        theta, fit = _mixture(p[rows], n[rows], np.searchsorted(local, np.arange(len(again))), local, on, on / np.float32(size))
        fit = fit + base[again] - (size - 1) * penalty[again]
        paid = fit > score[again]
        score[again[paid]], best[again[paid]] = fit[paid], theta[paid]
        growing = again[paid]
    out[there] = best
    has = np.zeros(len(texts), bool)
    has[there] = True
    return out, has


def predict(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``lang_pred``, ``score`` (its proportion) and ``languages`` (the set with proportions) for each row."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS figures for each language

    def run(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        model = shared.value
        share, has = infer(model, [t or "" for t in part.column("text").to_pylist()])
        names = np.array([*model.languages, UNKNOWN], object)
        top = np.where(has, share.argmax(1) if share.shape[1] else 0, len(model.languages))
        sets = [[{"lang": names[k], "share": float(row[k])} for k in np.flatnonzero(row)] for row in share]
        yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(names[top], pa.string()), pa.array(share.max(1, initial=0), pa.float64()), pa.array(sets, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))], [key, "lang_pred", "score", "languages"])

    return map_text(df, key, text, run, f"`{key}` {ddl(df, key)}, lang_pred string, score double, languages array<struct<lang:string,share:double>>", PREDICT_BYTES)


def labelled(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score`` beside its columns, whatever they are, row for row."""
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(text).alias("text"))
    got = predict(whole, model, "row", "text")
    return got.select("row.*", "lang_pred", "score")


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))

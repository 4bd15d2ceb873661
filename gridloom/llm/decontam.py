"""Benchmark decontamination by q-gram lemma filtering.

Texts and benchmark items are normalised to lower-case letters and digits with single gaps. A text's character q-grams
are looked up among those of the items; each shared one votes for a diagonal (place in the text less place in the item).
Diagonals are cut into bands twice the edit budget wide, each overlapping the next by half, so that any match within the
budget lies whole in one band. By the q-gram lemma a match of an item of m characters within e edits shares at least
m + 1 - q (e + 1) q-grams with it: bands below that are dropped, the others are aligned with the item by banded dynamic
programming, and those within the budget are reported.

Texts never leave the task that read them. The items' index goes to every task; items are taken in blocks of at most
``BLOCK_CHARS`` characters, so what is broadcast has a fixed bound and a larger benchmark takes more passes.

An item shorter than ``LEAST`` normalised characters has too few grams for that; it matches where it stands word for word,
by hashes of as many words as it has, compared character by character where they are equal.

Defined results: null or empty texts and items match nothing, nor do items without letter or digit; repeated rows are reported for each row; of matches of one item that
overlap in a text the one with fewest edits stays, the first of equals; other columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.cluster import ddl, map_text

#: Length of the grams; edits allowed in a character of an item; shortest item that may be edited; characters of items in one pass.
Q, EDITS, LEAST, BLOCK_CHARS = 10, 0.08, 40, 4_000_000


@lru_cache(1)
def folded() -> np.ndarray:
    """For each code point: its lower case if it is a letter or digit, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if unicodedata.category(c)[0] in "LN":
            out[i] = ord(low) if len(low := c.lower()) == 1 else i
    return out


def normalised(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, normalised, gaps as blanks; the text and the place in it that each comes from."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    points = np.frombuffer(" ".join([*texts, ""]).encode("utf-32-le"), np.uint32)
    out = folded()[points]
    keep = out > 0
    keep[1:] |= out[:-1] > 0
    at = np.flatnonzero(keep)
    out = out[at]
    out[out == 0] = 32
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), lengths)[at]
    return out, owner, at - (np.cumsum(lengths) - lengths)[owner]


def gram_hashes(points: np.ndarray) -> np.ndarray:
    """A hash of the q-gram that starts at each place; of the last places, where none does, it means nothing.

    A polynomial in an odd base modulo 2**64; hashes of grams of length k give those of length 2 k, and so on up to q.
    """
    base, power = 0x9E3779B97F4A7C15, points.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    out, done, length = np.zeros(len(points), np.uint64), 0, 1
    while done < Q:
        if Q & length:
            joined = out * np.uint64(pow(base, length, 1 << 64))
            joined[: max(0, len(points) - done)] += power[done:]
            out, done = joined, done + length
        doubled = power * np.uint64(pow(base, length, 1 << 64))
        doubled[: max(0, len(points) - length)] += power[length:]
        power, length = doubled, 2 * length
    return out ^ (out >> np.uint64(29))


@dataclass(frozen=True)
class Index:
    ids: list[object]
    points: list[np.ndarray]
    lengths: np.ndarray
    #: Sorted hashes of all items' grams with item and place, and a table of which low hash bits occur.
    hashes: np.ndarray
    items: np.ndarray
    places: np.ndarray
    bits: np.ndarray
    #: Of items shorter than ``LEAST``, by their number of words: sorted hashes and the items.
    short: dict[int, tuple[np.ndarray, np.ndarray]]


def word_hashes(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word of a normalised row starts and ends, and its hash."""
    real = np.concatenate([[False], points != 32, [False]])
    starts, ends = np.flatnonzero(real[1:] & ~real[:-1]), np.flatnonzero(real[:-1] & ~real[1:])
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    lead = starts[0]
    at = np.arange(len(points)) - np.concatenate([np.zeros(lead, np.int64), np.repeat(starts, np.diff(np.append(starts, len(points))))])
    powers = np.cumprod(np.full(int(at.max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
    sums = np.append(np.uint64(0), np.cumsum(np.where(real[1:-1], points.astype(np.uint64) * powers[at], np.uint64(0)), dtype=np.uint64))
    out = sums[ends] - sums[starts]
    return starts, ends, (out ^ (out >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)


def joined(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of the ``k`` words from each on; there are none for the last ``k - 1``."""
    out = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k if len(out) else 0):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + words[j : j + len(out)]
    return out


def index(rows: list[tuple[object, str]]) -> Index:
    points, owner, _ = normalised([t for _, t in rows])
    edges = np.searchsorted(owner, np.arange(len(rows) + 1))
    kept = [(i, p) for i, a, b in zip([i for i, _ in rows], edges, edges[1:], strict=False) if len(p := points[a:b][: -1 if b > a and points[b - 1] == 32 else None])]
    kept.sort(key=lambda item: len(item[1]) < LEAST)  # short ones last
    n_long = sum(len(p) >= LEAST for _, p in kept)
    lengths = np.array([len(p) for _, p in kept], np.int64)
    grams = [gram_hashes(p)[: len(p) - Q + 1] for _, p in kept[:n_long]]
    hashes = np.concatenate([np.zeros(0, np.uint64), *grams])
    items = np.repeat(np.arange(n_long), [len(g) for g in grams])
    places = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(g)) for g in grams)])
    order = np.argsort(hashes, kind="stable")
    bits = np.zeros(1 << 22, bool)
    bits[(hashes & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    short: dict[int, list[tuple[int, int]]] = {}
    for i, (_, p) in enumerate(kept[n_long:], n_long):
        words = word_hashes(p)[2]
        short.setdefault(len(words), []).append((int(joined(words, len(words))[0]), i))
    by_words = {k: (np.array([h for h, _ in sorted(v)], np.uint64), np.array([i for _, i in sorted(v)])) for k, v in short.items()}
    return Index([i for i, _ in kept], [p for _, p in kept], lengths, hashes[order], items[order], places[order], bits, by_words)


def budget(m: int) -> int:
    return int(m * EDITS)


def align(text: np.ndarray, item: np.ndarray, e: int) -> tuple[int, int, int] | None:
    """Fewest edits that turn some stretch of ``text`` into the whole ``item``, and where it starts and ends; at most ``e``.

    A plain occurrence is found at once. Else row by row over the item, all starts free; the band is the stretch itself, which is the item's length and 2 (e + 1) wide at most.
    """
    n = len(text)
    if (at := text.tobytes().find(item.tobytes())) >= 0 and at % text.itemsize == 0:
        return 0, at // text.itemsize, at // text.itemsize + len(item)
    column = np.arange(n + 1)
    cost, start = np.zeros(n + 1, np.int64), column.copy()
    for k, c in enumerate(item, 1):
        # Down (a character of the item is missing) or diagonal; then along (a character too many) as a running minimum.
        diagonal = cost[:-1] + (text != c)
        down = cost + 1
        take = np.append(False, diagonal <= down[1:])
        best = down.copy()
        best[1:][take[1:]] = diagonal[take[1:]]
        from_ = np.where(take, np.append(0, start[:-1]), start)
        best[0], from_[0] = k, 0
        slope = (best - column) * (n + 1) + column
        reach = np.minimum.accumulate(slope)
        source = reach % (n + 1)
        cost, start = best[source] + column - source, from_[source]
        if cost.min() > e:
            return None
    end = int(cost.argmin())
    return (int(cost[end]), int(start[end]), end) if cost[end] <= e else None


def matches(known: Index, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
    """For each match: number of the text, number of the item, start and end in the text, edits."""
    points, owner, places = normalised(texts)
    found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    _short(known, points, owner, places, found)
    _long(known, points, owner, places, len(texts), found)
    out = []
    for (d, i), spans in found.items():
        taken: list[tuple[int, int]] = []
        for cost, a, z in sorted(set(spans)):
            if all(z <= p or a >= q for p, q in taken):
                taken.append((a, z))
                out.append((d, i, a, z, cost))
    return sorted(out)


def _short(known: Index, points: np.ndarray, owner: np.ndarray, places: np.ndarray, found: dict[tuple[int, int], list[tuple[int, int, int]]]) -> None:
    if not known.short:
        return
    starts, ends, words = word_hashes(points)
    for k, (hashes, items) in known.short.items():
        here = joined(words, k)
        low, high = np.searchsorted(hashes, here, "left"), np.searchsorted(hashes, here, "right")
        for w in np.flatnonzero(high > low).tolist():
            a, z = int(starts[w]), int(ends[w + k - 1])
            if owner[a] == owner[z - 1]:
                for i in items[low[w] : high[w]].tolist():
                    if np.array_equal(points[a:z], known.points[i]):
                        found.setdefault((int(owner[a]), i), []).append((0, int(places[a]), int(places[z - 1]) + 1))


def _long(known: Index, points: np.ndarray, owner: np.ndarray, places: np.ndarray, n_texts: int, found: dict[tuple[int, int], list[tuple[int, int, int]]]) -> None:
    if len(points) < Q or not len(known.hashes):
        return
    hashes = gram_hashes(points)
    at = np.flatnonzero(known.bits[(hashes & np.uint64(len(known.bits) - 1)).astype(np.int64)])
    at = at[(at + Q <= len(points))]
    at = at[owner[at] == owner[at + Q - 1]]
    low = np.searchsorted(known.hashes, hashes[at], "left")
    n = np.searchsorted(known.hashes, hashes[at], "right") - low
    at, low, n = at[n > 0], low[n > 0], n[n > 0]
    if not len(at):
        return
    hit = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
    place, item = np.repeat(at, n), known.items[hit]
    diagonal = place - known.places[hit]  # in the row of all texts; an item that begins before its text is cut off there
    e = (known.lengths[item] * EDITS).astype(np.int64)
    width = 2 * e + 1
    # Two overlapping bands for each hit, each `2 * width` diagonals wide.
    band = np.concatenate([diagonal // width, diagonal // width - 1])
    item, place, gram, doc = np.tile(item, 2), np.tile(place, 2), np.tile(known.places[hit], 2), np.tile(owner[place], 2)
    # Shared grams: those of the item, each counted once in a band.
    order = np.lexsort((gram, band, item, doc))
    doc, item, band, gram = doc[order], item[order], band[order], gram[order]
    new = np.append(True, (np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(band) != 0))
    distinct = new | np.append(True, np.diff(gram) != 0)
    edges = np.flatnonzero(new)
    shared = np.add.reduceat(distinct.astype(np.int64), edges)
    doc, item, band = doc[edges], item[edges], band[edges]
    m = known.lengths[item]
    e = (m * EDITS).astype(np.int64)
    full = shared >= np.maximum(1, m + 1 - Q * (e + 1))
    first = np.searchsorted(owner, np.arange(n_texts + 1))
    for d, i, b, w, k in zip(doc[full].tolist(), item[full].tolist(), band[full].tolist(), (2 * e + 1)[full].tolist(), e[full].tolist(), strict=True):
        a, z = max(int(first[d]), b * w - k), min(int(first[d + 1]), (b + 2) * w + int(known.lengths[i]) + k)
        if z > a and (got := align(points[a:z], known.points[i], k)):
            found.setdefault((d, i), []).append((got[0], int(places[a + got[1]]), int(places[a + got[2] - 1]) + 1))


def blocks(items: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """``item``, ``text`` and ``block`` of the items, and how many blocks there are; none holds over ``BLOCK_CHARS`` characters but for its last item."""
    rows = items.where(F.col(text).isNotNull()).select(F.col(key).alias("item"), F.col(text).alias("text"))
    # Sums of lengths run inside 64 parts by hash, so no task has to see all items in order; the parts stand one after the other.
    rows = rows.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(64)).cast("int")).withColumn("size", F.length("text").cast("long"))
    sizes = {r["part"]: r["size"] for r in rows.groupBy("part").agg(F.sum("size").alias("size")).collect()}
    before = [sum(sizes.get(k, 0) for k in range(part)) for part in range(64)]
    along = Window.partitionBy("part").orderBy("item", "text").rowsBetween(Window.unboundedPreceding, -1)
    start = F.element_at(F.array(*map(F.lit, before)), F.col("part") + 1) + F.coalesce(F.sum("size").over(along), F.lit(0))
    return rows.select("item", "text", F.floor(start / BLOCK_CHARS).alias("block")), max(1, -(-sum(sizes.values()) // BLOCK_CHARS))


def passes(items: DataFrame, key: str, text: str) -> Iterator[Broadcast[Index]]:
    """The items' indexes, each of a bounded size."""
    cut_up, n = blocks(items, key, text)
    for block in range(n):
        part = cut_up.where(F.col("block") == block).select("item", "text").orderBy("item", "text")
        yield items.sparkSession.sparkContext.broadcast(index([(r["item"], r["text"]) for r in part.collect()]))


def find(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each place where an item stands in a text: ``key``, ``item_id``, ``start``, ``end`` (code points), ``edits``, ``similarity``."""
    kind, item_kind = ddl(df, key), ddl(items, item_key)
    found = []
    for shared in passes(items, item_key, item_text):

        def run(batch: pa.RecordBatch, shared=shared) -> Iterator[pa.RecordBatch]:
            known: Index = shared.value
            rows = matches(known, [t or "" for t in batch.column("text").to_pylist()])
            if rows:
                doc, item, start, end, edits = map(np.array, zip(*rows, strict=True))
                of = pa.array([known.ids[i] for i in item])
                share = 1 - edits / np.maximum(known.lengths[item], 1)
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(doc)), of, pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(edits, pa.int64()), pa.array(share, pa.float64())], [key, "item_id", "start", "end", "edits", "similarity"])

        found.append(map_text(df, key, text, run, f"`{key}` {kind}, item_id {item_kind}, start long, `end` long, edits long, similarity double"))
    return reduce(DataFrame.unionAll, found)


def clean(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``df`` in which no item stands, each judged alone, whatever its ``key``."""
    # The row goes through with its text, so rows with equal keys or none are told apart.
    names = [F.col(f"`{c}`") for c in df.columns]
    for shared in passes(items, item_key, item_text):
        whole = df.select(F.struct(*names).alias("row"), F.col(text).alias("text"))

        def run(batch: pa.RecordBatch, shared=shared) -> Iterator[pa.RecordBatch]:
            clean = np.ones(batch.num_rows, bool)
            clean[[r[0] for r in matches(shared.value, [t or "" for t in batch.column("text").to_pylist()])]] = False
            yield pa.RecordBatch.from_arrays([batch.column("key").filter(pa.array(clean))], ["row"])

        df = map_text(whole, "row", "text", run, f"row {ddl(whole, 'row')}").select("row.*")
    return df

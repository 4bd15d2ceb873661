"""Near-duplicate documents by SuperMinHash, banding, verification on full sets, and union of what is linked.

Each word shingle has a pseudo-random permutation of the signature's slots: at its rank j it offers j plus a fraction to
the slot that it meets there, and a slot keeps the least offer. Ranks are drawn level by level over a whole batch, by
Fisher-Yates steps, and a document stops as soon as all its slots hold less than the next level could offer.

Equal sets are one class, named by a 128-bit sum over its shingles. Bands of the signatures put classes into buckets. In a
bucket every class is compared with the smallest name first, and what isn't linked with that with the bucket's most central
member. Members that no links, of whatever bucket, have connected by then are compared with all that share one of their
rarest shingles, by an exact prefix filter, so no component is split and a bucket of copies costs about as many comparisons
as it has members. Sizes, sketches of the signatures (a bound four standard deviations wide) and the number of shingles that nothing
else in such buckets has drop hopeless pairs; the others are confirmed on full sets of 64-bit shingle hashes.

Defined results: a text without words, or null, has an empty set and is linked with nothing; fewer words than a shingle
has form one shingle; repeated rows give repeated results; rows with equal keys and different texts are judged apart, each by
its own text; a row with a null key is linked with nothing and its component is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.cluster import cut, dropped, map_text, released, stored
from gridloom.llm.components import components

#: The sketch keeps four bits of each of so many slots, sixteen slots in a long.
SLOTS = 256
SKETCH = tuple(f"b{k}" for k in range(SLOTS // 16))
#: Shingles that two prefixes have to share.
SHARED = 16
U = np.uint64


def bands_for(percent: int) -> tuple[int, int]:
    """Bands and rows in each: a pair just at the threshold shares none with probability below 1e-4."""
    rows = 8 if percent >= 85 else 6 if percent >= 75 else 4
    return 256 // rows, rows


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit mix."""
    x = (x + U(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(30))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x5851F42D4C957F2D
    out = [np.ones(n, np.uint64) for _ in range(2)]
    for powers, b in zip(out, (base, pow(base, -1, 1 << 64)), strict=True):
        powers[1:] = U(b)
        np.multiply.accumulate(powers, out=powers)
    return out[0], out[1]


@lru_cache(1)
def _letters() -> np.ndarray:
    """A random number for each byte, the same one for a letter of ASCII in either case."""
    out = mixed(np.arange(1, 257, dtype=np.uint64))
    out[65:91] = out[97:123]
    return out


def shingles(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and where each text's begin and the last end."""
    raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    edges = np.cumsum([0, *(len(t) + 1 for t in texts)])
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    turns = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).view(np.int8)))
    starts, stops = turns[::2], turns[1::2]
    powers, inverse = _powers(1 << max(19, int(len(raw)).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_letters()[raw] * powers[: len(raw)], dtype=np.uint64)])
    word = mixed((sums[stops] - sums[starts]) * inverse[starts])
    first = np.searchsorted(starts, edges)
    count = np.diff(first)
    out, ends = [], [0]
    for a, n in zip(first.tolist(), count.tolist(), strict=False):
        k = min(size, n)
        if k:
            h = np.full(n - k + 1, U(k))
            for j in range(k):
                h = mixed(h * U(0x100000001B3) + word[a + j : a + n - k + 1 + j])
            out.append(np.unique(h))
        ends.append(ends[-1] + (len(out[-1]) if k else 0))
    return np.concatenate([np.zeros(0, np.uint64), *out]), np.array(ends)


def signatures(sets: np.ndarray, ends: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash: a row of ``m`` slots for each set; rank in the high half, fraction in the low one."""
    sizes = np.diff(ends)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    out = np.full((len(sizes), m), np.iinfo(np.int64).max)
    flat, state, order = out.reshape(-1), sets, None
    for level in range(m):
        if not len(doc):
            break
        draw = mixed(state, level + 1)
        slot = level + (((draw >> U(32)) * U(m - level)) >> U(32)).astype(np.int64)
        every = np.arange(len(doc))
        if order is None:
            at, order = slot, slot[:0]
        else:
            at = order[every, slot].astype(np.int64)
            order[every, slot] = order[:, level]
        offer = (level << 32) | (draw & U(0xFFFFFFFF)).astype(np.int64)
        np.minimum.at(flat, doc * m + at, offer)
        there = np.unique(doc)
        open_ = np.zeros(len(sizes), bool)
        open_[there] = out[there].max(1) >= (level + 1) << 32
        go = open_[doc]
        if level == 0:
            left = int(go.sum())
            order = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (left, 1))
            order[np.arange(left), slot[go]] = 0
        else:
            order = order[go]
        doc, state = doc[go], state[go]
    return out


def names_of(sets: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two sums that name each set."""
    total = np.concatenate([np.zeros((1, 2), np.uint64), np.cumsum(np.stack([mixed(sets, 7777), mixed(sets, 9999)], 1), 0, dtype=np.uint64)])
    return (total[ends[1:]] - total[ends[:-1]]).view(np.int64)


def sketches(df: DataFrame, key: str, text: str, size: int, bands: int, rows: int) -> DataFrame:
    """Per row: ``key``, ``mark`` of its text, ``n`` shingles, two sums that name the set, band hashes, and a sketch of four bits for each slot."""

    def run(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets, ends = shingles([t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()], size)
        n = np.diff(ends)
        names = names_of(sets, ends)
        slots = mixed(signatures(sets, ends, max(SLOTS, bands * rows)).view(np.uint64))
        nibbles = (slots[:, :SLOTS] & U(15)).astype(np.uint8)
        bits = np.ascontiguousarray(nibbles[:, ::2] | nibbles[:, 1::2] << 4).view(np.int64)
        h = np.tile(np.arange(bands, dtype=np.uint64), (len(n), 1))
        for k in range(rows):
            h = mixed(h * U(0x100000001B3) + slots[:, k : bands * rows : rows])
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.where(n > 0, bands, 0))), pa.int32()), pa.array(h[n > 0].view(np.int64).reshape(-1)))
        yield pa.RecordBatch.from_arrays([part.column("key"), part.column("mark"), pa.array(n, pa.int64()), *(pa.array(names[:, k]) for k in range(2)), lists, *(pa.array(bits[:, k]) for k in range(len(SKETCH)))], ["key", "mark", "n", "s1", "s2", "bands", *SKETCH])

    return map_text(df.withColumn(key, F.col(key).cast("long")), key, text, run, "key long, mark long, n long, s1 long, s2 long, bands array<long>, " + ", ".join(f"{c} long" for c in SKETCH), 1 << 19, (F.xxhash64(text).alias("mark"),))


def sets_of(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """``key`` (the first name of the set) and ``items`` (sorted distinct shingle hashes, binary) of each row."""

    def run(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets, ends = shingles([t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()], size)
        yield pa.RecordBatch.from_arrays([pa.array(names_of(sets, ends)[:, 0]), pa.array([sets[a:b].tobytes() for a, b in zip(ends.tolist(), ends.tolist()[1:], strict=False)], pa.binary())], ["key", "items"])

    return map_text(df.withColumn(key, F.col(key).cast("long")), key, text, run, "key long, items binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (``a``, ``b``) whose sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch, "x"):
                keep = []
                for x, y in zip(part.column("x"), part.column("y"), strict=True):
                    x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                    common = int((y[at] == x).sum())
                    keep.append(100 * common >= percent * (len(x) + len(y) - common))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.withColumnsRenamed({"key": "a", "items": "x"}), "a").join(sets.withColumnsRenamed({"key": "b", "items": "y"}), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _beside(df: DataFrame, key: str) -> DataFrame:
    """``df`` as the other side of a pair: its key renamed, ``o_`` before all else."""
    return df.toDF(*[key if c == "key" else f"o_{c}" for c in df.columns])


def _items(sets: DataFrame) -> DataFrame:
    """A row for each shingle of each of ``sets``: ``item`` and ``key``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch, "items"):
                items = np.frombuffer(b"".join(part.column("items").to_pylist()), np.int64)
                sizes = np.array([len(x) // 8 for x in part.column("items").to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(items), pa.array(np.repeat(part.column("key").to_numpy(), sizes))], ["item", "key"])

    return sets.mapInArrow(run, "item long, key long")


def _prefixes(items: DataFrame, often: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """For each set, among its shingles that are not its alone: ``long`` and ``short`` prefixes, and ``long1`` and ``short1`` for a single one.

    All shingles stand in one order, rarest first. Two sets at the threshold share k shingles of the larger one's first
    n - ceil(percent n / 100) + k and the smaller one's first n - ceil(2 percent n / (100 + percent)) + k.
    """
    rank = F.row_number().over(Window.partitionBy("key").orderBy("many", "item"))
    ranked = items.join(often, "item").join(known.select("key", "n"), "key").select("item", "key", "many", "n", rank.alias("rank"))
    most = F.col("n") - F.expr(f"(n * {percent} + 99) div 100")
    early = F.col("n") - F.expr(f"(2 * {percent} * n + {99 + percent}) div {100 + percent}")
    held = ranked.where((F.col("rank") <= most + SHARED) & (F.col("many") > 1))
    # As long as a part of the set.
    some = lambda length, k, name: F.collect_list(F.when(F.col("rank") <= length + k, F.col("item"))).alias(name)
    return held.groupBy("key").agg(some(most, SHARED, "long"), some(early, SHARED, "short"), some(most, 1, "long1"), some(early, 1, "short1"))


def _meeting(percent: int) -> Column:
    """Whether the prefixes of a pair leave a chance of the threshold, and ``item`` is the first of those that say so."""

    def where(long: str, short: str, least: str) -> Column:
        enough = F.least(F.lit(SHARED), F.expr(f"(2 * {percent} * {least} + {99 + percent}) div {100 + percent}"))
        first = F.array_min(F.array_intersect(f"{long}1", f"{short}1")) == F.col("item")
        return first & (F.size(F.array_intersect(long, short)) >= enough)

    return F.when(F.col("n") >= F.col("o_n"), where("long", "o_short", "o_n")).otherwise(where("o_long", "short", "n"))


def _hopeful(percent: int) -> Column:
    """Whether sizes and sketches of a pair leave a chance of the threshold."""
    other = (1 - percent / 100) * 15 / 16
    most = int(SLOTS * other + 4 * (SLOTS * other * (1 - other)) ** 0.5) + 1

    def unlike(c: str) -> Column:
        x = F.col(c).bitwiseXOR(F.col(f"o_{c}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111)))

    apart = sum(map(unlike, SKETCH), F.lit(0))
    return (F.least("n", "o_n") * 100 >= F.greatest("n", "o_n") * percent) & (apart <= most)


def _possible(percent: int) -> Column:
    """Whether the shingles that others have too are enough for the threshold."""
    common = F.least(F.col("n") - F.col("u"), F.col("o_n") - F.col("o_u"))
    return common * 100 >= (F.col("n") + F.col("o_n") - common) * percent


def _judged(df: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """``key``, ``mark`` of the text, ``n`` shingles and ``component_id`` of each row."""
    bands, rows = bands_for(percent)
    every = stored(sketches(df, key, text, size, bands, rows), "sketches")
    real = every.where("n > 0 and key is not null")
    classes = stored(real.groupBy("n", "s1", "s2").agg(F.min("key").alias("key")), "set-classes")
    # From here on a class goes by its first name; ``doc`` is where its text is found.
    one = real.join(classes, ["key", "n", "s1", "s2"], "left_semi").withColumnRenamed("key", "doc").withColumnRenamed("s1", "key")
    small = one.select("key", "n", *SKETCH)
    keys = one.select("key", "doc", F.explode("bands").alias("bucket"))
    buckets = keys.groupBy("bucket").agg(F.min("key").alias("rep"), F.max("key").alias("last"), F.count("*").alias("n")).where("rep <> last")
    members = stored(keys.join(buckets.drop("last"), "bucket"), "buckets")
    # What one step has shuffled goes before the next one shuffles.
    released(df.sparkSession)

    # Sets of all that share a bucket, from one pass over the texts. The join is always by shuffle: its cost follows the input.
    texts = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    sets = stored(sets_of(texts.join(members.select(F.col("doc").alias("key")).distinct().hint("merge"), "key", "left_semi"), "key", "text", size).dropDuplicates(["key"]), "sets")
    released(df.sparkSession)
    done = [classes, members, sets]

    def confirmed(pairs: DataFrame) -> DataFrame:
        tried = stored(pairs.select(F.greatest("key", "other").alias("a"), F.least("key", "other").alias("b")).distinct(), "pairs")
        released(df.sparkSession)
        found = stored(_confirmed(tried, sets, percent), "links")
        dropped(tried)
        released(df.sparkSession)
        done.append(found)
        return found

    stars = members.where("key <> rep").select("key", F.col("rep").alias("other")).distinct()
    links = confirmed(stars.join(small, "key").join(_beside(small, "other"), "other").where(_hopeful(percent)))
    # Members that aren't linked with the representative, where the bucket has a third that they may be linked with.
    linked = links.select(F.col("a").alias("key"), F.col("b").alias("hub"))
    others = members.where("key <> rep and n > 2")
    apart = stored(others.join(linked.withColumnRenamed("hub", "rep"), ["key", "rep"], "left_anti").select("bucket", "key", "rep"), "apart")
    done.append(apart)
    if not apart.isEmpty():
        split = stored(members.join(apart.select("bucket").distinct(), "bucket", "left_semi").select("bucket", "key", "rep").distinct(), "split-buckets")
        inside = split.select("key").distinct()
        # A shingle that no other text there has can be in no intersection.
        items = stored(_items(sets.join(inside, "key", "left_semi")), "items")
        often = stored(items.groupBy("item").agg(F.count("*").alias("many")), "item-counts")
        alone = items.join(often.where("many = 1"), "item").groupBy("key").agg(F.count("*").alias("u"))
        known = stored(small.join(inside, "key", "left_semi").join(alone, "key", "left").withColumn("u", F.coalesce("u", F.lit(0))), "profiles")
        central = stored(split.join(known, "key").groupBy("bucket").agg(F.min(F.struct((F.col("u") / F.col("n")).alias("share"), "key")).getField("key").alias("hub")), "centers")
        toward = apart.join(known, "key").join(central, "bucket").join(_beside(known, "hub"), "hub").where((F.col("key") != F.col("hub")) & _hopeful(percent) & _possible(percent))
        links = links.unionAll(confirmed(toward.select("key", F.col("hub").alias("other"))))
        # What other links have connected needs no more; the rest meets all that share one of its rarest shingles.
        parts = stored(components(links), "parts")
        connected = lambda df, node, name: df.join(parts.select(F.col("node").alias(node), F.col("component").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))
        rest = connected(connected(apart, "key", "part"), "rep", "rep_part").where("part <> rep_part").select("key", F.lit(True).alias("rest")).distinct()
        first = connected(_prefixes(items, often, known, percent), "key", "part").join(known, "key").join(rest, "key", "left")
        first = stored(first.withColumn("rest", F.coalesce("rest", F.lit(False))).withColumn("item", F.explode("long1")), "prefixes")
        both = first.where("rest").join(_beside(first, "other").withColumnRenamed("o_item", "item"), "item")
        once = ~F.col("o_rest") | (F.col("key") > F.col("other"))
        pairs = both.where((F.col("part") != F.col("o_part")) & once & _hopeful(percent) & _possible(percent) & _meeting(percent))
        links = parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(confirmed(pairs.select("key", "other")))
        done += [split, items, often, known, central, parts, first]
    parts = stored(components(links), "parts")

    of_class = classes.join(parts.withColumnRenamed("node", "s1"), "s1", "left").withColumn("component", F.coalesce("component", "s1"))
    least = stored(of_class.groupBy("component").agg(F.min("key").alias("component_id")), "component-ids")
    of_class = stored(of_class.join(least, "component").select("n", "s1", "s2", "component_id"), "class-components")
    for table in [*done, parts, least]:
        dropped(table)
    # Rows without a set share one name; they don't meet in the join.
    bare = "n = 0 or key is null"
    got = every.where(f"not ({bare})").select("key", "mark", "n", "s1", "s2").join(of_class, ["n", "s1", "s2"], "left").select("key", "mark", "n", "component_id")
    return got.unionAll(every.where(bare).select("key", "mark", "n", F.col("key").alias("component_id")))


def groups(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """``key``, ``n_shingles``, ``component_id`` (the smallest key it reaches) and ``kept`` for each row."""
    kept = F.coalesce(F.col("key") == F.col("component_id"), F.lit(True)).alias("kept")
    return _judged(df, key, text, size, percent).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id", kept)


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df`` that stay: one of each group, all that are linked with nothing; rows with equal key and text share their fate."""
    gone = _judged(df, key, text, size, percent).where("key <> component_id").select("key", "mark").distinct()
    # The row goes through as one column, so none of its names can clash.
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{key}`").cast("long").alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("mark"))
    return rows.join(gone, ["key", "mark"], "left_anti").select("row.*")

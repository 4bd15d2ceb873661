"""Byte-level BPE, encoding and decoding.

Pre-tokenisation uses no regular expression. Each code point becomes a symbol (letter, number, space, other white
space, anything else, an apostrophe that may open a contraction), each symbol is a function from automaton state to
automaton state, and as composition of such functions is associative, the state before every character of a batch comes
from a blocked prefix scan in numpy. A table over (state, symbol) then says where a piece starts. The distinct pieces of
a batch go through a cache of merged pieces; only one that isn't there runs the pair merging (the tiktoken library's,
piece by piece).

Defined results: a null text counts as empty; an empty text has no ids and decodes to no bytes; rows are independent, so
repeated rows give repeated results and an empty table gives an empty one; columns other than the two named are not read.
"""

from __future__ import annotations

import base64
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from gridloom.llm.cluster import cut, ddl, extended, map_text, trimmed

# Unicode's White_Space property.
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 133, 160, 5760, 8192, 8193, 8194, 8195, 8196, 8197, 8198, 8199, 8200, 8201, 8202, 8232, 8233, 8239, 8287, 12288)
# The contractions that the pattern of the vocabulary lists.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")

LETTER, NUMBER, SPACE, BLANK, OTHER, SEPARATOR, SHORT, LONG = range(8)  # symbols
FREE, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_SPACE, AFTER_BLANK, ONE_LEFT, TWO_LEFT = range(8)  # states before a symbol
BLOCK = 64
SLICE = 1 << 20
#: The first k bytes of eight.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
CACHED_BYTES, CACHED_PIECES, NEW_PIECES = 48, 1_000_000, 65_536


@lru_cache(1)
def symbol_table() -> np.ndarray:
    """The symbol of each code point."""
    by_category = {c: LETTER if c[0] == "L" else NUMBER if c[0] == "N" else OTHER for c in {unicodedata.category(chr(i)) for i in range(0x110000)}}
    table = np.fromiter((by_category[unicodedata.category(chr(i))] for i in range(0x110000)), np.uint8, 0x110000)
    table[list(WHITE_SPACE)] = BLANK
    table[32] = SPACE
    return table


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """After a symbol in a state: the next state; whether a piece starts at the symbol (runs of white space apart)."""
    to, starts = np.zeros((8, 8), np.uint8), np.ones((8, 8), bool)
    for symbol, state in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (SPACE, AFTER_SPACE), (BLANK, AFTER_BLANK), (OTHER, IN_OTHER), (SEPARATOR, FREE)):
        to[symbol] = state
    to[LETTER, ONE_LEFT], to[LETTER, TWO_LEFT] = FREE, ONE_LEFT
    for symbol, state in ((SHORT, ONE_LEFT), (LONG, TWO_LEFT)):
        to[symbol] = state
        to[symbol, [IN_OTHER, AFTER_SPACE]] = IN_OTHER  # there the apostrophe belongs to a run that has begun
    starts[LETTER, [IN_LETTERS, AFTER_SPACE, ONE_LEFT, TWO_LEFT]] = False
    starts[NUMBER, [IN_NUMBERS, AFTER_SPACE]] = False
    for symbol in (OTHER, SHORT, LONG):
        starts[symbol, [IN_OTHER, AFTER_SPACE]] = False
    for symbol in (SPACE, BLANK):
        starts[symbol, [AFTER_SPACE, AFTER_BLANK]] = False
    return to, starts


TO, STARTS = _tables()


def symbols(points: np.ndarray, separators: np.ndarray) -> np.ndarray:
    out = symbol_table()[points]
    out[separators] = SEPARATOR
    at = np.flatnonzero(points == 39)
    if len(at):
        after = np.concatenate([points, np.zeros(2, points.dtype)])
        for text in CONTRACTIONS:
            here = at
            for k, c in enumerate(text[1:], 1):
                here = here[after[here + k] == ord(c)]
            out[here] = SHORT if len(text) == 2 else LONG
    return out


def states_before(symbol: np.ndarray) -> np.ndarray:
    """The automaton's state before each symbol: functions composed inside blocks, then over blocks, then applied."""
    n = len(symbol)
    blocks = -(-n // BLOCK)
    by_column = np.full(blocks * BLOCK, SEPARATOR, np.uint8)
    by_column[:n] = symbol
    by_column = np.ascontiguousarray(by_column.reshape(blocks, BLOCK).T)
    flat, base = TO.ravel(), by_column.astype(np.intp) * 8
    whole = np.tile(np.arange(8, dtype=np.uint8), (blocks, 1))
    for row in base:
        whole = flat[row[:, None] + whole]
    step = 1
    while step < blocks:  # inclusive scan: whole[i] becomes the function of blocks 0..i
        whole[step:] = np.take_along_axis(whole[step:], whole[:-step], 1)
        step *= 2
    state = np.full(blocks, FREE, np.uint8)
    state[1:] = whole[:-1, FREE]
    out = np.empty((BLOCK, blocks), np.uint8)
    for k, row in enumerate(base):
        out[k] = state
        state = flat[row + state]
    return out.T.reshape(-1)[:n]


def piece_starts(symbol: np.ndarray) -> np.ndarray:
    """Indices at which a piece starts."""
    state = states_before(symbol)
    starts = STARTS[symbol, state]
    blank = (symbol == SPACE) | (symbol == BLANK)
    follows = np.append(~blank[1:] & (symbol[1:] != SEPARATOR), False)
    starts |= blank & follows & ((state == AFTER_SPACE) | (state == AFTER_BLANK))  # the last of a run, if more text follows
    return np.flatnonzero(starts)


def boundaries(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All texts as UTF-8 with a zero byte between two; where each piece starts and stops there; how many pieces lie before each text and in all."""
    whole = "\0".join(texts)
    raw, points = whole.encode(), np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    if not len(points):
        return raw, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    separators = ends[:-1] - 1
    starts = piece_starts(symbols(points, separators))
    stops = np.append(starts[1:], len(points))
    real = np.ones(len(starts), bool)
    real[np.searchsorted(starts, separators)] = False
    starts, stops = starts[real], stops[real]
    before = np.append(np.searchsorted(starts, np.append(0, ends[:-1])), len(starts))
    if len(raw) > len(points):  # from code points to bytes
        at = np.append(0, np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000), dtype=np.int64))
        starts, stops = at[starts], at[stops]
    return raw, starts, stops, before


def pieces(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The pieces of all texts in order; how many of them lie before each text and in all."""
    raw, starts, stops, before = boundaries(texts)
    return [raw[a:b].decode() for a, b in zip(starts.tolist(), stops.tolist(), strict=True)], before


def packed(raw: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each piece: its first eight bytes, the next eight, its size, and a hash of the three. Up to 16 bytes the three tell pieces apart."""
    windows = np.ndarray(len(raw) + 9, "<u8", raw + bytes(16), strides=(1,))
    size = stops - starts
    low = windows[starts] & MASKS[np.minimum(size, 8)]
    high = windows[np.minimum(starts + 8, len(raw))] & MASKS[np.clip(size - 8, 0, 8)]
    return low, high, size, (low * np.uint64(0x9E3779B97F4A7C15)) ^ ((high + size.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F))


def distinct(low: np.ndarray, high: np.ndarray, size: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of pieces among which every piece finds its equal, and which of them each piece equals; pieces of over 16 bytes stand for themselves."""
    order = np.argsort(key)
    sorted_key = key[order]
    first = np.append(True, sorted_key[1:] != sorted_key[:-1])
    which, group = order[first], np.empty(len(size), np.int64)
    group[order] = np.cumsum(first) - 1
    of_group = which[group]
    alone = np.flatnonzero((size > 16) | (low != low[of_group]) | (high != high[of_group]) | (size != size[of_group]))
    group[alone] = len(which) + np.arange(len(alone))
    return np.append(which, alone), group


class Cache(dict):
    """From piece to ids (unsigned 32-bit, little-endian): new pieces as a dict, older ones of up to 16 bytes in arrays sorted by their hash."""

    def __init__(self):
        super().__init__()
        self._forget()

    def _forget(self) -> None:
        # One entry that equals no piece.
        self.low = self.high = self.key = np.zeros(1, np.uint64)
        self.size, self.at, self.count, self.pool = np.full(1, -1), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, "<u4")

    def merged(self, piece: bytes) -> list[int]:
        raise NotImplementedError

    def __missing__(self, piece: bytes) -> bytes:
        got = array("I", self.merged(piece)).tobytes()
        if len(piece) <= CACHED_BYTES:
            self[piece] = got
        return got

    def settle(self) -> None:
        """From the dict into the arrays, which begin anew when they are full."""
        held = {p: ids for p, ids in self.items() if len(p) <= 16}
        self.clear()
        if len(self.key) + len(held) > CACHED_PIECES:
            self._forget()
        stops = np.cumsum(np.fromiter(map(len, held), np.int64, len(held)))
        low, high, size, key = packed(b"".join(held), np.append(0, stops[:-1]), stops)
        count = np.fromiter(map(len, held.values()), np.int64, len(held)) // 4
        at = len(self.pool) + np.cumsum(count) - count
        self.pool = np.append(self.pool, np.frombuffer(b"".join(held.values()), "<u4"))
        order = np.argsort(np.append(self.key, key))
        for name, new in (("low", low), ("high", high), ("size", size), ("key", key), ("at", at), ("count", count)):
            setattr(self, name, np.append(getattr(self, name), new)[order])

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each distinct piece looked up once; how many of them lie before each text and in all."""
        raw, starts, stops, before = boundaries(texts)
        if not len(starts):
            return np.zeros(0, "<u4"), before
        of_piece = packed(raw, starts, stops)
        which, group = distinct(*of_piece)
        low, high, size, key = (x[which] for x in of_piece)
        near = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        at, count = self.at[near], self.count[near]
        new = np.flatnonzero((self.low[near] != low) | (self.high[near] != high) | (self.size[near] != size))
        got = [self[raw[a:b]] for a, b in zip(starts[which[new]].tolist(), stops[which[new]].tolist(), strict=True)]
        count[new] = np.fromiter(map(len, got), np.int64, len(got)) // 4
        at[new] = len(self.pool) + np.cumsum(count[new]) - count[new]
        pool = np.append(self.pool, np.frombuffer(b"".join(got), "<u4"))
        length = count[group]
        ends = np.cumsum(length)
        ids = pool[np.repeat(at[group] - ends + length, length) + np.arange(ends[-1])]
        if len(self) >= NEW_PIECES:
            self.settle()
        return ids, np.append(0, ends)[before]


class Vocabulary(Cache):
    """Ranks from a file of base64 tokens; and the cache of what they make of pieces."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        size = max(self.ranks.values(), default=-1) + 1
        by_id = [b""] * size
        for token, rank in self.ranks.items():
            by_id[rank] = token
        #: Decoding: the bytes of all tokens in a row, and where each token's begin and how many they are.
        self.spelled = np.frombuffer(b"".join(by_id), np.uint8)
        self.lengths = np.fromiter(map(len, by_id), np.int64, size)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        #: Pair merging of one piece. The pattern and special tokens play no part: pieces are found here.
        self.merged = tiktoken.Encoding("pieces", pat_str=r"(?s:.)+", mergeable_ranks=self.ranks, special_tokens={})._core_bpe.encode_single_piece

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, before = self.encode_flat(texts)
        return [ids[a:b].tobytes() for a, b in zip(before.tolist(), before.tolist()[1:], strict=False)]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The tokens' bytes, gathered from all tokens' by the retained offsets."""
        flat = np.frombuffer(b"".join(ids), "<u4")
        length = self.lengths[flat]
        ends = np.cumsum(length)
        out = self.spelled[np.repeat(self.offsets[flat] - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        stops = np.append(0, ends)[np.cumsum([0, *(len(x) // 4 for x in ids)])].tolist()
        return [out[a:b] for a, b in zip(stops, stops[1:], strict=False)]


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    """One for each worker process."""
    return Vocabulary(path)


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_tokens`` and ``ids`` (binary: unsigned 32-bit, little-endian) of each row's whole text."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        got = vocabulary(path).encode([t or "" for t in batch.column("text").to_pylist()])
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([len(x) // 4 for x in got], pa.int64()), pa.array(got, pa.binary())], [key, "n_tokens", "ids"])

    return map_text(df, key, text, run, f"`{key}` {ddl(df, key)}, n_tokens long, ids binary", SLICE)


def decode(df: DataFrame, path: str) -> DataFrame:
    """``df`` of :func:`encode` with ``decoded`` (binary, UTF-8 for ids of whole texts) beside its columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch, "ids", SLICE):
                got = vocabulary(path).decode([x or b"" for x in part.column("ids").to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.binary())], [*part.schema.names, "decoded"])
        trimmed()

    return df.mapInArrow(run, extended(df, decoded="binary"))

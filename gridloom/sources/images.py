"""PNG and PPM files as rows of sites, and back. Files are read in parallel, one task holding one file at a time."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.expr import GridError
from gridloom.functions.types import Type

SITES = "path string, x bigint, y bigint, c bigint, v bigint"


def decode_ppm(raw: bytes) -> np.ndarray:
    """Binary P6 or P5, 8 or 16 bits, as (y, x, c)."""
    fields, at = [], 2
    while len(fields) < 3:
        while raw[at : at + 1].isspace():
            at += 1
        if raw[at : at + 1] == b"#":
            at = raw.index(b"\n", at)
            continue
        stop = at
        while not raw[stop : stop + 1].isspace():
            stop += 1
        fields.append(int(raw[at:stop]))
        at = stop
    width, height, most = fields
    channels = {b"P6": 3, b"P5": 1}[raw[:2]]
    data = np.frombuffer(raw, ">u2" if most > 255 else np.uint8, width * height * channels, at + 1)
    return data.reshape(height, width, channels)


def encode_ppm(image: np.ndarray) -> bytes:
    if image.shape[2] == 1:
        image = np.repeat(image, 3, 2)
    wide = image.dtype.itemsize == 2
    return b"P6\n%d %d\n%d\n" % (image.shape[1], image.shape[0], 65535 if wide else 255) + image[:, :, :3].astype(">u2" if wide else np.uint8).tobytes()


def decode_png(raw: bytes) -> np.ndarray:
    """Gray, RGB, with or without alpha, 8 or 16 bits, not interlaced, as (y, x, c)."""
    at, data, head = 8, [], None
    while at < len(raw):
        (n,) = struct.unpack(">I", raw[at : at + 4])
        kind, body = raw[at + 4 : at + 8], raw[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    width, height, bits, color, _, _, interlaced = head
    if bits not in (8, 16) or interlaced or color not in (0, 2, 4, 6):
        raise GridError("only gray and RGB images of 8 or 16 bits, not interlaced, are read")
    channels = {0: 1, 2: 3, 4: 2, 6: 4}[color]
    step, row = channels * bits // 8, width * channels * bits // 8
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, row + 1)
    out = np.zeros((height, row), np.uint8)
    above = np.zeros(row, np.uint8)
    for y in range(height):
        method, line = lines[y, 0], lines[y, 1:].copy()
        if method == 1:
            line = np.cumsum(line.reshape(-1, step), 0, dtype=np.uint8).reshape(-1)
        elif method == 2:
            line += above
        elif method in (3, 4):
            for i in range(row):
                left, up = int(line[i - step]) if i >= step else 0, int(above[i])
                corner = int(above[i - step]) if i >= step else 0
                guess = left + up - corner
                near = min((abs(guess - left), 0, left), (abs(guess - up), 1, up), (abs(guess - corner), 2, corner))[2]
                line[i] = (int(line[i]) + ((left + up) // 2 if method == 3 else near)) & 255
        out[y] = above = line
    return (out.view(">u2") if bits == 16 else out).reshape(height, width, channels)


def encode_png(image: np.ndarray) -> bytes:
    height, width, channels = image.shape
    wide = image.dtype.itemsize == 2
    rows = np.ascontiguousarray(image.astype(">u2" if wide else np.uint8)).view(np.uint8).reshape(height, -1)
    body = zlib.compress(np.hstack([np.zeros((height, 1), np.uint8), rows]).tobytes())

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, height, 16 if wide else 8, {1: 0, 2: 4, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def decode(raw: bytes) -> np.ndarray:
    """By what the bytes say they are."""
    return decode_png(raw) if raw[:4] == b"\x89PNG" else decode_ppm(raw)


def load(spark: SparkSession, path: str) -> DataFrame:
    """A row for each site and channel of each file at ``path``."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, raw in zip(batch["path"], batch["content"], strict=True):
                image = decode(bytes(raw))
                y, x, c = np.indices(image.shape)
                yield pd.DataFrame({"path": name, "x": x.ravel(), "y": y.ravel(), "c": c.ravel(), "v": image.astype(np.int64).ravel()})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SITES)


def encoded(df: DataFrame, kind: str = "png", bits: int = 8) -> DataFrame:
    """``path`` and ``content`` of the image of each ``path``: one group holds one image, which has to fit a task anyway."""

    def run(sites: pd.DataFrame) -> pd.DataFrame:
        low = sites[["x", "y"]].min()
        shape = (sites["y"].max() - low["y"] + 1, sites["x"].max() - low["x"] + 1, sites["c"].max() + 1)
        image = np.zeros(shape, np.uint16 if bits == 16 else np.uint8)
        image[sites["y"] - low["y"], sites["x"] - low["x"], sites["c"]] = sites["v"]
        return pd.DataFrame({"path": [sites["path"].iloc[0]], "content": [encode_png(image) if kind == "png" else encode_ppm(image)]})

    return df.groupBy("path").applyInPandas(run, "path string, content binary")


def rescaled(v: Column, had: Type, to: Type) -> Column:
    """The change of number format that reading and writing imply: shifts between widths, floats over the full range."""
    if had == to:
        return v
    if had.is_float:
        return F.floor(v * float(to.max())).cast("bigint")
    if to.is_float:
        return v / float(had.max())
    return F.call_function("shiftright", v, F.lit(had.bits - to.bits)) if had.bits > to.bits else F.call_function("shiftleft", v, F.lit(to.bits - had.bits))

"""Token ids in Parquet: list columns, dictionary and delta encoding, small row groups and pages with page indexes.

Documents are dealt out by ranges of their key and sorted before they are encoded, so that the files hold ascending
keys; a reader that wants a few keys, or only the counts, opens only row groups, pages and columns that hold them.

The ids of a text are those of the tokenizers library: texts are cut into pieces as in :mod:`gridloom.llm.bpe`, and the
library's model gives the ids of each distinct piece. A text that holds an added token of the file (such as a special
one) is given whole to the library, which knows what each of them takes of its surroundings.

Defined results: a null text counts as empty and gives the end id alone; rows with equal keys stay separate rows, side by
side, in the order of their texts; null keys come first; an empty table gives no files' rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm.bpe import Cache
from gridloom.llm.cluster import cut, ddl, stored, stored_path

#: Of the files. Keys and counts are delta encoded, ids get a dictionary as long as that is small.
WRITER = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
    "compression": "zstd",
}


class Pieces(Cache):
    """From piece to ids (unsigned 32-bit), for misses by the model of a tokenizer file."""

    def __init__(self, path: str):
        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        # Byte-level vocabularies write byte b as a printable character: itself where it is one, else from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.letters = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}

    def of_text(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def merged(self, piece: bytes) -> list[int]:
        return [t.id for t in self.model.tokenize(piece.decode("latin-1").translate(self.letters))]


@lru_cache(2)
def tokenizer(path: str) -> Pieces:
    return Pieces(path)


def encoded(df: DataFrame, path: str, end: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_tokens`` and ``ids`` with the end id, in ascending order of ``key`` over the partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = tokenizer(path)
        for batch in batches:
            for part in cut(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                special = {k: ids_of.of_text(t) for k, t in enumerate(texts) if any(a in t for a in ids_of.added)}
                ids, before = ids_of.encode_flat(["" if k in special else t for k, t in enumerate(texts)])
                counts = np.diff(before) + 1
                if special:
                    edges = before.tolist()
                    rows = [special[k] if k in special else ids[a:b].tobytes() for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
                    counts = np.fromiter(map(len, rows), np.int64, len(rows)) // 4 + 1
                    ids = np.frombuffer(b"".join(rows), "<u4")
                # The end id goes behind each text's own ids.
                stops = np.cumsum(counts)
                values = np.full(int(stops[-1]), end, np.int32)
                own = np.ones(len(values), bool)
                own[stops - 1] = False
                values[own] = ids.view(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, stops), pa.int32()), pa.array(values))
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(counts, pa.int32()), lists], [key, "n_tokens", "ids"])

    dealt = df.select(F.col(key).alias("key"), F.col(text).alias("text")).repartitionByRange("key").sortWithinPartitions("key", "text")
    return dealt.mapInArrow(run, f"`{key}` {ddl(df, key)}, n_tokens int, ids array<int>")


def write(df: DataFrame, to: str, path: str, end: int, key: str = "doc_id", text: str = "text") -> None:
    encoded(df, path, end, key, text).write.options(**WRITER).parquet(to)


def read(spark: SparkSession, at: str, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    """A selective read: columns are pruned, ``where`` is pushed down to row groups and pages."""
    df = spark.read.parquet(at)
    df = df.where(where) if where else df
    return df.select(*columns) if columns else df


def places(spark: SparkSession, at: str, key: str = "doc_id") -> DataFrame:
    """For each row of the files: how many ids stand before it in all files, its own count and its ids' CRC."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            raw, edges = memoryview(lists.values.to_numpy(zero_copy_only=True).astype("<u4", copy=False)).cast("B"), (lists.offsets.to_numpy() * 4).tolist()
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("file"), batch.column("row"), pa.array(np.diff(edges) // 4, pa.int64()), pa.array(crc, pa.int64())], ["key", "file", "row", "n_tokens", "ids_crc32"])

    files = spark.read.parquet(at)
    kind = files.schema[key].dataType.simpleString()
    read_back = files.select(F.col(key).alias("key"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), "ids")
    rows = stored(read_back.mapInArrow(run, f"key {kind}, file string, row long, n_tokens long, ids_crc32 long"), "token-places")
    # As many rows as files: each file's place among all, by the keys it holds.
    totals = rows.groupBy("file").agg(F.min(F.struct("key", "file")).alias("first"), F.sum("n_tokens").alias("all_tokens"))
    before = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("file", F.coalesce(F.sum("all_tokens").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return rows.join(totals, "file").select(F.col("key").alias(key), (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def written_places(df: DataFrame, path: str, end: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the ids of ``df`` into the shared folder and reads the files back."""
    at = stored_path(df.sparkSession, "token-ids")
    write(df, at, path, end, key, text)
    return places(df.sparkSession, at, key)

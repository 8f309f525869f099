"""Token ids on disk as directly addressable codes.

An id is cut into chunks of eight bits. The lowest chunk of every id lies in the
first level; a bitmap says which ids go on, and their next chunks lie in the next
level. A rank directory counts the bits before each block of a bitmap, so the place
of an id in any level, and with it any token, is found without decoding others.

A file is a Parquet table with one row per segment: its documents' ids and sizes,
and the levels as one binary value.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.taskcontext import TaskContext

from cohortspan.llm.common import quoted, scratch, shuffle_width
from cohortspan.llm.tokens import encoder, tokenizer_path

MAGIC = b"DAC1"
CHUNK = 8
#: Bits of a bitmap between two counts of the rank directory.
RANK = 512
#: Tokens of a segment, about: it ends with the document that reaches this.
SEGMENT = 1 << 20
SCHEMA = "part int, part_start long, n_tokens long, nulls int, doc_ids array<long>, sizes array<long>, payload binary"


def encode(ids: np.ndarray) -> bytes:
    """The levels of an array of unsigned 32-bit ids."""
    levels, rest = [], np.ascontiguousarray(ids, "<u4")
    while True:
        more = rest >> CHUNK
        goes_on = more > 0
        bitmap = np.packbits(goes_on, bitorder="little")
        blocks = np.zeros(-(-len(bitmap) // (RANK // 8)) * (RANK // 8), np.uint8)
        blocks[: len(bitmap)] = bitmap
        ones = np.bitwise_count(blocks).reshape(-1, RANK // 8).sum(axis=1, dtype="<u4")
        ranks = np.concatenate([[0], np.cumsum(ones)]).astype("<u4")
        levels.append(struct.pack("<I", len(rest)) + rest.astype(np.uint8).tobytes() + bitmap.tobytes() + ranks.tobytes())
        rest = more[goes_on]
        if not len(rest):
            return MAGIC + struct.pack("<B", len(levels)) + b"".join(levels)


class Codes:
    """Random access to an encoded segment."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a token segment")
        self.levels = []
        at = 5
        for _ in range(payload[4]):
            (n,) = struct.unpack_from("<I", payload, at)
            size = (n + 7) // 8
            chunks = np.frombuffer(payload, np.uint8, n, at + 4)
            bitmap = np.frombuffer(payload, np.uint8, size, at + 4 + n)
            counts = -(-size // (RANK // 8)) + 1
            ranks = np.frombuffer(payload, "<u4", counts, at + 4 + n + size)
            self.levels.append((chunks, bitmap, ranks))
            at += 4 + n + size + 4 * counts

    def __len__(self) -> int:
        return len(self.levels[0][0])

    @staticmethod
    def _rank(level: tuple[np.ndarray, np.ndarray, np.ndarray], i: int) -> int:
        """Set bits before place ``i``."""
        _, bitmap, ranks = level
        block = i // RANK
        start, whole, rest = block * RANK // 8, i // 8, i % 8
        ones = int(ranks[block]) + int(np.bitwise_count(bitmap[start:whole]).sum())
        return ones + ((int(bitmap[whole]) & ((1 << rest) - 1)).bit_count() if rest else 0)

    def __getitem__(self, i: int) -> int:
        """One token, from one chunk per level."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for k, level in enumerate(self.levels):
            chunks, bitmap, _ = level
            value |= int(chunks[i]) << (CHUNK * k)
            if not bitmap[i // 8] >> (i % 8) & 1:
                break
            i = self._rank(level, i)
        return value

    def slice(self, start: int, end: int) -> np.ndarray:
        """Tokens start to end (exclusive); only their chunks are read."""
        out = np.zeros(max(0, end - start), "<u4")
        places = np.arange(len(out))
        for k, level in enumerate(self.levels):
            if not len(places):
                break
            chunks, bitmap, _ = level
            out[places] |= chunks[start:end].astype("<u4") << np.uint32(CHUNK * k)
            bits = np.unpackbits(bitmap[start // 8:(end + 7) // 8], bitorder="little")[start % 8:][: end - start]
            places = places[bits.astype(bool)]
            start = self._rank(level, start)
            end = start + len(places)
        return out


def write(docs: DataFrame, path: str, tokenizer: str, text: str = "text", doc_id: str = "doc_id", segment: int = SEGMENT) -> None:
    """Encode all documents in ascending doc_id order to a token file.

    Null ids come first and equal ids are ordered by their texts, null before
    empty; a null or empty text is the end id alone. Rows are dealt out by ranges of doc_id, so
    each task writes the segments of one stretch of the order. ``nulls`` counts a segment's
    null ids, which are its first and stored as 0.
    """
    width = shuffle_width(docs.sparkSession)
    rows = docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).cast("binary").alias("text"))

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode_text = encoder(tokenizer).encode
        part, before = TaskContext.get().partitionId(), 0
        ids, sizes, blobs, held, nulls = [], [], [], 0, 0

        def row() -> pd.DataFrame:
            payload = encode(np.frombuffer(b"".join(blobs), "<u4"))
            return pd.DataFrame({"part": [part], "part_start": [before], "n_tokens": [held], "nulls": [nulls], "doc_ids": [ids], "sizes": [sizes], "payload": [payload]})

        for batch in batches:
            for key, known, value in zip(batch["key"], batch["known"], batch["text"]):
                blob = encode_text(value)
                ids.append(key)
                nulls += not known
                sizes.append(len(blob) // 4)
                blobs.append(blob)
                held += len(blob) // 4
                if held >= segment:
                    yield row()
                    before += held
                    ids, sizes, blobs, held, nulls = [], [], [], 0, 0
        if ids:
            yield row()

    ordered = rows.repartitionByRange(width, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered = ordered.select(F.coalesce("doc_id", F.lit(0)).alias("key"), F.col("doc_id").isNotNull().alias("known"), "text")
    ordered.mapInPandas(segments, SCHEMA).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of a token file."""
    table = spark.read.schema(SCHEMA).parquet(path)
    # one row per written part, so its size is bounded by their number
    totals = table.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    placed = table.join(F.broadcast(bases), "part").select((F.col("base") + F.col("part_start")).alias("start"), "nulls", "doc_ids", "sizes", "payload")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start, nulls, ids, sizes, payload in zip(batch["start"], batch["nulls"], batch["doc_ids"], batch["sizes"], batch["payload"]):
                codes = Codes(payload)
                data = memoryview(codes.slice(0, len(codes)).tobytes())
                ends = np.cumsum(np.asarray(sizes, np.int64))
                starts = ends - np.asarray(sizes, np.int64)
                sums = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                keys = pd.array(ids, dtype="Int64")
                keys[:nulls] = pd.NA
                yield pd.DataFrame({"doc_id": keys, "start": start + starts, "n_tokens": ends - starts, "ids_crc32": sums})

    return placed.mapInPandas(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Write a token file to the shared folder and read it back. An empty table gives no rows."""
    spark = docs.sparkSession
    path = scratch(spark, "tokens")
    write(docs, path, tokenizer or tokenizer_path(), text, doc_id)
    return read(spark, path)

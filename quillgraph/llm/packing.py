"""Best-fit packing of documents into sequences, planned on a histogram of lengths.

Every document is tokenized once; a piece is at most ``capacity`` ids, and only longer documents are cut (the
first piece takes the remainder). The number of pieces of each length, at most ``capacity`` numbers, comes to the
driver, where best-fit decreasing runs over counts: all sequences with the same room are one group, and a group
takes as many pieces of a length as fit, at once. The plan's slots name a range of ranks within a length; pieces
take them by joining on length and rank. Ranks are numbered within (length, bucket) and offset by the buckets
before, so that a length that any share of the rows has is spread over as many tasks as it needs.

Bounds: the histogram and the plan depend on ``capacity`` alone, not on the corpus.

Defined results: a null or empty text is one piece with the end id; repeated rows are packed each; an empty
table gives an empty result; columns other than key and text are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .arrow import slices, texts
from .tokens import binary_rows, encoder, with_end

BUCKET_ROWS = 50_000


def cut(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, number in its row, length) of the pieces of rows with these many ids, at least one each."""
    pieces = -(-counts // capacity)
    row = np.repeat(np.arange(len(counts)), pieces)
    number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    length = np.where(number == 0, (counts - (pieces - 1) * capacity)[row], capacity)
    return row, number, length


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int | None = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids as little-endian unsigned 32-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, "_text"):
                flat, counts = with_end(*codes.encode(texts(part, "_text")), end_id)
                row, number, length = cut(counts, capacity)
                start = np.cumsum(length) - length
                start -= np.repeat((np.cumsum(counts) - counts), np.bincount(row, minlength=len(counts)))
                ids = binary_rows(flat.astype("<u4"), length).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), ids], [key, "piece", "start", "length", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).alias("_text")).mapInArrow(run, f"`{key}` {kind}, piece int, start long, length long, ids binary")


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, first rank, rank after the last, pieces a sequence, first sequence, offset) of best-fit
    decreasing: each piece, the longest first, goes to the fullest sequence that has room for it."""
    room: dict[int, list[tuple[int, int]]] = {}  # room left: groups (first sequence, sequences)
    slots, opened = [], 0
    for length in sorted((x for x in histogram if histogram[x]), reverse=True):
        left, rank = histogram[length], 0
        while left:
            space = next((r for r in range(length, capacity + 1) if room.get(r)), None)
            if space is None:
                space, first = capacity, opened
                each = capacity // length
                used, some = (left // each, each) if left >= each else (1, left)
                opened += used
            else:
                first, size = room[space].pop()
                each = space // length
                used, some = (min(size, left // each), each) if left >= each else (1, left)
                if used < size:
                    room[space].append((first + used, size - used))
            slots.append((length, rank, rank + used * some, some, first, capacity - space))
            room.setdefault(space - some * length, []).append((first, used))
            rank, left = rank + used * some, left - used * some
    return slots


def pack(pieces: DataFrame, capacity: int = 1024, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add sequence_id and offset to ``pieces``, a table that can be read again, with a length from 1 to
    ``capacity`` in each row."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = spark.createDataFrame(best_fit(histogram, capacity), "length long, low long, high long, each long, first long, offset long")
    buckets = max(1, math.ceil(max(histogram.values(), default=0) / bucket_rows))
    names = [c for c in pieces.columns if c != "length"]
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*names), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n")).select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_bucket").orderBy(*names)
    ranked = dealt.withColumn("_place", F.row_number().over(within) - 1).join(offsets, ["length", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_place"))
    plan = F.broadcast(slots.withColumnRenamed("length", "_length"))  # its size is bounded by the capacity
    fits = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("low")) & (F.col("_rank") < F.col("high"))
    nth = F.col("_rank") - F.col("low")
    return ranked.join(plan, fits).select(
        *[f"`{c}`" for c in pieces.columns], (F.col("first") + F.floor(nth / F.col("each"))).alias("sequence_id"), (F.col("offset") + nth % F.col("each") * F.col("length")).alias("offset")
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int | None = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of ``docs``."""
    pieces = token_pieces(docs, tokenizer, capacity, end_id).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(stage(pieces, "pieces"), capacity)

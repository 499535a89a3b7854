"""Token ids in files: canonical length-limited Huffman codes, in blocks that decode alone.

Writing: documents are range-partitioned and sorted by key, tokenized once and kept as a stage table of ids, with a
last row a part that says how often the part has each id; counts of ids (a vocabulary's worth) come to the driver, which
makes code lengths of at most ``limit`` bits by package-merge; tasks then encode. A token file is a folder with

* ``codebook``: (id, bits), from which the canonical codes follow: ordered by bits, then by id;
* ``blocks``: Parquet in folders ``part=0``, ``part=1``, ... that ascend by key, a row a block of whole documents:
  the place of its first token, documents' keys and token counts, the codes as one bit string, the highest
  bit first, and the bit offset of every ``STRIDE``-th token.

Reading: each block decodes by itself; the checkpoints let numpy decode all strides of several blocks side by side, a
table look-up a token.

The driver holds the vocabulary's counts and one row a part. Defined results: a null or empty text is the
end id alone; null keys come first; repeated keys are kept, ordered by a hash of their text, and may lie in several
parts; an empty table gives empty files.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop, stage
from .arrow import slices, texts
from .tokens import binary_rows, encoder, with_end

STRIDE = 256
BLOCK_TOKENS = 1 << 16
DECODED_TOKENS = 1 << 20  # of blocks that are decoded together, unless one has more
LIMIT = 16


def code_lengths(weights: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of the optimal prefix code of at most ``limit`` bits (package-merge) for positive ``weights``."""
    n = len(weights)
    if n <= 1:
        return np.ones(n, np.int64)
    limit = max(limit, math.ceil(math.log2(n)))
    order = np.argsort(weights, kind="stable")
    leaves = weights[order].astype(np.int64)
    levels, row = [], leaves
    for _ in range(limit - 1):
        half = len(row) // 2
        packages = row[: 2 * half : 2] + row[1 : 2 * half : 2]
        both = np.concatenate([leaves, packages])
        by = np.argsort(both, kind="stable")
        levels.append(by >= n)
        row = both[by]
    bits, take = np.zeros(n, np.int64), 2 * (n - 1)
    for is_package in reversed(levels):
        packages = int(is_package[:take].sum())
        bits[: take - packages] += 1
        take = 2 * packages
    bits[:take] += 1
    out = np.empty(n, np.int64)
    out[order] = bits
    return out


class Codebook:
    """Canonical codes of ``ids`` with these many ``bits``."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray) -> None:
        order = np.lexsort((ids, bits))
        self.ids, self.bits = ids[order].astype(np.int64), bits[order].astype(np.int64)
        self.limit = int(self.bits.max(initial=1))
        spans = 1 << (self.limit - self.bits)
        starts = np.cumsum(spans) - spans
        self.size = int(self.ids.max(initial=0)) + 1
        self.code, self.length = np.zeros(self.size, np.uint64), np.zeros(self.size, np.uint8)
        self.code[self.ids], self.length[self.ids] = starts.astype(np.uint64) << np.uint64(64 - self.limit), self.bits  # from the highest bit on
        self.found = np.ones(1 << self.limit, np.int64)  # what starts with these bits: id << 8 | its bits
        self.found[: int(spans.sum())] = np.repeat(self.ids << 8 | self.bits, spans)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bit string in 32-bit words, offset of every STRIDE-th token)."""
        if not len(ids):
            return b"", np.zeros(0, np.int64)
        length = self.length[ids]
        ends = np.cumsum(length, dtype=np.int64)
        at = ends - length
        words = np.zeros((int(ends[-1]) >> 5) + 2, np.uint64)
        place, inside = at >> 5, at & 31
        wide = self.code[ids] >> inside.astype(np.uint64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        words[place[first]] = np.add.reduceat(wide >> np.uint64(32), first)
        over = np.flatnonzero(inside + length > 32)
        words[place[over] + 1] += wide[over] & np.uint64(0xFFFFFFFF)
        return words.astype(">u4").tobytes(), at[::STRIDE]

    def decode(self, bits: bytes, offsets: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` ids of a bit string."""
        return self.decode_all([(bits, offsets, n)])

    def decode_all(self, blocks: list[tuple[bytes, np.ndarray, int]]) -> np.ndarray:
        """The ids of blocks (bit string, offsets, how many ids) one after another; all strides advance together."""
        raw = b"".join([*(x[0] for x in blocks), bytes(8)])
        base = 8 * np.cumsum([0, *(len(x[0]) for x in blocks)])
        at = np.concatenate([x[1].astype(np.int64) + b for x, b in zip(blocks, base, strict=False)])
        left = np.concatenate([x[2] - STRIDE * np.arange(len(x[1])) for x in blocks])
        window = np.ndarray((len(raw) - 7,), ">i8", raw, strides=(1,)).astype(np.int64)  # 64 bits from each byte on
        last, mask, shift = len(window) * 8 - 8, np.int64((1 << self.limit) - 1), 64 - self.limit
        steps = min(STRIDE, int(left.max(initial=0)))
        out = np.empty((steps, len(at)), np.int64)
        for k in range(steps):
            out[k] = self.found[window[at >> 3] >> (shift - (at & 7)) & mask]
            at = np.minimum(at + (out[k] & 255), last)
        ids = (out >> 8).astype(np.uint32).T
        return ids[np.arange(steps) < left[:, None]]


def token_table(docs: DataFrame, tokenizer: str, end_id: int | None = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A stage table (part, key, start in its part, n, ids, seen) in ascending key order within and across parts.

    A part's last row is no document: its start is the part's number of ids, ``seen`` has (id, how often) and ids is null.
    """
    names, pair = ["part", key, "start", "n", "ids", "seen"], pa.struct([("id", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, part_id, before, total, batch = encoder(tokenizer), TaskContext.get().partitionId(), 0, np.zeros(0, np.int64), None
        for batch in batches:
            for part in slices(batch, "_text"):
                flat, counts = with_end(*codes.encode(texts(part, "_text")), end_id)
                start = before + np.cumsum(counts) - counts
                before += int(counts.sum())
                got = np.bincount(flat, minlength=len(total))
                got[: len(total)] += total
                total = got
                small = flat.astype("<u2") if flat.max(initial=0) < 1 << 16 else flat.astype("<u4")
                ids = binary_rows(small, counts).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(counts), part_id, np.int32)), part.column(0), pa.array(start, pa.int64()), pa.array(counts, pa.int64()), ids, pa.nulls(len(counts), pa.list_(pair))], names)
        if batch is not None:
            found = np.flatnonzero(total)
            pairs = pa.StructArray.from_arrays([pa.array(found, pa.int32()), pa.array(total[found], pa.int64())], fields=list(pair))
            seen = pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays([pa.array([part_id], pa.int32()), pa.nulls(1, batch.schema.field(0).type), pa.array([before], pa.int64()), pa.array([0], pa.int64()), pa.nulls(1, pa.binary()), seen], names)

    kind = docs.schema[key].dataType.simpleString()
    ranged = docs.select(key, F.col(text).alias("_text"), F.xxhash64(text).alias("_tie")).repartitionByRange(key, "_tie").sortWithinPartitions(key, "_tie", "_text")
    return stage(ranged.drop("_tie").mapInArrow(run, f"part int, `{key}` {kind}, start long, n long, ids binary, seen array<struct<id: int, n: long>>"), "ids")


def ids_of(cell, n: int) -> np.ndarray:
    """Ids of a stage cell of ``n`` ids with two or four bytes each."""
    return np.frombuffer(cell, "<u2" if len(cell) == 2 * n else "<u4")


def id_counts(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(ids, how often each occurs), summed from the parts, in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            ids, n = batch.column(0).flatten().flatten()
            got = np.bincount(ids, n, minlength=len(total)).astype(np.int64)
            got[: len(total)] += total
            total = got
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found], pa.int64())], ["id", "n"])

    rows = table.where("seen is not null").select("seen").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas().sort_values("id")
    return rows["id"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> None:
    """Write the token file of ``docs`` to the folder ``path``."""
    spark = docs.sparkSession
    table = token_table(docs, tokenizer, end_id, key, text)
    ids, counts = id_counts(table)
    bits = code_lengths(counts, limit)
    sums = {r["part"]: r["start"] for r in table.where("seen is not null").select("part", "start").collect()}
    parts = sorted(sums)
    base = dict(zip(parts, np.cumsum([0, *[sums[p] for p in parts]])[:-1].tolist(), strict=True))
    book = spark.sparkContext.broadcast((ids, bits, base))  # a vocabulary and a number a part
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, bits, base = book.value
        codes = Codebook(ids, bits)
        held: list[tuple[int, object, int, np.ndarray]] = []

        def block() -> pa.RecordBatch:
            data, offsets = codes.encode(np.concatenate([x[3] for x in held]).astype(np.int64))
            part, _, start, _ = held[0]
            made = {"part": [part], "start": [base[part] + start], "keys": [[x[1] for x in held]], "counts": [[len(x[3]) for x in held]], "offsets": [offsets], "bits": [data]}
            held.clear()
            return pa.RecordBatch.from_pydict(made, schema=schema)

        schema = None
        for batch in batches:
            schema = schema or pa.schema([("part", pa.int32()), ("start", pa.int64()), ("keys", pa.list_(batch.schema.field(1).type)), ("counts", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("bits", pa.binary())])
            part, keys, start, n, cells = batch.columns
            for p, k, s, m, cell in zip(part.to_pylist(), keys.to_pylist(), start.to_pylist(), n.to_pylist(), cells, strict=True):
                if held and (held[-1][0] != p or held[-1][2] + len(held[-1][3]) != s or s - held[0][2] >= BLOCK_TOKENS):
                    yield block()
                held.append((p, k, s, ids_of(cell.as_py(), m)))
        if held:
            yield block()

    blocks = table.where("ids is not null").select("part", key, "start", "n", "ids").mapInArrow(run, f"part int, start long, keys array<{kind}>, counts array<long>, offsets array<long>, bits binary")
    blocks.write.option("compression", "zstd").partitionBy("part").parquet(f"{path}/blocks")
    pairs = [(int(i), int(b)) for i, b in zip(ids, bits, strict=True)]
    spark.createDataFrame(pairs, "id int, bits int").coalesce(1).write.parquet(f"{path}/codebook")
    drop(table)


def read_tokens(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids as little-endian unsigned 32-bit integers) of a token file."""
    rows = spark.read.schema("id int, bits int").parquet(f"{path}/codebook").toPandas()
    book = spark.sparkContext.broadcast((rows["id"].to_numpy(np.int64), rows["bits"].to_numpy(np.int64)))
    layout = "start long, keys array<long>, counts array<long>, offsets array<long>, bits binary"
    if not len(rows):
        return spark.createDataFrame([], f"`{key}` long, start long, n_tokens long, ids binary")
    blocks = spark.read.parquet(f"{path}/blocks").select(*[x.split()[0] for x in layout.split(", ")])
    kind = blocks.schema["keys"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codebook(*book.value)
        for batch in batches:
            start, keys, counts, offsets, bits = batch.columns
            each = [c.values.to_numpy(zero_copy_only=False) for c in counts]
            sizes = np.array([int(c.sum()) for c in each], np.int64)
            group = (np.cumsum(sizes) - sizes) // DECODED_TOKENS
            for rows in np.split(np.arange(len(each)), np.flatnonzero(np.diff(group)) + 1):
                flat = codes.decode_all([(bits[k].as_buffer(), offsets[k].values.to_numpy(zero_copy_only=False), int(sizes[k])) for k in rows.tolist()])
                count = np.concatenate([each[k] for k in rows])
                first = np.concatenate([start[int(k)].as_py() + np.cumsum(each[k]) - each[k] for k in rows])
                whole = keys.slice(int(rows[0]), len(rows)).flatten()
                yield pa.RecordBatch.from_arrays([whole, pa.array(first, pa.int64()), pa.array(count, pa.int64()), binary_rows(flat.astype("<u4"), count).cast(pa.binary())], [key, "start", "n_tokens", "ids"])

    return blocks.mapInArrow(run, f"`{key}` {kind}, start long, n_tokens long, ids binary")

"""Near-duplicate documents by min-max hashing.

A document's shingles are hashed to 64 bits once. Each of ``PERMUTATIONS`` maps gives two signature values, the
smallest and the largest of the mapped shingles, so a signature costs half as many evaluations as its length; both
values of two documents agree with a chance equal to their sets' Jaccard similarity. Bands of ``ROWS`` values are
buckets: at a similarity of 0.8 a pair shares none of them with a chance of 5e-6.

Documents with equal sets are one class, with a number of its own, and classes alone enter buckets. No bucket is
expanded into its pairs:

1. each member is compared with the smallest of its bucket, and components of the links found are formed;
2. members outside their bucket's largest component are compared with the first ``FEW`` members of the bucket, which
   links most of them;
3. who is still outside is compared with every member of another component: buckets of more than ``FEW`` members are
   cut into blocks of at most some ``BLOCK_SHINGLES`` shingles, two blocks meet in one task, which counts common
   shingles through one sorted list, and gives only as many links as join their components.

So every pair that shares a bucket is compared or already connected, whatever the bucket's size, and components are
those of all links between pairs that share a bucket. Comparisons are of full sets of 64-bit shingle hashes.

Texts are read three times at most and moved by hash joins on (key, hash of the text) whose other side is slim: once
for the sets of classes that share a bucket, once in ``keep_first``. Every other exchange is by class, pair, bucket or
bucket and salt; adaptive execution splits joins on hot keys, hot sets and buckets are aggregated in their tasks
first. Nothing but counts reaches the driver.

Defined results: null or empty text and text without words have no shingles and are linked with nothing; texts with
fewer words than a shingle are one shingle. A row is a document, whatever its key: rows that repeat a key with other
texts are compared each. A component is named by its smallest key that is not null, or by null without one; a key
may have any type that can be ordered. ``keep_first`` keeps one row of a component, and all rows without shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop, stage
from .arrow import slices, texts, words
from .components import components, extend

PERMUTATIONS, ROWS = 120, 6
BANDS = 2 * PERMUTATIONS // ROWS
FEW = 8
BLOCK_SHINGLES = 1 << 20
SALT_ROWS = 10_000
CACHED = 1 << 15  # shingles that are mapped together
_random = np.random.default_rng(20240229)
FACTORS = _random.integers(0, 1 << 31, PERMUTATIONS, np.uint32) * np.uint32(2) + np.uint32(1)
SHIFTS = _random.integers(0, 1 << 32, PERMUTATIONS, np.uint32)
M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)  # the finalizer of MurmurHash3


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * M1
    x = (x ^ (x >> np.uint64(33))) * M2
    return x ^ (x >> np.uint64(33))


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: runs of ``size`` words in lower case (A-Z only)."""
    row, code, distinct = words(column, lower=True)
    hashed = np.array([xxhash.xxh3_64_intdigest(w.as_buffer()) for w in distinct], np.uint64)[code] if len(code) else np.zeros(0, np.uint64)
    counts = np.bincount(row, minlength=len(column))
    joined = _mix(hashed)
    for k in range(1, size):
        if len(joined) > 1:
            joined = _mix(joined[:-1] + hashed[k:]) if len(hashed) > k else joined[:0]
        else:
            joined = joined[:0]
    out, at = [], 0
    for n in counts.tolist():
        if n >= size:
            out.append(np.unique(joined[at : at + n - size + 1]))
        elif n:
            out.append(np.array([xxhash.xxh3_64_intdigest(hashed[at : at + n].tobytes(), seed=n)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each band of each (non-empty) set's signature: (sets, BANDS)."""
    out = np.empty((len(sets), BANDS), np.uint64)
    at = 0
    while at < len(sets):
        to, total = at, 0
        while to < len(sets) and (to == at or total + len(sets[to]) <= CACHED):
            total += len(sets[to])
            to += 1
        flat = np.concatenate(sets[at:to]).astype(np.uint32)
        starts = np.cumsum([0, *map(len, sets[at : to - 1])])
        signature = np.empty((2 * PERMUTATIONS, to - at), np.uint64)
        for k in range(PERMUTATIONS):
            mapped = flat * FACTORS[k] + SHIFTS[k]
            signature[2 * k] = np.minimum.reduceat(mapped, starts)
            signature[2 * k + 1] = np.maximum.reduceat(mapped, starts)
        for band in range(BANDS):
            key = np.full(to - at, band + 1, np.uint64)
            for value in signature[band * ROWS : (band + 1) * ROWS]:
                key = _mix(key * M2 + value)
            out[at:to, band] = key
        at = to
    return out


def _mark(text: Column):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def signatures(docs: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """(id, mark, n, print, bands): a hash of the text, the set's size, a 128-bit hash of it and its bands; none for an
    empty set."""
    rows = docs.select(F.col(f"`{key}`").alias("id"), _mark(F.col(f"`{text}`")).alias("mark"), F.col(f"`{text}`").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                sets = shingle_sets(texts(part, "_text"), size)
                n = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(n)
                values = bands([sets[k] for k in some]).astype(np.int64).reshape(-1)
                offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
                prints = pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), prints, pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["id", "mark", "n", "print", "bands"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, mark long, n long, print binary, bands array<long>")


def set_table(docs: DataFrame, classes: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """(id, set): the sorted 64-bit hashes of each of ``classes`` (class, print, first), once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                sets = [s.tobytes() for s in shingle_sets(texts(part, "_text"), size)]
                same = [xxhash.xxh3_128_digest(s) == p for s, p in zip(sets, part.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["id", "set"]).filter(pa.array(same))

    rows = docs.select(F.col(f"`{key}`").alias("_id"), _mark(F.col(f"`{text}`")).alias("_mark"), F.col(f"`{text}`").alias("_text"))
    wanted = classes.select("class", "print", "first").hint("shuffle_hash")
    found = rows.join(wanted, F.col("_id").eqNullSafe(F.col("first.id")) & (F.col("_mark") == F.col("first.mark")))
    return found.select("class", "print", "_text").mapInArrow(run, "id long, set binary").dropDuplicates(["id"])


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                good[k] = 100 * common >= percent * (len(both) - common)
            yield batch.select([0, 1]).filter(pa.array(good))

    first, second = sets.toDF("a", "_x"), sets.toDF("b", "_y")
    return pairs.join(first, "a").join(second, "b").select("a", "b", "_x", "_y").mapInArrow(run, "a long, b long")


def placed_rows(docs: DataFrame, size: int, percent: int, key: str, text: str) -> DataFrame:
    """(id, mark, n, head) of each row; head: (none, id, mark) of the first row of its component, null without shingles."""
    signed = stage(signatures(docs, size, key, text), "signatures")
    first = F.struct(F.col("id").isNull().alias("none"), "id", "mark")
    sets_once = signed.where("n > 0").groupBy("print").agg(F.min(first).alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = stage(sets_once.withColumn("class", F.monotonically_increasing_id()), "classes")

    exploded = classes.select(F.col("class").alias("id"), "n", F.explode("bands").alias("bucket"))
    sizes = exploded.groupBy("bucket").agg(F.count("*").alias("size"), F.min("id").alias("first_id"), F.min_by("n", "id").alias("first_n")).where("size > 1")
    buckets = stage(exploded.join(sizes, "bucket"), "buckets")
    pairs = stage(buckets.where((F.col("id") != F.col("first_id")) & _close(percent, "n", "first_n")).select(F.col("first_id").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    shared = classes.join(buckets.select(F.col("id").alias("class")).distinct(), "class", "left_semi")
    sets = stage(set_table(docs, shared, size, key, text), "sets")
    found = components(stage(confirm(pairs, sets, percent), "found"))
    for unsettled_links in (_links_to_few, _links_to_all):
        unsettled = stage(_unsettled(buckets.select("bucket", "size", "id", "n"), found), "unsettled")
        new = stage(unsettled_links(unsettled, pairs, sets, percent), "found")
        if not new.isEmpty():
            found = extend(found, new)
        drop(unsettled)

    linked = classes.select("print", "first", "class").join(found.toDF("class", "component"), "class")
    heads = linked.groupBy("component").agg(F.min("first").alias("head"))
    placed = stage(linked.join(heads, "component").select(F.col("print").alias("_print"), "head"), "heads")
    firsts = classes.select("print", "first").join(placed, F.col("print") == F.col("_print"), "left").select("print", F.coalesce("head", "first").alias("head"))
    drop(buckets, pairs, sets)
    return signed.select("id", "mark", "n", "print").join(firsts, "print", "left").select("id", "mark", "n", "head")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) of each row."""
    whole = F.when(F.col("head").isNull(), F.col("id")).otherwise(F.col("head.id"))
    rows = placed_rows(docs, size, percent, key, text)
    return rows.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), whole.alias("component_id"), F.col("id").eqNullSafe(whole).alias("kept"))


def _close(percent: int, m: str, n: str):
    """Whether sizes alone leave a link possible."""
    return 100 * F.least(m, n) >= percent * F.greatest(m, n)


def _unsettled(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """Members, with their components so far, of buckets of three members or more that span two components or more;
    main: the component most members are in."""
    placed = buckets.where("size > 2").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    parts = placed.groupBy("bucket", "component").agg(F.count("*").alias("k"))
    mains = parts.groupBy("bucket").agg(F.count("*").alias("parts"), F.max(F.struct("k", "component")).alias("most")).where("parts > 1")
    return placed.join(mains.select("bucket", F.col("most.component").alias("main")), "bucket")


def _links_to_few(unsettled: DataFrame, done: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of members outside their bucket's main component to the first FEW of it, which the first FEW of each share
    of it contain."""
    salt = F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / SALT_ROWS))
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
    shares = unsettled.withColumn("_salt", salt).withColumn("_place", place("bucket", "_salt")).where(F.col("_place") <= FEW)
    few = shares.withColumn("_place", place("bucket")).where(F.col("_place") <= FEW)
    partners = few.select("bucket", F.col("id").alias("_id"), F.col("n").alias("_n"), F.col("component").alias("_component"))
    apart = (F.col("component") != F.col("_component")) & _close(percent, "n", "_n")
    pairs = unsettled.where("component <> main").select("bucket", "id", "n", "component").join(partners, "bucket").where(apart)
    named = pairs.select(F.least("id", "_id").alias("a"), F.greatest("id", "_id").alias("b")).distinct()
    return confirm(stage(named.join(done, ["a", "b"], "left_anti"), "pairs"), sets, percent)


def _links_to_all(unsettled: DataFrame, done: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of members outside their bucket's main component to any member; of each two components that a group of
    blocks finds linked, directly or by others, as many links as join them."""
    larger = unsettled.where(F.col("size") > FEW)
    blocks = lambda n: F.ceil(F.coalesce(F.sum(n), F.lit(1)) / BLOCK_SHINGLES)
    outside = F.when(F.col("component") != F.col("main"), F.col("n"))
    sizes = larger.groupBy("bucket").agg(blocks(outside).alias("own_blocks"), blocks(F.col("n")).alias("all_blocks"))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    full = larger.join(sizes, "bucket").join(sets, "id")
    own = full.where("component <> main").withColumn("own", deal("own_blocks")).withColumn("other", every("all_blocks"))
    other = full.withColumn("other", deal("all_blocks")).withColumn("own", every("own_blocks"))
    keys, columns = ["bucket", "own", "other"], ["id", "component", "set"]
    arrow = lambda df: df.select(*keys, *columns).toDF(*keys, *columns).groupBy(*keys)
    return arrow(own).cogroup(arrow(other)).applyInArrow(lambda x, y: spanning_links(x, y, percent), "a long, b long")


def spanning_links(own: pa.Table, other: pa.Table, percent: int) -> pa.Table:
    """Links (a, b) of rows of ``own`` with rows of ``other`` (id, component, set) that join components; every pair of
    rows is compared by their full sets unless links found before join it already."""
    first, second = [], []
    if own.num_rows and other.num_rows:
        y_id, y_sets = other["id"].to_numpy(), [np.frombuffer(v.as_buffer(), np.uint64) for v in other["set"]]
        y_n = np.array([len(v) for v in y_sets])
        flat, owner = np.concatenate(y_sets), np.repeat(np.arange(len(y_sets)), y_n)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        part = np.unique(np.concatenate([own["component"].to_numpy(), other["component"].to_numpy()]), return_inverse=True)[1]
        for k, (x_id, cell) in enumerate(zip(own["id"].to_pylist(), own["set"], strict=True)):
            x, y_part = np.frombuffer(cell.as_buffer(), np.uint64), part[own.num_rows :]
            able = (y_part != part[k]) & (100 * np.minimum(len(x), y_n) >= percent * np.maximum(len(x), y_n))
            if not able.any():
                continue
            low, high = np.searchsorted(flat, x, "left"), np.searchsorted(flat, x, "right")
            lengths = high - low
            at = np.repeat(low - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
            common = np.bincount(owner[at], minlength=len(y_sets))
            linked = np.flatnonzero(able & (100 * common >= percent * (len(x) + y_n - common)))
            for j in linked[np.unique(y_part[linked], return_index=True)[1]].tolist():
                first.append(min(x_id, int(y_id[j])))
                second.append(max(x_id, int(y_id[j])))
                part[part == part[own.num_rows + j]] = part[k]
    return pa.table({"a": pa.array(first, pa.int64()), "b": pa.array(second, pa.int64())})


def keep_first(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` of each component, one with its smallest key, and all rows without shingles."""
    rows = stage(placed_rows(docs.select(key, text), size, percent, key, text).where("n > 0"), "rows")
    stays = F.col("id").eqNullSafe(F.col("head.id")) & (F.col("mark") == F.col("head.mark"))
    gone = rows.where(~stays).select("id", "mark").distinct()
    again = rows.where(stays).groupBy("id", "mark").count().where("count > 1").select("id", "mark")

    def joined(named: DataFrame, how: str) -> DataFrame:
        slim = named.hint("shuffle_hash")
        return docs.join(slim, docs[f"`{key}`"].eqNullSafe(slim["id"]) & (_mark(docs[f"`{text}`"]) == slim["mark"]), how)

    if again.isEmpty():
        return joined(gone, "left_anti")
    return joined(gone.union(again), "left_anti").union(joined(again, "left_semi").dropDuplicates([key, text]))

"""Near-duplicate vectors by an inverted multi-index.

Unit vectors are halved and each half has its own codebook (k-means on a bounded sample), so a vector's cell is one of
their product grid. Codebooks grow with the root of the number of vectors, so that a cell holds about a block of them.
Every vector is indexed in its cell. A query visits the cells of the grid nearest first by the multi-sequence
traversal: of each entry of the first codebook the next cell is at hand, and the nearest of these is visited. How many
it visits is measured: ``CALIBRATE`` sampled vectors are compared with all vectors of their label, and the number is the
smallest, from ``LEAST_VISITS``, at which the true pairs found, from either side, reach ``TARGET``, both as a mean over
those vectors and as a share of their links (of each vector's partners in a batch, ``PARTNERS`` are placed in the order
and stand for all). If they have no pairs, pairs are planted: each with a copy turned to just the cosine asked for.

Candidates meet in blocks: a cell of one label is cut into blocks of at most ``BLOCK`` index rows, the queries that
visit it into blocks as well, and each pair of blocks is one group, whose cosines are one matrix product in double
precision. A group returns counts and a spanning set of its links, never its pairs. A pair is found from the side
of each vector whose visits contain the other's cell; the indexed side carries its own visits, so that a pair counts
once for both whichever side finds it.

Equal vectors of one label are one class, with a number of its own and a weight. Bounds: sample, codebooks and
calibration are of fixed size; a group holds at most BLOCK + BLOCK rows; only counts of blocks, a number a cell, are
aggregated.

Defined results: vectors that are null, zero, or hold null or non-finite components, null labels and null ids link
with nothing; vectors of another length than most of the sample's are compared by one cell of their own length;
repeated ids are one vector each row; ids and labels may have any type that can be ordered; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop, stage
from .components import components

LEAST_CENTROIDS, MOST_CENTROIDS = 16, 1_000
SAMPLE = 20_000
CALIBRATE = 2_000
PARTNERS = 16
TARGET = 0.999
LEAST_VISITS = 8
BLOCK = 1024
ROUNDS = 12
ROWS = 1024  # that are compared with the sample together


def k_means(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    random = np.random.default_rng(seed)
    centers = x[random.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _distances(x, centers).argmin(1)
        for c in range(len(centers)):
            own = x[near == c]
            centers[c] = own.mean(0) if len(own) else x[random.integers(len(x))]
    return centers


def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances."""
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ centers.T + (centers**2).sum(1)[None], 0)


class Grid:
    """The product of two codebooks."""

    def __init__(self, first: np.ndarray, second: np.ndarray) -> None:
        self.books = first, second
        self.half = first.shape[1]

    @classmethod
    def fit(cls, sample: np.ndarray, k: int = LEAST_CENTROIDS) -> Grid:
        half = sample.shape[1] // 2
        return cls(k_means(sample[:, :half], k), k_means(sample[:, half:], k))

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _distances(unit[:, : self.half], self.books[0]), _distances(unit[:, self.half :], self.books[1])

    def visits(self, unit: np.ndarray, most: int) -> np.ndarray:
        """The ``most`` nearest cells of each vector, nearest first: (vectors, most)."""
        a, b = self.distances(unit)
        by_a, by_b = a.argsort(1, kind="stable"), b.argsort(1, kind="stable")
        i, j = multi_sequence(np.take_along_axis(a, by_a, 1), np.take_along_axis(b, by_b, 1), min(most, self.cells))
        return (np.take_along_axis(by_a, i, 1) * b.shape[1] + np.take_along_axis(by_b, j, 1)).astype(np.int32)

    def ranks(self, unit: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """How many cells each vector visits before the one named for it."""
        a, b = self.distances(unit)
        row, width = np.arange(len(unit)), b.shape[1]
        target = a[row, cells // width] + b[row, cells % width]
        a, out = np.sort(a, 1), np.zeros(len(unit), np.int64)
        least = b.min(1)
        for k in range(a.shape[1]):
            near = np.flatnonzero(a[:, k] + least < target)
            if not len(near):
                break
            for at in range(0, len(near), ROWS):
                some = near[at : at + ROWS]
                out[some] += (a[some, k][:, None] + b[some] < target[some][:, None]).sum(1)
        return out

    @property
    def cells(self) -> int:
        return len(self.books[0]) * len(self.books[1])


def multi_sequence(a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, the first ``most`` index pairs (i, j) by ascending a[i] + b[j], of rows that ascend: (rows, most) each."""
    n, row = len(a), np.arange(len(a))
    first, second = np.empty((n, most), np.int64), np.empty((n, most), np.int64)
    b = np.concatenate([b, np.full((n, 1), np.inf)], 1)
    ahead = np.zeros(a.shape, np.int64)  # of each i, the next j
    sums = a + b[:, :1]
    for k in range(most):
        i = sums[:, : k + 1].argmin(1)  # an i opens only after those before it
        first[:, k], second[:, k] = i, ahead[row, i]
        ahead[row, i] += 1
        sums[row, i] = a[row, i] + b[row, ahead[row, i]]
    return first, second


def unit_rows(vectors: pa.Array) -> np.ndarray:
    """Unit vectors in double precision of list rows of one length."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _unit(flat.reshape(len(vectors), -1))


def usable(vector: str):
    v = F.col(vector)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & sound & F.exists(v, lambda x: x != 0)


def fit(rows: DataFrame, cosine: float) -> tuple[Grid, int] | None:
    """A grid from a sample, and how many cells reach the target recall from either side; None without rows."""
    size = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if size is None:
        return None
    even = rows.where(F.size("vector") == size["size"])
    sample = even.orderBy(F.xxhash64("class", "vector"), "class").limit(SAMPLE).select("vector").toPandas()["vector"]
    k = min(MOST_CENTROIDS, max(LEAST_CENTROIDS, math.ceil(math.sqrt(size["count"] / BLOCK))))
    grid = Grid.fit(_unit(np.stack([np.asarray(v, np.float64) for v in sample])), k) if size["size"] > 1 else Grid(np.zeros((1, 0)), np.zeros((1, 1)))
    asked = even.orderBy(F.xxhash64("vector", "class"), "class").limit(CALIBRATE).select("class", "label", "vector").toPandas()
    vectors = _unit(np.stack([np.asarray(v, np.float64) for v in asked["vector"]]))
    queries = even.sparkSession.sparkContext.broadcast((asked["class"].to_numpy(), asked["label"].to_numpy(), vectors, grid))

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, q, grid = queries.value
        homes = grid.visits(q, 1)[:, 0]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                y, y_labels = unit_rows(part.column(2)), part.column(1).to_numpy(zero_copy_only=False)
                true = (q @ y.T >= cosine) & (labels[:, None] == y_labels[None]) & (ids[:, None] != part.column(0).to_numpy()[None])
                n = true.sum(1)
                i, j = np.nonzero(true & (np.cumsum(true, 1) <= PARTNERS))
                if len(i):
                    best = np.minimum(grid.ranks(q[i], grid.visits(y, 1)[j, 0]), grid.ranks(y[j], homes[i]))
                    each = n[i] / np.minimum(n[i], PARTNERS)
                    yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(best, pa.int64()), pa.array(each, pa.float64())], ["query", "rank", "n"])

    found = even.select("class", "label", "vector").mapInArrow(ranks, "query long, rank long, n double")
    counted = found.groupBy("query", "rank").agg(F.sum("n").alias("n")).toPandas()  # of CALIBRATE queries
    if not len(counted):
        turned = _turned(vectors, cosine)
        best = np.minimum(grid.ranks(vectors, grid.visits(turned, 1)[:, 0]), grid.ranks(turned, grid.visits(vectors, 1)[:, 0]))
        counted = pd.DataFrame({"query": np.arange(len(best)), "rank": best, "n": 1.0})
    by_vector = counted["n"] / counted.groupby("query")["n"].transform("sum")
    most = LEAST_VISITS
    for weight in (by_vector, counted["n"]):
        order = np.argsort(counted["rank"].to_numpy(), kind="stable")
        reached = np.cumsum(weight.to_numpy()[order]) / weight.sum()
        most = max(most, int(counted["rank"].to_numpy()[order][min(int(np.searchsorted(reached, TARGET)), len(order) - 1)]) + 1)
    return grid, min(grid.cells, most)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def _turned(unit: np.ndarray, cosine: float) -> np.ndarray:
    """Of each unit vector, one at this cosine to it in a random direction."""
    side = np.random.default_rng(5).normal(size=unit.shape)
    side -= (side * unit).sum(1)[:, None] * unit
    lengths = np.sqrt((side * side).sum(1))[:, None]
    side = np.divide(side, lengths, out=np.zeros_like(side), where=lengths > 0)
    return cosine * unit + math.sqrt(max(0.0, 1 - cosine * cosine)) * side


def near_vectors(df: DataFrame, cosine: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, n_links, component_id, kept) of each row."""
    rows = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("vector"))
    fine = rows.where(usable("vector") & F.col("label").isNotNull() & F.col("id").isNotNull())
    grouped = fine.groupBy("label", "vector").agg(F.min("id").alias("first"), F.count("*").alias("weight"))
    classes = stage(grouped.withColumn("class", F.monotonically_increasing_id()), "vectors")
    fitted = fit(classes, cosine)
    if fitted is None:
        return rows.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    index = _index(classes, *fitted)
    found = stage(_compare(index, cosine), "near")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    groups = components(found.where("root <> id").select(F.col("id").alias("a"), F.col("root").alias("b")))
    placed = classes.join(groups.toDF("class", "component"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = placed.groupBy("component").agg(F.min("first").alias("least"))
    judged = placed.join(least, "component").join(counts.toDF("class", "n"), "class", "left").select(
        F.col("label").alias("_label"), F.col("vector").alias("_vector"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("_n"), F.col("least").alias("_component")
    )
    joined = rows.join(judged, (F.col("label") == F.col("_label")) & (F.col("vector") == F.col("_vector")), "left")
    known = F.col("id").isNotNull()
    component = F.coalesce(F.when(known, F.col("_component")), "id")
    drop(index)
    return joined.select(F.col("id").alias(key), F.coalesce(F.when(known, F.col("_n")), F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _index(classes: DataFrame, grid: Grid, most: int) -> DataFrame:
    """A stage table of the classes with their visits; the first is their cell. Vectors of another length visit cell
    -length alone."""
    shared = classes.sparkSession.sparkContext.broadcast(grid)
    width = grid.books[0].shape[1] + grid.books[1].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = shared.value
        for batch in batches:
            cells = [np.array([-len(v)], np.int32) for v in batch.column(3)]
            even = np.flatnonzero([len(v) == width for v in batch.column(3)])
            if len(even):
                for k, v in zip(even, grid.visits(unit_rows(batch.column(3).take(pa.array(even))), most), strict=True):
                    cells[k] = v
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], ["id", "label", "weight", "vector", "visits"])

    kind = lambda c: classes.schema[c].dataType.simpleString()
    return stage(classes.select("class", "label", "weight", "vector").mapInArrow(run, f"id long, label {kind('label')}, weight long, vector {kind('vector')}, visits array<int>"), "index")


def _compare(index: DataFrame, cosine: float) -> DataFrame:
    """(id, n, root): of each vector in each pair of blocks, the weight of the links counted and the least id it
    reaches there."""
    kept = index.withColumn("cell", F.col("visits")[0])
    asks = index.withColumn("cell", F.explode("visits"))
    blocks = lambda df, name: df.groupBy("label", "cell").agg(F.ceil(F.count("*") / BLOCK).alias(name))
    sizes = blocks(kept, "own_blocks").join(blocks(asks, "ask_blocks"), ["label", "cell"])
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = kept.join(sizes, ["label", "cell"]).withColumn("own", deal("own_blocks")).withColumn("ask", every("ask_blocks"))
    ask = asks.join(sizes, ["label", "cell"]).withColumn("ask", deal("ask_blocks")).withColumn("own", every("own_blocks"))
    columns = ["label", "cell", "own", "ask", "id", "weight", "vector"]

    def group(own: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"id": [], "n": [], "root": []}).astype("int64")
        if own.empty or ask.empty:
            return none
        y, x = (np.stack([np.asarray(v, np.float64) for v in d["vector"]]) for d in (own, ask))
        y, x = _unit(y), _unit(x)
        y_id, x_id = own["id"].to_numpy(), ask["id"].to_numpy()
        link = (x @ y.T >= cosine) & (x_id[:, None] != y_id[None])
        home = ask["home"].to_numpy()
        mutual = np.zeros(link.shape, bool)  # the other side finds the pair too: each counts its own
        for k, v in enumerate(own["visits"]):
            mutual[:, k] = np.isin(home, v)
        ahead = link @ own["weight"].to_numpy()
        back = (link & ~mutual).T @ ask["weight"].to_numpy()
        ids = np.concatenate([x_id, y_id])
        n = np.concatenate([ahead, back])
        root, size = ids.copy(), len(x_id)
        far = np.iinfo(np.int64).max
        while True:
            least_x = np.where(link, root[size:][None], far).min(1, initial=far)
            new = np.minimum(root, np.concatenate([least_x, np.full(len(y_id), far)]))
            new[size:] = np.minimum(new[size:], np.where(link, new[:size][:, None], far).min(0, initial=far))
            if (new == root).all():
                break
            root = new
        some = (n > 0) | (root != ids)
        return pd.DataFrame({"id": ids[some], "n": n[some], "root": root[some]}).astype("int64")

    keys = ["label", "cell", "own", "ask"]
    left = own.select(*columns, "visits")
    right = ask.select(*columns, F.col("visits")[0].alias("home")).toDF(*columns, "home")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(group, "id long, n long, root long")

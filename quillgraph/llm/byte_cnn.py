"""A quality classifier: a convolutional network on bytes, in numpy.

A text is its UTF-8 bytes. Filters of ``WIDTH`` bytes slide over it; their rectified responses are averaged within
chunks of ``CHUNK`` bytes that overlap by half and together cover the whole text; a hidden layer judges each chunk; the
largest value of each hidden unit over all chunks goes to a logistic output. Averages within a chunk show habits
of spelling and repetition, the maximum finds one bad passage in a long text. A response depends on a byte's place
only through its neighbours, so it is a sum of table look-ups.

Training: filters, hidden layer and output are learned together by Adam on a sample of at most ``SAMPLE`` labelled
texts of each label. A step reads every byte of its texts, as scoring does, and goes back through the chunks that hold a
hidden unit's maximum, ``HIDDEN`` at most a text. Tasks hold a slice of a few megabytes and the weights (some 100 kB).

Defined results: a null or empty text is one chunk of zero bytes and gets a score; equal texts get equal scores;
without labels of both kinds the score is the share of label 1 (0.5 without any); labels with a null are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import slices

WIDTH, FILTERS, HIDDEN = 4, 24, 16
CHUNK = 256
SAMPLE = 1_000
EPOCHS, STEP_TEXTS, RATE = 9, 16, 0.01


@dataclass
class Network:
    tables: np.ndarray  # (WIDTH, 256, FILTERS): what a byte at each place adds to each filter
    hidden: np.ndarray  # (2 * FILTERS + 1, HIDDEN)
    output: np.ndarray  # (HIDDEN + 1,)
    prior: float = 0.5
    trained: bool = True

    def responses(self, data: np.ndarray) -> np.ndarray:
        """Rectified filter responses at each byte of ``data`` but the last WIDTH - 1."""
        n = len(data) - WIDTH + 1
        out = self.tables[0].take(data[:n], 0)
        for k in range(1, WIDTH):
            out += self.tables[k].take(data[k : k + n], 0)
        return np.maximum(out, 0, out=out)


def padded(raw: bytes) -> np.ndarray:
    """Bytes with zeros to a whole number of half chunks, two at least, and WIDTH - 1 more."""
    half = CHUNK // 2
    n = max(2, -(-len(raw) // half)) * half + WIDTH - 1
    return np.frombuffer(raw.ljust(n, b"\0"), np.uint8)


def chunk_features(net: Network, half_sums: np.ndarray, half_peaks: np.ndarray) -> np.ndarray:
    """Mean and largest response of each filter in chunks made of neighbouring halves, and a constant."""
    mean = (half_sums[:-1] + half_sums[1:]) / CHUNK
    return np.concatenate([mean, np.maximum(half_peaks[:-1], half_peaks[1:]) * 0.25, np.ones((len(mean), 1), mean.dtype)], 1)


def score(net: Network, raws: list[bytes]) -> np.ndarray:
    """The probability of label 1 of each text; texts are run through together."""
    if not net.trained:
        return np.full(len(raws), net.prior)
    half = CHUNK // 2
    parts = [padded(r) for r in raws]
    out = np.empty(len(raws))
    group, size = [], 0
    for k, part in enumerate(parts):
        group.append(k)
        size += len(part)
        if size >= 1 << 16 or k + 1 == len(parts):
            halves = [(len(parts[j]) - WIDTH + 1) // half for j in group]
            sums, peaks = _halves(net, [parts[j] for j in group])
            at = np.cumsum([0, *halves])
            for j, a, b in zip(group, at[:-1], at[1:], strict=True):
                hidden = np.maximum(chunk_features(net, sums[a:b], peaks[a:b]) @ net.hidden, 0)
                out[j] = 1 / (1 + np.exp(-np.clip(hidden.max(0) @ net.output[:-1] + net.output[-1], -40, 40)))
            group, size = [], 0
    return out


PIECE = 1 << 13


def _halves(net: Network, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    half = CHUNK // 2
    sums, peaks = [], []
    for part in parts:
        whole = len(part) - WIDTH + 1
        for at in range(0, whole, PIECE):
            r = net.responses(part[at : min(at + PIECE, whole) + WIDTH - 1]).reshape(-1, half, FILTERS)
            sums.append(r.sum(1))
            peaks.append(r.max(1))
    return np.concatenate(sums), np.concatenate(peaks)


def train(texts: list[bytes], labels: np.ndarray, seed: int = 11) -> Network:
    """A network for P(label = 1); both labels weigh the same."""
    random = np.random.default_rng(seed)
    if len(set(labels.tolist())) < 2:
        return Network(np.zeros((WIDTH, 256, FILTERS), np.float32), np.zeros((2 * FILTERS + 1, HIDDEN), np.float32), np.zeros(HIDDEN + 1), float(labels.mean()) if len(labels) else 0.5, False)
    net = Network(
        random.normal(0, 0.5, (WIDTH, 256, FILTERS)).astype(np.float32),
        random.normal(0, 0.4, (2 * FILTERS + 1, HIDDEN)).astype(np.float32),
        random.normal(0, 0.4, HIDDEN + 1).astype(np.float32),
    )
    data = [padded(t) for t in texts]
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (net.tables, net.hidden, net.output)]
    step = 0
    for epoch in range(EPOCHS):
        order = random.permutation(len(data))
        rate = RATE * (1 - epoch / EPOCHS) + RATE / 20
        for first in range(0, len(order), STEP_TEXTS):
            grads = [np.zeros_like(p) for p in (net.tables, net.hidden, net.output)]
            batch = order[first : first + STEP_TEXTS]
            for k in batch:
                _gradient(net, data[k], labels[k], weight[k] / len(batch), grads)
            step += 1
            for p, g, (m, v) in zip((net.tables, net.hidden, net.output), grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
    return net


def _gradient(net: Network, data: np.ndarray, label: int, weight: float, grads: list[np.ndarray]) -> None:
    """Add the gradient of one text's loss: forward over the whole text, back through each hidden unit's best chunk."""
    half, every = CHUNK // 2, np.arange(FILTERS)
    features = chunk_features(net, *_halves(net, [data]))
    hidden = features @ net.hidden
    best = hidden.argmax(0)
    top = np.maximum(hidden[best, np.arange(HIDDEN)], 0)
    p = 1 / (1 + np.exp(-np.clip(top @ net.output[:-1] + net.output[-1], -40, 40)))
    d = np.float32(weight * (p - label))
    grads[2][:-1] += d * top
    grads[2][-1] += d
    d_top = d * net.output[:-1] * (top > 0)
    used = np.flatnonzero(d_top)
    if not len(used):
        return
    grads[1][:, used] += features[best[used]].T * d_top[used]
    chunks, at = np.unique(best[used], return_inverse=True)
    d_features = np.zeros((len(chunks), features.shape[1]), np.float32)
    np.add.at(d_features, at, (net.hidden[:, used] * d_top[used]).T)
    parts = data[(chunks * half)[:, None] + np.arange(CHUNK + WIDTH - 1)]
    r = sum(net.tables[k].take(parts[:, k : k + CHUNK], 0) for k in range(WIDTH))
    d_r = np.repeat(d_features[:, None, :FILTERS] / CHUNK, CHUNK, 1)
    d_r[np.arange(len(chunks))[:, None], r.argmax(1), every] += d_features[:, FILTERS : 2 * FILTERS] * np.float32(0.25)
    d_r = (d_r * (r > 0)).reshape(-1, FILTERS)
    for k in range(WIDTH):
        values = parts[:, k : k + CHUNK].reshape(-1)
        order = np.argsort(values, kind="stable")
        starts = np.flatnonzero(np.diff(values[order], prepend=-1))
        grads[0][k][values[order[starts]]] += np.add.reduceat(d_r[order], starts, 0)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """Train on at most ``sample`` texts of each label, in the order of a hash of their ids, among labels of ids that
    ``docs`` has. The ids of that sample, a bounded number, are sent to the tasks that read the texts."""
    there = docs.where("doc_id IS NOT NULL").select("doc_id").distinct()
    fine = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality")).join(there, "doc_id", "left_semi")
    picked = fine.where("quality = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).union(fine.where("quality = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").orderBy("doc_id", "text").select("text", "quality").toPandas()
    return train([(t or "").encode() for t in rows["text"]], rows["quality"].to_numpy())


def add_score(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """``docs`` without the text and with its score."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kept = [c for c in docs.columns if c not in (text, "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, len(kept)):
                raws = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in part.column(len(kept)).cast(pa.large_string())]
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in range(len(kept))], pa.array(score(shared.value, raws), pa.float64())], [*kept, "score"])

    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept], "score double"])
    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("_text")).mapInArrow(run, schema)


def held_out(key: str = "doc_id", folds: int = 4, fold: int = 2):
    """Rows never learned from: crc32(key as text) mod folds = fold."""
    return F.crc32(F.col(key).cast("string")) % folds == fold


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    net = fit(docs, labels.where(~held_out()))
    out = F.coalesce(held_out(), F.lit(False))
    return add_score(docs.select("doc_id", "text"), net).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` at least, with all their columns."""
    net = fit(docs, labels.where(~held_out()))
    shared = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                raws = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in part.column(at).cast(pa.large_string())]
                yield part.filter(pa.array(score(shared.value, raws) >= threshold))

    return docs.mapInArrow(run, docs.schema)

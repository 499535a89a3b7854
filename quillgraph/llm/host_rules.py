"""Quality rules on documents and on the hosts they come from.

Each document gets counts and fails the base rules or not. A host's failures are counted, its failure rate is
shrunk towards all hosts' rates by a beta prior fitted to those rates (method of moments), and a host whose
shrunk rate exceeds ``max_rate`` loses all its documents.

The text is read by a function over Arrow batches whose sorts and counts run on whole batches. ``judge`` writes the
slim counts to a stage table. ``keep_good`` reads texts twice, for the hosts' sums and for the rows, and neither writes
nor moves them between tasks. Sums are partial sums in each task first; a host with any share of the rows is one row
in the join's other side.

Defined results: a null or empty text has no words and fails; a null host has no verdict, so its documents
are judged by the base rules alone; repeated rows count each; an empty table gives an empty result; columns
of ``judge`` named like a result are replaced; ``keep_good`` carries all columns along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import stage
from .arrow import slices, texts, words

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = b"#*$%&|<>"
SLICE = 2 << 20
SPACES = b" \t\n\x0b\f\r"
NOT_COUNTED = SPACES + bytes(range(0x80, 0xC0))  # continuation bytes: what is left is one byte a code point


def text_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of each text of a batch."""
    n = len(column)
    row, word, distinct = words(column)
    out = {"n_words": np.bincount(row, minlength=n)}
    raw = [t.as_buffer().to_pybytes() for t in column]
    out["word_chars"] = np.array([len(b.translate(None, NOT_COUNTED)) for b in raw], np.int64)
    out["n_symbols"] = np.array([len(b) - len(b.translate(None, SYMBOLS)) for b in raw], np.int64)
    out["n_dup_lines"] = np.array([len(lines) - len(set(lines)) for lines in ([x for x in b.split(b"\n") if x.strip()] for b in raw)], np.int64)
    out["n_repeat_words"] = _repeat_words(row, word, len(distinct), n)
    return {k: out[k].astype(np.int64) for k in COUNTS}


def _repeat_words(row: np.ndarray, word: np.ndarray, n_distinct: int, n_rows: int) -> np.ndarray:
    """Words of each row that lie in a window of three words found twice or more in that row."""
    if len(word) < 3:
        return np.zeros(n_rows, np.int64)
    inside = row[2:] == row[:-2]
    pairs = np.unique(word[:-2] * n_distinct + word[1:-1], return_inverse=True)[1]  # a rank: three indexes would not fit 64 bits
    _, rank, times = np.unique(pairs * n_distinct + word[2:], return_inverse=True, return_counts=True)
    _, same, times = np.unique(rank * n_rows + row[2:], return_inverse=True, return_counts=True)
    found = np.flatnonzero(inside & (_times_inside(same, inside, len(times)) >= 2))
    covered = np.zeros(len(word), bool)
    for k in range(3):
        covered[found + k] = True
    return np.bincount(row[covered], minlength=n_rows)


def _times_inside(same: np.ndarray, inside: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(same[inside], minlength=n)[same]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            counts = text_counts(texts(part, "text"))
            kept = [c for c in part.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *map(pa.array, counts.values())], [*kept, *counts])


def document_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without the text and with COUNTS of it."""
    kept = [c for c in df.columns if c != text and c not in COUNTS]
    schema = StructType([*[df.schema[c] for c in kept], *[StructField(c, LongType()) for c in COUNTS]])
    return df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("text")).mapInArrow(_count_batches, schema)


def base_failed(n_words, n_repeat_words, min_words: int = 50, max_repeat_percent: int = 50):
    """The base verdict, of columns or of arrays."""
    return (n_words < min_words) | (100 * n_repeat_words > max_repeat_percent * n_words)


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """(a, b) of a beta prior with the mean and the spread of the hosts' rates (n, failed), beyond what chance
    alone spreads. One row comes to the driver."""
    rate = F.col("failed") / F.col("n")
    got = hosts.agg(F.count("*").alias("k"), F.avg(rate).alias("mean"), F.var_pop(rate).alias("var"), F.avg(1 / F.col("n")).alias("chance")).first()
    if not got["k"]:
        return 1.0, 1.0
    mean = min(max(got["mean"], 1e-6), 1 - 1e-6)
    spread = got["var"] - mean * (1 - mean) * got["chance"]
    weight = min(max(mean * (1 - mean) / spread - 1, 1.0), 1e6) if spread > 0 else 1e6
    return mean * weight, (1 - mean) * weight


def host_sums(judged: DataFrame, host: str) -> DataFrame:
    """(_host, n, failed) of each host that is not null."""
    name = F.col(f"`{host}`")
    return judged.where(name.isNotNull()).groupBy(name.alias("_host")).agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("int")).alias("failed"))


def host_rates(hosts: DataFrame) -> DataFrame:
    """(_host, host_rate) of hosts (_host, n, failed)."""
    a, b = beta_prior(hosts)
    return hosts.select("_host", ((F.col("failed") + a) / (F.col("n") + a + b)).alias("host_rate"))


def judge(df: DataFrame, text: str = "text", host: str = "source", max_rate: float = 0.5, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """``df`` without the text, with COUNTS, base_failed, host_rate (shrunk) and kept."""
    counts = document_counts(df, text).drop("base_failed", "host_rate", "kept")
    judged = stage(counts.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words"), min_words, max_repeat_percent)), "rules")
    joined = judged.join(rates := host_rates(host_sums(judged, host)), judged[f"`{host}`"] == rates["_host"], "left").drop("_host")
    return joined.withColumn("kept", ~F.col("base_failed") & (F.coalesce("host_rate", F.lit(0.0)) <= max_rate))


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = 0.5, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns. Each row goes by its own verdict, whatever its
    key; only the hosts that lose their documents are joined."""
    hosts = docs.select(F.col(f"`{host}`").alias("_host"), F.col(f"`{text}`").alias("text"))
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"), min_words, max_repeat_percent)
    judged = document_counts(hosts).select("_host", failed.alias("base_failed"))
    sums = stage(host_sums(judged, "_host"), "hosts")
    gone = host_rates(sums).where(F.col("host_rate") > max_rate).select("_host")
    at = docs.columns.index(text)

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at, SLICE):
                n = text_counts(texts(part, at))
                yield part.filter(pa.array(~base_failed(n["n_words"], n["n_repeat_words"], min_words, max_repeat_percent)))

    kept = docs.mapInArrow(good, docs.schema)
    return kept.join(gone, kept[f"`{host}`"] == gone["_host"], "left_anti")

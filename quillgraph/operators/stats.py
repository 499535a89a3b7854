"""Statistics of a graph: sums by node and predicate, made once where the triples are, and small aggregations of these."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def node_sums(triples: DataFrame) -> DataFrame:
    """(node, p, n_out, n_in) of ``triples`` (s, p, o; each once): how often a node is subject and object of a predicate."""
    end = lambda node, out: F.struct(F.col(node).alias("node"), "p", F.lit(out).alias("n_out"), F.lit(1 - out).alias("n_in"))
    return triples.select(F.inline(F.array(end("s", 1), end("o", 0)))).groupBy("node", "p").agg(F.sum("n_out").alias("n_out"), F.sum("n_in").alias("n_in"))


def sizes(triples: DataFrame) -> DataFrame:
    """One row: n_triples, n_nodes, n_predicates and density, n_triples / (n_nodes (n_nodes - 1) n_predicates)."""
    sums = node_sums(triples)
    nodes = sums.groupBy("node").agg(F.lit(1).alias("one")).agg(F.count("one").alias("n_nodes"))
    both = sums.groupBy("p").agg(F.sum("n_out").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_triples"), F.count("n").alias("n_predicates")).crossJoin(nodes)  # one row each
    n = F.col("n_nodes").cast("double")
    return both.select("n_triples", "n_nodes", "n_predicates", (F.col("n_triples") / F.nullif(n * (n - 1) * F.col("n_predicates"), F.lit(0.0))).alias("density"))


def degrees(triples: DataFrame, end: str) -> DataFrame:
    """(node, degree): triples with the node as subject (``s``) or object (``o``)."""
    return triples.groupBy(F.col(end).alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def degree_stats(triples: DataFrame, end: str) -> DataFrame:
    """One row: least, most, median and population deviation over nodes with such an edge; the mean over all nodes; and
    the mean number of kinds of predicate."""
    n = F.col({"s": "n_out", "o": "n_in"}[end])
    by_node = node_sums(triples).groupBy("node").agg(F.sum(n).alias("degree"), F.count_if(n > 0).alias("kinds"))
    some = lambda c: F.when(F.col("degree") > 0, F.col(c))
    return by_node.agg(
        F.min(some("degree")).alias("least"), F.max("degree").alias("most"), (F.sum("degree") / F.count(F.lit(1))).alias("mean"), F.percentile(some("degree"), F.lit(0.5)).alias("median"),
        F.stddev_pop(some("degree")).alias("deviation"), F.avg(some("kinds")).alias("mean_kinds"),
    )


def predicate_counts(triples: DataFrame) -> DataFrame:
    return triples.groupBy("p").agg(F.count(F.lit(1)).alias("n"))


def predicate_stats(triples: DataFrame) -> DataFrame:
    return predicate_counts(triples).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("deviation"))


def histogram(counts: DataFrame, column: str) -> DataFrame:
    """(value, n): how many rows have each count."""
    return counts.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def write_histograms(triples: DataFrame, folder: str) -> None:
    """One count a line, without a header: outdegree, indegree and edge."""
    for name, counts in (("outdegree", degrees(triples, "s").select("degree")), ("indegree", degrees(triples, "o").select("degree")), ("edge", predicate_counts(triples).select("n"))):
        counts.write.csv(f"{folder}/{name}")

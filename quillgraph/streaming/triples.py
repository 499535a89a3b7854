"""Triples that arrive as a stream, matched against a graph that is at rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import is_variable
from ..operators.match import Either, Pattern, match, same_terms
from ..plans.graph import Graph


def triple_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New Parquet files of (s, p, o) in a folder."""
    return spark.readStream.schema("s string, p string, o string").parquet(folder)


def stream_solutions(stream: DataFrame, graph: Graph, pattern: tuple[str, str, str], where: Sequence[Pattern | Either] = ()) -> DataFrame:
    """Each arriving triple that fits ``pattern`` with the solutions of ``where`` in the graph that share its variables,
    or with all solutions if they share none; a stateless stream-static join, to be written with ``writeStream``."""
    found = stream
    for column, term in zip("spo", pattern, strict=True):
        if not is_variable(term):
            full = graph.full("rdf:type" if (column, term) == ("p", "a") else term)
            found = found.where(F.col(column) == full)
    places: dict[str, list[str]] = {}
    for column, term in zip("spo", pattern, strict=True):
        if is_variable(term):
            places.setdefault(term[1:], []).append(column)
    found = same_terms(found, places).select(*[F.col(at[0]).alias(n) for n, at in places.items()])
    if not where:
        return found
    static = match(graph, where)
    shared = [c for c in static.columns if c in places]
    return found.join(static, shared) if shared else found.crossJoin(static)

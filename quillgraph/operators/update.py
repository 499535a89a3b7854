"""What is derived from triples when they come in: inverse edges and insertions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import INVERSE_OF, is_variable
from ..plans.graph import Graph, TripleGraph
from .match import Either, Pattern, match


def with_inverses(triples: DataFrame) -> DataFrame:
    """``triples`` (s, p, o) and (o, q, s) for each p that is, in either direction, owl:inverseOf q. Pairs of
    predicates are a schema's worth of rows; Spark measures them before it broadcasts any."""
    declared = triples.where(F.col("p") == INVERSE_OF).select(F.col("s").alias("a"), F.col("o").alias("b"))
    pairs = declared.union(declared.select("b", "a")).distinct()
    turned = triples.join(pairs, triples["p"] == pairs["a"]).select(F.col("o").alias("s"), F.col("b").alias("p"), F.col("s").alias("o"))
    return triples.select("s", "p", "o").union(turned).distinct()


def infer(graph: TripleGraph) -> TripleGraph:
    return TripleGraph(with_inverses(graph.triples()), graph.prefixes)


def instantiate(graph: Graph, template: Sequence[tuple[str, str, str]], where: Sequence[Pattern | Either]) -> DataFrame:
    """(s, p, o) of the template for each solution; an empty ``where`` gives the template once. Solutions that leave a
    variable of a triple null give no such triple."""
    found = match(graph, where)
    term = lambda t: F.col(t[1:]) if is_variable(t) else F.lit(graph.full(t))
    made = [found.select(term(s).alias("s"), term("rdf:type" if p == "a" else p).alias("p"), term(o).alias("o")) for s, p, o in template]
    return reduce(DataFrame.union, made).dropna().distinct()


def insert(graph: TripleGraph, template: Sequence[tuple[str, str, str]], where: Sequence[Pattern | Either] = ()) -> TripleGraph:
    """A new graph with the template's triples and what follows from them; the old one stays as it is."""
    return infer(TripleGraph(graph.triples().union(instantiate(graph, template, where)), graph.prefixes))

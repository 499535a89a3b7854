"""Results for people and other programs: CSV, JSON, tables and GraphViz, each built as lines of a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import CLASS, SUBCLASS, TYPE, abbreviate, is_variable, local_name, namespace
from ..plans.graph import Graph
from ..session import stage
from .match import Either, Pattern


def json_rows(found: DataFrame) -> DataFrame:
    """(value): a JSON object a row, ``{"?x": {"Namespace": ..., "Value": ...}}``, namespaces without their last ``#``."""
    term = lambda c: F.struct(F.regexp_replace(namespace(F.col(c)), "#$", "").alias("Namespace"), local_name(F.col(c)).alias("Value")).alias(f"?{c}")
    return found.select(F.to_json(F.struct(*[term(c) for c in found.columns])).alias("value"))


def csv_rows(found: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """``found`` as it is, or with terms shortened and unknown namespaces empty: for ``.write.csv``."""
    return found if prefixes is None else found.select(*[F.coalesce(abbreviate(F.col(c), prefixes), F.lit("")).alias(c) for c in found.columns])


def _dot(edges: DataFrame, name: str) -> DataFrame:
    """(value): lines of a GraphViz file of edges (s, label, o)."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.col(c), '(["\\\\])', "\\\\$1"), F.lit('"'))
    label = F.when(F.col("label") == "", "").otherwise(F.concat(F.lit(" [label="), quoted("label"), F.lit("]")))
    lines = edges.select(F.lit(1).alias("part"), F.concat(quoted("s"), F.lit(" -> "), quoted("o"), label, F.lit(";")).alias("value"))
    spark = edges.sparkSession
    frame = spark.createDataFrame([(0, f"digraph {name} {{"), (2, "}")], "part int, value string")
    return frame.union(lines).orderBy("part", "value").select("value")


def short(graph: Graph, column: str):
    return F.coalesce(abbreviate(F.col(column), graph.prefixes), F.col(column))


def graph_dot(graph: Graph) -> DataFrame:
    """Every edge of the graph."""
    return _dot(graph.triples().select(short(graph, "s").alias("s"), short(graph, "p").alias("label"), short(graph, "o").alias("o")).distinct(), "graph_")


def class_edges(graph: Graph) -> DataFrame:
    """(s, o): subclass edges from named classes, without blank nodes."""
    classes = graph.edges(TYPE, o=CLASS).select("s")
    return graph.edges(SUBCLASS, s=classes).where(~F.col("s").startswith("_:") & ~F.col("o").startswith("_:"))


def class_dot(graph: Graph) -> DataFrame:
    return _dot(class_edges(graph).select(short(graph, "s").alias("s"), F.lit("").alias("label"), short(graph, "o").alias("o")), "classes")


def result_class_edges(graph: Graph, found: DataFrame, kept: Sequence[str] = ("uuid",)) -> DataFrame:
    """(s, p, o) between classes: for each node that a result names, edges from its classes to those of its neighbours.
    Predicates with a local name in ``kept`` lead to a node of their own name, whatever their objects are."""
    nodes = stage(found.select(F.explode(F.array(*found.columns)).alias("s")).dropna().distinct(), "nodes")
    from_class = graph.edges(TYPE, s=nodes).select("s", F.col("o").alias("_from"))
    out = graph.triples(s=nodes).where(F.col("p") != TYPE).join(from_class, "s")
    neighbours = out.select(F.col("o").alias("s")).distinct()
    to_class = graph.edges(TYPE, s=neighbours).where(F.col("o") != CLASS).select(F.col("s").alias("o"), F.col("o").alias("_to"))
    between = out.join(to_class, "o").select(F.col("_from").alias("s"), "p", F.col("_to").alias("o"))
    alone = out.where(local_name(F.col("p")).isin(list(kept))).select(F.col("_from").alias("s"), "p", F.col("p").alias("o"))
    return between.union(alone).distinct()


def result_class_dot(graph: Graph, found: DataFrame) -> DataFrame:
    edges = result_class_edges(graph, found)
    return _dot(edges.select(short(graph, "s").alias("s"), short(graph, "p").alias("label"), short(graph, "o").alias("o")).distinct(), "result")


def turtle_lines(graph: Graph) -> DataFrame:
    """(value): a Turtle file of the graph. Terms that look like IRIs are in marks, shortened where a prefix is known and
    the rest is plain; blank nodes as they are; others are literals."""

    def term(column: str):
        c = F.col(column)
        name = abbreviate(c, graph.prefixes)
        quoted = c
        for mark, spelt in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            quoted = F.replace(quoted, F.lit(mark), F.lit(spelt))
        iri = c.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:[^\s<>\"{}|\\^`]*$")
        return F.when(name.rlike(r"^[A-Za-z][\w-]*:[A-Za-z_][\w-]*$"), name).when(c.rlike(r"^_:[\w-]+$"), c).when(iri, F.concat(F.lit("<"), c, F.lit(">"))).otherwise(F.concat(F.lit('"'), quoted, F.lit('"')))

    head = graph.spark.createDataFrame([(0, f"@prefix {k}: <{v}> .") for k, v in sorted(graph.prefixes.items())], "part int, value string")
    body = graph.triples().select(F.lit(1).alias("part"), F.concat_ws(" ", term("s"), term("p"), term("o"), F.lit(".")).alias("value"))
    return head.union(body).orderBy("part", "value").select("value")


def pattern_dot(variables: Sequence[str], where: Sequence[Pattern | Either]) -> str:
    """A query's patterns, one edge each, selected variables coloured."""
    names = {v if is_variable(v) else f"?{v}" for v in variables}
    lines = ["digraph query {", *(f'"{v}" [fillcolor="#e57373" style=filled];' for v in sorted(names))]
    lines += [f'"{w[0]}" -> "{w[2]}" [label="{getattr(w[1], "name", w[1])}"];' for w in where if not isinstance(w, Either)]
    return "\n".join([*lines, "}"]) + "\n"

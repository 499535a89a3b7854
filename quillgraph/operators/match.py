"""Graph patterns to one lazy DataFrame.

A pattern is ``(subject, path, object)``: a term is ``?name`` for a variable, else a constant; the path is a predicate,
a variable, or a combination (``functions.paths``). A pattern becomes a renamed (s, o) relation, narrowed by its
constants in the graph; patterns are natural-joined on all variables they share. Patterns with few open ends come first.
A pattern that would otherwise read everything (a path that repeats, an open predicate) waits until others have bound
one of its ends, and then starts from those bindings alone, which are a stage table. What to broadcast and in which
order stages run is left to Catalyst and adaptive execution. Only such patterns run jobs while a plan is made.

Defined results: bindings are sets; an unknown constant or predicate matches nothing; one variable twice in a pattern
asks for equal terms; patterns without shared variables are a product; a pattern without variables keeps all solutions
or none; no pattern at all has one solution without columns; a zero-length path holds for the bound end even if the
graph does not know it, and for every node if both ends are open; a selected variable that no pattern has is an error;
a literal and an IRI with the same text are one node.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import Alt, Inverse, Path, Pred, Repeat, Seq, pred
from ..functions.terms import is_variable
from ..plans.graph import Bound, Graph
from ..session import stage
from .closure import compose, plus

Pattern = tuple[str, "Path | str", str]


@dataclass(frozen=True)
class Either:
    """Solutions of any of several groups; variables that a group lacks are null."""

    groups: tuple[Sequence[Pattern | Either], ...]


def either(*groups: Sequence[Pattern | Either]) -> Either:
    return Either(groups)


def relation(graph: Graph, path: Path, start: Bound = None) -> DataFrame:
    """(s, o) of a path, each once; ``start``: only from this term, or from these nodes (s)."""
    if isinstance(path, Pred):
        return graph.edges(path.name, s=start)
    if isinstance(path, Inverse):
        if isinstance(path.path, Pred):
            return _swap(graph.edges(path.path.name, o=start))
        return relation(graph, reverse(path.path), start)
    if isinstance(path, Seq) and any(isinstance(x, Repeat) and x.zero for x in (path.first, path.second)):
        return _sequence_or_part(graph, path, start)
    if isinstance(path, Seq):
        first = relation(graph, path.first, start)
        middle = first.select(F.col("o").alias("s")).distinct() if start is not None else None
        return compose(first, relation(graph, path.second, middle))
    if isinstance(path, Alt):
        both = relation(graph, path.first, start).union(relation(graph, path.second, start))
        apart = isinstance(path.first, Pred) and isinstance(path.second, Pred) and graph.apart(path.first.name, path.second.name)
        return both if apart else both.distinct()
    if not isinstance(path, Repeat):
        raise TypeError(f"not a path: {path!r}")
    ends = graph.spark.createDataFrame([(start,)], "s string") if isinstance(start, str) else start
    some = plus(lambda nodes: relation(graph, path.path, nodes), ends) if path.many else relation(graph, path.path, start)
    if not path.zero:
        return some
    known = graph.nodes().toDF("s") if ends is None else ends.distinct()
    return some.union(known.select("s", F.col("s").alias("o"))).distinct()


def _sequence_or_part(graph: Graph, path: Seq, start: Bound) -> DataFrame:
    """A sequence whose first or second path may have no length: the sequence with that path at least one edge long, or
    the other path alone. So zero lengths hold for the nodes that the other path meets, and no other nodes are read."""
    some = lambda x: Repeat(x.path, zero=False, many=x.many)
    if isinstance(path.second, Repeat) and path.second.zero:
        first = relation(graph, path.first, start)
        middle = first.select(F.col("o").alias("s")).distinct() if start is not None else None
        return first.union(compose(first, relation(graph, some(path.second), middle))).distinct()
    alone = relation(graph, path.second, start)
    return alone.union(relation(graph, Seq(some(path.first), path.second), start)).distinct()


def _swap(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("o").alias("s"), F.col("s").alias("o"))


def reverse(path: Path) -> Path:
    """The path from its object to its subject."""
    if isinstance(path, Seq):
        return Seq(reverse(path.second), reverse(path.first))
    if isinstance(path, Alt):
        return Alt(reverse(path.first), reverse(path.second))
    if isinstance(path, Repeat):
        return Repeat(reverse(path.path), path.zero, path.many)
    return path.path if isinstance(path, Inverse) else Inverse(path)


def keyed(graph: Graph, where: Sequence[Pattern | Either]) -> dict[str, str]:
    """The variables that join patterns and are the same prefix and a number in all of them, with the prefix. They are
    joined as numbers, and made terms at the end."""
    found: dict[str, list[str | None]] = {}
    for w in where:
        plain = not isinstance(w, Either) and not (isinstance(w[1], str) and is_variable(w[1])) and isinstance(pred(w[1]), Pred)
        ends = {} if not plain else {place: graph.key_prefix(pred(w[1]).name, place) for place in ("s", "o")}
        for name in variables([w]):
            found.setdefault(name, []).extend({prefix for place, prefix in ends.items() if w["spo".index(place)] == "?" + name} if plain else {None})
    return {name: prefixes[0] for name, prefixes in found.items() if len(prefixes) > 1 and len(set(prefixes)) == 1 and prefixes[0] is not None}


def solutions(graph: Graph, pattern: Pattern, bound: DataFrame | None = None, keys: Collection[str] = ()) -> DataFrame:
    """A column, without the ``?``, for each variable of one pattern. ``bound``: bindings that it is to be joined to; if
    they bind an end, the pattern may start from them. ``keys``: variables that are had as numbers."""
    s, p, o = pattern
    terms = {"s": s, "o": o}

    def end(term: str) -> Bound:
        if not is_variable(term):
            return graph.full(term)
        return bound.select(F.col(term[1:]).alias("s")).distinct() if bound is not None and term[1:] in bound.columns and _open(pattern) else None

    if isinstance(p, str) and is_variable(p):
        found, terms = graph.triples(end(s), end(o)), {"s": s, "p": p, "o": o}
    elif isinstance(pred(p), Pred):
        numbers = [place for place, term in terms.items() if is_variable(term) and term[1:] in keys]
        found = graph.edges(pred(p).name, end(s), end(o), **({"keys": numbers} if numbers else {}))
    elif end(s) is None and end(o) is not None:
        found = _swap(relation(graph, reverse(pred(p)), end(o)))
    else:
        found = relation(graph, pred(p), end(s))
    places: dict[str, list[str]] = {}
    for place, term in terms.items():
        if is_variable(term):
            places.setdefault(term[1:], []).append(place)
        else:
            found = found.where(F.col(place) == graph.full(term))
    found = same_terms(found, places)
    if not places:
        return found.select(F.lit(1).alias("_hit")).limit(1).drop("_hit")
    return found.select(*[F.col(at[0]).alias(name) for name, at in places.items()])  # of a set, without what is fixed: a set


def same_terms(found: DataFrame, places: dict[str, list[str]]) -> DataFrame:
    """The rows whose columns agree where one variable stands in several places."""
    for first, *others in places.values():
        for other in others:
            found = found.where(F.col(first) == F.col(other))
    return found


def _repeats(path: Path) -> bool:
    return isinstance(path, Repeat) and path.many or isinstance(path, (Inverse, Repeat)) and _repeats(path.path) or isinstance(path, (Seq, Alt)) and (_repeats(path.first) or _repeats(path.second))


def _open(pattern: Pattern) -> bool:
    """Whether a pattern reads far more than an edge's worth unless an end is bound."""
    return isinstance(pattern[1], str) and is_variable(pattern[1]) or _repeats(pred(pattern[1]))


def variables(where: Sequence[Pattern | Either]) -> list[str]:
    """The variables' names in order of appearance."""
    names: dict[str, None] = {}
    for w in where:
        if isinstance(w, Either):
            names |= dict.fromkeys(v for g in w.groups for v in variables(g))
        else:
            names |= dict.fromkeys(t[1:] for t in w if isinstance(t, str) and is_variable(t))
    return list(names)


def _join(left: DataFrame, right: DataFrame) -> DataFrame:
    shared = [c for c in left.columns if c in right.columns]
    return left.join(right, shared) if shared else left.crossJoin(right)


def match(graph: Graph, where: Sequence[Pattern | Either], chosen: Sequence[str] | None = None) -> DataFrame:
    """The bindings of the variables ``chosen`` (None: all, in order of appearance), each combination once. Parts that
    share a variable with those before them are joined first, so that a product is made only where the pattern asks for
    one; of these, parts that do not need bindings to start from; then those with fewest variables still open.

    A variable that is not chosen goes as soon as no part to come has it. What starts from bindings is first joined to
    the parts that share a new variable of its own that is not chosen, so that this variable goes before the bindings
    come: many bindings and many nodes with one node between them are never all paired. A part that has a variable of the
    bindings which is not there yet waits for them."""
    left, chosen = list(where), variables(where) if chosen is None else list(chosen)
    if not left:
        return graph.spark.range(1).select()

    def kept(found: DataFrame, others: Sequence[str] = ()) -> DataFrame:
        """Without the variables that are neither chosen, nor in ``others``, nor in parts to come."""
        asked = {*chosen, *others, *variables(left)}
        names = [c for c in found.columns if c in asked]
        return found if names == found.columns else found.select(*names).distinct() if names else found.select(F.lit(1).alias("_hit")).limit(1).drop("_hit")

    def starts(part: Pattern | Either, found: DataFrame | None) -> bool:
        return found is not None and not isinstance(part, Either) and _open(part) and bool(set(variables([part])) & set(found.columns))

    def cost(part: Pattern | Either, found: DataFrame | None) -> tuple[bool, bool, int]:
        names = set(variables([part]))
        bound = names & set(found.columns) if found is not None else set()
        return found is not None and not bound, not isinstance(part, Either) and _open(part), len(names - bound)

    def inner(made: DataFrame, needed: Sequence[str]) -> list[Pattern | Either]:
        """The parts to come that have a variable which can go once they are joined to ``made``."""
        having = [[x for x in left if v in variables([x])] for v in made.columns if v not in chosen and v not in needed]
        return next((parts for parts in having if parts and not set(variables(parts)) & (set(needed) - set(made.columns))), [])

    def joined(found: DataFrame | None, part: Pattern | Either, others: Sequence[str] = ()) -> DataFrame:
        """``found`` and ``part``; ``others``: variables that are needed beside."""
        left.remove(part)
        begins = starts(part, found)
        if begins:
            found = stage(found, "bindings")  # both the pattern's start and the join read it
        needed = [*others, *(found.columns if found is not None else [])]
        made = kept(_part(graph, part, found, prefixes), needed)
        while begins and (after := inner(made, needed)):
            made = joined(made, min(after, key=lambda x: cost(x, made)), needed)
        return kept(made if found is None else _join(found, made), others)

    out, prefixes = None, keyed(graph, where)
    while left:
        out = joined(out, min(left, key=lambda x: cost(x, out)))
    return out.select(*[F.concat(F.lit(prefixes[c]), F.col(c).cast("string")).alias(c) if c in prefixes else c for c in chosen])


def _part(graph: Graph, part: Pattern | Either, bound: DataFrame | None, keys: Collection[str]) -> DataFrame:
    if not isinstance(part, Either):
        return solutions(graph, part, bound, keys)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [match(graph, g) for g in part.groups]).distinct()


def select(graph: Graph, names: Sequence[str], where: Sequence[Pattern | Either]) -> DataFrame:
    """Distinct bindings of the variables ``names`` (``?x`` or ``x``; none or ``*``: all, in order of appearance)."""
    chosen = [v.lstrip("?") for v in names]
    if chosen in ([], ["*"]):
        return match(graph, where)
    if missing := [v for v in chosen if v not in variables(where)]:
        raise ValueError(f"no pattern has the variables {', '.join('?' + v for v in missing)}")
    return match(graph, where, chosen)


def count(graph: Graph, names: Sequence[str], where: Sequence[Pattern | Either]) -> DataFrame:
    """One row: the number of distinct bindings."""
    return select(graph, names, where).agg(F.count(F.lit(1)).alias("count"))


def select_from(graphs: dict[str, Graph], names: Sequence[str] | None, chosen: Sequence[str], where: Sequence[Pattern | Either]) -> DataFrame:
    """Each named graph's distinct bindings, one after another, with the graph's name in ``g``. Names that are not
    there are passed over; None: all."""
    there = [n for n in graphs if names is None or n in names]
    if not there:
        raise ValueError("none of the named graphs exists")
    found = [select(graphs[n], chosen, where).withColumn("g", F.lit(n)) for n in there]
    return reduce(lambda a, b: a.unionByName(b), found)


def count_from(graphs: dict[str, Graph], names: Sequence[str] | None, chosen: Sequence[str], where: Sequence[Pattern | Either]) -> DataFrame:
    """One row: the number of bindings that are distinct over all named graphs."""
    return select_from(graphs, names, chosen, where).drop("g").distinct().agg(F.count(F.lit(1)).alias("count"))

"""Graphs: what a pattern is matched against.

A graph gives, for each predicate, a lazy ``(s, o)`` DataFrame, and the union of all as ``(s, p, o)``. Either end may be
bound, to a term or to a DataFrame of nodes; the graph narrows what it reads as early as it can. ``TripleGraph`` keeps
triples in one DataFrame (partitioned by predicate when saved, so that a bound predicate reads its folder alone);
``TableGraph`` maps each predicate to columns of relational tables, which are never turned into triples unless a
pattern leaves the predicate open. All are sets: an edge counts once.
"""

from __future__ import annotations

import uuid
from collections.abc import Collection, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import STANDARD, expand
from ..session import file_system

NODE = "node"
SHARE = 8_000_000  # bytes of a table's files to a partition where its pairs are made unique
Bound = str | DataFrame | None  # a term, nodes (one column), or anything


def nodes_of(bound: DataFrame) -> DataFrame:
    return bound.toDF("_bound")


def narrowed(edges: DataFrame, ends: dict[str, Bound]) -> DataFrame:
    """The rows whose column is the term, or one of the nodes, that it is bound to."""
    for column, bound in ends.items():
        if isinstance(bound, str):
            edges = edges.where(F.col(column) == bound)
        elif bound is not None:
            edges = edges.join(nodes_of(bound), F.col(column) == F.col("_bound"), "left_semi")
    return edges


def stored_bytes(rows: DataFrame) -> int:
    """The size of the files that a frame reads; 0 if it reads none."""
    found = 0
    for file in rows.inputFiles():
        fs, where = file_system(rows.sparkSession, file)
        found += fs.getFileStatus(where).getLen()
    return found


class Graph:
    """Triples as sets of edges. A subclass gives ``edges`` and ``predicate_names`` or overrides ``triples``."""

    spark: SparkSession
    prefixes: dict[str, str]

    def edges(self, predicate: str, s: Bound = None, o: Bound = None) -> DataFrame:
        """(s, o), each once, of one predicate; empty if the graph does not know it."""
        return self.triples(s, o, predicate).select("s", "o")

    def key_prefix(self, predicate: str, end: str) -> str | None:
        """The prefix, if every node at that end of a predicate is the same prefix and a number. Such ends can be had as
        numbers: ``edges`` of a graph that names one takes ``keys``."""
        return None

    def apart(self, one: str, other: str) -> bool:
        """Whether it is known without a look at data that no edge is of both predicates."""
        return False

    def predicate_names(self) -> Iterable[str]:
        return [r["p"] for r in self.triples().select("p").distinct().collect()]

    def triples(self, s: Bound = None, o: Bound = None, p: str | None = None) -> DataFrame:
        """(s, p, o), each once."""
        names = self.predicate_names() if p is None else [self.full(p)]
        parts = [self.edges(name, s, o).select("s", F.lit(name).alias("p"), "o") for name in names]
        return reduce(DataFrame.union, parts) if parts else self.spark.createDataFrame([], "s string, p string, o string")

    def coded_triples(self) -> DataFrame:
        """(s, p, o) as ``triples``, for counts: s and o may be codes, equal where the terms are, and p a number."""
        return self.triples()

    def nodes(self) -> DataFrame:
        """(node) each subject or object once."""
        return self.triples().select(F.explode(F.array("s", "o")).alias(NODE)).distinct()

    def full(self, term: str) -> str:
        return expand(term, self.prefixes)

    def empty_edges(self) -> DataFrame:
        return self.spark.createDataFrame([], "s string, o string")


class TripleGraph(Graph):
    def __init__(self, triples: DataFrame, prefixes: dict[str, str] | None = None) -> None:
        self.spark = triples.sparkSession
        self.prefixes = STANDARD | (prefixes or {})
        self._triples = triples.select("s", "p", "o").distinct()

    def triples(self, s: Bound = None, o: Bound = None, p: str | None = None) -> DataFrame:
        found = self._triples if p is None else self._triples.where(F.col("p") == self.full(p))
        return narrowed(found, {"s": s, "o": o})

    def union(self, other: Graph) -> TripleGraph:
        """Both graphs' triples, as an ontology and a graph that uses it."""
        return TripleGraph(self.triples().union(other.triples()), other.prefixes | self.prefixes)

    def save(self, path: str) -> None:
        """A new version: Parquet partitioned by predicate, prefixes beside it, and a pointer that names it, written last
        and swapped by a rename. Readers see the version before or the new one; those before stay until removed."""
        version = f"{path}/version-{uuid.uuid4().hex}"
        self._triples.repartition("p", F.pmod(F.xxhash64("s"), F.lit(32))).write.partitionBy("p").parquet(f"{version}/triples")
        self.spark.createDataFrame(list(self.prefixes.items()), "prefix string, namespace string").coalesce(1).write.parquet(f"{version}/prefixes")
        jvm = self.spark.sparkContext._jvm
        fs, draft = file_system(self.spark, f"{path}/.current-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(version.rsplit("/", 1)[1].encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(context.makeQualified(draft), context.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{path}/CURRENT")), options)

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: str | None = None) -> TripleGraph:
        """The current version, or the one named."""
        version = version or spark.read.text(f"{path}/CURRENT").first()[0]
        made = cls.__new__(cls)
        made.spark = spark
        made.prefixes = {r["prefix"]: r["namespace"] for r in spark.read.parquet(f"{path}/{version}/prefixes").collect()}
        made._triples = spark.read.schema("s string, o string, p string").parquet(f"{path}/{version}/triples").select("s", "p", "o")  # distinct when saved
        return made

    def cache(self) -> TripleGraph:
        self._triples = self._triples.cache()
        return self


@dataclass(frozen=True)
class Node:
    """A term made of a row: ``prefix`` and key columns with ``-`` between them; no columns: the prefix alone."""

    prefix: str
    keys: tuple[str, ...] = ()

    def term(self) -> Column:
        """Null if a key is."""
        between = [x for k in self.keys for x in (F.lit("-"), F.col(k).cast("string"))]
        return F.concat(F.lit(self.prefix), *between[1:])

    def fits(self, term: str, rows: DataFrame) -> Column | None:
        """The condition on the key columns under which a row makes ``term``; None if none can."""
        if not term.startswith(self.prefix) or (not self.keys and term != self.prefix):
            return None
        key = term[len(self.prefix) :]
        if len(self.keys) > 1:
            return self.term() == term
        if not self.keys:
            return F.lit(True)
        if not self.whole(rows):
            return F.col(self.keys[0]).cast("string") == key
        if not key.lstrip("-").isdecimal() or str(int(key)) != key or len(key) > 18:
            return None
        return F.col(self.keys[0]) == int(key)

    def whole(self, rows: DataFrame) -> bool:
        """Whether the key is one column of whole numbers."""
        return len(self.keys) == 1 and rows.schema[self.keys[0]].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")

    def code(self, rows: DataFrame, prefixes: list[str]) -> Column:
        """The node as (kind, key, text): the place of its prefix in ``prefixes`` and its number, or else -1 and its term.
        Terms that happen to be one of the prefixes and a number are coded as such. Null if a key is."""
        text, number, kind = F.lit(None).cast("string"), F.lit(None).cast("bigint"), F.lit(-1)
        if self.prefix in prefixes and self.whole(rows):
            number, kind = F.col(self.keys[0]).cast("bigint"), F.lit(prefixes.index(self.prefix))
            return F.when(number.isNotNull(), F.struct(kind.alias("kind"), number.alias("key"), text.alias("text")))
        for k, prefix in enumerate(prefixes):
            if self.prefix.startswith(prefix) or prefix.startswith(self.prefix):
                found = F.substring(self.term(), len(prefix) + 1, 20).try_cast("bigint")
                fits = F.coalesce(self.term() == F.concat(F.lit(prefix), found.cast("string")), F.lit(False))
                kind, number = F.when(fits, F.lit(k)).otherwise(kind), F.when(fits, found).otherwise(number)
        text = F.when(kind == -1, self.term())
        return F.when(self.term().isNotNull(), F.struct(kind.alias("kind"), number.alias("key"), text.alias("text")))

    def among(self, nodes: DataFrame, rows: DataFrame) -> DataFrame:
        """The rows that make one of ``nodes``. A key of whole numbers is compared as a number, with those nodes that are
        the prefix and a number as it is written."""
        if not self.whole(rows):
            return rows.join(nodes_of(nodes), self.term() == F.col("_bound"), "left_semi")
        key = F.substring("_bound", len(self.prefix) + 1, 20).try_cast("bigint").alias("_key")
        keys = nodes_of(nodes).select("_bound", key).where(F.col("_bound") == F.concat(F.lit(self.prefix), F.col("_key").cast("string"))).select("_key")
        return rows.join(keys, F.col(self.keys[0]) == F.col("_key"), "left_semi")


@dataclass(frozen=True)
class Part:
    """Edges made of the rows of a table; ``unique``: no two rows make the same edge."""

    rows: DataFrame
    s: Node
    o: Node
    unique: bool = True

    def edges(self, s: Bound = None, o: Bound = None, keys: Collection[str] = ()) -> DataFrame | None:
        """(s, o), each once; ends in ``keys`` as the number in place of the term; None if no row can fit."""
        rows = self.pairs(s, o)
        end = lambda name, node: (F.col(node.keys[0]).cast("bigint") if name in keys else node.term()).alias(name)
        return None if rows is None else rows.select(end("s", self.s), end("o", self.o)).dropna()

    def pairs(self, s: Bound = None, o: Bound = None) -> DataFrame | None:
        """The key columns of both ends, each pair once, narrowed on the table's own columns first; None if no row can
        fit. Pairs are made unique in as many partitions as the table's size asks for, so that a task's share stays the
        same as tables grow."""
        rows = self.rows
        for node, bound in ((self.s, s), (self.o, o)):
            if isinstance(bound, str):
                condition = node.fits(bound, rows)
                if condition is None:
                    return None
                rows = rows.where(condition)
            elif bound is not None:
                rows = node.among(bound, rows)
        keys = list(dict.fromkeys([*self.s.keys, *self.o.keys]))
        rows = rows.select(*keys)
        if self.unique:
            return rows
        parts = 0 if isinstance(s, str) or isinstance(o, str) else stored_bytes(self.rows) // SHARE
        return (rows.repartition(parts, *keys) if parts > 1 else rows).distinct()

    def apart(self, other: Part) -> bool:
        """Whether no edge can be in both, by the prefixes of their ends."""
        ends = ((self.s.prefix, other.s.prefix), (self.o.prefix, other.o.prefix))
        return any(not a.startswith(b) and not b.startswith(a) for a, b in ends)


def _prefixes(nodes: DataFrame, asked: set[str]) -> set[str]:
    """Those of a few prefixes that some node has."""
    names = sorted(asked)
    flags = nodes_of(nodes).agg(*[F.max(F.col("_bound").startswith(x)).alias(f"_{k}") for k, x in enumerate(names)]).first() if names else ()
    return {x for x, flag in zip(names, flags, strict=True) if flag}


class TableGraph(Graph):
    """Predicates over tables: full predicate IRI to the parts whose edges, none in two of them, it has."""

    def __init__(self, spark: SparkSession, predicates: dict[str, list[Part]], prefixes: dict[str, str] | None = None) -> None:
        self.spark, self.predicates, self.prefixes = spark, predicates, STANDARD | (prefixes or {})

    def edges(self, predicate: str, s: Bound = None, o: Bound = None, keys: Collection[str] = ()) -> DataFrame:
        parts = [e for part in self.predicates.get(self.full(predicate), []) if (e := part.edges(s, o, keys)) is not None]
        return reduce(DataFrame.union, parts) if parts else self.empty_edges().withColumns({end: F.col(end).cast("bigint") for end in keys})

    def key_prefix(self, predicate: str, end: str) -> str | None:
        found = {node.prefix if node.whole(part.rows) else None for part in self.predicates.get(self.full(predicate), []) for node in [getattr(part, end)]}
        return found.pop() if len(found) == 1 else None

    def apart(self, one: str, other: str) -> bool:
        return all(a.apart(b) for a in self.predicates.get(self.full(one), []) for b in self.predicates.get(self.full(other), []))

    def predicate_names(self) -> Iterable[str]:
        return self.predicates

    def triples(self, s: Bound = None, o: Bound = None, p: str | None = None) -> DataFrame:
        """The tables' rows that fit, as triples. Tables that cannot make the term, or any of the nodes, that an end is
        bound to are not read; which prefixes nodes have is a row's worth of flags, found by a job over the nodes."""
        names = self.predicates if p is None else [self.full(p)]
        parts = [(name, part) for name in names for part in self.predicates.get(name, [])]
        for end, bound in (("s", s), ("o", o)):
            if isinstance(bound, DataFrame):
                there = _prefixes(bound, {getattr(part, end).prefix for _, part in parts})
                parts = [(name, part) for name, part in parts if getattr(part, end).prefix in there]
        made = [(name, e) for name, part in parts if (e := part.edges(s, o)) is not None]
        parts = [e.select("s", F.lit(name).alias("p"), "o") for name, e in made]
        return reduce(DataFrame.union, parts) if parts else self.spark.createDataFrame([], "s string, p string, o string")

    def coded_triples(self) -> DataFrame:
        """Nodes whose key is a number stay numbers: a term is several times as long as its key."""
        parts = [(k, part) for k, found in enumerate(self.predicates.values()) for part in found]
        asked = {node.prefix for _, part in parts for node in (part.s, part.o) if node.whole(part.rows)}
        prefixes = sorted(x for x in asked if not any(x != y and (x.startswith(y) or y.startswith(x)) for y in asked))
        made = [part.pairs().select(part.s.code(part.rows, prefixes).alias("s"), F.lit(k).alias("p"), part.o.code(part.rows, prefixes).alias("o")).dropna() for k, part in parts]
        return reduce(DataFrame.union, made) if made else self.triples()

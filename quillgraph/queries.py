"""Queries over the star-schema tables as a graph, and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.paths import Path, pred
from .functions.terms import CLASS as OWL_CLASS
from .functions.terms import INVERSE_OF, STANDARD, SUBCLASS, abbreviate, local_name, namespace
from .functions.terms import TYPE as RDF_TYPE
from .operators import output, search, stats
from .operators.match import count, count_from, either, select, select_from
from .operators.update import insert, with_inverses
from .plans.graph import TableGraph, TripleGraph
from .sources.warehouse import BASE, PREFIXES, VOCAB, warehouse

LOCATED, IS_LOCATION, NEXT, NEXT_TURN, TYPE, SUB = (pred(x) for x in ("v:locatedIn", "v:isLocationOf", "v:nextTo", "v:nextTurn", "a", "rdfs:subClassOf"))
PLACED, CONTAINS, SUPPLIED, SUPPLIES = (pred(f"v:{x}") for x in ("placed", "contains", "suppliedBy", "supplies"))

#: All triples, for the SQL side.
TRIPLES = f"""
loc AS (SELECT '{BASE}nation#' || n_nationkey AS s, '{BASE}region#' || n_regionkey AS o FROM nation
  UNION SELECT '{BASE}customer#' || c_custkey, '{BASE}nation#' || c_nationkey FROM customer
  UNION SELECT '{BASE}supplier#' || s_suppkey, '{BASE}nation#' || s_nationkey FROM supplier),
typ AS (SELECT '{BASE}part#' || p_partkey AS s, '{BASE}class#' || p_brand AS o FROM part
  UNION SELECT '{BASE}part#' || p_partkey, '{BASE}class#' || p_type FROM part
  UNION SELECT '{BASE}customer#' || c_custkey, '{BASE}class#' || c_mktsegment FROM customer
  UNION SELECT '{BASE}supplier#' || s_suppkey, '{BASE}class#Supplier' FROM supplier),
sub AS (SELECT '{BASE}class#' || p_brand AS s, '{BASE}class#Brand' AS o FROM part
  UNION SELECT '{BASE}class#' || p_type, '{BASE}class#Kind' FROM part
  UNION SELECT '{BASE}class#' || c_mktsegment, '{BASE}class#Customer' FROM customer
  UNION SELECT '{BASE}class#' || a, '{BASE}class#' || b FROM (VALUES ('Brand', 'Part'), ('Kind', 'Part'), ('Customer', 'Party'), ('Supplier', 'Party')) v(a, b)),
plc AS (SELECT '{BASE}order#' || o_orderkey AS s, '{BASE}customer#' || o_custkey AS o FROM orders),
nxt AS (SELECT '{BASE}nation#' || n_nationkey AS s, '{BASE}nation#' || ((n_nationkey + 1) % 25) AS o FROM nation),
trn AS (SELECT DISTINCT '{BASE}turn#' || a.conv_id || '-' || a.turn AS s, '{BASE}turn#' || b.conv_id || '-' || b.turn AS o
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn),
ctn AS (SELECT DISTINCT '{BASE}order#' || l_orderkey AS s, '{BASE}part#' || l_partkey AS o FROM lineitem),
spb AS (SELECT DISTINCT '{BASE}order#' || l_orderkey AS s, '{BASE}supplier#' || l_suppkey AS o FROM lineitem),
spl AS (SELECT DISTINCT '{BASE}supplier#' || l_suppkey AS s, '{BASE}part#' || l_partkey AS o FROM lineitem),
prf AS (SELECT DISTINCT '{BASE}user#' || user_id AS s, '{BASE}class#' || event_type AS o FROM events),
lab AS (SELECT '{BASE}region#' || r_regionkey AS s, r_name AS o FROM region UNION SELECT '{BASE}nation#' || n_nationkey, n_name FROM nation),
t AS (SELECT s, '{VOCAB}locatedIn' AS p, o FROM loc UNION ALL SELECT o, '{VOCAB}isLocationOf', s FROM loc
  UNION ALL SELECT s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', o FROM typ UNION ALL SELECT s, 'http://www.w3.org/2000/01/rdf-schema#subClassOf', o FROM sub
  UNION ALL SELECT s, '{VOCAB}placedBy', o FROM plc UNION ALL SELECT o, '{VOCAB}placed', s FROM plc UNION ALL SELECT s, '{VOCAB}nextTo', o FROM nxt
  UNION ALL SELECT s, '{VOCAB}nextTurn', o FROM trn UNION ALL SELECT s, '{VOCAB}contains', o FROM ctn UNION ALL SELECT s, '{VOCAB}suppliedBy', o FROM spb
  UNION ALL SELECT s, '{VOCAB}supplies', o FROM spl UNION ALL SELECT s, '{VOCAB}performed', o FROM prf UNION ALL SELECT s, '{VOCAB}label', o FROM lab)"""
NATION, REGION, ORDER, CUSTOMER, CLASS = (f"{BASE}{x}#" for x in ("nation", "region", "order", "customer", "class"))


def _closed(name: str, edges: str) -> str:
    return f"{name}(s, o) AS (SELECT s, o FROM {edges} UNION SELECT c.s, e.o FROM {name} c JOIN {edges} e ON c.o = e.s)"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _register(name: str, sql: str | None, *recursive: tuple[str, str] | str):
    """Keep a function of a graph as a query of (spark, sf_dir), with SQL over TRIPLES, closures (name, edges) and tables
    in SQL."""

    def keep(function):
        QUERIES[name] = lambda spark, sf_dir: function(warehouse(spark, sf_dir))
        if sql:
            SQL[name] = f"WITH RECURSIVE {', '.join([TRIPLES, *(x if isinstance(x, str) else _closed(*x) for x in recursive)])} {sql}"
        return function

    return keep


def _pattern(name: str, variables: str, where: list, sql: str, *recursive: tuple[str, str] | str, counted: bool = False) -> None:
    _register(name, sql, *recursive)(lambda g: (count if counted else select)(g, variables.split(), where))


_pattern("bgp_subject_of_object", "c", [("?c", LOCATED, "nation:7")], f"SELECT s AS c FROM loc WHERE o = '{NATION}7'")
_pattern("bgp_object_of_subject", "o", [("customer:42", PLACED, "?o")], f"SELECT s AS o FROM plc WHERE o = '{CUSTOMER}42'")
_pattern("bgp_predicate_between", "p", [("nation:3", "?p", "nation:4")], f"SELECT DISTINCT p FROM t WHERE s = '{NATION}3' AND o = '{NATION}4'")
_pattern("bgp_pair_scan", "o c", [("?o", "v:placedBy", "?c")], "SELECT s AS o, o AS c FROM plc")
_pattern("bgp_chain_join", "c r", [("?c", PLACED, "?o"), ("?c", LOCATED, "?n"), ("?n", LOCATED, "?r")],
         "SELECT DISTINCT plc.o AS c, r.o AS r FROM plc JOIN loc n ON n.s = plc.o JOIN loc r ON r.s = n.o")
_pattern("bgp_triangle", "o s p", [("?o", SUPPLIED, "?s"), ("?o", CONTAINS, "?p"), ("?s", SUPPLIES, "?p")],
         "SELECT spb.s AS o, spb.o AS s, spl.o AS p FROM spb JOIN spl ON spl.s = spb.o JOIN ctn ON ctn.s = spb.s AND ctn.o = spl.o")
_pattern("bgp_subject_predicate", "s p", [("?s", "?p", "region:2")], f"SELECT DISTINCT s, p FROM t WHERE o = '{REGION}2'")
_pattern("bgp_predicate_object", "p o", [("customer:42", "?p", "?o")], f"SELECT DISTINCT p, o FROM t WHERE s = '{CUSTOMER}42'")
_pattern("bgp_open_after_subject", "s p o", [("?s", LOCATED, "nation:7"), ("?s", "?p", "?o")], f"SELECT DISTINCT t.* FROM t JOIN loc ON loc.s = t.s AND loc.o = '{NATION}7'")
_pattern("bgp_open_after_object", "s p o", [("?o", LOCATED, "region:1"), ("?s", "?p", "?o")], f"SELECT DISTINCT t.* FROM t JOIN loc ON loc.s = t.o AND loc.o = '{REGION}1'")
_pattern("bgp_open_after_predicate", "s p o", [("nation:3", "?p", "nation:4"), ("?s", "?p", "?o")], f"SELECT DISTINCT * FROM t WHERE p IN (SELECT p FROM t WHERE s = '{NATION}3' AND o = '{NATION}4')")
_pattern("bgp_open", "s p o", [("?s", "?p", "?o")], "SELECT DISTINCT * FROM t")
_pattern("bgp_ground", "r", [("nation:3", NEXT, "nation:4"), ("?n", LOCATED, "?r"), ("?n", NEXT, "nation:1")], f"SELECT DISTINCT loc.o AS r FROM loc JOIN nxt ON nxt.s = loc.s WHERE nxt.o = '{NATION}1'")
_pattern("bgp_same_term_twice", "n", [("?n", NEXT.plus(), "?n")], f"SELECT s AS n FROM nxt")
_pattern("bgp_product", "r n", [("?r", IS_LOCATION, "?x"), ("?x", NEXT, "nation:2"), ("?n", NEXT, "nation:9")],
         f"SELECT DISTINCT loc.o AS r, b.s AS n FROM loc JOIN nxt a ON a.s = loc.s AND a.o = '{NATION}2' CROSS JOIN nxt b WHERE b.o = '{NATION}9'")
_pattern("path_sequence", "c r", [("?c", LOCATED / LOCATED, "?r")], "SELECT DISTINCT a.s AS c, b.o AS r FROM loc a JOIN loc b ON b.s = a.o")
_pattern("path_optional", "x", [("nation:7", LOCATED.optional(), "?x")], f"SELECT '{NATION}7' AS x UNION SELECT o FROM loc WHERE s = '{NATION}7'")
_pattern("path_plus", "x y", [("?x", NEXT_TURN.plus(), "?y")], "SELECT s AS x, o AS y FROM c", ("c", "trn"))
_pattern("path_plus_from_object", "x", [("?x", LOCATED.plus(), "region:1")], f"SELECT s AS x FROM c WHERE o = '{REGION}1'", ("c", "loc"))
_pattern("path_star", "x", [("region:1", IS_LOCATION.star(), "?x")], f"SELECT s AS x FROM c WHERE o = '{REGION}1' UNION SELECT '{REGION}1'", ("c", "loc"))
_pattern("path_plus_cycle", "a b", [("?a", NEXT.plus(), "?b")], "SELECT s AS a, o AS b FROM c", ("c", "nxt"))
_pattern("path_sequence_plus", "x", [("nation:7", LOCATED / IS_LOCATION.plus(), "?x")],
         f"SELECT DISTINCT c.s AS x FROM loc JOIN c ON c.o = loc.o WHERE loc.s = '{NATION}7'", ("c", "loc"))
_pattern("path_sequence_optional", "c x", [("?c", LOCATED / LOCATED.optional(), "?x")], "SELECT s AS c, o AS x FROM loc UNION SELECT a.s, b.o FROM loc a JOIN loc b ON b.s = a.o")
_pattern("path_alternative", "o x", [("?o", CONTAINS | SUPPLIED, "?x")], "SELECT s AS o, o AS x FROM ctn UNION SELECT s, o FROM spb")
_pattern("path_inverse", "c o", [("?c", ~pred("v:placedBy"), "?o")], "SELECT o AS c, s AS o FROM plc")
_pattern("type_subclass_star", "x", [("?x", TYPE / SUB.star(), "class:Party")],
         f"SELECT DISTINCT typ.s AS x FROM typ WHERE o = '{CLASS}Party' OR o IN (SELECT s FROM c WHERE o = '{CLASS}Party')", ("c", "sub"))
_pattern("union_two", "x", [either([("?x", LOCATED, "nation:1")], [("?x", LOCATED, "nation:2")])], f"SELECT s AS x FROM loc WHERE o IN ('{NATION}1', '{NATION}2')")
_pattern("union_nested", "x n", [("?x", LOCATED, "?n"), either([("?n", NEXT, "nation:2")], [either([("?n", NEXT, "nation:5")], [("nation:8", NEXT, "?n")])])],
         f"SELECT s AS x, o AS n FROM loc WHERE o IN ('{NATION}1', '{NATION}4', '{NATION}9')")
_pattern("select_star", "*", [("?n", LOCATED, "?r"), ("?n", "v:label", "?name")], "SELECT loc.s AS n, loc.o AS r, lab.o AS name FROM loc JOIN lab ON lab.s = loc.s")
_pattern("count_distinct", "c n", [("?c", PLACED, "?o"), ("?c", LOCATED, "?n")], "SELECT CAST(count(*) AS BIGINT) AS count FROM (SELECT DISTINCT plc.o, loc.o FROM plc JOIN loc ON loc.s = plc.o)", counted=True)
_pattern("star_join", "s p c u", [("?s", SUPPLIES, "?p"), ("?s", LOCATED, "nation:7"), ("?p", TYPE, "?c"), ("?c", SUB, "?u")],
         f"SELECT spl.s, spl.o AS p, typ.o AS c, sub.o AS u FROM spl JOIN loc ON loc.s = spl.s AND loc.o = '{NATION}7' JOIN typ ON typ.s = spl.o JOIN sub ON sub.s = typ.o")


_pattern("path_plus_after_binding", "c x", [("?c", LOCATED.plus(), "?x"), ("?c", LOCATED, "nation:7")],
         f"SELECT loc.s AS c, c.o AS x FROM loc JOIN c ON c.s = loc.s WHERE loc.o = '{NATION}7'", ("c", "loc"))
_pattern("path_plus_before_binding", "x y", [("?x", NEXT_TURN.plus(), "?y"), ("?y", NEXT_TURN, "?z"), ("?z", NEXT_TURN, "?e")],
         "SELECT DISTINCT c.s AS x, c.o AS y FROM c JOIN trn a ON a.s = c.o JOIN trn b ON b.s = a.o", ("c", "trn"))
_pattern("path_star_after_binding", "c x", [("?c", LOCATED.star(), "?x"), ("?c", PLACED, "order:7")],
         f"SELECT plc.o AS c, c.o AS x FROM plc JOIN c ON c.s = plc.o WHERE plc.s = '{ORDER}7' UNION SELECT o, o FROM plc WHERE s = '{ORDER}7'", ("c", "loc"))
_pattern("path_star_open", "a b", [("?a", SUB.star(), "?b"), ("?a", SUB, "?c")], "SELECT s AS a, o AS b FROM c UNION SELECT s, s FROM sub", ("c", "sub"))
_pattern("path_group_plus", "x", [("nation:7", (LOCATED / IS_LOCATION).plus(), "?x")], "SELECT o AS x FROM r",
         f"r(o) AS (SELECT b.s FROM loc a JOIN loc b ON b.o = a.o WHERE a.s = '{NATION}7' UNION SELECT b.s FROM r JOIN loc a ON a.s = r.o JOIN loc b ON b.o = a.o)")
_pattern("path_inverse_plus", "x", [("region:1", (~LOCATED).plus(), "?x")], f"SELECT s AS x FROM c WHERE o = '{REGION}1'", ("c", "loc"))
_pattern("path_inverse_of_sequence", "r c", [("?r", ~(LOCATED / LOCATED), "?c"), ("?r", "v:label", "ASIA")], "SELECT DISTINCT b.o AS r, a.s AS c FROM loc a JOIN loc b ON b.s = a.o JOIN lab ON lab.s = b.o AND lab.o = 'ASIA'")
_pattern("type_subclass_of_neighbours", "s p k", [("?s", LOCATED, "nation:7"), ("?s", "?p", "?o"), ("?o", TYPE / SUB.star(), "?k")],
         f"SELECT DISTINCT t.s, t.p, k.k FROM t JOIN loc ON loc.s = t.s AND loc.o = '{NATION}7' JOIN (SELECT s, o AS k FROM typ UNION SELECT typ.s, c.o FROM typ JOIN c ON c.s = typ.o) k ON k.s = t.o", ("c", "sub"))
_pattern("bgp_open_chain", "s q k", [("?s", LOCATED, "nation:3"), ("?s", "?p", "?o"), ("?o", "?q", "?e"), ("?e", TYPE, "?k")],
         f"SELECT DISTINCT t.s, u.p AS q, typ.o AS k FROM t JOIN loc ON loc.s = t.s AND loc.o = '{NATION}3' JOIN t u ON u.s = t.o JOIN typ ON typ.s = u.o")
_pattern("count_open_between", "p q", [("?a", "?p", "?b"), ("?b", "?q", "region:1")], f"SELECT CAST(count(*) AS BIGINT) AS count FROM (SELECT DISTINCT t.p, u.p AS q FROM t JOIN t u ON u.s = t.o WHERE u.o = '{REGION}1')", counted=True)
_pattern("unknown_terms", "x y", [("?x", "v:nothing", "?y")], "SELECT s AS x, o AS y FROM loc WHERE false")


def _two(g: TableGraph) -> dict:
    """Two graphs with an edge or more in common: orders' parts and suppliers, and where suppliers and nations are."""
    keep = lambda *names: {VOCAB + n: g.predicates[VOCAB + n] for n in names}
    return {"trade": TableGraph(g.spark, keep("suppliedBy", "locatedIn"), PREFIXES), "places": TableGraph(g.spark, keep("locatedIn", "nextTo"), PREFIXES)}


_register("from_several", "SELECT 'trade' AS g, s AS x, o AS n FROM loc UNION ALL SELECT 'places', s, o FROM loc")(lambda g: select_from(_two(g), None, ["x", "n"], [("?x", LOCATED, "?n")]))
_register("count_several", "SELECT CAST(count(*) AS BIGINT) AS count FROM loc")(lambda g: count_from(_two(g), ["trade", "places", "none"], ["x", "n"], [("?x", LOCATED, "?n")]))


@_register("inverse_edges", f"SELECT s, '{VOCAB}nextTo' AS p, o FROM nxt UNION SELECT o, '{VOCAB}follows', s FROM nxt UNION SELECT '{VOCAB}follows', '{INVERSE_OF}', '{VOCAB}nextTo'")
def _inverse(g: TableGraph) -> DataFrame:
    declared = g.spark.createDataFrame([(f"{VOCAB}follows", INVERSE_OF, f"{VOCAB}nextTo")], "s string, p string, o string")
    return with_inverses(g.edges("v:nextTo").select("s", F.lit(f"{VOCAB}nextTo").alias("p"), "o").union(declared))


@_register("insert_where", f"SELECT loc.s, loc.o FROM loc UNION SELECT a.s, b.o FROM loc a JOIN loc b ON b.s = a.o")
def _insert(g: TableGraph) -> DataFrame:
    kept = TripleGraph(g.edges("v:locatedIn").select("s", F.lit(f"{VOCAB}locatedIn").alias("p"), "o"), PREFIXES)
    return insert(kept, [("?x", "v:locatedIn", "?z")], [("?x", LOCATED / LOCATED, "?z")]).edges("v:locatedIn")


_register("stats_sizes", """SELECT CAST(n AS BIGINT) AS n_triples, CAST(k AS BIGINT) AS n_nodes, CAST(m AS BIGINT) AS n_predicates, n / (k::DOUBLE * (k::DOUBLE - 1) * m) AS density
  FROM (SELECT count(*) AS n, count(DISTINCT p) AS m FROM t), (SELECT count(*) AS k FROM (SELECT s FROM t UNION SELECT o FROM t))""")(lambda g: stats.sizes(g.coded_triples()))


def _degree_sql(end: str) -> str:
    return f"""SELECT min(d) AS least, max(d) AS most, sum(d)::DOUBLE / (SELECT count(*) FROM (SELECT s FROM t UNION SELECT o FROM t)) AS mean, median(d) AS median, round(stddev_pop(d), 6) AS deviation, round(avg(k), 6) AS mean_kinds
  FROM (SELECT {end}, count(*) AS d, count(DISTINCT p) AS k FROM t GROUP BY {end})"""


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


_register("stats_outdegree", _degree_sql("s"))(lambda g: _rounded(stats.degree_stats(g.coded_triples(), "s"), "deviation", "mean_kinds"))
_register("stats_indegree", _degree_sql("o"))(lambda g: _rounded(stats.degree_stats(g.coded_triples(), "o"), "deviation", "mean_kinds"))
_register("stats_predicates", "SELECT min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS deviation FROM (SELECT p, count(*) AS n FROM t GROUP BY p)")(
    lambda g: _rounded(stats.predicate_stats(g.triples()), "mean", "deviation")
)
_register("predicate_counts", "SELECT p, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY p")(lambda g: stats.predicate_counts(g.triples()))
_register("class_edges_of_result", f"SELECT DISTINCT a.o AS s, t.p, b.o FROM t JOIN typ a ON a.s = t.s JOIN typ b ON b.s = t.o WHERE t.s IN (SELECT s FROM loc WHERE o = '{NATION}7')")(
    lambda g: output.result_class_edges(g, select(g, ["x"], [("?x", LOCATED, "nation:7")]))
)
_register("abbreviate", f"SELECT replace(s, '{NATION}', 'nation:') AS n, replace(o, '{REGION}', 'region:') AS r FROM loc WHERE starts_with(s, '{NATION}')")(
    lambda g: select(g, ["n", "r"], [("?n", NEXT, "?m"), ("?n", LOCATED, "?r")]).select(abbreviate(F.col("n"), PREFIXES).alias("n"), abbreviate(F.col("r"), PREFIXES).alias("r"))
)


def _ontology(g: TableGraph) -> TripleGraph:
    """Each class that has one above it as an owl:Class, and the edges between them."""
    above = g.edges("rdfs:subClassOf")
    kinds = above.select("s", F.lit(RDF_TYPE).alias("p"), F.lit(OWL_CLASS).alias("o"))
    return TripleGraph(kinds.union(above.select("s", F.lit(SUBCLASS).alias("p"), "o")), PREFIXES)


_register("search_classes", """SELECT term, hits, round(score, 6) AS score FROM (SELECT term, count(*) AS hits, sum(sqrt(n) * pow(1 + ln(total / (df + 1)), 2) / sqrt(n_words)) AS score
  FROM (SELECT term, word, count(*) AS n, any_value(n_words) AS n_words, any_value(total) AS total FROM words GROUP BY term, word) x
  JOIN (SELECT word, count(DISTINCT term) AS df FROM words GROUP BY word) d USING (word) WHERE word IN ('13', 'supplier', 'building', 'large', 'economy') GROUP BY term) ORDER BY score DESC, term LIMIT 10""",
  """names AS (SELECT DISTINCT s AS term, [x for x in string_split_regex(lower(regexp_replace(s, '^[a-z][a-z0-9+.-]*:.*[#/]', '')), '[_\\s]+') if x <> ''] AS w FROM sub),
  words AS (SELECT term, len(w) AS n_words, unnest(w) AS word, (SELECT count(*) FROM names WHERE len(w) > 0)::DOUBLE AS total FROM names)""")(
    lambda g: search.search(_ontology(g), "13 Supplier_Building large ECONOMY").withColumn("score", F.round("score", 6))
)
_register("json_lines", f"""SELECT '{{"?n":{{"Namespace":"{BASE}nation","Value":"' || replace(s, '{NATION}', '') || '"}},"?m":{{"Namespace":"{BASE}nation","Value":"' || replace(o, '{NATION}', '') || '"}}}}' AS value FROM nxt""")(
    lambda g: output.json_rows(select(g, ["n", "m"], [("?n", NEXT, "?m")]))
)
_register("csv_lines", f"SELECT 'nation:' || replace(lab.s, '{NATION}', '') AS n, '' AS name FROM lab WHERE starts_with(s, '{NATION}')")(
    lambda g: output.csv_rows(select(g, ["n", "name"], [("?n", NEXT, "?m"), ("?n", "v:label", "?name")]), PREFIXES)
)
_register("dot_of_classes", f"""SELECT 'digraph classes {{' AS value UNION ALL SELECT '}}' UNION ALL
  SELECT DISTINCT '"class:' || replace(replace(s, '{CLASS}', ''), '"', '') || '" -> "class:' || replace(o, '{CLASS}', '') || '";' FROM sub""")(lambda g: output.class_dot(_ontology(g)))
_register("dot_of_graph", f"""SELECT 'digraph graph_ {{' AS value UNION ALL SELECT '}}' UNION ALL
  SELECT '"nation:' || replace(s, '{NATION}', '') || '" -> "nation:' || replace(o, '{NATION}', '') || '" [label="v:nextTo"];' FROM nxt""")(
    lambda g: output.graph_dot(TableGraph(g.spark, {f"{VOCAB}nextTo": g.predicates[f"{VOCAB}nextTo"]}, PREFIXES))
)
_register("turtle_lines", " UNION ALL ".join(f"SELECT '@prefix {k}: <{v}> .' AS value" for k, v in (STANDARD | PREFIXES).items()) + f" UNION ALL SELECT '<' || s || '> v:nextTo <' || o || '> .' FROM nxt")(
    lambda g: output.turtle_lines(TableGraph(g.spark, {f"{VOCAB}nextTo": g.predicates[f"{VOCAB}nextTo"]}, PREFIXES))
)
_register("outdegree_histogram", "SELECT d AS value, count(*) AS n FROM (SELECT s, count(*) AS d FROM t GROUP BY s) GROUP BY d")(lambda g: stats.histogram(stats.degrees(g.coded_triples(), "s"), "degree"))
_register("indegree_histogram", "SELECT d AS value, count(*) AS n FROM (SELECT o, count(*) AS d FROM t GROUP BY o) GROUP BY d")(lambda g: stats.histogram(stats.degrees(g.coded_triples(), "o"), "degree"))
_register("namespaces", f"SELECT regexp_extract(s, '^[a-z][a-z0-9+.-]*:.*[#/]') AS namespace, CAST(count(*) AS BIGINT) AS n, max(replace(s, regexp_extract(s, '^[a-z][a-z0-9+.-]*:.*[#/]'), '')) AS last FROM loc GROUP BY 1")(
    lambda g: g.edges("v:locatedIn").groupBy(namespace(F.col("s")).alias("namespace")).agg(F.count(F.lit(1)).alias("n"), F.max(local_name(F.col("s"))).alias("last"))
)
FLAGSHIP = "bgp_chain_join"

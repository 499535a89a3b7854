"""The star-schema tables as a graph: each predicate is columns of one table, or of a few."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.terms import SUBCLASS, TYPE
from ..plans.graph import Node, Part, TableGraph

BASE = "https://example.org/wh/"
VOCAB = BASE + "vocab#"
PREFIXES = {"v": VOCAB, "class": BASE + "class#"} | {t: f"{BASE}{t}#" for t in ("region", "nation", "customer", "supplier", "part", "order", "user", "turn")}


def node(table: str, *keys: str) -> Node:
    return Node(f"{BASE}{table}#", keys)


def one_class(name: str) -> Node:
    return Node(f"{BASE}class#{name}")


def warehouse(spark: SparkSession, sf_dir: str) -> TableGraph:
    tables = {}

    def rows(table: str):
        if table not in tables:
            tables[table] = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        return tables[table]

    def part(table: str, s: Node, o: Node, unique: bool = True) -> Part:
        return Part(rows(table), s, o, unique)

    order, customer, supplier, nation, region, item = node("order", "l_orderkey"), node("customer", "c_custkey"), node("supplier", "s_suppkey"), node("nation", "n_nationkey"), node("region", "n_regionkey"), node("part", "p_partkey")
    placed_by = (node("order", "o_orderkey"), node("customer", "o_custkey"))
    located_in = [("nation", nation, region), ("customer", customer, node("nation", "c_nationkey")), ("supplier", supplier, node("nation", "s_nationkey"))]
    turns = rows("conversations").select("conv_id", "turn").distinct()
    after = turns.select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"))
    both = turns.join(after, (F.col("conv_id") == F.col("_conv")) & (F.col("turn") + 1 == F.col("_turn")))
    above = spark.createDataFrame([("Brand", "Part"), ("Kind", "Part"), ("Customer", "Party"), ("Supplier", "Party")], "a string, b string")
    ring = rows("nation").withColumn("_next", (F.col("n_nationkey") + 1) % 25)
    predicates = {
        "locatedIn": [part(*x) for x in located_in],
        "isLocationOf": [part(t, o, s) for t, s, o in located_in],
        "placedBy": [part("orders", *placed_by)],
        "placed": [part("orders", *reversed(placed_by))],
        "contains": [part("lineitem", order, node("part", "l_partkey"), unique=False)],
        "suppliedBy": [part("lineitem", order, node("supplier", "l_suppkey"), unique=False)],
        "supplies": [part("lineitem", node("supplier", "l_suppkey"), node("part", "l_partkey"), unique=False)],
        "nextTo": [Part(ring, nation, node("nation", "_next"))],
        "nextTurn": [Part(both, node("turn", "conv_id", "turn"), node("turn", "conv_id", "_turn"))],
        "performed": [part("events", node("user", "user_id"), node("class", "event_type"), unique=False)],
        "label": [part("region", node("region", "r_regionkey"), Node("", ("r_name",))), part("nation", nation, Node("", ("n_name",)))],
    }
    types = [
        part("part", item, node("class", "p_brand")), part("part", item, node("class", "p_type")),
        part("customer", customer, node("class", "c_mktsegment")), part("supplier", supplier, one_class("Supplier")),
    ]
    subclasses = [
        part("part", node("class", "p_brand"), one_class("Brand"), unique=False), part("part", node("class", "p_type"), one_class("Kind"), unique=False),
        part("customer", node("class", "c_mktsegment"), one_class("Customer"), unique=False), Part(above, node("class", "a"), node("class", "b")),
    ]
    return TableGraph(spark, {VOCAB + k: v for k, v in predicates.items()} | {TYPE: types, SUBCLASS: subclasses}, PREFIXES)

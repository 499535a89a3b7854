"""Search of classes by the words of their names, ranked by tf-idf."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import CLASS, TYPE, local_name
from ..plans.graph import Graph


def class_words(graph: Graph) -> DataFrame:
    """(term, word, n, n_words): the words of the local name of each owl:Class, lower-cased, split at ``_`` and spaces."""
    classes = graph.edges(TYPE, o=CLASS).select(F.col("s").alias("term"))
    words = F.split(F.lower(local_name(F.col("term"))), "[_\\s]+")
    one_each = classes.select("term", F.filter(words, lambda w: w != "").alias("words")).select("term", F.size("words").alias("n_words"), F.explode("words").alias("word"))
    return one_each.groupBy("term", "word", "n_words").agg(F.count(F.lit(1)).alias("n"))


def search(graph: Graph, text: str, top: int = 10) -> DataFrame:
    """(term, hits, score) of the ``top`` classes whose names share a word with ``text``."""
    asked = sorted({w for w in text.lower().replace("_", " ").split() if w})
    index = class_words(graph)
    hits = index.where(F.col("word").isin(asked))
    total = index.agg(F.count_distinct("term").alias("_total"))
    weights = hits.groupBy("word").agg(F.count_distinct("term").alias("_df")).crossJoin(total)  # a row a word asked for
    scored = hits.join(weights, "word").withColumn("_part", F.sqrt("n") * F.pow(1 + F.log(F.col("_total") / (F.col("_df") + 1)), 2) / F.sqrt("n_words"))
    return scored.groupBy("term").agg(F.count_distinct("word").alias("hits"), F.sum("_part").alias("score")).orderBy(F.desc("score"), "term").limit(top)

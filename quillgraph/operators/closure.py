"""Reachability over edges, by joins in rounds.

With seeds, each round asks for the edges that leave the nodes met last, and only pairs not met before go on, so a round
costs what it finds and no edge is read for a node that the seeds do not reach. Without seeds, paths double: a round
joins what is new with all that is known on either side, and a chain of length n takes log n rounds. Cycles end since
nothing new is found. What a round finds is a stage table in the folder that all machines share, so lineage stays short
and a lost executor costs no earlier round; pairs known so far are merged into one table as rounds go on, and tables
that nothing reads any more are removed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop, stage

MERGED = 8  # tables of pairs that are kept apart


def compose(first: DataFrame, second: DataFrame) -> DataFrame:
    """(s, o) with a step of ``first`` and then one of ``second`` between them, each pair once."""
    return first.select("s", F.col("o").alias("_via")).join(second.select(F.col("s").alias("_via"), "o"), "_via").select("s", "o").distinct()


def plus(step: Callable[[DataFrame | None], DataFrame], seeds: DataFrame | None = None) -> DataFrame:
    """(s, o) where one edge or more lead from s to o. ``step``: (s, o) of the edges that leave the nodes (s) of a
    frame, or of all for None; ``seeds`` (s): only from these."""
    new = stage(step(seeds if seeds is None else seeds.distinct()).select("s", "o").distinct(), "pairs")
    known = [new]
    while not new.isEmpty():
        if seeds is None:
            every = reduce(DataFrame.union, known)
            found = compose(new, every).union(compose(every, new)).distinct()
        else:
            ends = new.select(F.col("o").alias("s")).distinct()
            found = compose(new, step(ends))
        new = stage(reduce(lambda a, b: a.join(b, ["s", "o"], "left_anti"), [found, *known]), "pairs")
        known.append(new)
        if len(known) > MERGED:
            merged = stage(reduce(DataFrame.union, known), "pairs")
            drop(*[k for k in known if k is not new])
            known = [merged]
    return reduce(DataFrame.union, known)

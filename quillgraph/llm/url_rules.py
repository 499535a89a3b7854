"""URL filters: a sort-merge range join of hosts with nested rules, in DataFrame operations only.

Reversing a host's labels (``www.example.com`` to ``com.example.www.``) puts a domain before all its
subdomains, so a rule for a host is the interval of keys that start with its key. Such intervals nest or are
disjoint. The sweep sorts distinct hosts and the rules' starts and ends by key; a running sum of starts and
ends is the depth of nesting, and the last start at each depth, while it has not ended, is one slot of the
stack of active rules.

The sweep runs in parallel over range partitions ("blocks"): what a block needs from those before it, its
starting depth and the slots still open, is one row a block. The stack holds hosts of rules and the lengths of their
paths alone; which of a host's rules a path starts with is a join on host and a prefix of each such length, so no row
holds all rules of a host.

Defined results: a null url, or one without ``://``, has host and path ``""`` and meets no rule; an empty
table gives an empty result; repeated rows are judged each; columns beside the url are carried along unless
their name is one of the results', which then replaces them. Of rules that fit, the longest ``host + path``
wins, then the longer host, then the smaller verdict (``allow``). Without a fitting rule the verdict is ``default``.
Rules with a null are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ACTIVE = "array<struct<host:string,lengths:array<int>>>"


def url_host(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_key(host: Column) -> Column:
    """Labels in reverse order, each followed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, "[.]", -1)), "."), F.lit("."))


def active_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``hosts`` (key) and ``rules`` (host, path, verdict) to (key, rules): each key that lies in a rule's interval once,
    with the hosts of its stack from the outermost inwards and the lengths of their rules' paths."""
    lengths = F.sort_array(F.collect_set(F.length("path")))
    by_host = rules.groupBy("host").agg(F.array(F.struct("host", lengths.alias("lengths"))).alias("rules")).withColumn("key", host_key(F.col("host")))
    none = F.lit(None).cast(ACTIVE)
    end = F.expr("concat(substring(key, 1, length(key) - 1), '/')")  # '/' follows '.': the first key after all that start with key
    starts = by_host.select(F.col("key").alias("at"), F.lit(1).alias("step"), end.alias("until"), "rules")
    ends = by_host.select(end.alias("at"), F.lit(-1).alias("step"), F.lit(None).cast("string").alias("until"), none.alias("rules"))
    points = hosts.select("key").distinct().select(F.col("key").alias("at"), F.lit(0).alias("step"), F.lit(None).cast("string").alias("until"), none.alias("rules"))
    events = stage(starts.unionByName(ends).unionByName(points).repartitionByRange("at").withColumn("block", F.spark_partition_id()), "url-sweep")

    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    in_block = Window.partitionBy("block").orderBy("at", F.desc("step")).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    moves = events.groupBy("block").agg(F.sum("step").alias("net")).select("block", F.coalesce(F.sum("net").over(before), F.lit(0)).alias("base"))
    deep = events.join(F.broadcast(moves), "block").withColumn("depth", F.col("base") + F.sum("step").over(in_block))
    rule_depth = deep.where("step = 1")
    most = rule_depth.agg(F.max("depth")).first()[0] or 0  # no more than a host name has labels
    slots = [f"slot{d}" for d in range(1, most + 1)]
    if not slots:
        return events.where("false").select(F.col("at").alias("key"), "rules")

    opened = {s: F.when((F.col("step") == 1) & (F.col("depth") == d), F.struct("until", "rules")) for d, s in enumerate(slots, 1)}
    carried = (
        rule_depth.groupBy("block").agg(*[F.max_by(c, F.when(c.isNotNull(), F.col("at"))).alias(s) for s, c in opened.items()])
        .join(moves.select("block"), "block", "right")
        .select("block", *[F.last(s, ignorenulls=True).over(before).alias(f"{s}_before") for s in slots])
    )
    swept = deep.join(F.broadcast(carried), "block").select(
        "at", "step", *[F.coalesce(F.last(c, ignorenulls=True).over(in_block), F.col(f"{s}_before")).alias(s) for s, c in opened.items()]
    )
    stack = F.filter(F.array(*slots), lambda x: x["until"] > F.col("at"))
    return swept.where("step = 0").select(F.col("at").alias("key"), F.flatten(F.transform(stack, lambda x: x["rules"])).alias("rules")).where(F.size("rules") > 0)


def judge_urls(df: DataFrame, rules: DataFrame | Sequence[tuple[str, str, str]], url: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict to ``df``. ``rules``: (verdict, host, path), each once."""
    spark = df.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")
    rules = rules.select("verdict", "host", "path").dropna()
    address = F.col(f"`{url}`")
    parts = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), url_host(address).alias("host"), url_path(address).alias("path"))
    places = parts.select("host", "path").distinct().withColumn("key", host_key(F.col("host")))
    stacks = active_hosts(places.select("key"), rules)
    asked = places.join(stacks, "key").select("host", "path", F.inline("rules")).toDF("host", "path", "rule_host", "lengths")
    prefixes = asked.select("host", "path", "rule_host", F.explode("lengths").alias("n")).where(F.col("n") <= F.length("path"))
    prefixes = prefixes.select("host", "path", "rule_host", F.substring("path", F.lit(1), F.col("n")).alias("rule_path"))
    fits = prefixes.join(rules.toDF("verdict", "rule_host", "rule_path"), ["rule_host", "rule_path"])
    rank = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"), F.col("verdict") == "allow", F.concat("rule_host", "rule_path").alias("rule"), "verdict")
    best = fits.groupBy("host", "path").agg(F.max(rank).alias("best")).select("host", "path", "best.rule", "best.verdict")
    kept = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    return parts.join(best, ["host", "path"], "left").select(*[F.col(f"row.`{c}`") for c in kept], "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))

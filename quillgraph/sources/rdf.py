"""N-Triples and Turtle files as triples (s, p, o).

Both are read by Spark's text source, split between tasks: N-Triples by lines and regular expressions, Turtle at dots
that end a line, into records of one statement or more, whose few grammar rules a small function applies to Arrow
batches. Prefixes and bases, a few a file, are gathered first and sent to the tasks.

Literals are their text: language tags and data types are dropped. Blank nodes are named by file and label, or for
``[...]`` and ``(...)`` by their record. Defined results: a statement that does not parse raises an error with its
text; of several prefixes or bases by one name in a file the last holds; a file whose lines end in CRLF is one record;
a dot at a line's end inside a statement, in a literal of several lines or a comment, is not supported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import RDF, STANDARD
from ..plans.graph import TripleGraph
from ..session import ship_package

PREFIX = re.compile(r"(?:^|[\n.>])\s*@?prefix\s+([\w.-]*):\s*<([^>]*)>", re.IGNORECASE)
BASE = re.compile(r"(?:^|[\n.>])\s*@?base\s*<([^>]*)>", re.IGNORECASE)
TOKEN = re.compile(
    r"""\s*+(?:\#[^\n]*+\s*+)*+(?:(?P<directive>@prefix\b[^<]*<[^>]*>\s*\.?|@base\s*<[^>]*>\s*\.?|(?i:prefix)\s[^<:]*:\s*<[^>]*>|(?i:base)\s*<[^>]*>)|(?P<iri><[^>]*>)|(?P<text>\"{3}(?:[^\\]|\\.)*?\"{3}|'{3}(?:[^\\]|\\.)*?'{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')(?:@[A-Za-z-]+|\^\^(?:<[^>]*>|[\w.-]*:[\w.-]+))?
    |(?P<blank>_:[\w.-]*\w)|(?P<name>[\w.-]*:(?:[\w%-]|\.(?=[\w%-]))*)|(?P<number>[+-]?(?:\d+\.\d+|\d+)(?:[eE][+-]?\d+)?)|(?P<word>a|true|false)(?![\w:])|(?P<sign>[;,\[\]().]))""",
    re.VERBOSE | re.DOTALL,
)
ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.DOTALL)
ESCAPED = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
SCHEMA = "s string, p string, o string"


def _unescape(text: str) -> str:
    return ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else ESCAPED.get(m[3], m[3]), text)


def statement(text: str, prefixes: dict[str, str], scope: str, base: str = "") -> list[tuple[str, str, str]]:
    """The triples of Turtle statements with dots between them; directives are passed over."""
    found, at, made = [], 0, 0
    tokens: list[tuple[str, str]] = []
    body = text.rstrip()
    while at < len(body):
        m = TOKEN.match(body, at)
        if not m:
            if re.fullmatch(r"\s*(?:#[^\n]*\s*)*", body[at:]):
                break
            raise ValueError(f"not Turtle: {body[at:at + 80]!r}")
        if m.lastgroup != "directive":
            tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    tokens.reverse()

    def fresh() -> str:
        nonlocal made
        made += 1
        return f"_:{scope}n{made}"

    def term() -> str:
        if not tokens:
            raise ValueError(f"not Turtle: {text[:80]!r}")
        kind, value = tokens.pop()
        if kind == "iri":
            return _resolved(_unescape(value[1:-1]), base)
        if kind == "text":
            return _unescape(value[3:-3] if value[:3] in ('"""', "'''") and len(value) >= 6 else value[1:-1])
        if kind == "name":
            head, _, local = value.partition(":")
            return prefixes[head] + local
        if kind == "blank":
            return f"_:{scope.split('/')[0]}{value[2:]}"
        if (kind, value) == ("word", "a"):
            return RDF + "type"
        if (kind, value) == ("sign", "["):
            node = fresh()
            properties(node, "]")
            tokens.pop()
            return node
        if (kind, value) == ("sign", "("):
            items = []
            while tokens[-1] != ("sign", ")"):
                items.append(term())
            tokens.pop()
            nodes = [fresh() for _ in items] + [RDF + "nil"]
            for node, item, after in zip(nodes, items, nodes[1:], strict=False):
                found.extend([(node, RDF + "first", item), (node, RDF + "rest", after)])
            return nodes[0]
        if kind in ("number", "word"):
            return value
        raise ValueError(f"not expected in Turtle: {value!r}")

    def properties(subject: str, end: str) -> None:
        while tokens and tokens[-1] != ("sign", end):
            if tokens[-1] == ("sign", ";"):
                tokens.pop()
                continue
            predicate = term()
            while True:
                found.append((subject, predicate, term()))
                if not tokens or tokens[-1] != ("sign", ","):
                    break
                tokens.pop()

    while tokens:
        if tokens[-1] == ("sign", "."):
            tokens.pop()
            continue
        before, subject = len(found), term()
        properties(subject, ".")
        if len(found) == before:
            raise ValueError(f"not Turtle: {text[:80]!r}")
    return found


def _resolved(iri: str, base: str) -> str:
    return iri if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", iri) else urljoin(base, iri)


def turtle_text(spark: SparkSession, text: str, base: str = "") -> TripleGraph:
    """The graph of a small Turtle text that the driver holds."""
    prefixes = STANDARD | dict(PREFIX.findall(text))
    found = BASE.findall(text)
    rows = statement(text, prefixes, "text/0", urljoin(base, found[-1]) if found else base)
    return TripleGraph(spark.createDataFrame(rows, SCHEMA), {k: v for k, v in prefixes.items() if k})


def read_turtle(spark: SparkSession, *paths: str) -> TripleGraph:
    ship_package(spark)
    lines = spark.read.option("lineSep", ".\n").text(list(paths)).select("value", F.xxhash64("_metadata.file_path").alias("file"))
    marks = lambda pattern, parts: F.expr(f"regexp_extract_all(value, r'{pattern}', 0)").alias(parts)
    named = lines.where(F.col("value").rlike(r"(?i)@?(prefix|base)\s*[^<\n]*<"))
    headers = named.select("file", marks(r"(?is)(^|[\n.>])\s*@?prefix\s+[\w.-]*:\s*<[^>]*>", "prefixes"), marks(r"(?is)(^|[\n.>])\s*@?base\s*<[^>]*>", "bases"))
    prefixes: dict[int, dict[str, str]] = {}
    bases: dict[int, str] = {}
    for row in headers.where("size(prefixes) + size(bases) > 0").collect():  # a file's directives
        for text in row["prefixes"]:
            prefixes.setdefault(row["file"], {}).update(PREFIX.findall(text))
        for text in row["bases"]:
            bases[row["file"]] = urljoin(bases.get(row["file"], ""), BASE.search(text)[1])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for value, file, hashed in batch.itertuples(index=False):
                scope = f"f{file & 0xFFFFFFFF:08x}/{hashed & 0xFFFFFFFFFFFFFFFF:016x}"
                rows += statement(value, STANDARD | prefixes.get(file, {}), scope, bases.get(file, ""))
            yield pd.DataFrame(rows, columns=["s", "p", "o"], dtype="str")

    triples = lines.select("value", "file", F.xxhash64("value")).mapInPandas(run, SCHEMA)
    known: dict[str, str] = {}
    for each in prefixes.values():
        known |= each
    return TripleGraph(triples, {k: v for k, v in known.items() if k})


def read_ntriples(spark: SparkSession, *paths: str, prefixes: dict[str, str] | None = None) -> TripleGraph:
    """Lines that are not triples (comments, blank lines) are passed over."""
    lines = spark.read.text(list(paths)).select(F.trim("value").alias("value"), F.hex(F.xxhash64("_metadata.file_path")).alias("file"))
    node = r"(<[^>]*>|_:[\w.-]*\w)"
    line = rf'^{node}\s+<([^>]*)>\s+(<[^>]*>|_:[\w.-]*\w|"((?:[^"\\]|\\.)*)"\S*)\s*\.\s*(?:#.*)?$'
    part = lambda k: F.regexp_extract("value", line, k)
    name = lambda c: F.when(c.startswith("<"), F.substring(c, F.lit(2), F.length(c) - 2)).when(c.startswith("_:"), F.concat(F.lit("_:f"), F.col("file"), F.substring(c, F.lit(3), F.length(c)))).otherwise(c)
    text = F.replace(part(4), F.lit("\\\\"), F.lit("\0"))  # a literal backslash waits as a character that no text holds
    for mark, plain in (("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), ('\\"', '"'), ("\0", "\\")):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    matched = lines.where(F.col("value").rlike(line))
    value = F.when(part(3).startswith('"'), text).otherwise(name(part(3)))
    return TripleGraph(matched.select(name(part(1)).alias("s"), part(2).alias("p"), value.alias("o")), prefixes)

"""Terms are strings: an IRI in full, a literal's text, or ``_:label`` for a blank node."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The namespaces of W3C vocabularies.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
STANDARD = {"rdf": RDF, "rdfs": RDFS, "owl": OWL}
TYPE, SUBCLASS, INVERSE_OF, CLASS = RDF + "type", RDFS + "subClassOf", OWL + "inverseOf", OWL + "Class"


def is_variable(term: str) -> bool:
    return term.startswith("?")


def expand(term: str, prefixes: dict[str, str]) -> str:
    """``pfx:local`` in full where the prefix is known, ``<iri>`` and ``"text"`` without their marks; else as it is."""
    if term[:1] + term[-1:] in ("<>", '""'):
        return term[1:-1]
    head, colon, local = term.partition(":")
    return prefixes[head] + local if colon and head in prefixes and not local.startswith("//") else term


def namespace(term: Column) -> Column:
    """Up to the last ``#``, or else the last ``/``, of an IRI, with it; empty for other terms."""
    return F.regexp_extract(term, r"^([a-z][a-z0-9+.-]*:.*[#/])", 1)


def local_name(term: Column) -> Column:
    return F.when(namespace(term) == "", term).otherwise(F.substring(term, F.length(namespace(term)) + 1, F.length(term)))


def abbreviate(term: Column, prefixes: dict[str, str]) -> Column:
    """``pfx:local`` for terms of a known namespace, null for others."""
    out = F.lit(None).cast("string")
    for name, full in sorted(prefixes.items(), key=lambda x: (len(x[1]), x)):  # the longest namespace is asked first
        out = F.when(term.startswith(full), F.concat(F.lit(name + ":"), F.substring(term, F.lit(len(full) + 1), F.length(term)))).otherwise(out)
    return out

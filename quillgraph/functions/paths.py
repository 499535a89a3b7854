"""Property paths: small values that say how to get from a subject to an object.

``pred("feeds")`` is one edge; ``a / b`` follows one after the other, ``a | b`` either, ``~a`` backwards, and
``a.plus()``, ``a.star()``, ``a.optional()`` repeat. Names with a known prefix are expanded by the graph they meet.
"""

from __future__ import annotations

from dataclasses import dataclass


class Path:
    def __truediv__(self, other: Path | str) -> Path:
        return Seq(self, pred(other))

    def __or__(self, other: Path | str) -> Path:
        return Alt(self, pred(other))

    def __invert__(self) -> Path:
        return Inverse(self)

    def plus(self) -> Path:
        return Repeat(self, zero=False, many=True)

    def star(self) -> Path:
        return Repeat(self, zero=True, many=True)

    def optional(self) -> Path:
        return Repeat(self, zero=True, many=False)


@dataclass(frozen=True)
class Pred(Path):
    name: str


@dataclass(frozen=True)
class Seq(Path):
    first: Path
    second: Path


@dataclass(frozen=True)
class Alt(Path):
    first: Path
    second: Path


@dataclass(frozen=True)
class Inverse(Path):
    path: Path


@dataclass(frozen=True)
class Repeat(Path):
    path: Path
    zero: bool
    many: bool


def pred(name: Path | str) -> Path:
    """One edge; ``a`` is rdf:type."""
    return name if isinstance(name, Path) else Pred("rdf:type" if name == "a" else name)

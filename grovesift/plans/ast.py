"""Filter trees. Sizes and times are inclusive bounds, None where open; every form of a constraint reduces to that."""

from __future__ import annotations

from dataclasses import dataclass


class Node:
    pass


@dataclass(frozen=True)
class Everything(Node):
    pass


@dataclass(frozen=True)
class Text(Node):
    term: str


@dataclass(frozen=True)
class PathText(Node):
    term: str


@dataclass(frozen=True)
class Folder(Node):
    path: str


@dataclass(frozen=True)
class Extensions(Node):
    names: tuple[str, ...]


@dataclass(frozen=True)
class Pattern(Node):
    regex: str


@dataclass(frozen=True)
class Kind(Node):
    folder: bool


@dataclass(frozen=True)
class Size(Node):
    low: int | None
    high: int | None


@dataclass(frozen=True)
class Modified(Node):
    low: int | None
    high: int | None


@dataclass(frozen=True)
class And(Node):
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class Or(Node):
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class Xor(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class Not(Node):
    part: Node


@dataclass(frozen=True)
class Plan:
    """What a query asks for: a tree, and a limit if it names one."""

    tree: Node
    limit: int | None = None

    @property
    def unconstrained(self) -> bool:
        return self.tree == Everything()

    @property
    def terms(self) -> list[str]:
        """The search terms, in order."""

        def walk(node: Node) -> list[str]:
            match node:
                case Text(term):
                    return [term]
                case And(parts) | Or(parts):
                    return [t for p in parts for t in walk(p)]
                case Xor(a, b):
                    return walk(a) + walk(b)
            return []

        return walk(self.tree)


def all_of(parts: list[Node | None]) -> Node | None:
    """Conjunction; a missing part is no condition."""
    parts = [p for p in parts if p is not None and p != Everything()]
    return parts[0] if len(parts) == 1 else And(tuple(parts)) if parts else None


def any_of(parts: list[Node | None]) -> Node | None:
    """Disjunction of the parts that are there."""
    parts = [p for p in parts if p is not None]
    return parts[0] if len(parts) == 1 else Or(tuple(parts)) if parts else None

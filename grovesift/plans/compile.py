"""Filter trees to one Catalyst expression over the files table; nothing runs in Python for a row."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import fold, glob_pattern, has_wildcard, whole_word_pattern, within
from .ast import And, Everything, Extensions, Folder, Kind, Modified, Node, Not, Or, PathText, Pattern, Size, Text, Xor
from .patterns import compiled


@dataclass(frozen=True)
class Options:
    match_path: bool = False
    ignore_case: bool = True
    whole_word: bool = False


def _text(term: str, target: str, o: Options, whole_word: bool) -> Column:
    """A term in ``name`` or ``path``. ASCII terms are tested on the stored folded column, whose test reaches the scan."""
    if not o.ignore_case:
        column = F.col(target)
    elif term.isascii():
        column, term = F.col(f"{target}_fold"), fold(term)
    else:
        column, term = F.lower(target), term.lower()
    if has_wildcard(term):
        return column.rlike(glob_pattern(term))
    return column.rlike(whole_word_pattern(term)) if whole_word else column.contains(term)


def _needed(need, column: Column) -> Column:
    """The texts of a pattern's formula in a column."""
    if isinstance(need, str):
        return column.contains(need)
    kind, parts = need
    return reduce(and_ if kind == "and" else or_, (_needed(p, column) for p in parts))


def _between(column: str, low: int | None, high: int | None) -> Column:
    c = F.col(column)
    bounds = [c >= low] * (low is not None) + [c <= high] * (high is not None)
    return reduce(and_, bounds)


def to_column(node: Node, o: Options = Options()) -> Column:
    """True or false for every row; a null column counts as no match."""
    match node:
        case Everything():
            return F.lit(True)
        case And(parts):
            return reduce(and_, (to_column(p, o) for p in parts))
        case Or(parts):
            return reduce(or_, (to_column(p, o) for p in parts))
        case Xor(a, b):
            return F.coalesce(to_column(a, o), F.lit(False)) != F.coalesce(to_column(b, o), F.lit(False))
        case Not(part):
            return ~F.coalesce(to_column(part, o), F.lit(False))
        case Text(term):
            slashed = term.replace("\\", "/") if o.match_path else term
            return _text(slashed, "path" if o.match_path else "name", o, o.whole_word)
        case PathText(term):
            return _text(term.replace("\\", "/"), "path", o, False)
        case Folder(path):
            if o.ignore_case and path.isascii():
                return within(F.col("path_fold"), fold(path)) if path != "/" else F.lit(True)
            if o.ignore_case:
                return within(F.lower("path"), path.lower())
            return within(F.col("path"), path) if path != "/" else F.lit(True)
        case Extensions(names):
            return F.col("ext_fold").isin([fold(n) for n in names if n.isascii()]) if any(n.isascii() for n in names) else F.lit(False)
        case Pattern(regex):
            target, found = "path" if o.match_path else "name", compiled(regex, o.ignore_case)
            test = F.col(target).rlike(found.java)
            # Texts that every match holds are tested first; these tests reach the scan.
            return test if found.need is None else _needed(found.need, F.col(f"{target}_fold" if found.ignoring else target)) & test
        case Kind(folder):
            return F.col("is_dir") if folder else ~F.col("is_dir")
        case Size(low, high):
            return _between("size", low, high)
        case Modified(low, high):
            return _between("mtime", low, high)
    raise TypeError(f"no such filter: {node!r}")

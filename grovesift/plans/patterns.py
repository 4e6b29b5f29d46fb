r"""Patterns: read to a tree, from which come Java's spelling and the texts that every match must hold.

Classes are Unicode's: ``\w``, ``\d``, ``\s``, ``\b`` and POSIX classes hold letters, digits and blanks of all scripts, which
Java's own don't. Whatever isn't a letter or digit is spelled by its code, so that no character has a second meaning.

What a match must hold is a formula of texts: a sequence needs what its parts need, an alternative what one of its branches
does. Its texts are tested before the pattern, reach the scan, and can be looked up in an index.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

from ..errors import QueryError

WORD = r"\p{IsAlphabetic}\p{M}\p{Nd}\p{Pc}\x{200c}\x{200d}"
SPACES, LINES = r"\p{IsWhite_Space}", r"\n\x{b}\f\r\x{85}\x{2028}\x{2029}"
#: Classes of one letter, as what stands between brackets.
CLASSES = {"d": r"\p{Nd}", "w": WORD, "s": SPACES, "h": r"\t\p{Zs}", "v": LINES}
POSIX = {
    "alpha": r"\p{IsAlphabetic}", "digit": r"\p{Nd}", "alnum": r"\p{IsAlphabetic}\p{Nd}", "upper": r"\p{IsUppercase}", "lower": r"\p{IsLowercase}", "punct": r"\p{P}", "space": SPACES, "blank": r"\t\p{Zs}",
    "cntrl": r"\p{Cc}", "xdigit": r"\p{Nd}\p{IsHex_Digit}", "graph": r"[^\p{IsWhite_Space}\p{Cc}\p{Cs}\p{Cn}]", "print": r"\p{Zs}[^\p{IsWhite_Space}\p{Cc}\p{Cs}\p{Cn}]", "word": WORD,
}
#: Unicode's general categories by their long names.
CATEGORIES = {
    "letter": "L", "uppercaseletter": "Lu", "lowercaseletter": "Ll", "titlecaseletter": "Lt", "modifierletter": "Lm", "otherletter": "Lo", "mark": "M", "nonspacingmark": "Mn", "spacingmark": "Mc", "enclosingmark": "Me",
    "number": "N", "decimalnumber": "Nd", "letternumber": "Nl", "othernumber": "No", "punctuation": "P", "connectorpunctuation": "Pc", "dashpunctuation": "Pd", "openpunctuation": "Ps", "closepunctuation": "Pe",
    "initialpunctuation": "Pi", "finalpunctuation": "Pf", "otherpunctuation": "Po", "symbol": "S", "mathsymbol": "Sm", "currencysymbol": "Sc", "modifiersymbol": "Sk", "othersymbol": "So", "separator": "Z",
    "spaceseparator": "Zs", "lineseparator": "Zl", "paragraphseparator": "Zp", "other": "C", "control": "Cc", "format": "Cf", "surrogate": "Cs", "privateuse": "Co", "unassigned": "Cn",
}
CONTROLS = {"a": "\a", "e": "\x1b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
BORDER = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
NO_BORDER = rf"(?:(?<=[{WORD}])(?=[{WORD}])|(?<![{WORD}])(?![{WORD}]))"
#: Letters that a pattern without case also finds in characters beyond ASCII (dotted and dotless i, Kelvin, long s).
FOLDED_FROM_AFAR = frozenset("iks")
#: Texts that a node may stand for, and texts in a formula, at most; beyond that a node needs nothing.
MOST_EXACT, MOST_TEXTS = 32, 64


@dataclass(frozen=True)
class Char:
    text: str


@dataclass(frozen=True)
class One:
    """One character of a class; ``chars`` if these are all."""

    java: str
    chars: str | None = None


@dataclass(frozen=True)
class Mark:
    """Takes no characters: anchors, borders, looks ahead and back."""

    java: str


@dataclass(frozen=True)
class Unknown:
    """Takes characters that aren't known before: references and clusters."""

    java: str


@dataclass(frozen=True)
class Seq:
    parts: tuple


@dataclass(frozen=True)
class Alt:
    parts: tuple


@dataclass(frozen=True)
class Group:
    opens: str
    part: object


@dataclass(frozen=True)
class Repeat:
    part: object
    low: int
    high: int | None
    how: str


def spelled(c: str) -> str:
    return c if c.isascii() and c.isalnum() else rf"\x{{{ord(c):x}}}"


class Reader:
    """Reads one pattern; ``ignoring`` tells whether any part of it is without case by a flag of its own."""

    def __init__(self, text: str):
        self.text, self.at, self.ignoring, self.flags = text, 0, False, frozenset()

    def fail(self) -> QueryError:
        return QueryError(f"Not a valid pattern: {self.text}")

    def peek(self, n: int = 1) -> str:
        return self.text[self.at : self.at + n]

    def take(self, n: int = 1) -> str:
        out = self.peek(n)
        if len(out) < n:
            raise self.fail()
        self.at += n
        return out

    def given(self, mark: str) -> bool:
        if self.text.startswith(mark, self.at):
            self.at += len(mark)
            return True
        return False

    def found(self, pattern: str) -> re.Match | None:
        m = re.compile(pattern, re.S).match(self.text, self.at)
        if m:
            self.at = m.end()
        return m

    def read(self):
        tree = self.alternatives()
        if self.at < len(self.text):
            raise self.fail()
        return tree

    def alternatives(self):
        """Up to a closing parenthesis or the end; flags that are set within hold until there."""
        flags, branches = self.flags, [self.sequence()]
        while self.given("|"):
            branches.append(self.sequence())
        self.flags = flags
        return branches[0] if len(branches) == 1 else Alt(tuple(branches))

    def sequence(self) -> Seq:
        parts = []
        while self.at < len(self.text) and self.peek() not in ("|", ")"):
            if "x" in self.flags and self.found(r"\s+|#[^\n]*\n?"):
                continue
            if self.given("\\Q"):
                end = self.text.find("\\E", self.at)
                quoted = self.text[self.at : end if end >= 0 else len(self.text)]
                self.at = end + 2 if end >= 0 else len(self.text)
                parts += map(Char, quoted[:-1])
                if quoted:
                    parts.append(self.repeated(Char(quoted[-1])))
                continue
            atom = self.atom()
            if atom is not None:
                parts.append(self.repeated(atom))
        return Seq(tuple(parts))

    def repeated(self, atom):
        while True:
            if "x" in self.flags:
                self.found(r"(?:\s+|#[^\n]*\n?)+")
            m = self.found(r"([*+?]|\{(\d+)(,?)(\d*)\})([+?]?)")
            if not m:
                return atom
            if isinstance(atom, Mark) and not atom.java.startswith("(?"):
                raise self.fail()
            if m[2] is None:
                low, high = {"*": (0, None), "+": (1, None), "?": (0, 1)}[m[1]]
            else:
                low, high = int(m[2]), int(m[4]) if m[4] else None if m[3] else int(m[2])
                if high is not None and high < low:
                    raise self.fail()
            atom = Repeat(atom, low, high, m[5])

    def atom(self):
        c = self.take()
        if c == "(":
            return self.group()
        if c == "[":
            return self.set_()
        if c == "\\":
            return self.escape()
        if c == ".":
            return One(r"[\x{0}-\x{10ffff}]" if "s" in self.flags else r"[^\n]" if "d" in self.flags else f"[^{LINES}]")
        if c in "^$":
            return Mark(c)
        if c in "*+?{":
            raise self.fail()
        return Char(c)

    def group(self):
        if self.given("?#"):
            if not self.found(r"[^)]*\)"):
                raise self.fail()
            return None
        if m := self.found(r"\?([a-z]*)(?:-([a-z]*))?([:)])"):
            return self.flagged(m[1], m[2] or "", m[3] == ")")
        opens = self.found(r"\?<=|\?<!|\?=|\?!|\?>|\?<[A-Za-z][A-Za-z0-9]*>")
        if self.peek() == "?" and not opens:
            raise self.fail()
        part = self.alternatives()
        if not self.given(")"):
            raise self.fail()
        opens = f"({opens[0] if opens else ''}"
        return Mark(f"{opens}{java(part)})") if opens in ("(?=", "(?!", "(?<=", "(?<!") else Group(opens, part)

    def flagged(self, on: str, off: str, alone: bool):
        """``(?i)`` for the rest of a group, ``(?i:...)`` for a group of its own. Blanks and remarks are gone from the tree."""
        if not set(on + off) <= set("idmsuwx"):
            raise self.fail()
        self.ignoring = self.ignoring or "i" in on
        before, self.flags = self.flags, (self.flags | set(on)) - set(off)
        keep = "".join(("iu" if f == "i" else f) for f in on if f in "im"), "".join(("iu" if f == "i" else f) for f in off if f in "im")
        opens = f"(?{keep[0]}{'-' + keep[1] if keep[1] else ''}"
        if alone:
            return Mark(opens + ")") if opens != "(?" else None
        part = self.alternatives()
        self.flags = before
        if not self.given(")"):
            raise self.fail()
        return Group(opens + ":", part)

    def escape(self):
        if m := self.found(r"[dwshvDWSHV]"):
            inside = CLASSES[m[0].lower()]
            return One(f"[{inside}]" if m[0].islower() else f"[^{inside}]")
        if self.given("b"):
            return Mark(BORDER)
        if self.given("B"):
            return Mark(NO_BORDER)
        if m := self.found(r"[AZzG]"):
            return Mark("\\" + m[0])
        if self.given("R"):
            return Unknown(rf"(?:\r\n|[{LINES}])")
        if self.given("X"):
            return Unknown(r"\X")
        if m := self.found(r"k<[A-Za-z][A-Za-z0-9]*>|[1-9][0-9]*"):
            return Unknown(rf"(?:\{m[0]})")
        if self.peek() in ("p", "P"):
            return One(f"[{self.property_()}]")
        return Char(self.character())

    def property_(self) -> str:
        m = self.found(r"([pP])(?:\{(\^?)\s*([\w\s=-]+?)\s*\}|([A-Z]))")
        if not m:
            raise self.fail()
        name = (m[3] or m[4]).strip()
        low = re.sub(r"[\s_-]", "", name).lower()
        if "=" not in name:
            inside = rf"\p{{{name}}}" if re.fullmatch(r"[A-Z][a-z]?", name) else rf"\p{{{CATEGORIES[low]}}}" if low in CATEGORIES else POSIX.get(low) or rf"\p{{Is{re.sub(r'[\s-]', '_', name)}}}"
        else:
            key, _, value = name.partition("=")
            value = value.strip()
            inside = rf"\p{{{CATEGORIES.get(re.sub(r'[\s_-]', '', value).lower(), value)}}}" if key.strip().lower() in ("gc", "general_category", "generalcategory") else rf"\p{{{key.strip()}={value}}}"
        return f"[^{inside}]" if (m[1] == "P") != bool(m[2]) else inside

    def character(self) -> str:
        """The character behind a backslash."""
        for pattern, base in ((r"u([0-9A-Fa-f]{4})", 16), (r"U([0-9A-Fa-f]{8})", 16), (r"x\{([0-9A-Fa-f]{1,6})\}", 16), (r"x([0-9A-Fa-f]{2})", 16), (r"0([0-7]{1,3})", 8)):
            if m := self.found(pattern):
                if int(m[1], base) > 0x10FFFF:
                    raise self.fail()
                return chr(int(m[1], base))
        if m := self.found(r"c(.)"):
            return chr(ord(m[1].upper()) & 0x1F)
        if m := self.found(r"N\{([^}]+)\}"):
            try:
                return unicodedata.lookup(m[1])
            except KeyError:
                raise self.fail() from None
        c = self.take()
        if c in CONTROLS:
            return CONTROLS[c]
        if c.isascii() and c.isalnum():
            raise self.fail()
        return c

    def set_(self) -> One:
        """A class in brackets: unions, ``&&`` and ``--`` from left to right, classes within."""
        negated, whole, union, op, chars = self.given("^"), None, [], None, []

        def closed():
            nonlocal whole, union
            if not union:
                raise self.fail()
            own = "".join(union)
            whole = own if whole is None else f"[{whole}]&&[{own}]" if op == "&&" else f"[{whole}]&&[^{own}]"
            union = []

        first = True
        while first or not self.given("]"):
            if self.at >= len(self.text):
                raise self.fail()
            if not first and self.peek(2) in ("&&", "--") and self.peek(3) != "--]":
                closed()
                op, chars = self.take(2), None
            elif m := self.found(r"\[:(\^?)(\w+):\]"):
                if m[2].lower() not in POSIX:
                    raise self.fail()
                union.append(f"[^{POSIX[m[2].lower()]}]" if m[1] else POSIX[m[2].lower()])
                chars = None
            elif self.given("["):
                union.append(self.set_().java)
                chars = None
            elif self.found(r"\\(?=[dwshvDWSHVpP])"):
                if m := self.found(r"[dwshvDWSHV]"):
                    inside = CLASSES[m[0].lower()]
                    union.append(inside if m[0].islower() else f"[^{inside}]")
                else:
                    union.append(self.property_())
                chars = None
            else:
                low = self.member()
                if self.peek() == "-" and self.peek(2) not in ("-]", "--") and not re.match(r"-(\[|\\[dwshvDWSHVpP])", self.text[self.at : self.at + 3]):
                    self.take()
                    high = self.member()
                    if ord(high) < ord(low):
                        raise self.fail()
                    union.append(f"{spelled(low)}-{spelled(high)}")
                    chars = None
                else:
                    union.append(spelled(low))
                    chars = None if chars is None else [*chars, low]
            first = False
        closed()
        return One(f"[^{f'[{whole}]' if op else whole}]" if negated else f"[{whole}]", None if negated or chars is None else "".join(chars))

    def member(self) -> str:
        return self.character() if self.given("\\") else self.take()


def java(node) -> str:
    """A node in Java's spelling."""
    match node:
        case Char(text):
            return spelled(text)
        case One(text) | Mark(text) | Unknown(text):
            return text
        case Seq(parts):
            return "".join(map(java, parts))
        case Alt(parts):
            return "|".join(map(java, parts))
        case Group(opens, part):
            return f"{opens}{java(part)})"
        case Repeat(part, low, high, how):
            inner = f"(?:{java(part)})" if isinstance(part, Repeat) else java(part)
            count = {(0, None): "*", (1, None): "+", (0, 1): "?"}.get((low, high)) or (f"{{{low}}}" if low == high else f"{{{low},{'' if high is None else high}}}")
            return f"{inner}{count}{how}"
    raise TypeError(node)


# What a match must hold: None (nothing is known), a text, or ("and" | "or", parts).


def both(parts) -> object:
    parts = list(dict.fromkeys(p for p in parts if p is not None))
    return None if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def either(parts) -> object:
    parts = list(dict.fromkeys(parts))
    return None if None in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def texts(need) -> Iterator[str]:
    if isinstance(need, str):
        yield need
    elif need is not None:
        for p in need[1]:
            yield from texts(p)


def _kept(exact) -> object:
    """What is needed where one of some texts is: those of three characters and more can be told."""
    return either(t if len(t) >= 3 else None for t in exact)


def _known(node, ignore: bool) -> tuple[tuple[str, ...] | None, object]:
    """The texts that a node stands for, if these are few; and what it needs besides."""
    safe = lambda c: not ignore or (c.isascii() and c.lower() not in FOLDED_FROM_AFAR)
    match node:
        case Char(c):
            return ((c.lower() if ignore else c,), None) if safe(c) else (None, None)
        case One(_, chars):
            return (tuple(dict.fromkeys(c.lower() if ignore else c for c in chars)), None) if chars and len(chars) <= 4 and all(map(safe, chars)) else (None, None)
        case Mark():
            return ("",), None
        case Group(_, part):
            return _known(part, ignore)
        case Seq(parts):
            exact, needs, whole = ("",), [], True
            for part in parts:
                own, need = _known(part, ignore)
                needs.append(need)
                if own is not None and len(exact) * len(own) <= MOST_EXACT:
                    exact = tuple(dict.fromkeys(a + b for a in exact for b in own))
                else:
                    needs.append(_kept(exact))
                    exact, whole = own or ("",), False
            if not whole:
                needs.append(_kept(exact))
            return (exact, both(needs)) if whole else (None, both(needs))
        case Alt(parts):
            every = [_known(p, ignore) for p in parts]
            if all(e is not None and n is None for e, n in every) and sum(len(e) for e, _ in every) <= MOST_EXACT:
                return tuple(dict.fromkeys(t for e, _ in every for t in e)), None
            return None, either(both([n, _kept(e) if e is not None else None]) for e, n in every)
        case Repeat(part, low, high, _):
            own, need = _known(part, ignore)
            if low == high == 1 or high == 0:
                return (own, need) if high else (("",), None)
            if low == 0:
                return (("", *own), None) if own is not None and high == 1 and need is None else (None, None)
            if own is not None and need is None and low == high and len(own) ** low <= MOST_EXACT and low <= 16:
                return _known(Seq((part,) * low), ignore)
            # At least ``low`` in a row: one of them is needed, more where that is a single text.
            more = (own[0] * min(low, 16),) if own is not None and len(own) == 1 else own
            return None, both([need, _kept(more) if more is not None else None])
    return None, None


@dataclass(frozen=True)
class Compiled:
    java: str
    need: object
    ignoring: bool  # whether texts of ``need`` are in lower case, for names in lower case


def compiled(pattern: str, ignore_case: bool = True) -> Compiled:
    """A pattern's spelling and needs; raises ``QueryError`` where it isn't one."""
    reader = Reader(pattern)
    try:
        tree = reader.read()
    except RecursionError:
        raise reader.fail() from None
    ignore = ignore_case or reader.ignoring
    exact, need = _known(tree, ignore)
    need = both([need, _kept(exact) if exact is not None else None])
    if sum(1 for _ in texts(need)) > MOST_TEXTS:
        need = None
    return Compiled(("(?iu)" if ignore_case else "") + java(tree), need, ignore)

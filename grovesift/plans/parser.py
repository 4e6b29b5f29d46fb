"""Two query syntaxes, one tree.

Structured: words, ``filter:value``, parentheses, and AND, OR, XOR, NOT in capitals. Binding, from loose to tight:
OR, XOR, AND (written or not), NOT. Slash: words and ``/command value``. A query with an operator, a parenthesis
or a word that begins like a filter is structured; otherwise, in pattern mode and without slash commands, the whole
text is a pattern; otherwise it is in slash syntax, of which plain words are a part.
"""

from __future__ import annotations

import re
from datetime import datetime

from ..errors import QueryError
from . import values
from .ast import And, Everything, Extensions, Folder, Node, Not, Or, PathText, Pattern, Plan, Text, Xor, all_of, any_of
from .patterns import compiled

# The filters and commands.
FILTERS = ("name", "path", "in", "filetype", "ext", "regex", "rx", "type", "size", "modified", "limit")
COMMANDS = ("/filetype", "/in", "/limit", "/modified", "/not", "/or", "/regex", "/size", "/type")
BINDING = {"OR": 1, "XOR": 2, "AND": 3}
#: What each filter's value must be.
EXPECTS = {
    "in": "a path that starts with / or ~.",
    "filetype": "extensions parted by commas, like csv,txt.",
    "type": "either file or folder.",
    "size": "a count of bytes or a range, like >20mb or 1kb..5kb.",
    "modified": "a day, two days with .. between them, today, or a count of days like 30d.",
    "limit": "a whole number above 0.",
}
MOST_BYTES = 16 * 1024


def admit(text: str) -> str:
    """The text of a query that is worth parsing."""
    if not text.strip():
        raise QueryError("The query is empty.")
    if "\0" in text or len(text.encode()) > MOST_BYTES:
        raise QueryError("The query is too long or contains a null character.")
    return text


def check_pattern(regex: str) -> str:
    """A valid pattern. With a running session Java tests its spelling too."""
    from pyspark.sql import SparkSession

    spark, found = SparkSession.getActiveSession(), compiled(regex)
    if spark is not None:
        try:
            spark._jvm.java.util.regex.Pattern.compile(found.java)
        except Exception as e:
            raise QueryError(f"Not a valid pattern: {regex}") from e
    return regex


def lex(text: str, marks: str = "()") -> list[tuple[str, bool]]:
    """(word, whether any of it was quoted). Quotes join what they hold to the word they stand in and are dropped."""
    out = []
    for m in re.finditer(rf'(?P<mark>[{re.escape(marks)}])|(?P<word>(?:"[^"]*"?|[^\s"{re.escape(marks)}])+)' if marks else r'(?P<mark>(?!))|(?P<word>(?:"[^"]*"?|[^\s"])+)', text):
        word = m[0].replace('"', "")
        if m["mark"] or word:
            out.append((word, not m["mark"] and '"' in m[0]))
    return out


def is_structured(text: str) -> bool:
    return any(not quoted and (w in BINDING or w in ("NOT", "(", ")")) or re.match(r"(?:[^\W\d_]|-)+:", w) for w, quoted in lex(text))


def leaf(name: str, value: str, now: datetime | None) -> Node | int:
    """The predicate of a filter, or the number of a limit."""
    read = {"in": values.absolute_path, "filetype": values.extensions, "type": values.kind, "size": values.size, "modified": lambda v: values.modified(v, now), "limit": values.limit}
    found = read[name](value)
    if found is None:
        raise QueryError(EXPECTS[name])
    return {"in": Folder, "filetype": Extensions}.get(name, lambda x: x)(found)


class Structured:
    """Precedence climbing over the words of a structured query."""

    def __init__(self, text: str, now: datetime | None):
        if text.count('"') % 2:
            raise QueryError("A quote is never closed.")
        self.words, self.at, self.now, self.limit = lex(text), 0, now, None

    def peek(self) -> str | None:
        """The operator or parenthesis that comes next, '' for another word, None at the end."""
        if self.at >= len(self.words):
            return None
        word, quoted = self.words[self.at]
        return word if not quoted and (word in BINDING or word in ("NOT", "(", ")")) else ""

    def plan(self) -> Plan:
        if not self.words:
            return Plan(Everything())
        tree = self.climb(1)
        if self.peek() is not None:
            raise QueryError(f"{self.words[self.at][0]} doesn't belong there.")
        return Plan(tree or Everything(), self.limit)

    def climb(self, least: int) -> Node | None:
        tree = self.operand()
        while (op := self.peek()) not in (None, ")"):
            written = op in BINDING
            bound = BINDING[op] if written else BINDING["AND"]
            if bound < least:
                break
            self.at += written
            if written and self.peek() in (None, ")", *BINDING):
                raise QueryError(f"{op} joins two expressions; one is missing.")
            tree = self.join(op if written else "AND", tree, self.climb(bound + 1))
        return tree

    @staticmethod
    def join(op: str, a: Node | None, b: Node | None) -> Node | None:
        """Directives are None, and vanish from what they are joined to."""
        if op == "XOR":
            return Xor(a, b) if a and b else a or b
        kind = And if op == "AND" else Or
        return (all_of if op == "AND" else any_of)([*(a.parts if isinstance(a, kind) else [a]), b])

    def operand(self) -> Node | None:
        op = self.peek()
        if op in BINDING:
            raise QueryError(f"{op} joins two expressions; one is missing.")
        if op is None or op == ")":
            raise QueryError("There is nothing between the parentheses." if self.at and self.words[self.at - 1] == ("(", False) else "An expression is missing." if op is None else f"{op} doesn't belong there.")
        word = self.words[self.at][0]
        self.at += 1
        if op == "NOT":
            if self.peek() in (None, ")", *BINDING):
                raise QueryError("NOT has nothing to negate.")
            part = self.operand()
            return Not(part) if part else None
        if op == "(":
            if self.peek() == ")":
                raise QueryError("There is nothing between the parentheses.")
            tree = self.climb(1)
            if self.peek() != ")":
                raise QueryError("One of the parentheses is never closed.")
            self.at += 1
            return tree
        return self.word(word)

    def word(self, word: str) -> Node | None:
        name, colon, value = word.partition(":")
        if not colon:
            return Text(word)
        name = name.lower()
        if name not in FILTERS:
            raise QueryError(f"There is no filter {name}:.")
        if not value:
            raise QueryError(f"{name}: has no value.")
        if name in ("name", "path"):
            return (Text if name == "name" else PathText)(value)
        if name in ("regex", "rx"):
            return Pattern(check_pattern(value))
        name = {"ext": "filetype"}.get(name, name)
        try:
            found = leaf(name, value, self.now)
        except QueryError as e:
            raise QueryError(f"{name}: takes {e}") from None
        if name == "limit":
            self.limit = found
            return None
        return found


def slash(text: str, now: datetime | None) -> Plan:
    """Slash syntax. ``/or`` parts groups of terms; types that lead a group belong to it, all other filters hold for every group."""
    words = [w for w, _ in lex(text, marks="")]
    groups: list[dict] = [{"terms": [], "types": []}]
    shared_types: list[str] = []
    filters: list[Node] = []
    kind = limit = regex = None
    error = None
    at = 0
    both_sides = "/or joins two searches; one is missing."
    while at < len(words):
        word, command = words[at], words[at].lower()
        at += 1
        if command not in COMMANDS:
            if word.startswith("/"):
                error = error or f"There is no command {word}."
            groups[-1]["terms"].append(word)
        elif command == "/or":
            if len(groups) == 1 and not groups[0]["terms"] and shared_types:
                groups[0]["types"], shared_types = shared_types, []
            if not groups[-1]["terms"] and not groups[-1]["types"]:
                error = error or both_sides
            else:
                groups.append({"terms": [], "types": []})
        elif command == "/regex":
            regex = " ".join(words[at:])
            if len(groups) > 1:
                error = error or "/regex doesn't go together with /or."
            elif not regex:
                error = error or "/regex takes the rest of the query as its pattern; there is none."
            break
        elif at == len(words):
            error = error or f"{command} has no value."
        else:
            value, name = words[at], command[1:]
            at += 1
            if name == "not":
                filters.append(Not(PathText(value)))
                continue
            try:
                found = leaf(name, value, now)
            except QueryError as e:
                error = error or f"{command} takes {e}"
                continue
            if name == "limit":
                limit = found
            elif name == "type":
                kind = found  # the last one holds
            elif name == "filetype":
                own = len(groups) > 1 and not groups[-1]["terms"]
                (groups[-1]["types"] if own else shared_types).extend(found.names)
            else:
                filters.append(found)
    if len(groups) > 1 and not groups[-1]["terms"] and not groups[-1]["types"]:
        error = error or both_sides
    if error:
        raise QueryError(error)
    types = lambda names: Extensions(tuple(names)) if names else None
    matched = any_of([all_of([*map(Text, g["terms"]), types(g["types"])]) for g in groups])
    tree = all_of([matched, types(shared_types), kind, *filters, Pattern(check_pattern(regex)) if regex is not None else None])
    return Plan(tree or Everything(), limit)


def parse(text: str, pattern_mode: bool = False, now: datetime | None = None) -> Plan:
    """The plan of a query; raises QueryError with the first thing that is wrong with it."""
    if is_structured(text):
        return Structured(text, now).plan()
    if pattern_mode and not any(w.lower() in COMMANDS for w, _ in lex(text, marks="")):
        return Plan(Pattern(check_pattern(text)) if text else Everything())
    return slash(text, now)


def matching_commands(text: str) -> list[str]:
    """The commands that the last word of a query may become."""
    last = "" if not text or text[-1].isspace() else text.split()[-1].lower()
    return [c for c in COMMANDS if c.startswith(last)] if last.startswith("/") else []


def completion(text: str) -> str | None:
    """The query with its last word completed, if just one command fits."""
    found = matching_commands(text)
    return re.sub(r"\S+\Z", lambda _: f"{found[0]} ", text) if len(found) == 1 else None


def suggestions(text: str) -> list[str]:
    """Filters and operators for the last word: the same, then those that begin with it, then those that contain it.

    Where an operand is due, operators that need one before them aren't offered.
    """
    words = text.split()
    last = "" if not text or text[-1].isspace() else words.pop().lower().rstrip(":")
    due = not words or words[-1] in (*BINDING, "NOT", "(")
    offered = [f"{f}:" for f in FILTERS if f != "rx"] + ["NOT"] + ([] if due else list(BINDING))
    rank = lambda s: (0 if s.rstrip(":").lower() == last else 1 if s.lower().startswith(last) else 2)
    return sorted((s for s in offered if last in s.lower()), key=rank)


def query_of_url(url: str, scheme: str) -> str:
    """The query in ``scheme://search?q=...``."""
    from urllib.parse import parse_qsl, urlsplit

    u = urlsplit(url)
    pairs = parse_qsl(u.query, keep_blank_values=True, strict_parsing=bool(u.query), encoding="utf-8", errors="strict")
    if u.scheme != scheme or u.netloc != "search" or u.path not in ("", "/") or u.fragment or [k for k, _ in pairs] != ["q"] or re.search(r"%(?![0-9A-Fa-f]{2})", u.query):
        raise QueryError("The link has no query.")
    return admit(pairs[0][1])

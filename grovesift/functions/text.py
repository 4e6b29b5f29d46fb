"""Scalar functions over names and paths, as column expressions."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
#: Letters, marks and digits: what a whole word may not touch.
WORD_CHARACTER = r"[\p{L}\p{M}\p{N}]"


def fold(text: str) -> str:
    """A-Z in lower case; nothing else changes."""
    return text.translate(str.maketrans(UPPER, LOWER))


def fold_column(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def quote(text: str) -> str:
    """A pattern (Java) that matches just this text."""
    return "".join(c if c.isalnum() or ord(c) > 127 else f"\\x{{{ord(c):x}}}" for c in text)


def has_wildcard(term: str) -> bool:
    return "*" in term or "?" in term


def glob_pattern(glob: str) -> str:
    """A pattern for the whole of a name: ``*`` any run, ``?`` one code point."""
    return "(?s)^" + "".join({"*": ".*", "?": "."}.get(part, quote(part)) for part in re.split(r"([*?])", glob)) + r"\z"


def glob_matches(pattern: str, text: str, ignore_case: bool = True) -> bool:
    """The same rule for single strings."""
    fix = (lambda s: fold(s) if pattern.isascii() else s.lower()) if ignore_case else str
    return re.fullmatch("".join({"*": ".*", "?": "."}.get(p, re.escape(p)) for p in re.split(r"([*?])", fix(pattern))), fix(text), re.DOTALL) is not None


def whole_word_pattern(term: str) -> str:
    return f"(?<!{WORD_CHARACTER}){quote(term)}(?!{WORD_CHARACTER})"


def extension(name: Column) -> Column:
    """What follows the last dot, unless nothing else precedes or follows it."""
    return F.regexp_extract(name, r"(?s)^.+\.([^.]*)$", 1)


def within(path: Column, root: str | Column) -> Column:
    """The folder itself or anything below it, by whole components."""
    root = F.lit(root) if isinstance(root, str) else root
    return (root == "/") | (path == root) | path.startswith(F.concat(root, F.lit("/")))


def ancestors(path: Column) -> Column:
    """All folders on the way from ``/`` to an absolute path, itself included."""
    cut = lambda i: F.call_function("substring_index", path, F.lit("/"), i)
    every = F.transform(F.sequence(F.lit(1), F.size(F.split(path, "/"))), lambda i: F.when(i == 1, "/").otherwise(cut(i)))
    return F.when(path == "/", F.array(F.lit("/"))).otherwise(every)


def natural_key(path: Column) -> Column:
    """A key under which numbers within paths sort by value, whatever their length.

    A number is spelled without leading zeros, behind its count of digits, and that behind the count's own.
    """
    runs = F.regexp_extract_all(F.lower(path), F.lit(r"([0-9]+|[^0-9]+)"), 1)
    bare = lambda t: F.regexp_replace(t, r"^0+(?=[0-9])", "")
    counted = lambda t: F.concat(F.length(F.length(t).cast("string")).cast("string"), F.length(t).cast("string"), t)
    return F.concat_ws("", F.transform(runs, lambda t: F.when(t.rlike("^[0-9]"), counted(bare(t))).otherwise(t)))


# Directories that are links into the private volume, and the data volume's mount.
PRIVATE = ("/var", "/tmp", "/etc")
DATA_VOLUME = "/System/Volumes/Data"


def canonical_path(path: str) -> str:
    """One spelling for paths that the system gives two."""
    if path == DATA_VOLUME:
        return "/"
    path = path.removeprefix(DATA_VOLUME) if path.startswith(DATA_VOLUME + "/") else path
    return f"/private{path}" if any(path == p or path.startswith(p + "/") for p in PRIVATE) else path


def is_volume_root(path: str) -> bool:
    """Whether a path is the root of the system's volumes or of a mounted one."""
    return path in ("/", DATA_VOLUME) or bool(re.fullmatch(r"/Volumes/[^/]*", path))


def canonical_column(path: Column) -> Column:
    plain = F.when(path == DATA_VOLUME, "/").otherwise(F.regexp_replace(path, f"^{DATA_VOLUME}(?=/)", ""))
    return F.regexp_replace(plain, r"^(?=/(?:var|tmp|etc)(?:/|$))", "/private")


def kind_label(is_dir: Column, name: Column) -> Column:
    ext = F.upper(extension(name))
    return F.when(is_dir, "Folder").when(ext == "", "File").otherwise(F.concat(ext, F.lit(" File")))


def rfc3339(seconds: Column) -> Column:
    return F.concat(F.date_format(F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))


def local_time(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss")


def trigrams(name_fold: Column) -> Column:
    """Distinct runs of three characters of an ASCII name; none for others."""
    n = F.length(name_fold)
    every = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substr(name_fold, i, F.lit(3)))
    return F.when((n >= 3) & (F.octet_length(name_fold) == n), F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def retry_delay(attempt: int) -> int:
    """Seconds before the next try: doubling, a minute at most."""
    return min(60, 1 << min(max(attempt, 1) - 1, 6))

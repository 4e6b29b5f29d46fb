"""What a scan leaves out: exclusion rules, scopes and mounts."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import asdict, dataclass, field, replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ancestors, canonical_path, fold, fold_column, glob_matches, glob_pattern, has_wildcard, within
from .below import outside

# Names of folders that tools make, at any depth.
DEV_FOLDERS = frozenset(
    (
        "node_modules", "bower_components", ".next", ".nuxt", ".svelte-kit", ".astro", ".angular", ".turbo", ".parcel-cache",
        ".build", "DerivedData", "Pods", "Carthage", ".gradle", ".cargo", ".rustup",
        "__pycache__", ".pytest_cache", ".mypy_cache", ".tox", ".eggs", "venv", ".venv", ".terraform", ".cache",
    )
)
# Names that are left out only beside a project marker.
BUILD_FOLDERS = frozenset(("build", "dist", "target", "out", "vendor", "coverage"))
# What marks a project.
MARKERS = frozenset(
    (
        "Cargo.toml", "package.json", "go.mod", "pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts",
        "CMakeLists.txt", "Makefile", "GNUmakefile", "composer.json", "Gemfile", "pyproject.toml", "setup.py", "setup.cfg",
        "tsconfig.json", "Package.swift", ".git",
    )
)
# Version control, trash, and paths left out by default.
VCS_FOLDERS = frozenset((".git", ".hg", ".svn"))
TRASH_FOLDERS = frozenset((".Trash", ".Trashes"))
DEFAULT_PREFIXES = ("/private/var/folders", "/System/Volumes/Data/private/var/folders")
# Volumes of the system, of which the first is seen a second time at the root; a whole-disk scan leaves them out.
SYSTEM_VOLUMES = tuple(f"/System/Volumes/{name}" for name in ("Data", "Preboot", "VM", "Update", "xarts", "iSCPreboot", "Hardware"))


@dataclass(frozen=True)
class ExcludeRules:
    names: tuple[str, ...] = ()
    path_prefixes: tuple[str, ...] = DEFAULT_PREFIXES
    exclude_hidden: bool = False
    exclude_dev: bool = True
    exclude_vcs: bool = True
    exclude_trash: bool = True
    file_patterns: tuple[str, ...] = ()

    @property
    def fixed_names(self) -> frozenset[str]:
        """Names that are left out wherever they stand."""
        out = frozenset(self.names)
        for on, names in ((self.exclude_vcs, VCS_FOLDERS), (self.exclude_trash, TRASH_FOLDERS), (self.exclude_dev, DEV_FOLDERS)):
            out |= names if on else frozenset()
        return out

    @property
    def prefixes(self) -> tuple[str, ...]:
        return tuple(p if p == "/" else p.removesuffix("/") for p in self.path_prefixes if p)

    def excludes(self, name: str, path: str, hidden: bool, in_project: bool = False) -> bool:
        """Whether an entry goes, with all below it."""
        return (
            (self.exclude_hidden and hidden)
            or name in self.fixed_names
            or (self.exclude_dev and in_project and name in BUILD_FOLDERS)
            or any(p == "/" or path == p or path.startswith(p + "/") for p in self.prefixes)
        )

    def excludes_file(self, name: str) -> bool:
        """Whether a file goes by its name; folders never do."""
        return any(glob_matches(p, name) if has_wildcard(p) else name.lower() == p.lower() for p in self.file_patterns if p)

    def entry_column(self, in_project: Column) -> Column:
        """``excludes`` over columns name, path and hidden."""
        tests = [F.col("name").isin(sorted(self.fixed_names)) if self.fixed_names else F.lit(False)]
        if self.exclude_hidden:
            tests.append(F.col("hidden"))
        if self.exclude_dev:
            tests.append(in_project & F.col("name").isin(sorted(BUILD_FOLDERS)))
        tests += [within(F.col("path"), p) for p in self.prefixes]
        return reduce(or_, tests)

    def file_column(self) -> Column:
        """``excludes_file`` over columns name and is_dir."""
        ascii_or_not = lambda p: fold_column(F.col("name")) if p.isascii() else F.lower("name")
        low = lambda p: fold(p) if p.isascii() else p.lower()
        tests = [ascii_or_not(p).rlike(glob_pattern(low(p))) if has_wildcard(p) else F.lower("name") == p.lower() for p in self.file_patterns if p]
        return ~F.col("is_dir") & reduce(or_, tests, F.lit(False))

    def fingerprint(self) -> str:
        """The same for rules that leave out the same, whatever the order of their names; other orders count."""
        return hashlib.sha256(json.dumps(asdict(replace(self, names=tuple(sorted(set(self.names)))))).encode()).hexdigest()

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> ExcludeRules:
        """Rules as saved; what an older file lacks has its default."""
        known = ExcludeRules.__dataclass_fields__
        return ExcludeRules(**{k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(text).items() if k in known})


def in_project(entries: DataFrame) -> DataFrame:
    """Adds in_project: whether any sibling, excluded or not, is a project marker."""
    marker = F.max(F.col("name").isin(sorted(MARKERS))).over(Window.partitionBy("parent"))
    return entries.withColumn("in_project", F.coalesce(marker, F.lit(False)))


def projects(entries: DataFrame) -> DataFrame:
    """(parent): folders that hold a marker. By a partial aggregate, so a folder of any size is no single task's burden."""
    return entries.filter(F.col("name").isin(sorted(MARKERS))).select("parent").distinct()


def apply_rules(entries: DataFrame, rules: ExcludeRules) -> DataFrame:
    """The entries (id, parent, name, path, hidden, is_dir) that the rules leave, without anything below an excluded folder."""
    marked = entries.join(projects(entries).withColumn("in_project", F.lit(True)), "parent", "left").withColumn("in_project", F.coalesce("in_project", F.lit(False)))
    judged = marked.withColumn("out", rules.entry_column(F.col("in_project")) | rules.file_column())
    cut = judged.filter(F.col("out") & F.col("is_dir")).select("path")
    return outside(judged.filter(~F.col("out")), cut, itself=True, among=entries).select(*entries.columns)


@dataclass(frozen=True)
class IndexScope:
    """Where a scan goes: whole local volumes, or some folders with the identities they had when chosen."""

    mode: str = "localVolumes"
    roots: tuple[str, ...] = ()
    identities: dict[str, tuple[int, int]] = field(default_factory=dict, hash=False)

    def __post_init__(self):
        object.__setattr__(self, "roots", ("/",) if self.mode == "localVolumes" else outermost(self.roots))

    def contains(self, path: str) -> bool:
        return any(r == "/" or path == r or path.startswith(r + "/") for r in self.roots)

    def valid_roots(self) -> tuple[list[str], list[tuple[str, int]]]:
        """Roots that still are the folders that were chosen, and issues for the others."""
        import errno

        good, issues = [], []
        for r in self.roots:
            try:
                s = os.stat(r, follow_symlinks=False)
                same = r not in self.identities or (s.st_dev, s.st_ino) == tuple(self.identities[r])
            except OSError:
                same = False
            good, issues = ([*good, r], issues) if same else (good, [*issues, (r, errno.ENOENT)])
        return good, issues

    def fingerprint(self, rules: ExcludeRules) -> str:
        return hashlib.sha256(json.dumps([self.mode, self.roots, sorted((k, list(v)) for k, v in self.identities.items()), rules.fingerprint()]).encode()).hexdigest()


def outermost(roots) -> tuple[str, ...]:
    """Canonical, distinct, sorted roots without those that lie in others."""
    out: list[str] = []
    for r in sorted({canonical_path(r if r == "/" else r.rstrip("/")) for r in roots}, key=lambda r: (r != "/", r + "/")):
        if not out or not (out[-1] == "/" or r.startswith(out[-1] + "/")):
            out.append(r)
    return tuple(out)


def outermost_rows(roots: DataFrame) -> DataFrame:
    """The same for a table (path): each path's ancestors are looked up, so the work is that of an equality join."""
    paths = roots.select("path")
    return outside(paths, paths).distinct()


def inspectable(paths: DataFrame, mounts: DataFrame) -> DataFrame:
    """Paths with ``local``: whether the longest mount (mount, is_local) around each is local; no mount, no.

    Mounts are few, those of a system, and go to all tasks as one map, in which each path looks its ancestors up from the
    longest on. So paths stay in their tasks: a join would bring all of them together under ``/``.
    """
    listed = mounts.filter(F.col("mount").isNotNull()).groupBy("mount").agg(F.max("is_local").alias("is_local"))
    known = listed.agg(F.map_from_entries(F.collect_list(F.struct("mount", "is_local"))).alias("_known"))
    around = F.filter(ancestors(F.col("path")), lambda a: F.map_contains_key("_known", a))
    local = F.when(F.col("path").startswith("/"), F.element_at("_known", F.get(around, F.size(around) - 1)))
    others = [c for c in paths.columns if c != "path"]
    return paths.crossJoin(F.broadcast(known)).select("path", *others, F.coalesce(local, F.lit(False)).alias("local"))


def effective(rules: ExcludeRules, mounts: list[tuple[str, bool]], firmlinks: tuple[str, ...] = SYSTEM_VOLUMES) -> ExcludeRules:
    """Rules with the second names of linked folders and all mounts that aren't local."""
    return replace(rules, path_prefixes=(*rules.path_prefixes, *firmlinks, *(m for m, local in mounts if not local and m != "/")))

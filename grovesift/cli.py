"""``python -m grovesift.cli --store FOLDER [options] QUERY``: search a saved table from the command line.

Exit codes: 0 done, 2 wrong usage or query, 3 nothing indexed, 4 too busy or too slow, 5 failed, 130 interrupted.
"""

from __future__ import annotations

import argparse
import sys
import threading

from .errors import Busy, Cancelled, Denied, NotReady, QueryError
from .plans.parser import admit
from .plans.values import MOST_ROWS


def _number(low: float, high: float, kind, open_low: bool = False):
    def read(text: str):
        try:
            v = kind(text)
        except ValueError:
            raise argparse.ArgumentTypeError(f"{text!r} is not a number") from None
        if not (low < v if open_low else low <= v) or v > high:
            raise argparse.ArgumentTypeError(f"must be from {low} to {high}")
        return v

    return read


def options() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="grovesift", description="Search a saved files table.")
    p.add_argument("--store", required=True, help="folder of the snapshots")
    p.add_argument("--format", choices=("paths", "json"), default="paths")
    p.add_argument("--null", action="store_true", help="end paths with a null character")
    p.add_argument("--limit", type=_number(1, MOST_ROWS, int), default=1000)
    p.add_argument("--timeout", type=_number(0, 3600, float, True), default=30.0)
    p.add_argument("--match-path", action="store_true")
    p.add_argument("--case-sensitive", action="store_true")
    p.add_argument("--whole-word", action="store_true")
    p.add_argument("query", nargs="+")
    return p


def run(argv: list[str], engine=None, out=None, err=None) -> int:
    """Runs one command; ``engine`` is for callers that have one."""
    out, err = out or sys.stdout, err or sys.stderr
    try:
        a = options().parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    if a.null and a.format == "json":
        print("--null goes with paths only.", file=err)
        return 2
    try:
        text = admit(" ".join(a.query))
        if engine is None:
            from pyspark.sql import SparkSession

            from .service import Engine
            from .sources.snapshots import SnapshotStore

            spark = SparkSession.builder.getOrCreate()
            engine = Engine(spark, SnapshotStore(spark, a.store))
        late = threading.Timer(a.timeout, lambda: engine.cancel_session("cli"))
        late.start()
        try:
            answer = engine.search(text, session="cli", limit=a.limit, match_path=a.match_path, ignore_case=not a.case_sensitive, whole_word=a.whole_word)
        finally:
            late.cancel()
    except QueryError as e:
        print(e, file=err)
        return 2
    except (NotReady, Denied) as e:
        print(e, file=err)
        return 3
    except (Busy, Cancelled) as e:
        print(e, file=err)
        return 4
    except KeyboardInterrupt:
        return 130
    except Exception as e:  # the last resort of a command: say what failed
        print(f"The search failed: {e}", file=err)
        return 5
    from .sources import sinks

    out.write(sinks.envelope(answer) + "\n" if a.format == "json" else sinks.paths(answer["results"], a.null))
    return 0


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))

"""A Spark source over a monitor's log of events: ``spark.readStream.format("changelog").option("folder", ...)``.

The log is a folder of files of JSON lines (path, event_id, flags), by which event ids rise within a file and from file to
file; a file is moved there when it is whole. A stream's offset is the id of the last event, so a batch is the events
behind one id up to another, whichever files hold them, and can be read again after a failure. ``since`` is where a new stream
begins: it gets the events after that id. What a stream has done with is told to the monitor in the log's file ``_done``, up to
which it may delete its files; a stream reads nothing before its own offset, so that several may share a log.

The folder has to be mounted on the driver and the executors. Files that can't be read fail the batch, which is tried again;
lines that aren't events are passed over.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, event_id long, flags int"
DONE = "_done"
#: Bytes from the end of a file within which its last line begins; longer ones are looked for from the front.
TAIL = 1 << 16


def events(file: str) -> Iterator[tuple[str, int, int]]:
    with open(file, "rb") as lines:
        for line in lines:
            event = parsed(line)
            if event:
                yield event


def parsed(line: bytes) -> tuple[str, int, int] | None:
    try:
        e = json.loads(line)
        return str(e["path"]), int(e["event_id"]), int(e["flags"])
    except (ValueError, KeyError, TypeError):
        return None


def span(file: str) -> tuple[int, int] | None:
    """The first and the last event id of a file."""
    first = next((e[1] for e in events(file)), None)
    if first is None:
        return None
    with open(file, "rb") as f:
        f.seek(max(0, os.path.getsize(file) - TAIL))
        last = next((e[1] for line in reversed(f.read().splitlines()) if (e := parsed(line))), None)
    return first, max(e[1] for e in events(file)) if last is None else last


class Piece(InputPartition):
    """A file, and the ids that are read of it: those above ``low`` up to ``high``."""

    def __init__(self, file: str, low: int, high: int):
        self.file, self.low, self.high = file, low, high


class Log:
    def __init__(self, options):
        self.folder, self.since = options["folder"].removeprefix("file://"), int(options.get("since", -1))
        self.spans: dict[str, tuple[int, int]] = {}

    def files(self) -> dict[str, tuple[int, int]]:
        """The spans of all files that hold events; each file is looked at once."""
        names = [n for n in os.listdir(self.folder) if n[0] not in "._"] if os.path.isdir(self.folder) else []
        for n in names:
            if n not in self.spans and (found := span(f"{self.folder}/{n}")):
                self.spans[n] = found
        self.spans = {n: s for n, s in self.spans.items() if n in set(names)}
        return self.spans

    def pieces(self, low: int, high: int | None = None) -> list[Piece]:
        return [Piece(f"{self.folder}/{n}", low, last if high is None else high) for n, (first, last) in sorted(self.files().items()) if last > low and (high is None or first <= high)]


def read_piece(piece: Piece) -> Iterator[tuple[str, int, int]]:
    for event in events(piece.file):
        if piece.low < event[1] <= piece.high:
            yield event


class BatchReader(DataSourceReader):
    def __init__(self, options):
        self.log = Log(options)

    def partitions(self):
        return self.log.pieces(self.log.since) or [Piece(os.devnull, 0, 0)]

    def read(self, partition):
        return read_piece(partition)


class StreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.log = Log(options)

    def initialOffset(self):
        return {"event": self.log.since}

    def latestOffset(self):
        return {"event": max([self.log.since, *(last for _, last in self.log.files().values())])}

    def partitions(self, start, end):
        return self.log.pieces(start["event"], end["event"])

    def read(self, partition):
        return read_piece(partition)

    def commit(self, end):
        """Tells the monitor; a number that is there already and larger stays."""
        place, part = f"{self.log.folder}/{DONE}", f"{self.log.folder}/.{DONE}-{os.getpid()}"
        if done(self.log.folder) < end["event"]:
            with open(part, "w", encoding="utf-8") as f:
                f.write(str(end["event"]))
            os.replace(part, place)


class ChangeLog(DataSource):
    @classmethod
    def name(cls):
        return "changelog"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return BatchReader(self.options)

    def streamReader(self, schema):
        return StreamReader(self.options)


def done(folder: str) -> int:
    """The last event id that a stream has told it has done with; -1 before any."""
    try:
        with open(f"{folder.removeprefix('file://')}/{DONE}", encoding="utf-8") as f:
            return int(f.read())
    except (FileNotFoundError, ValueError):
        return -1


def stream(spark: SparkSession, folder: str, since: int = -1) -> DataFrame:
    spark.dataSource.register(ChangeLog)
    return spark.readStream.format("changelog").option("folder", folder).option("since", since).load()


def read(spark: SparkSession, folder: str, since: int = -1) -> DataFrame:
    spark.dataSource.register(ChangeLog)
    return spark.read.format("changelog").option("folder", folder).option("since", since).load()


def write(found: DataFrame, folder: str) -> None:
    """Writes events (path, event_id, flags) as a log."""
    found.select("path", "event_id", "flags").repartitionByRange("event_id").sortWithinPartitions("event_id").write.json(folder)

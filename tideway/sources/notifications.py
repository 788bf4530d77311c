"""Delivered notifications as a Spark data source, batch and stream: folders of files with one raw notification a line.

``spark.dataSource.register(NotificationSource)``, then ``spark.read.format("notifications").load(folder)`` or
``spark.readStream.format("notifications").load(folder)``.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

SCHEMA = "notification_id string, subscription_id string, notified_at string, id string, type string, run_id string, sim_t double, doc string, bad string, file string, line long"


def _open(path: str):
    """(file system, path in it) of a path or URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str, after: str = "") -> list[tuple[str, int]]:
    """(name, bytes) of the folder's files beyond ``after`` by name; hidden files and files still being written (.tmp) are left out."""
    from pyarrow import fs

    system, at = _open(path)
    found = [(f.base_name, f.size) for f in system.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File]
    return sorted((n, s) for n, s in found if n > after and not n.startswith((".", "_")) and not n.endswith(".tmp"))


def dealt(files: list[tuple[str, int]], size: int) -> list[Files]:
    """Files in order, about ``size`` bytes a partition."""
    out: list[list[str]] = []
    full = size
    for name, n in files:
        if full >= size:
            out.append([])
            full = 0
        out[-1].append(name)
        full += n
    return [Files(tuple(names)) for names in out]


@dataclass
class Files(InputPartition):
    names: tuple[str, ...]


def value(attribute):
    """A property's value; a date-time's text."""
    v = attribute.get("value") if isinstance(attribute, dict) else None
    return v.get("@value") if isinstance(v, dict) else v


def rows_of(raw: str, types: frozenset[str] | None) -> Iterator[tuple]:
    """A row for each entity of a notification; one with its raw text where it is none."""
    try:
        body = json.loads(raw)
        data = body["data"] if body.get("type") == "Notification" else None
    except (ValueError, KeyError, AttributeError, TypeError, RecursionError):
        data = None
    if not isinstance(data, list):
        if types is None:
            yield (None,) * 8 + (raw,)
        return
    text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
    head = tuple(text(body.get(k)) for k in ("id", "subscriptionId", "notifiedAt"))
    for entity in data:
        if not isinstance(entity, dict):
            if types is None:
                yield *head, None, None, None, None, None, json.dumps(entity, ensure_ascii=False)
            continue
        kind = text(entity.get("type"))
        if types is None or kind in types:
            t = value(entity.get("simulationTime"))
            yield *head, text(entity.get("id")), kind, text(value(entity.get("simulationRunId"))), float(t) if isinstance(t, int | float) and not isinstance(t, bool) else None, json.dumps(entity, ensure_ascii=False), None


class _Read:
    """What batch and stream share: reading a partition's files line by line."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"].rstrip("/")
        self.size = int(options.get("partitionBytes", 16 << 20))
        named = options.get("types")
        self.types = frozenset(x.strip() for x in named.split(",")) if named else None

    def read(self, partition: Files) -> Iterator[tuple]:
        system, at = _open(self.path)
        for name in partition.names:
            with system.open_input_stream(f"{at}/{name}", compression=None) as stream:
                line, rest = 0, b""
                while block := stream.read(1 << 20):
                    *whole, rest = (rest + block).split(b"\n")
                    for raw in whole:
                        yield from self._line(raw, name, line)
                        line += 1
                if rest:
                    yield from self._line(rest, name, line)

    def _line(self, raw: bytes, name: str, line: int) -> Iterator[tuple]:
        if raw.strip():
            for row in rows_of(raw.decode("utf-8", "replace"), self.types):
                yield *row, name, line


class NotificationReader(_Read, DataSourceReader):
    """Batch: all files. ``type = ...`` and ``type IN (...)`` are taken over from the query's filters."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            asked = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if asked is None or f.attribute != ("type",):
                yield f
            else:
                self.types = frozenset(asked) if self.types is None else self.types & asked

    def partitions(self) -> list[Files]:
        return dealt(listed(self.path), self.size)


class NotificationStream(_Read, DataSourceStreamReader):
    """Stream: an offset is the name of the last file taken, so names must grow with time; a restart reads what lies beyond it."""

    def initialOffset(self) -> dict:
        return {"upto": ""}

    def latestOffset(self) -> dict:
        return {"upto": max((n for n, _ in listed(self.path)), default="")}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return dealt([f for f in listed(self.path, start["upto"]) if f[0] <= end["upto"]], self.size)

    def commit(self, end: dict) -> None:
        pass


class NotificationSource(DataSource):
    """Options: ``path``; ``types``, a subscription's entity types by comma (all, and rows of what is no notification, if
    unset); ``partitionBytes``. Rows have (file, line) of their notification; empty lines are none."""

    @classmethod
    def name(cls) -> str:
        return "notifications"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> NotificationReader:
        return NotificationReader(self.options)

    def streamReader(self, schema) -> NotificationStream:
        return NotificationStream(self.options)

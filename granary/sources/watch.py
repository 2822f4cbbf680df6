"""Changes below a folder as a stream: a data source that compares listings, so deletions are seen as well as creations."""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "root string, path string, op string, ts timestamp, seq long"


def listing(root: str, extensions: tuple[str, ...] = (".zip", ".rar"), most_depth: int = 6) -> list[str]:
    """Archives below root, by path from it. Contents don't count, only names."""
    out = []
    for folder, _, names in os.walk(root):
        below = os.path.relpath(folder, root).replace(os.sep, "/")
        prefix = "" if below == "." else below + "/"
        if prefix.count("/") < most_depth:
            out += [prefix + n for n in names if n.lower().endswith(extensions)]
    return sorted(out)


def differences(before: list[str], after: list[str]) -> list[tuple[str, str]]:
    """(path, op), deletions first."""
    old, new = set(before), set(after)
    return [(p, "deleted") for p in sorted(old - new)] + [(p, "created") for p in sorted(new - old)]


def until_readable(path: str, waits: tuple[float, ...] = (1, 2, 4), sleep=time.sleep) -> bool:
    """Whether a file can be opened, tried again after each wait: archives are often still being copied when they appear."""
    for wait in (*waits, None):
        try:
            with open(path, "rb"):
                return True
        except OSError:
            if wait is None:
                return False
            sleep(wait)
    return False


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.root = options["path"]

    def initialOffset(self) -> dict:
        return {"seq": 0, "names": [], "events": []}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now = listing(self.root)
        seen = datetime.now(timezone.utc)
        events = [(p, op, start["seq"] + k) for k, (p, op) in enumerate(differences(start["names"], now))]
        # The offset holds its batch, so a batch can be read again after the folder has changed.
        end = {"seq": start["seq"] + len(events), "names": now, "events": [[*e, seen.isoformat()] for e in events]}
        return iter(self._rows(end)), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._rows(end))

    def _rows(self, end: dict) -> list[tuple]:
        return [(self.root, p, op, datetime.fromisoformat(at), seq) for p, op, seq, at in end["events"]]


class ArchiveChanges(DataSource):
    """spark.dataSource.register(ArchiveChanges), then spark.readStream.format('archive_changes').load(folder)."""

    @classmethod
    def name(cls) -> str:
        return "archive_changes"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> _Reader:
        return _Reader(self.options)

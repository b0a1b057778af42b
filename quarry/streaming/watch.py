"""A streaming source of changes in corpus folders.

Each read lists the folders and compares the listing with the one before: (corpus, path, action), action
``changed`` for what is new or has another time or size, ``removed`` for what has gone; a folder that goes
takes its documents with it. A listing and its changes are kept in a state folder until the stream has
committed them, so a restarted query gets the same changes again. The state folder lies where the driver
can write; only the driver lists.

``MOST`` changes are given out at once; the rest waits for the next read, oldest paths first, and nothing
is lost: what was not given out is still a difference to the listing that was kept. A query that is
drained (``processAllAvailable``, or the trigger availableNow) gives out all of it before it stops.
"""

from __future__ import annotations

import fnmatch
import json
import os
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from quarry.sources.corpus import EXTENSIONS, MAX_BYTES, MAX_DEPTH

MOST = 65_536
FORMAT = "folder_events"


def left_out(path: str, ignore: list[str]) -> bool:
    """The rules of the walk: dot names, other endings, depth, and ignore patterns."""
    parts = path.split("/")
    if any(p.startswith(".") for p in parts) or not path.lower().endswith(tuple(f".{e}" for e in EXTENSIONS)) or len(parts) > MAX_DEPTH + 1:
        return True
    return any(p in path or (set(p) & set("*?") and (fnmatch.fnmatchcase(path, p) or fnmatch.fnmatchcase(parts[-1], p))) for p in ignore)


def listing(folders: dict[str, str], ignore: list[str]) -> dict[str, list[int]]:
    """Time and size of every document, by corpus and path."""
    found = {}
    for corpus, root in folders.items():
        top = root.removeprefix("file://").rstrip("/")
        for folder, below, names in os.walk(top):
            below[:] = [d for d in below if not d.startswith(".")]
            for name in names:
                full = f"{folder}/{name}"
                path = os.path.relpath(full, top)
                try:
                    stat = os.stat(full)
                except OSError:  # gone meanwhile
                    continue
                if not left_out(path, ignore) and 1 <= stat.st_size <= MAX_BYTES:
                    found[f"{corpus}\0{path}"] = [stat.st_mtime_ns, stat.st_size]
    return found


def changes(before: dict[str, list[int]], now: dict[str, list[int]], most: int) -> tuple[list[tuple[str, str, str]], dict[str, list[int]]]:
    """At most ``most`` changes, and the listing that they lead to."""
    due = sorted(k for k in before.keys() | now.keys() if before.get(k) != now.get(k))[:most]
    after = dict(before)
    for k in due:
        if k in now:
            after[k] = now[k]
        else:
            del after[k]
    return [(*k.split("\0", 1), "changed" if k in now else "removed") for k in due], after


class FolderReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folders, self.ignore = json.loads(options["folders"]), json.loads(options.get("ignore", "[]"))
        self.state, self.most = Path(options["state"].removeprefix("file://")), int(options.get("most", MOST))

    def initialOffset(self) -> dict:
        return {"read": 0}

    def _file(self, n: int) -> Path:
        return self.state / f"{n:012d}.json"

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        n = int(start["read"])
        stored = json.loads(self._file(n).read_text())["listing"] if n else {}
        rows, after = changes(stored, listing(self.folders, self.ignore), self.most)
        if not rows:
            return iter([]), start
        self.state.mkdir(parents=True, exist_ok=True)
        temporary = self._file(n + 1).with_suffix(".tmp")
        temporary.write_text(json.dumps({"listing": after, "rows": rows}))
        temporary.replace(self._file(n + 1))
        return iter(rows), {"read": n + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for n in range(int(start["read"]) + 1, int(end["read"]) + 1):
            yield from map(tuple, json.loads(self._file(n).read_text())["rows"])

    def commit(self, end: dict) -> None:
        """The latest listing stays; those before it have been used."""
        for f in self.state.glob("*.json"):
            if int(f.stem) < int(end["read"]):
                f.unlink(missing_ok=True)


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "corpus string, path string, action string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return FolderReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FolderSource)


def folder_events(spark: SparkSession, folders: dict[str, str], state: str, ignore: list[str] | None = None, most: int = MOST) -> DataFrame:
    """The stream of changes in these folders (corpus: path)."""
    options = {"folders": json.dumps(folders), "ignore": json.dumps(ignore or []), "state": state, "most": str(most)}
    return spark.readStream.format(FORMAT).options(**options).load()

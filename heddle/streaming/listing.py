"""A stream of file changes (survey L1, L4): a Python data source whose offsets are times at which folders were listed.

    spark.dataSource.register(listing.Changes)
    spark.readStream.format("listing_changes").options(kb="k", roots=json.dumps([...]), state=shared_folder).load()

Each trigger lists the folders in tasks, one for each folder below a root and one for the root's own files, and compares
them with the listing of the trigger before, which lies in the state folder by time; so the trigger's interval is that of
the reconciliation, and nothing that happens between two triggers is lost but what is undone again. A batch that is run
again after a failure finds its listing there and gives the same rows. The first listing is the baseline and gives no
rows. Both folders must be mounted on all executors. Symbolic links aren't followed; ignored folders aren't entered.

Rows are as `freshness.watched` takes them, with the path: create, modify and delete of files, touched for folders that
come or go, unreadable for a folder that can't be listed. seq counts within a batch.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
from collections.abc import Iterator
from datetime import datetime

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources.files import IGNORED

SCHEMA = "kb string, epoch long, seq long, ts timestamp, kind string, hash string, base long, path string"
KEPT_MS = 3_600_000  # listings older than this before the last committed one are removed


class Part(InputPartition):
    """A folder with all below it, or a root's own files (deep is false), between two times."""

    def __init__(self, number: int, folder: str, deep: bool, start: int, end: int):
        self.number, self.folder, self.deep, self.start, self.end = number, folder, deep, start, end


def listed(folder: str, deep: bool) -> dict[str, list] | None:
    """{path: [is a folder, size, time]}; None if the folder can't be listed."""
    found, open_folders = {}, [folder]
    while open_folders:
        at = open_folders.pop()
        try:
            with os.scandir(at) as entries:
                for e in entries:
                    if e.is_symlink():
                        continue
                    below = e.is_dir(follow_symlinks=False)
                    if below and e.name.lower() in IGNORED:
                        continue
                    s = e.stat(follow_symlinks=False)
                    found[e.path] = [below, 0 if below else s.st_size, 0 if below else s.st_mtime_ns]
                    if below and deep:
                        open_folders.append(e.path)
        except FileNotFoundError:
            if at == folder and not deep:
                return None
        except OSError:
            return None
    return found


class Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.kb, self.epoch = options.get("kb", ""), int(options.get("epoch", 0))
        self.roots, self.state = json.loads(options["roots"]), options["state"]

    def initialOffset(self) -> dict:
        return {"ms": 0}

    def latestOffset(self) -> dict:
        return {"ms": int(time.time() * 1000)}

    def _place(self, folder: str, deep: bool) -> str:
        return f"{self.state}/{hashlib.sha256(f'{deep} {folder}'.encode()).hexdigest()[:24]}"

    def partitions(self, start: dict, end: dict) -> list[Part]:
        """The folders below each root that are there now or were at some listing before."""
        known = f"{self.state}/folders.json"
        before = set(json.load(open(known))) if os.path.exists(known) else set()
        now = {e.path for root in self.roots if os.path.isdir(root) for e in os.scandir(root) if e.is_dir(follow_symlinks=False) and e.name.lower() not in IGNORED}
        if now - before:
            os.makedirs(self.state, exist_ok=True)
            self._written(known, sorted(now | before))
        parts = [(root, False) for root in self.roots] + [(folder, True) for folder in sorted(now | before)]
        return [Part(k, folder, deep, start["ms"], end["ms"]) for k, (folder, deep) in enumerate(parts)]

    def _written(self, path: str, value) -> None:
        aside = f"{path}-{uuid.uuid4().hex}"
        with open(aside, "w") as f:
            json.dump(value, f)
        os.replace(aside, path)

    def read(self, part: Part) -> Iterator[tuple]:
        place = self._place(part.folder, part.deep)
        os.makedirs(place, exist_ok=True)
        here = f"{place}/{part.end}.json"
        if os.path.exists(here):
            now = json.load(open(here))
        else:
            now = listed(part.folder, part.deep)
            self._written(here, now)
        then = f"{place}/{part.start}.json"
        # a folder that is new below its root had nothing in it; at the first trigger all is baseline
        before = json.load(open(then)) if os.path.exists(then) else (now if part.start == 0 else {})
        at, base, n = datetime.fromtimestamp(part.end / 1000), part.number * 10**9, 0
        if now is None:
            changes = [("unreadable", part.folder)]
        else:
            before = before or {}
            changes = []
            for path in sorted(before.keys() | now.keys()):
                old, new = before.get(path), now.get(path)
                if old != new:
                    folder = (new or old)[0]
                    changes.append(("touched" if folder else "create" if old is None else "delete" if new is None else "modify", path))
        for kind, path in changes:
            n += 1
            yield self.kb, self.epoch, base + n, at, kind, None, None, path

    def commit(self, end: dict) -> None:
        """Listings that no batch can ask for any more go."""
        for name in os.listdir(self.state) if os.path.isdir(self.state) else ():
            place = f"{self.state}/{name}"
            for f in os.listdir(place) if os.path.isdir(place) else ():
                if f.endswith(".json") and f[:-5].isdigit() and int(f[:-5]) < end["ms"] - KEPT_MS:
                    os.remove(f"{place}/{f}")


class Changes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "listing_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> Reader:
        return Reader(self.options)

"""Revisions of an index as Parquet tables (survey A22, B1-B3, G7, J18, J19, L9, L11, 2.N): saved apart, published by a conditional pointer.

A revision is a folder of tables with a manifest that is written last, so a revision without one is none. Tables with a
key are bucketed and sorted by it, so that joins on the key move no rows and look-ups read few buckets; they are named
in the session's catalogue when they are loaded. A revision may use tables of earlier ones (`uses` in its manifest).

The state of a knowledge base is a log of JSON files, one for each change. A change claims the next number, which only
one writer can create, looks whether a later one is there after all, writes the state aside and renames it, so that it
is never seen half written; of two writers that start from the same state one wins. Which status may follow which is a
relation, `LEGAL`; anything else is refused. All file work goes through Hadoop's file systems.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = 5
STATUSES = ("EMPTY", "READY", "DIRTY", "BUILDING", "FAILED", "INCOMPATIBLE")
LEGAL = frozenset(
    [(old, "BUILDING") for old in STATUSES if old != "BUILDING"]  # a build begins, one at a time
    + [("BUILDING", "READY")]  # published
    + [("BUILDING", "FAILED"), ("DIRTY", "FAILED")]  # failed, perhaps after the sources had changed
    + [(old, new) for old in ("READY", "BUILDING", "FAILED", "DIRTY", "INCOMPATIBLE") for new in ("DIRTY", "INCOMPATIBLE")]  # sources or model changed
)
KEPT_STATES = 50
CLAIM_SECONDS = 600  # a claim without a state is given up after this


def listed(stores: list[Store]) -> list[dict]:
    """The states of several knowledge bases, the one changed last first, then by folder."""
    return sorted(({"folder": s.folder, **s.state()} for s in stores), key=lambda x: (-x.get("at", 0), x["folder"]))


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.folder))

    # files

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _read(self, path: str) -> dict:
        stream = self._fs.open(self._path(path))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _manifest(self, revision: int | None) -> dict | None:
        """None if there is none, or a broken one."""
        path = f"{self.folder}/revision={revision}/manifest.json"
        if not self._fs.exists(self._path(path)):
            return None
        try:
            got = self._read(path)
        except (ValueError, Py4JJavaError):
            return None
        return got if isinstance(got, dict) else None

    def _create(self, path: str, value: dict) -> bool:
        """Write a new file; False if it is there already."""
        try:
            out = self._fs.create(self._path(path), False)
        except Exception as failure:
            if self._fs.exists(self._path(path)):
                return False
            raise failure
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        return True

    # the control row

    def _versions(self) -> list[int]:
        return sorted(int(n) for n in self._names(f"{self.folder}/state") if n.isdigit())

    def state(self) -> dict:
        """The newest state: version, revision, published, status, error, at."""
        versions = self._versions()
        return self._read(f"{self.folder}/state/{versions[-1]}") if versions else {"version": 0, "revision": 1, "published": None, "status": "EMPTY", "error": "", "at": 0}

    def _change(self, old: dict, **values) -> dict | None:
        """The next state, if no one else has changed it meanwhile. An illegal one is refused."""
        new = {**old, **values, "version": old["version"] + 1, "at": int(time.time() * 1000)}
        if (old["status"], new["status"]) not in LEGAL:
            raise ValueError(f"a knowledge base that is {old['status']} can't become {new['status']}")
        if new["status"] == "READY" and new["published"] != new["revision"]:
            raise ValueError("READY needs the present revision to be published")
        at = f"{self.folder}/state"
        self._fs.mkdirs(self._path(at))
        claim = self._path(f"{at}/claim-{new['version']}")
        if not self._create(f"{at}/claim-{new['version']}", {"at": new["at"]}):
            return None
        try:
            if (self._versions() or [0])[-1] != old["version"]:
                return None  # the log went on, and this number was cleared away
            aside = f"{at}/aside-{uuid.uuid4().hex}"
            self._create(aside, new)
            if not self._fs.rename(self._path(aside), self._path(f"{at}/{new['version']}")):
                raise OSError(f"could not write state {new['version']}")
        finally:
            self._fs.delete(claim, False)
        for version in self._versions()[:-KEPT_STATES]:
            self._fs.delete(self._path(f"{at}/{version}"), False)
        return new

    def begin(self) -> int | None:
        """Start a build: its revision, a new one only if the present one is published. None while another build runs."""
        old = self.state()
        if old["status"] == "BUILDING":
            return None
        new = self._change(old, status="BUILDING", error="", revision=old["revision"] + (old["published"] == old["revision"]))
        return new and new["revision"]

    def mark_dirty(self, revision: int) -> bool:
        """The sources changed: a new revision is due, so a build of this one can't be published any more."""
        old = self.state()
        return old["revision"] == revision and (old["status"], "DIRTY") in LEGAL and bool(self._change(old, status="DIRTY", revision=revision + 1))

    def mark_incompatible(self, reason: str) -> bool:
        """The model changed: what is published can't be searched by vectors until it is built anew."""
        old = self.state()
        return (old["status"], "INCOMPATIBLE") in LEGAL and bool(self._change(old, status="INCOMPATIBLE", error=reason[:500]))

    def fail(self, revision: int, error: str) -> bool:
        old = self.state()
        return old["revision"] == revision and (old["status"], "FAILED") in LEGAL and bool(self._change(old, status="FAILED", error=error[:500]))

    # revisions

    def save(self, revision: int, tables: dict[str, DataFrame], manifest: dict, keys: dict[str, str] | None = None) -> None:
        """Write the tables aside, those with a key bucketed by it, then move the whole to its place."""
        with Staging(self, revision) as staging:
            for name, df in tables.items():
                staging.write(name, df, (keys or {}).get(name))
            staging.commit(manifest)

    def publish(self, revision: int) -> bool:
        """Make the revision the published one, if it is still the one being built; else remove it."""
        old = self.state()
        if old["revision"] == revision and old["status"] == "BUILDING" and self._change(old, status="READY", published=revision):
            return True
        self._fs.delete(self._path(f"{self.folder}/revision={revision}"), True)
        return False

    def load(self, revision: int | None = None) -> tuple[dict, dict[str, DataFrame]] | None:
        """Manifest and tables of a revision, of the published one if none is named. None if it is missing, broken or of a later format."""
        revision = self.state()["published"] if revision is None else revision
        at, manifest = f"{self.folder}/revision={revision}", self._manifest(revision)
        if manifest is None or not 1 <= manifest.get("format", 0) <= FORMAT or not all(self._fs.exists(self._path(f"{at}/{t}")) for t in manifest.get("tables", ())):
            return None
        return manifest, {t: self._table(f"{at}/{t}", manifest["build"], manifest["bucketed"].get(t)) for t in manifest["tables"]}

    def _table(self, path: str, build: str, bucketed: dict | None) -> DataFrame:
        """A saved table; a bucketed one by a name in the catalogue, where its buckets are known."""
        if bucketed is None:
            return self.spark.read.parquet(path)
        name = f"heddle_{hashlib.sha256(f'{path} {build}'.encode()).hexdigest()[:24]}"
        key, n = bucketed["key"], bucketed["buckets"]
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({bucketed['columns']}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {n} BUCKETS LOCATION '{path}'")
        return self.spark.table(name)

    def clean(self) -> list[str]:
        """Remove what a broken build left, and revisions that aren't published. A build that was under way at a restart has failed."""
        old, gone = self.state(), []
        for name in self._names(f"{self.folder}/state"):
            at = self._path(f"{self.folder}/state/{name}")
            if not name.isdigit() and self._fs.getFileStatus(at).getModificationTime() < (time.time() - CLAIM_SECONDS) * 1000:
                self._fs.delete(at, False)
        if old["status"] == "BUILDING":
            self._change(old, status="FAILED", error="stopped during a build")
        kept = {old["published"], *((self._manifest(old["published"]) or {}).get("uses", ()))}
        for name in self._names(self.folder):
            if name.startswith("staging-") or (name.startswith("revision=") and name not in {f"revision={k}" for k in kept}):
                self._fs.delete(self._path(f"{self.folder}/{name}"), True)
                gone.append(name)
        return gone


class Staging:
    """Tables of a revision under way: written aside one by one and readable there, moved to their place at the end, or removed."""

    def __init__(self, store: Store, revision: int):
        self.store, self.revision, self.build = store, revision, uuid.uuid4().hex
        self.aside, self.bucketed, self.tables, self.done = f"{store.folder}/staging-{self.build}", {}, [], False

    def __enter__(self) -> Staging:
        return self

    def __exit__(self, *_) -> None:
        self.store._fs.delete(self.store._path(self.aside), True)

    def write(self, name: str, df: DataFrame, key: str | None = None, dealt: bool = False, apart: str | None = None, buckets: int | None = None, lists: str | None = None) -> DataFrame:
        """The table as written. By a key it gets the buckets named, or as many as the session has shuffle partitions; rows that are dealt so already aren't moved again. Each bucket is written by one task, but for rows with a number above 0 in the column `apart`, which isn't kept: these go to as many tasks further on, so a bucket may have several files. lists: a column of lists of rows, which are dealt and sorted as they are and opened only then."""
        path = f"{self.aside}/{name}"
        self.tables.append(name)
        if key is None:
            df.write.parquet(path)
            return self.store.spark.read.schema(df.schema).parquet(path)
        spark = self.store.spark
        n, table = buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), self._named(name)
        if apart is not None:
            at = F.pmod(F.hash(key), F.lit(n))  # as Spark numbers buckets
            df = df.repartitionById(n, F.pmod(at + F.col(apart), F.lit(n)).cast("int")).drop(apart)
        elif not dealt:
            df = df.repartition(n, key)
        if lists is not None:
            df = df.sortWithinPartitions(key).select(key, F.inline(lists))
        df.write.format("parquet").option("path", path).bucketBy(n, key).sortBy(key).saveAsTable(table)
        self.bucketed[name] = {"key": key, "buckets": n, "columns": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)}
        return spark.table(table)

    def replace(self, name: str, df: DataFrame, key: str, buckets: int | None = None) -> None:
        """Write a table that stands in place of one written before and may be made of it."""
        self.write(f"{name}-next", df, key, buckets=buckets)
        self.tables.remove(f"{name}-next")
        fs, path = self.store._fs, self.store._path
        for staged in (name, f"{name}-next"):
            self.store.spark.sql(f"DROP TABLE IF EXISTS `{self._named(staged)}`")
        fs.delete(path(f"{self.aside}/{name}"), True)
        fs.rename(path(f"{self.aside}/{name}-next"), path(f"{self.aside}/{name}"))
        self.bucketed[name] = self.bucketed.pop(f"{name}-next")

    def _named(self, name: str) -> str:
        return f"heddle_staging_{self.build}_{name.replace('-', '_')}"

    def commit(self, manifest: dict) -> None:
        store, place = self.store, f"{self.store.folder}/revision={self.revision}"
        for name in self.bucketed:
            store.spark.sql(f"DROP TABLE IF EXISTS {self._named(name)}")  # of the catalogue alone: the files stay
        store._create(f"{self.aside}/manifest.json", {**manifest, "format": FORMAT, "revision": self.revision, "build": self.build, "tables": sorted(self.tables), "bucketed": self.bucketed})
        store._fs.delete(store._path(place), True)
        if not store._fs.rename(store._path(self.aside), store._path(place)):
            raise OSError(f"could not move {self.aside} to {place}")


def validated(manifest: dict | None, state: dict, source_hash: str, chunking: int, model: str) -> str:
    """Status of a loaded index: foreign or missing, then revision, then sources, then versions and model."""
    if manifest is None or manifest.get("kb") != state.get("kb", manifest.get("kb")):
        return "INCOMPATIBLE"
    if manifest.get("revision") != state["revision"] or manifest.get("source_hash") != source_hash:
        return "DIRTY"
    if (manifest.get("format"), manifest.get("chunking"), manifest.get("model")) != (FORMAT, chunking, model):
        return "INCOMPATIBLE"
    return "READY"

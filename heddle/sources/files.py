"""Directory scans (survey A1-A7, A9): folders are listed level by level in tasks; policies are column expressions.

The folders must be mounted on all executors. A level's folders are dealt over the tasks, ignored and denied ones are
not descended into, symbolic links are counted and never followed. Once the files listed so far exceed the budget, folders
that come after the first file beyond it, in the order of paths, are not entered: all files there would be beyond it, too.
Warnings tell of what was listed.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.stored import stored
from .readers import READERS

# Folders never entered; names, extensions and folders of credentials.
IGNORED = (".git", ".idea", ".vscode", "node_modules", "target", "build", "dist", "out", "vendor", ".venv", "venv", "__pycache__", ".next", ".gradle")
SECRET_NAMES = (".env", ".netrc", "_netrc", ".npmrc", ".pypirc", ".htpasswd", ".git-credentials", "credentials", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519", "secrets.yaml", "secrets.yml", "secrets.json")
SECRET_EXTENSIONS = ("pem", "key", "p12", "pfx", "jks", "keystore", "kdbx", "ppk", "asc", "gpg")
SECRET_FOLDERS = (".ssh", ".gnupg", ".aws", ".azure", ".kube")

ENTRIES = "root string, path string, name string, depth int, kind string, size long, modified_at long"
WARNING = ("path", "reader_id", "message", "skipped")


@dataclass(frozen=True)
class Budget:
    files: int = 50_000
    total_bytes: int = 8 << 30
    depth: int = 32

    def __post_init__(self):
        for name in ("files", "total_bytes", "depth"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} of a budget must be positive")


@dataclass(frozen=True)
class Scan:
    """documents: (root, path, relative_path, size, modified_at, reader_id, reader_version); warnings: (path, reader_id, message, skipped)."""

    roots: list[str]
    documents: DataFrame
    warnings: DataFrame


def outermost(roots: list[str]) -> list[str]:
    """The folders that exist, without those below another one, each once."""
    real = list(dict.fromkeys(os.path.normpath(os.path.abspath(r)) for r in roots if os.path.isdir(r)))
    return [r for r in real if not any(r != o and r.startswith(o.rstrip("/") + "/") for o in real)]


def _listed(batches):
    schema = pa.schema([("root", pa.string()), ("path", pa.string()), ("name", pa.string()), ("depth", pa.int32()), ("kind", pa.string()), ("size", pa.int64()), ("modified_at", pa.int64())])
    for batch in batches:
        out = []
        for root, folder, depth in zip(*(batch.column(c).to_pylist() for c in ("root", "path", "depth"))):
            try:
                with os.scandir(folder) as found:
                    for e in found:
                        kind = "link" if e.is_symlink() else "folder" if e.is_dir(follow_symlinks=False) else "file" if e.is_file(follow_symlinks=False) else "other"
                        s = e.stat(follow_symlinks=False)
                        out.append((root, e.path, e.name, depth + 1, kind, s.st_size, s.st_mtime_ns // 1_000_000))
            except OSError as failure:
                out.append((root, folder, str(failure), depth, "failed", 0, 0))
        yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*out)))) if out else {c: [] for c in schema.names}, schema=schema)


def denied(name: Column, folder: bool = False) -> Column:
    """Whether a file or folder looks like one of credentials."""
    name = F.lower(F.trim(name))
    if folder:
        return name.isin(*SECRET_FOLDERS)
    return name.isin(*SECRET_NAMES) | name.startswith(".env.") | F.regexp_extract(name, r"\.([^.]+)$", 1).isin(*SECRET_EXTENSIONS)


def dispatch(readers: dict) -> list[tuple[str, str, str, int, int]]:
    """(kind, key, id, version, most bytes) of each name and extension that some reader takes; two readers of one key are an error."""
    taken = {}
    for r in readers.values():
        for kind, keys in (("name", r.names), ("extension", r.extensions)):
            for key in (k.strip().lower() for k in keys):
                if (kind, key) in taken:
                    raise ValueError(f"both {taken[kind, key].id} and {r.id} take the {kind} {key}")
                taken[kind, key] = r
    return [(kind, key, r.id, r.version, r.most_bytes) for (kind, key), r in taken.items()]


def _united(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def listing(spark: SparkSession, roots: list[str], depth: int, policy: bool = True, ignored: tuple[str, ...] = (), worth: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """All entries below the roots down to a depth. Each level is one job over its folders. ignored: further folders not to enter, such as the application's own. worth: from the entries of a level, whether a folder of it is to be entered."""
    level = spark.createDataFrame([(r, r, 0) for r in roots], "root string, path string, depth int")
    levels, parts = [], int(spark.conf.get("spark.sql.shuffle.partitions"))
    for k in range(depth):
        found = stored(level.repartition(parts, "path").mapInArrow(_listed, ENTRIES))
        levels.append(found)
        below = found.where((F.col("kind") == "folder") & ~F.lower("name").isin(*IGNORED, *ignored))
        below = below.where(~denied(F.col("name"), True)) if policy else below
        level = (below.where(worth(found)) if worth else below).select("root", "path", "depth")
        if k + 1 < depth and level.isEmpty():
            break
    return _united(levels)


class _Judge:
    """What becomes of the files listed so far, and where the budget ends among them."""

    def __init__(self, spark: SparkSession, tops: list[str], policy: bool, budget: Budget, readers: dict):
        self.policy, self.budget, self.files, self.first = policy, budget, [], None
        self.known = spark.createDataFrame(dispatch(readers), "kind string, key string, id string, version int, most long")
        self.rank = F.create_map(*[F.lit(x) for k, r in enumerate(tops) for x in (r, k)])[F.col("root")]

    def judged(self, entries: DataFrame) -> DataFrame:
        """(root, path, relative_path, size, modified_at, extension, reader, state) of the files among the entries."""
        of = lambda kind, tag: F.broadcast(self.known.where(F.col("kind") == kind).select(F.col("key").alias(kind), F.struct("id", "version", "most").alias(tag)))
        files = entries.where("kind = 'file'").drop("kind", "depth").withColumn("secret", denied(F.col("name")) if self.policy else F.lit(False))
        files = files.withColumn("name", F.lower("name")).withColumn("extension", F.regexp_extract("name", r"^.+\.([^.]+)$", 1))
        files = files.join(of("name", "by_name"), "name", "left").join(of("extension", "by_extension"), "extension", "left").withColumn("reader", F.coalesce("by_name", "by_extension"))
        state = F.when(F.col("secret"), "secret").when(F.col("reader").isNull(), "unsupported").when(F.col("size") > F.col("reader.most"), "oversized").otherwise("taken")
        return files.select("root", "path", F.expr("substring(path, length(root) + 2)").alias("relative_path"), "size", "modified_at", "extension", "reader", state.alias("state"))

    def worth(self, found: DataFrame) -> Column:
        """Takes a level's entries; whether a folder lies before the first file beyond the budget."""
        self.files.append(stored(self.judged(found)))
        taken = self.files[-1].where("state = 'taken'").withColumn("of", self.rank)
        rows = taken if self.first is None else taken.unionByName(self.first.drop("n", "total", "beyond"))
        # the budget bounds what is ordered and numbered: the first files + 1 rows
        upto = Window.orderBy("of", "path").rowsBetween(Window.unboundedPreceding, 0)
        first = rows.orderBy("of", "path").limit(self.budget.files + 1).withColumns({"n": F.count("*").over(upto), "total": F.sum("size").over(upto)})
        beyond = F.when(F.col("n") > self.budget.files, f"more than {self.budget.files} files").when(F.col("total") > self.budget.total_bytes, f"more than {self.budget.total_bytes} bytes")
        self.first = stored(first.withColumn("beyond", beyond))
        end = self.first.where("beyond IS NOT NULL").agg(F.min_by(F.struct("of", "path"), "n").alias("end")).first()["end"]
        return F.lit(True) if end is None else (self.rank < end["of"]) | ((self.rank == end["of"]) & (F.col("path") < end["path"]))


def scan(spark: SparkSession, roots: list[str], policy: bool = True, budget: Budget = Budget(), readers: dict = READERS, ignored: tuple[str, ...] = ()) -> Scan:
    """The documents that some reader takes, in the order of their paths and within the budget, and what was left out and why."""
    tops = outermost(roots)
    if not tops:
        empty = spark.createDataFrame([], "root string, path string, relative_path string, size long, modified_at long, reader_id string, reader_version int")
        return Scan([], empty, spark.createDataFrame([], "path string, reader_id string, message string, skipped boolean"))
    judge = _Judge(spark, tops, policy, budget, readers)
    entries = listing(spark, tops, budget.depth, policy, ignored, judge.worth)
    files, first = _united(judge.files), judge.first
    documents = first.where("beyond IS NULL").select("root", "path", "relative_path", "size", "modified_at", F.col("reader.id").alias("reader_id"), F.col("reader.version").alias("reader_version"))

    warn = lambda df, path, reader, message, skipped: df.select(path.alias("path"), reader.alias("reader_id"), message.alias("message"), F.lit(skipped).alias("skipped"))
    top, lit = F.lit(tops[0]), F.lit
    count = lambda df, condition: df.agg(F.count_if(condition).alias("c")).where("c > 0")
    unread = files.where("state = 'unsupported'").groupBy(F.when(F.col("extension") == "", "none").otherwise(F.col("extension")).alias("e")).count()
    six = unread.orderBy(F.col("count").desc(), "e").limit(6).agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("c"), "e"))).alias("six"))
    rolled = unread.agg(F.sum("count").alias("c"), F.count("*").alias("kinds")).where("c > 0").crossJoin(F.broadcast(six))
    detail = F.array_join(F.transform("six", lambda x: F.concat_ws(" ", x["e"], -x["c"])), ", ")
    warnings = [
        warn(files.where("state = 'secret'"), F.col("path"), lit("sensitive-file"), lit("looks like a file of credentials"), True),
        warn(files.where("state = 'oversized'"), F.col("path"), F.col("reader.id"), F.concat(lit("larger than "), F.col("reader.most"), lit(" bytes")), True),
        warn(entries.where("kind = 'failed'"), F.col("path"), lit("filesystem"), F.concat(lit("not readable: "), F.col("name")), True),
        warn(first.agg(F.min_by("beyond", F.when(F.col("beyond").isNotNull(), F.col("n"))).alias("why")).where("why IS NOT NULL"), top, lit("scan-budget"), F.col("why"), True),  # the limit met first
        warn(rolled, top, lit("unsupported-format"), F.concat(F.col("c"), lit(" files of unsupported formats ("), detail, F.when(F.col("kinds") > 6, lit(", ...")).otherwise(lit("")), lit(")")), False),
        warn(count(entries, F.col("kind") == "link"), top, lit("symbolic-link"), F.concat(F.col("c"), lit(" symbolic links not followed")), False),
        warn(count(entries, (F.col("kind") == "folder") & (F.col("depth") >= budget.depth)), top, lit("scan-budget"), F.concat(F.col("c"), lit(f" folders at the greatest depth, {budget.depth}, not entered")), True),
    ]
    if policy:
        warnings.append(warn(entries.where((F.col("kind") == "folder") & denied(F.col("name"), True) & (F.col("depth") < budget.depth)), F.col("path"), lit("sensitive-file"), lit("looks like a folder of credentials"), True))
    return Scan(tops, documents, _united(warnings))

"""Tables that change together: one commit for all of them, or none.

A write puts the new rows of every table into folders of its own, together with
the keys (a repository, or a snapshot of one) whose rows it replaces, and becomes
visible with one small file in the log. Log files are numbered; a number is taken
by a rename that fails where the file is there already, so of two writers one
comes later. The later one looks whether a commit since its base has replaced a
key of its own; then it computes its rows anew on the new version. No clock
decides an order.

A reader takes for each key the rows of the newest commit that replaced it, at
one version for all tables. Nothing of an old version is touched by a commit;
``sweep`` removes what has been out of date for longer than a lease.

Layout: ``<root>/<table>/write_id=<id>/<key>=<value>/…``, the replaced keys under
``replaced_keys``, the log under ``commits``. A stream's commit also holds its epoch: a
micro-batch that is played again is found in the log and changes nothing.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

WRITE = "write_id"
LOG, KEYS = "commits", "replaced_keys"
# Row order inside a table's files; these columns also split a large repository.
ORDER = ["id", "from", "to", "kind", "file", "line", "start_line", "start", "n"]


class Conflict(RuntimeError):
    """Another writer has replaced a key of this commit since its base."""


class Files:
    """The few file operations that DataFrames do not have, by Hadoop's file system."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._gateway = spark.sparkContext._gateway
        self._fs = self.path(root).getFileSystem(self._conf)

    def path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def children(self, folder: str) -> list[tuple[str, int]]:
        """Names in a folder and when they changed, in milliseconds; nothing if there is no folder."""
        path = self.path(folder)
        if not self._fs.exists(path):
            return []
        return [(s.getPath().getName(), s.getModificationTime()) for s in self._fs.listStatus(path)]

    def read(self, name: str) -> str:
        stream = self._fs.open(self.path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, content: str) -> None:
        stream = self._fs.create(self.path(name), False)
        try:
            stream.write(bytearray(content.encode()))
        finally:
            stream.close()

    def rename_new(self, old: str, new: str) -> bool:
        """Rename; false, and nothing changed, if ``new`` is there already."""
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        no_options = self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self.path(old), self.path(new), no_options)
            return True
        except Exception as e:  # noqa: BLE001 - a Java exception, told by its class
            if "FileAlreadyExistsException" not in str(e):
                raise
            return False

    def remove(self, name: str) -> None:
        self._fs.delete(self.path(name), True)


def stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    """The files of a folder, or None where there is no folder yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


@dataclass(frozen=True)
class Version:
    """The log up to a commit. ``streams``: the last epoch of each stream."""

    number: int = 0
    writes: tuple[tuple[int, str, int], ...] = ()  # number, write, milliseconds
    streams: dict[str, int] = field(default_factory=dict)


class Store:
    """A folder of tables that are replaced key by key."""

    def __init__(self, spark: SparkSession, root: str, keys: tuple[str, ...] = ("repo",)):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), list(keys)
        self.files = Files(spark, self.root)

    def version(self) -> Version:
        """The newest version."""
        names = sorted(n for n, _ in self.files.children(f"{self.root}/{LOG}") if n.endswith(".json"))
        if not names:
            return Version()
        entries = []
        for name in names:  # a file for each commit that a sweep has left
            try:
                entries.append(json.loads(self.files.read(f"{self.root}/{LOG}/{name}")))
            except Exception:  # noqa: BLE001 - swept between the listing and here
                if name == names[-1]:
                    raise
        return Version(
            int(names[-1].removesuffix(".json")),
            tuple((e["number"], e["write"], e["at"]) for e in entries),
            entries[-1]["streams"],
        )

    def _replaced(self, version: Version) -> DataFrame | None:
        """Every commit's keys: number, write_id, at, and the keys."""
        schema = StructType([*(StructField(k, StringType()) for k in self.keys), StructField(WRITE, StringType())])
        keys = stored(self.spark, f"{self.root}/{KEYS}", schema) if version.writes else None
        if keys is None:
            return None
        log = self.spark.createDataFrame(list(version.writes), f"number long, {WRITE} string, at long")
        return keys.join(F.broadcast(log), WRITE)

    def live(self, version: Version | None = None) -> DataFrame | None:
        """The write that holds each key's rows: the keys and write_id."""
        replaced = self._replaced(version or self.version())
        if replaced is None:
            return None
        return replaced.groupBy(*self.keys).agg(F.max_by(WRITE, "number").alias(WRITE))

    def read(self, table: str, schema: StructType, version: Version | None = None) -> DataFrame:
        """A table's rows at a version (the newest by default)."""
        live = self.live(version)
        whole = StructType([*schema.fields, StructField(WRITE, StringType())])
        rows = None if live is None else stored(self.spark, f"{self.root}/{table}", whole)
        if rows is None:
            return self.spark.createDataFrame([], schema)
        # the predicate is always true; it lets Spark prune folders of other writes and keys
        return rows.join(live.where(F.col(WRITE) >= ""), [WRITE, *self.keys], "left_semi").select(*schema.fieldNames())

    def write_rows(self, write: str, table: str, rows: DataFrame) -> None:
        order = [c for c in ORDER if c in rows.columns]
        (
            rows.withColumn(WRITE, F.lit(write))
            .repartitionByRange(*self.keys, *order)
            .sortWithinPartitions(*self.keys, *order)
            .write.mode("append")
            .partitionBy(WRITE, *self.keys)
            .parquet(f"{self.root}/{table}")
        )

    def write_keys(self, write: str, keys: DataFrame) -> None:
        keys.withColumn(WRITE, F.lit(write)).write.mode("append").partitionBy(WRITE).parquet(f"{self.root}/{KEYS}")

    def take_number(self, number: int, write: str, streams: dict[str, int]) -> bool:
        """Make a write visible as commit ``number``; false if that number is taken."""
        entry = json.dumps({"number": number, "write": write, "at": time.time_ns() // 1_000_000, "streams": streams})
        draft = f"{self.root}/{LOG}/.{write}.draft"
        self.files.remove(draft)
        self.files.put(draft, entry)
        return self.files.rename_new(draft, f"{self.root}/{LOG}/{number:020d}.json")

    def commit(
        self, tables: dict[str, DataFrame], keys: DataFrame, base: Version, epoch: tuple[str, int] | None = None
    ) -> Version:
        """Replace the rows of ``keys`` in ``tables`` by those given.

        The rows were computed at ``base``. Raises ``Conflict`` if a later commit
        has replaced one of the keys; what was written is then never seen and
        left to ``sweep``. With an ``epoch`` (a stream's name and number) that the
        log has already, nothing is done.
        """
        if epoch and base.streams.get(epoch[0], -1) >= epoch[1]:
            return base
        write = uuid.uuid4().hex
        keys = keys.select(*self.keys).distinct()
        for name, rows in tables.items():
            self.write_rows(write, name, rows)
        self.write_keys(write, keys)
        seen = base
        while True:
            now = self.version()
            if now.number > seen.number:
                if epoch and now.streams.get(epoch[0], -1) >= epoch[1]:
                    return now
                since = self._replaced(Version(now.number, tuple(w for w in now.writes if w[0] > base.number)))
                if since is not None and not since.join(keys, self.keys, "left_semi").isEmpty():
                    raise Conflict(f"{self.root}: replaced since commit {base.number}")
                seen = now
            streams = now.streams | ({epoch[0]: epoch[1]} if epoch else {})
            if self.take_number(now.number + 1, write, streams):
                return self.version()

    def update(
        self,
        build: Callable[[Version], tuple[dict[str, DataFrame], DataFrame]],
        epoch: tuple[str, int] | None = None,
        tries: int = 8,
    ) -> Version:
        """Commit what ``build`` makes of a version (tables and keys), again on the next one after a conflict."""
        for left in reversed(range(tries)):
            base = self.version()
            if epoch and base.streams.get(epoch[0], -1) >= epoch[1]:
                return base
            try:
                return self.commit(*build(base), base, epoch)
            except Conflict:
                if not left:
                    raise
        raise AssertionError

    def sweep(self, lease_seconds: float = 24 * 3600.0) -> list[str]:
        """Remove what no reader may need: writes all of whose keys were replaced, and
        writes that never became visible, both longer than the lease ago. A reader
        that began within the lease loses nothing. Writes of which less than half
        of the keys are left are first written anew, so that old rows never hold
        more than twice the place. Returns the removed writes.
        """
        version = self.version()
        replaced = self._replaced(version)
        names = [n for n, _ in self.files.children(self.root) if n not in (LOG,)]
        if replaced is not None:
            w = Window.partitionBy(*self.keys).orderBy("number")
            ended = replaced.withColumn("ended", F.lead("at").over(w))
            parts = ended.groupBy(WRITE).agg(F.count("*").alias("n"), F.count("ended").alias("over")).where("over > 0 and over < n and 2 * over > n")
            thin = [r[WRITE] for r in parts.collect()]  # a row for each commit at most
            if thin:
                self._move(thin, [n for n in names if n != KEYS])
                version = self.version()
                ended = self._replaced(version).withColumn("ended", F.lead("at").over(w))
            over = ended.groupBy(WRITE).agg(F.count_if(F.col("ended").isNull()).alias("live"), F.max("ended").alias("ended"))
            dead = {r[WRITE]: r["ended"] for r in over.where("live = 0").collect()}
        else:
            dead = {}
        limit = time.time_ns() // 1_000_000 - int(lease_seconds * 1000)
        known = {w for _, w, _ in version.writes}
        gone = {w for w, at in dead.items() if at <= limit}
        for name in names:
            for folder, changed in self.files.children(f"{self.root}/{name}"):
                write = folder.removeprefix(f"{WRITE}=")
                if folder.startswith(f"{WRITE}=") and write not in known and changed <= limit:
                    gone.add(write)
        numbers = {w: n for n, w, _ in version.writes}
        for write in sorted(gone):
            if write in numbers and numbers[write] != version.number:  # first out of the log, then its files
                self.files.remove(f"{self.root}/{LOG}/{numbers[write]:020d}.json")
            for name in names:
                self.files.remove(f"{self.root}/{name}/{WRITE}={write}")
        return sorted(gone)

    def _move(self, writes: list[str], names: list[str]) -> None:
        """Write what is left of some writes anew, as a commit."""

        def build(base: Version) -> tuple[dict[str, DataFrame], DataFrame]:
            keys = self.live(base).where(F.col(WRITE).isin(writes))
            tables = {}
            for n in names:
                found = self.spark.read.parquet(f"{self.root}/{n}").schema  # keys are text, whatever they look like
                text = [StructField(f.name, StringType()) if f.name in (WRITE, *self.keys) else f for f in found]
                rows = self.spark.read.schema(StructType(text)).parquet(f"{self.root}/{n}")
                tables[n] = rows.join(keys, [WRITE, *self.keys], "left_semi").drop(WRITE)
            return tables, keys

        self.update(build)

"""A table kept as a log of versions: base and delta files, a manifest per version, commit by one rename.

A version's manifest names the files that make it up: one base and the deltas after it, oldest first. Data is written under a name of
its own and counts for nothing until the manifest has been renamed into the log, which fails if the version is taken. So a crash
before the rename leaves the last version as it was, two writers cannot both make the same version, and a step that is run again finds
its version there and does nothing. Versions never change, so any of them can be read; a rollback is a new version with an old
one's files. Reading opens only the files that the manifest names.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillgraph.session import remove

#: Of a delta's rows: the row's key is gone.
GONE = "__gone"


@dataclass(frozen=True)
class Version:
    """What makes up a version: base and deltas are folders, oldest delta first; meta is the caller's."""

    number: int
    base: str
    deltas: tuple[str, ...] = ()
    meta: dict = field(default_factory=dict)
    created_at: str = ""


class Versions:
    """The log in a folder that driver and executors share. key: the columns that name a row.

    On the driver are manifests only: one small file per version, of which a read opens one.
    """

    def __init__(self, spark: SparkSession, folder: str, key: list[str], compact_after: int = 8):
        self.spark, self.folder, self.key, self.compact_after = spark, folder.rstrip("/"), key, compact_after
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(f"{self.folder}/log").toUri(), spark._jsc.hadoopConfiguration())

    # ---- the log

    def numbers(self) -> list[int]:
        """The versions that are there."""
        log = self._path(f"{self.folder}/log")
        if not self._context.util().exists(log):
            return []
        return sorted(int(f.getPath().getName()[:-5]) for f in self._context.util().listStatus(log) if f.getPath().getName().endswith(".json"))

    def version(self, number: int | None = None) -> Version:
        """A version's manifest; the newest without a number."""
        there = self.numbers()
        if number is None and there:
            number = there[-1]
        if number not in there:
            raise LookupError(f"no version {number} in {self.folder}")
        text = self.spark.read.text(self._file(number), wholetext=True).first()[0]
        x = json.loads(text)
        return Version(x["number"], x["base"], tuple(x["deltas"]), x["meta"], x["created_at"])

    def history(self) -> DataFrame:
        """number, created_at, deltas, meta (JSON) of every version."""
        rows = self.spark.read.text(f"{self.folder}/log/*.json", wholetext=True)
        get = lambda p: F.get_json_object("value", p)
        return rows.select(get("$.number").cast("long").alias("number"), get("$.created_at").alias("created_at"), F.size(F.from_json(get("$.deltas"), "array<string>")).alias("deltas"), get("$.meta").alias("meta"))

    def _file(self, number: int) -> str:
        return f"{self.folder}/log/{number:012d}.json"

    def _data(self) -> str:
        return f"{self.folder}/data/{uuid.uuid4().hex}"

    def _commit(self, version: Version) -> bool:
        """Publish a version; False if its number is taken."""
        jvm, text = self.spark._jvm, json.dumps(asdict(version), sort_keys=True)
        waiting, final = self._path(f"{self.folder}/log/.{uuid.uuid4().hex}"), self._path(self._file(version.number))
        flags, parents = jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE), jvm.org.apache.hadoop.fs.Options.CreateOpts.createParent()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.CreateOpts, 1)
        options[0] = parents
        out = self._context.create(waiting, flags, options)
        out.write(text.encode())
        out.close()
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._context.rename(waiting, final, none)
        except Exception as e:  # the JVM's; only "it is there" is expected
            if not self._context.util().exists(final):
                raise
            self._context.delete(waiting, False)
            if "FileAlreadyExists" not in str(e):
                raise
            return False
        return True

    # ---- writing

    def _add(self, rows: DataFrame, number: int, base: str | None, deltas: tuple[str, ...], meta: dict) -> bool:
        if number in self.numbers():
            return False
        data = self._data()
        rows.write.parquet(data)
        now = self.spark.sql("select cast(current_timestamp() as string)").first()[0]
        made = Version(number, base or data, (*deltas, data) if base else (), meta, now)
        if self._commit(made):
            return True
        remove(self.spark, data)
        return False

    def write(self, rows: DataFrame, number: int | None = None, **meta: object) -> bool:
        """A version whose rows are these; False, and nothing written, if its number is taken. Without a number: the next."""
        return self._add(rows, self._next(number), None, (), meta)

    def change(self, rows: DataFrame, number: int | None = None, **meta: object) -> bool:
        """A version in which these rows take the place of those of their key; where column __gone is true, the key's row goes.

        Beyond `compact_after` deltas the version is written whole, so a read never merges more.
        """
        rows = rows if GONE in rows.columns else rows.withColumn(GONE, F.lit(False))
        last = self.version()
        number = self._next(number)
        if len(last.deltas) >= self.compact_after:
            return self._add(self._merged(self._files(last), rows), number, None, (), meta)
        return self._add(rows, number, last.base, last.deltas, meta)

    def compact(self, **meta: object) -> bool:
        """A version with the newest rows in one base."""
        return self.write(self.read(), **meta)

    def rollback(self, number: int, **meta: object) -> bool:
        """A version with the files of an old one: no data is read or written. The state before stays, under the number in meta `before`."""
        old, last = self.version(number), self.version()
        return self._commit(Version(last.number + 1, old.base, old.deltas, {"rollback_to": number, "before": last.number, **meta}, self.spark.sql("select cast(current_timestamp() as string)").first()[0]))

    def restore(self, number: int, keys: DataFrame, **meta: object) -> bool:
        """A version in which the listed keys are as in an old one: their rows then, or gone if they were not there."""
        keys = keys.select(*self.key).distinct()
        then = keys.join(self.read(number).withColumn("__had", F.lit(True)), self.key, "left")
        return self.change(then.withColumn(GONE, F.col("__had").isNull()).drop("__had"), rollback_to=number, **meta)

    def vacuum(self, keep: int) -> int:
        """Forget all but the newest `keep` versions and delete the data that none of these names, half-written data too; how many folders went.

        Not while a writer is at work: what it has written is not named yet.
        """
        numbers = self.numbers()
        named = {p for n in numbers[-keep:] for v in [self.version(n)] for p in (v.base, *v.deltas)}
        for n in numbers[:-keep]:
            self._context.delete(self._path(self._file(n)), False)
        data = self._path(f"{self.folder}/data")
        there = [f"{self.folder}/data/{f.getPath().getName()}" for f in self._context.util().listStatus(data)]
        gone = [p for p in there if p not in named]
        remove(self.spark, *gone)
        return len(gone)

    def _next(self, number: int | None) -> int:
        there = self.numbers()
        return (there[-1] + 1 if there else 1) if number is None else number

    # ---- reading

    def _merged(self, rows: DataFrame, change: DataFrame) -> DataFrame:
        left = rows.join(change.select(*self.key), self.key, "left_anti")
        return left.unionByName(change.filter(~F.col(GONE)).select(*rows.columns))

    def _files(self, v: Version) -> DataFrame:
        base = self.spark.read.parquet(v.base)
        if not v.deltas:
            return base
        # the newest row of each key among the deltas, which are small, then one anti-join with the base
        parts = [self.spark.read.parquet(p).withColumn("__at", F.lit(i)) for i, p in enumerate(v.deltas)]
        all_ = parts[0]
        for p in parts[1:]:
            all_ = all_.unionByName(p)
        columns = [c for c in all_.columns if c not in (*self.key, "__at")]
        newest = all_.groupBy(*self.key).agg(F.max_by(F.struct(*columns), "__at").alias("__row")).select(*self.key, "__row.*")
        return self._merged(base, newest)

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version; of the newest without a number."""
        return self._files(self.version(number))

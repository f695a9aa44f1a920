"""Versions of tables on shared storage: save, list, load, compare, roll back; transactions over a graph; files by name."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.diff import snapshot_diff

NAME = re.compile(r"[A-Za-z0-9_.-]+")


def files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """Rows (path, length, modified) of the files below ``folder``, at any depth, whose names fit; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return found.select("path", "length", F.col("modificationTime").alias("modified"))


class SnapshotStore:
    """Parquet snapshots of tables under ``root``, one folder per session, label and table.

    A snapshot counts once its marker is written, after all of its tables; one
    that was cut off is not listed and is written anew by the next ``save``.
    """

    def __init__(self, spark: SparkSession, root: str):
        self._spark, self._root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path(self._root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _at(self, session: str, label: str) -> str:
        for name in (session, label):
            if not NAME.fullmatch(name) or name in (".", ".."):
                raise ValueError(f"not a name: {name!r}")
        return f"{self._root}/session={session}/label={label}"

    def save(self, session: str, label: str, tables: dict[str, DataFrame]) -> None:
        """Write the tables as a snapshot; a label is written once."""
        at = self._at(session, label)
        if self.has(session, label):
            raise ValueError(f"{session} has a snapshot {label} already")
        self._fs.delete(self._path(at), True)
        for name, df in tables.items():
            if not NAME.fullmatch(name):
                raise ValueError(f"not a name: {name!r}")
            df.write.parquet(f"{at}/{name}")
        self._fs.create(self._path(f"{at}/_DONE-{time.time_ns()}")).close()

    def _marker(self, session: str, label: str) -> str | None:
        found = self._fs.globStatus(self._path(f"{self._at(session, label)}/_DONE-*"))
        return found[0].getPath().getName() if found else None

    def has(self, session: str, label: str) -> bool:
        return self._marker(session, label) is not None

    def labels(self, session: str) -> list[str]:
        """Labels of a session's snapshots, oldest first."""
        folder = self._path(self._at(session, "x")).getParent()
        names = [s.getPath().getName().removeprefix("label=") for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        done = [(int(m.removeprefix("_DONE-")), n) for n in names if (m := self._marker(session, n))]
        return [n for _, n in sorted(done)]

    def load(self, session: str, label: str | None = None) -> dict[str, DataFrame]:
        """The tables of a snapshot, the newest without a label."""
        label = label or (self.labels(session) or [None])[-1]
        if label is None or not self.has(session, label):
            raise KeyError(f"{session} has no snapshot {label}")
        at = self._at(session, label)
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(at)) if s.isDirectory()]
        return {n: self._spark.read.parquet(f"{at}/{n}") for n in sorted(names)}

    def delete(self, session: str, label: str) -> bool:
        return self._fs.delete(self._path(self._at(session, label)), True)

    def diff(self, session: str, before: str, after: str, table: str, id: str, value: str) -> DataFrame:
        """Rows (id, change) of a table between two snapshots, by a hash or other value."""
        return snapshot_diff(self.load(session, before)[table], self.load(session, after)[table], id, value)


@dataclass
class Transaction:
    """Named tables that change together: edits apply to copies, ``commit`` saves them, ``rollback`` drops them.

    Observers are told of each edit, commit and rollback; one that fails does not stop the others.
    """

    store: SnapshotStore
    session: str
    tables: dict[str, DataFrame]
    observers: list[Callable[[str, str], None]] = field(default_factory=list)
    revision: int = 0

    def __post_init__(self) -> None:
        self._kept = dict(self.tables)

    def _tell(self, event: str, name: str) -> None:
        for observer in self.observers:
            try:
                observer(event, name)
            except Exception:  # noqa: BLE001, S110  an observer must not stop an edit
                pass

    def edit(self, name: str, change: Callable[[DataFrame], DataFrame]) -> Transaction:
        self.tables[name] = change(self.tables[name])
        self._tell("edit", name)
        return self

    def commit(self) -> str:
        """Save a snapshot of all tables and go on from it; returns its label."""
        done = [int(n[1:]) for n in self.store.labels(self.session) if re.fullmatch("r[0-9]+", n)]
        self.revision = max([self.revision, *done]) + 1
        label = f"r{self.revision}"
        self.store.save(self.session, label, self.tables)
        self.tables = self.store.load(self.session, label)
        self._kept = dict(self.tables)
        self._tell("commit", label)
        return label

    def rollback(self, label: str | None = None) -> Transaction:
        """Back to a snapshot, or to the tables before the edits."""
        self.tables = self.store.load(self.session, label) if label else dict(self._kept)
        self._tell("rollback", label or "")
        return self


class CostRegistry:
    """Cost columns by pass name: what a unit of work weighs, 1 where nothing is registered."""

    def __init__(self):
        self._held: dict[str, Callable[[], Column]] = {}

    def register(self, name: str, cost: Callable[[], Column]) -> CostRegistry:
        self._held[name] = cost
        return self

    def weighed(self, work: DataFrame, name: str = "pass") -> DataFrame:
        """``work`` with ``weight`` by the cost of its pass; costs below 0 count as 0."""
        weight = F.lit(1.0)
        for key, cost in self._held.items():
            weight = F.when(F.col(name) == key, F.greatest(cost().cast("double"), F.lit(0.0))).otherwise(weight)
        return work.withColumn("weight", weight)

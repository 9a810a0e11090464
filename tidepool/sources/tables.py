"""Parquet tables of which single partitions are replaced, and versions of small tables.

New partitions are written beside the table, marked as complete, and then moved in one by one. A run that breaks off
before the mark leaves the table as it was; one that breaks off after it is completed by the next run (`recover`), as
every move can be done again. Readers never see staged files; while the moves go on they may see some partitions new
and others old.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

_STAGED, _MARK = "_staged-", "_complete"


class Folder:
    """A folder in whatever store its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.path = path.rstrip("/")
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(name))) if self.exists(name) else []

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def move(self, name: str, to: str) -> None:
        self._fs.mkdirs(self._at(to).getParent())
        if not self._fs.rename(self._at(name), self._at(to)):
            raise OSError(f"{self.path}/{name} could not be moved to {to}")

    def mark(self, name: str) -> None:
        self._fs.create(self._at(name), True).close()


def _partitions(folder: Folder, under: str, depth: int) -> list[str]:
    """Partition folders below, as paths from `under`."""
    out = [""]
    for _ in range(depth):
        out = [f"{a}/{n}".lstrip("/") for a in out for n in folder.names(f"{under}/{a}".rstrip("/")) if "=" in n]
    return out


def _move_in(folder: Folder, staged: str, depth: int) -> None:
    for part in _partitions(folder, staged, depth):
        folder.delete(part)
        folder.move(f"{staged}/{part}", part)
    folder.delete(staged)


def recover(spark: SparkSession, path: str, by: Sequence[str]) -> None:
    """Completes what a run that broke off had written whole, and deletes what it had not."""
    folder = Folder(spark, path)
    for name in folder.names():
        if name.startswith(_STAGED):
            if folder.exists(f"{name}/{_MARK}"):
                _move_in(folder, name, len(by))
            else:
                folder.delete(name)


def replace(rows: DataFrame, path: str, by: Sequence[str]) -> None:
    """Puts the rows in the place of all partitions (by the columns `by`) that they have rows of; others stay. The rows
    may be read from the table itself."""
    recover(rows.sparkSession, path, by)
    folder, staged = Folder(rows.sparkSession, path), f"{_STAGED}{uuid.uuid4().hex}"
    rows.write.partitionBy(*by).parquet(f"{path.rstrip('/')}/{staged}")
    folder.mark(f"{staged}/{_MARK}")
    _move_in(folder, staged, len(by))


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The table, or None if nothing was written yet."""
    folder = Folder(spark, path)
    if not any("=" in n for n in folder.names()):
        return None
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def store(rows: DataFrame, path: str, version: int, keep: int = 2) -> None:
    """Writes a whole table as a version, a number that grows; the newest `keep` stay."""
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/version={version}")
    folder = Folder(rows.sparkSession, path)
    for old in _versions(folder)[:-keep]:
        folder.delete(f"version={old}")


def _versions(folder: Folder) -> list[int]:
    return sorted(int(n.split("=")[1]) for n in folder.names() if n.startswith("version=") and folder.exists(f"{n}/_SUCCESS"))


def newest(spark: SparkSession, path: str) -> tuple[DataFrame, int] | None:
    """The newest version that was written whole, with its number."""
    found = _versions(Folder(spark, path))
    return (spark.read.parquet(f"{path.rstrip('/')}/version={found[-1]}"), found[-1]) if found else None

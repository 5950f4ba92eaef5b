"""One repository, two stores: tables kept as files, or in the session only, as for tests and offline work.

Operators see tables by name and never where they are kept. A file table is a folder of versions; a write makes a new version and then
a pointer to it, so a reader sees the old rows or the new ones, and a write that fails leaves the old. The version before stays until the next
write, for those who still read it.
"""

from __future__ import annotations

import json
import uuid
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from furrow.session import ensure_checkpoint_dir
from furrow.sources import files, sinks


class Store(Protocol):
    """What a repository needs of a place for tables."""

    def read(self, name: str) -> DataFrame | None:
        """The table's rows, none if there is no such table."""

    def replace(self, name: str, rows: DataFrame) -> None:
        """The table's rows from now on."""

    def names(self) -> list[str]:
        """The tables that there are."""


class VolatileStore:
    """Tables of this session; each write is checkpointed, so a chain of writes doesn't grow a plan. Nothing outlives the session."""

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self.tables: dict[str, DataFrame] = {}

    def read(self, name: str) -> DataFrame | None:
        return self.tables.get(name)

    def replace(self, name: str, rows: DataFrame) -> None:
        self.tables[name] = rows.checkpoint()

    def names(self) -> list[str]:
        return sorted(self.tables)


class FileStore:
    """Tables as Parquet versions under a folder that all machines share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _pointer(self, name: str) -> dict | None:
        path = f"{self.folder}/{name}/current.json"
        return json.loads(files.ranges(path)(0, 1 << 20)) if files.exists(path) else None

    def read(self, name: str) -> DataFrame | None:
        at = self._pointer(name)
        return None if at is None else self.spark.read.schema(StructType.fromJson(at["schema"])).parquet(f"{self.folder}/{name}/{at['version']}")

    def replace(self, name: str, rows: DataFrame) -> None:
        before, version = self._pointer(name), uuid.uuid4().hex
        rows.write.parquet(f"{self.folder}/{name}/{version}")
        system, top = files.opened(f"{self.folder}/{name}")
        with system.open_output_stream(f"{top}/{version}.json") as f:
            f.write(json.dumps({"version": version, "schema": rows.schema.jsonValue(), "previous": before["version"] if before else None}).encode())
        system.move(f"{top}/{version}.json", f"{top}/current.json")
        if before and before["previous"]:
            system.delete_dir(f"{top}/{before['previous']}")

    def names(self) -> list[str]:
        return sorted({path.split("/")[-2] for path, _ in files.listed(self.folder, "current.json")})


class Repository:
    """Reads and writes of tables by name, the same over every store.

    A table has a key; a row is owned by the user in its column `user_id`, if the repository is one user's. Writes return the rows that were
    written. One writer at a time is assumed for a table.
    """

    def __init__(self, store: Store, keys: dict[str, str], user_id: object = None):
        self.store, self.keys, self.user_id = store, keys, user_id

    def _own(self, rows: DataFrame) -> DataFrame:
        return rows if self.user_id is None or "user_id" not in rows.columns else rows.filter(F.col("user_id") == F.lit(self.user_id))

    def rows(self, name: str, where: Column | None = None) -> DataFrame:
        """The user's rows of a table; an error if there is no such table."""
        found = self.store.read(name)
        if found is None:
            raise KeyError(name)
        own = self._own(found)
        return own if where is None else own.filter(where)

    def row(self, name: str, key: object) -> DataFrame:
        """The row of a key, as a table of one row or none."""
        return self.rows(name, F.col(self.keys[name]) == F.lit(key)).limit(1)

    def insert(self, name: str, fresh: DataFrame) -> DataFrame:
        """Add rows; columns that the table lacks aren't written, those that the rows lack are null. A key that is there already is an error."""
        now, key = self.store.read(name), self.keys[name]
        if now is None:
            self.store.replace(name, fresh)
            return fresh
        clash = fresh.select(key).join(now.select(key), key, "left_semi").limit(1).collect()
        if clash or fresh.groupBy(key).count().filter("count > 1").limit(1).collect():
            raise ValueError(f"{name}: a key that is there already")
        self.store.replace(name, sinks.insert(now, fresh))
        return fresh.select(*[c for c in now.columns if c in fresh.columns])

    def update(self, name: str, changes: dict[str, Column], where: Column) -> DataFrame:
        """Set columns of the user's rows where a condition holds, also by what is in them now."""
        now = self.store.read(name)
        if now is None:
            raise KeyError(name)
        own = F.lit(True) if self.user_id is None or "user_id" not in now.columns else F.col("user_id") == F.lit(self.user_id)
        hit = F.coalesce(own & where, F.lit(False))
        kinds = {f.name: f.dataType for f in now.schema}
        changed = now.select(*[F.when(hit, changes[c]).otherwise(F.col(c)).cast(kinds[c]).alias(c) if c in changes else F.col(c) for c in now.columns])
        keys = [r[0] for r in now.filter(hit).select(self.keys[name]).limit(1).collect()]
        if keys:
            self.store.replace(name, changed)
        return self.rows(name, where) if not keys else self._own(changed.join(now.filter(hit).select(self.keys[name]), self.keys[name], "left_semi"))

    def delete(self, name: str, where: Column) -> None:
        """Take away the user's rows where a condition holds."""
        now = self.store.read(name)
        if now is None:
            raise KeyError(name)
        gone = self._own(now).filter(where).select(self.keys[name])
        self.store.replace(name, sinks.delete_by_key(now, gone, self.keys[name]))

    def set_json_key(self, name: str, key: object, column: str, field: str, value: Column) -> DataFrame:
        """Read, merge and write one key of a row's JSON column; the others stay."""
        return self.update(name, {column: sinks.set_json_key(F.col(column), field, value)}, F.col(self.keys[name]) == F.lit(key))

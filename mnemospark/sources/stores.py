"""The memory store in exchange formats: JSON folders, SQLite files, cold storage.

JSON is written in parallel as lines.  A SQLite file has one writer by nature: rows
come to it one partition at a time, never all at once, and are read back in slices of
row numbers by many tasks, which needs the file in a folder that executors share.
"""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark import store

#: Rows that are held at once on their way into a SQLite file.
ROWS_AT_ONCE = 10_000


class JsonStore:
    """Named tables as folders of JSON lines; a folder is written beside the old one and then takes its place."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def save(self, tables: dict[str, DataFrame]) -> None:
        for name, df in tables.items():
            hidden = f"{self.root}/.{name}.new"
            df.write.mode("overwrite").option("ignoreNullFields", "false").json(hidden)
            store.write_text(self.spark, f"{self.root}/{name}.schema", df.schema.json())
            store.replace(self.spark, hidden, f"{self.root}/{name}")

    def exists(self, name: str) -> bool:
        return f"{name}.schema" in store.names(self.spark, self.root)

    def load(self, name: str) -> DataFrame:
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(json.loads(store.read_text(self.spark, f"{self.root}/{name}.schema")))
        return self.spark.read.schema(schema).json(f"{self.root}/{name}")


def _sql_type(kind: str) -> str:
    return {"bigint": "INTEGER", "int": "INTEGER", "boolean": "INTEGER", "double": "REAL", "float": "REAL", "binary": "BLOB"}.get(kind, "TEXT")


class SqliteStore:
    """Named tables in one SQLite file: whole saves, upserts and deletions by key, parallel reads.

    Arrays, maps and structs are kept as JSON text.  The file is a path of the local
    file system that executors share; it is opened in write-ahead mode.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, str(Path(path))

    def _open(self) -> sqlite3.Connection:
        c = sqlite3.connect(self.path)
        c.execute("PRAGMA journal_mode=WAL")
        c.execute("CREATE TABLE IF NOT EXISTS _tables (name TEXT PRIMARY KEY, schema TEXT, key TEXT)")
        return c

    @staticmethod
    def _flat(df: DataFrame) -> DataFrame:
        nested = ("array", "map", "struct")
        return df.select(*[(F.to_json(F.col(f"`{c}`")) if t.startswith(nested) else F.col(f"`{c}`").cast("string") if t.startswith(("timestamp", "date", "decimal")) else F.col(f"`{c}`")).alias(c) for c, t in df.dtypes])

    def _put(self, c: sqlite3.Connection, name: str, df: DataFrame, verb: str) -> None:
        flat = self._flat(df)
        marks = ", ".join("?" * len(flat.columns))
        rows: list[tuple] = []
        for row in flat.toLocalIterator():
            rows.append(tuple(bytes(v) if isinstance(v, bytearray) else v for v in row))
            if len(rows) >= ROWS_AT_ONCE:
                c.executemany(f'{verb} INTO "{name}" VALUES ({marks})', rows)
                rows = []
        c.executemany(f'{verb} INTO "{name}" VALUES ({marks})', rows)

    def save(self, name: str, df: DataFrame, key: str | None = None) -> None:
        """Replaces a table, in one transaction; with a ``key``, which must be unique, rows can be put and deleted later."""
        columns = ", ".join(f'"{c}" {_sql_type(t)}' + (" PRIMARY KEY" if c == key else "") for c, t in df.dtypes)
        with self._open() as c:
            c.execute(f'DROP TABLE IF EXISTS "{name}"')
            c.execute(f'CREATE TABLE "{name}" ({columns})')
            c.execute("INSERT OR REPLACE INTO _tables VALUES (?, ?, ?)", (name, df.schema.json(), key))
            self._put(c, name, df, "INSERT")
        c.close()

    def put(self, name: str, df: DataFrame) -> None:
        """Inserts rows, in place of those of the same key."""
        with self._open() as c:
            self._put(c, name, df, "INSERT OR REPLACE")
        c.close()

    def delete(self, name: str, keys: DataFrame) -> None:
        """Deletes the rows of the keys in the first column."""
        with self._open() as c:
            (key,) = c.execute("SELECT key FROM _tables WHERE name = ?", (name,)).fetchone()
            for row in keys.toLocalIterator():
                c.execute(f'DELETE FROM "{name}" WHERE "{key}" = ?', (row[0],))
        c.close()

    def exists(self, name: str) -> bool:
        c = self._open()
        found = c.execute("SELECT 1 FROM _tables WHERE name = ?", (name,)).fetchone()
        c.close()
        return found is not None

    def load(self, name: str, rows: int = 100_000) -> DataFrame:
        """A table, read in slices of row numbers, one task for each."""
        from pyspark.sql.types import StructType

        c = self._open()
        (schema,) = c.execute("SELECT schema FROM _tables WHERE name = ?", (name,)).fetchone()
        (last,) = c.execute(f'SELECT coalesce(max(rowid), 0) FROM "{name}"').fetchone()
        c.close()
        want = StructType.fromJson(json.loads(schema))
        flat = ", ".join(f"`{f.name}` {_flat_type(f.dataType.simpleString())}" for f in want)
        path, columns = self.path, [f.name for f in want]

        def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                own = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
                for start in batch.id:
                    found = own.execute(f'SELECT * FROM "{name}" WHERE rowid > ? AND rowid <= ?', (int(start), int(start) + rows)).fetchall()
                    yield pd.DataFrame(found, columns=columns, dtype=object)
                own.close()

        slices = self.spark.range(0, max(1, last), rows, max(1, -(-last // rows)))
        raw = slices.mapInPandas(read, flat)
        back = lambda f: F.from_json(f"`{f.name}`", f.dataType) if f.dataType.simpleString().startswith(("array", "map", "struct")) else F.col(f"`{f.name}`").cast(f.dataType)
        return raw.select(*[back(f).alias(f.name) for f in want])


def _flat_type(kind: str) -> str:
    if kind in ("bigint", "int", "boolean", "double", "float", "binary"):
        return "bigint" if kind in ("int", "boolean") else kind
    return "string"


class ColdStore:
    """Rows moved out of a table to a folder of their own, in numbered parts, until they are wanted again."""

    def __init__(self, spark: SparkSession, root: str, key: str = "id") -> None:
        self.spark, self.root, self.key = spark, root.rstrip("/"), key

    def parts(self) -> list[int]:
        return sorted(int(n.removeprefix("part=")) for n in store.names(self.spark, self.root) if n.startswith("part="))

    def offload(self, df: DataFrame, cold: Column) -> DataFrame:
        """Writes the cold rows as the next part and returns the others; nulls of the condition stay."""
        n = (self.parts() or [0])[-1] + 1
        is_cold = F.coalesce(cold, F.lit(False))
        df.filter(is_cold).write.mode("overwrite").parquet(f"{self.root}/part={n}")
        return df.filter(~is_cold)

    def load(self) -> DataFrame | None:
        """All rows in cold storage; of a key the row of the latest part."""
        parts = self.parts()
        if not parts:
            return None
        rows = None
        for n in parts:
            own = self.spark.read.parquet(f"{self.root}/part={n}").withColumn("_part", F.lit(n))
            rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
        last = rows.groupBy(self.key).agg(F.max("_part").alias("_part"))
        return rows.join(last, [self.key, "_part"], "left_semi").drop("_part")

    def thaw(self, keys: DataFrame) -> DataFrame | None:
        """The rows of the keys; they stay in cold storage until it is compacted without them."""
        rows = self.load()
        return rows if rows is None else rows.join(keys.select(self.key).distinct(), self.key, "left_semi")

    def compact(self, without: DataFrame | None = None) -> None:
        """All parts as one, without the given keys."""
        rows, old = self.load(), self.parts()
        if rows is None:
            return
        kept = rows if without is None else rows.join(without.select(self.key).distinct(), self.key, "left_anti")
        kept.write.mode("overwrite").parquet(f"{self.root}/part={old[-1] + 1}")
        for n in old:
            store.delete(self.spark, f"{self.root}/part={n}")

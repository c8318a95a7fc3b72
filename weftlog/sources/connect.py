"""Connecting to data sources: their tables, columns, keys and first rows."""

from __future__ import annotations

import sqlite3
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a preview.
PREVIEW = 50


@dataclass
class Table:
    name: str
    columns: list[tuple[str, str]]
    primary_key: list[str] = field(default_factory=list)
    #: (column, other table, other column)
    foreign_keys: list[tuple[str, str, str]] = field(default_factory=list)
    preview: list[dict[str, str | None]] = field(default_factory=list)


@dataclass
class Source:
    """A connected source: its tables, and a lazy reader of each."""

    kind: str
    tables: dict[str, Table]
    frames: dict[str, DataFrame]


def preview(df: DataFrame, n: int = PREVIEW) -> list[dict[str, str | None]]:
    """The first rows as texts."""
    return [r.asDict() for r in df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns]).limit(n).collect()]


def connect(spark: SparkSession, said: dict) -> Source:
    """type: csv or parquet (path: a file or folder of files), sqlite (path), mysql or postgresql (url, tables, options,
    through a JDBC driver on the class path)."""
    kind = said["type"]
    if kind in ("csv", "parquet"):
        path = spark._jvm.org.apache.hadoop.fs.Path(said["path"])
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        ending = f".{kind}"
        found = [str(x.getPath()) for x in fs.listStatus(path)] if fs.getFileStatus(path).isDirectory() and not said["path"].endswith(ending) else [said["path"]]
        read = (lambda p: spark.read.csv(p, header=True)) if kind == "csv" else spark.read.parquet
        frames = {p.rstrip("/").rsplit("/", 1)[-1].removesuffix(ending): read(p) for p in sorted(found) if p.endswith(ending)}
        tables = {n: Table(n, list(df.dtypes)) for n, df in frames.items()}
    elif kind == "sqlite":
        tables, frames = _sqlite(spark, said["path"])
    elif kind in ("mysql", "postgresql"):
        frames = {t: spark.read.jdbc(said["url"], t, properties=said.get("options", {})) for t in said["tables"]}
        tables = {n: Table(n, list(df.dtypes)) for n, df in frames.items()}
    else:
        raise ValueError(f"unknown source {kind}")
    for n, df in frames.items():
        tables[n].preview = preview(df)
    return Source(kind, tables, frames)


def _sqlite(spark: SparkSession, path: str) -> tuple[dict[str, Table], dict[str, DataFrame]]:
    """Tables of a SQLite file, which one process can read; all values as texts."""
    db = sqlite3.connect(f"file:{Path(path)}?mode=ro", uri=True)
    try:
        quoted = lambda n: '"' + n.replace('"', '""') + '"'
        tables, frames = {}, {}
        for (name,) in db.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite_%' ORDER BY name").fetchall():
            columns = db.execute(f"PRAGMA table_info({quoted(name)})").fetchall()
            keys = [c[1] for c in sorted(columns, key=lambda c: c[5]) if c[5]]
            foreign = [(f[3], f[2], f[4]) for f in db.execute(f"PRAGMA foreign_key_list({quoted(name)})")]
            tables[name] = Table(name, [(c[1], c[2]) for c in columns], keys, foreign)
            rows = [tuple(None if x is None else str(x) for x in r) for r in db.execute(f"SELECT * FROM {quoted(name)}")]
            frames[name] = spark.createDataFrame(rows, ", ".join(f"`{c[1]}` string" for c in columns))
        return tables, frames
    finally:
        db.close()


def connect_all(spark: SparkSession, said: dict[str, dict]) -> dict[str, DataFrame]:
    """The tables of all sources as source.table, connected at once; the first failure is raised."""
    with ThreadPoolExecutor(max(1, len(said))) as pool:
        found = dict(zip(said, pool.map(lambda s: connect(spark, s), said.values()), strict=True))
    return {f"{n}.{t}": df for n, s in found.items() for t, df in s.frames.items()}

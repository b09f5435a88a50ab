"""Sinks: tables appear under their name only when they are whole."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def publish(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None, exclusive: bool = False) -> None:
    """Write beside ``path`` and rename; an older table there is set aside first, or refused if ``exclusive`` (the one writer that creates ``path.claim`` goes on)."""
    spark = df.sparkSession
    fs, target = _fs(spark, path)
    claim = _fs(spark, f"{path}.claim")[1]
    if exclusive:
        # of several writers one creates the claim; it stays beside the table
        if fs.exists(target):
            raise FileExistsError(path)
        try:
            fs.create(claim, False).close()
        except Py4JJavaError as e:
            raise FileExistsError(path) from e
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    writer = df.write.format(fmt)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(staging)
    if fs.exists(target):
        quarantine(spark, path)
    if not fs.rename(_fs(spark, staging)[1], target):
        raise OSError(f"could not rename {staging} to {path}")


def quarantine(spark: SparkSession, path: str) -> str:
    """Set an output aside under a name of its own; returns that name."""
    fs, p = _fs(spark, path)
    aside = f"{path}.stale-{uuid.uuid4().hex}"
    if not fs.rename(p, _fs(spark, aside)[1]):
        raise OSError(f"could not rename {path}")
    return aside


def canonical_rows(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows as JSON with sorted keys in a fixed order, for a line file that is the same in every run."""
    return df.orderBy(*order).select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_lines(df: DataFrame, path: str, order: list[str]) -> str:
    """One line file of canonical rows under ``path``, whole or not at all; returns its SHA-256. For tables that one task may write (a manifest)."""
    spark = df.sparkSession
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    canonical_rows(df, order).coalesce(1).write.text(staging)
    fs, folder = _fs(spark, staging)
    part = next(f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-"))
    target = _fs(spark, path)[1]
    if fs.exists(target):
        quarantine(spark, path)
    if not fs.rename(part, target):
        raise OSError(f"could not rename {part} to {path}")
    fs.delete(folder, True)
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]


def write_json(spark: SparkSession, value: dict, path: str, exclusive: bool = False) -> None:
    """A small JSON document (sorted keys) under ``path``, whole or not at all; refused if it exists and ``exclusive``."""
    fs, target = _fs(spark, path)
    staging = _fs(spark, f"{path}.staging-{uuid.uuid4().hex}")[1]
    stream = fs.create(staging, False)
    stream.write(bytearray(json.dumps(value, sort_keys=True, ensure_ascii=False, allow_nan=False, indent=2).encode()))
    stream.hsync()
    stream.close()
    if exclusive:
        try:
            fs.create(_fs(spark, f"{path}.claim")[1], False).close()
        except Py4JJavaError as e:
            fs.delete(staging, False)
            raise FileExistsError(path) from e
    if fs.exists(target):
        if exclusive:
            fs.delete(staging, False)
            raise FileExistsError(path)
        fs.delete(target, False)
    if not fs.rename(staging, target):
        raise OSError(f"could not rename to {path}")


def union_tables(tables: list[DataFrame]) -> DataFrame:
    """All rows over the sorted union of the tables' columns, null where a table has none."""
    if not tables:
        raise ValueError("there is no table")
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.select(*sorted(out.columns))


def allowed_columns(df: DataFrame, allow: list[str]) -> DataFrame:
    """Only the allowed columns, in the given order, those that exist."""
    return df.select(*(c for c in allow if c in df.columns))

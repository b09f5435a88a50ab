"""A capture study with a holdout that is opened once: coverage minimums, and a freeze that later audits are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normspark.operators.relations import ContractError, require_empty
from normspark.sources import sinks

# Least counts of a final audit.
MINIMUMS = {"n_normals": 20, "n_anomalies": 20, "n_sessions": 4, "n_cameras": 2, "n_lights": 2, "n_objects": 20}


def with_sessions(captures: DataFrame, sessions: DataFrame) -> DataFrame:
    """``captures`` with split, camera and light of their session; a session that isn't registered, or is twice, is a ContractError."""
    require_empty(sessions.groupBy("session_id").count().where("count > 1 OR session_id IS NULL"), "sessions are registered once")
    known = sessions.select("session_id", "split", "camera_id", "lighting_id")
    require_empty(captures.join(known, "session_id", "left_anti").select("capture_id", "session_id"), "captures of unknown sessions")
    return captures.join(known, "session_id")


def coverage(rows: DataFrame) -> DataFrame:
    """One row: counts of normals, anomalies, sessions, cameras, lights and objects."""
    return rows.agg(
        F.coalesce(F.sum((F.col("label") == "normal").cast("long")), F.lit(0)).alias("n_normals"),
        F.coalesce(F.sum((F.col("label") == "anomaly").cast("long")), F.lit(0)).alias("n_anomalies"),
        F.countDistinct("session_id").alias("n_sessions"),
        F.countDistinct("camera_id").alias("n_cameras"),
        F.countDistinct("lighting_id").alias("n_lights"),
        F.countDistinct("object_id").alias("n_objects"),
    )


def coverage_gaps(rows: DataFrame, minimums: dict[str, int] | None = None) -> DataFrame:
    """What an evaluation lacks: ``requirement, value, observed, needed``.

    The least counts, and both labels in each session, camera and light (``value`` names the one that lacks a label).
    """
    needed = MINIMUMS | (minimums or {})
    entries = F.array(*(F.struct(F.lit(k).alias("requirement"), F.lit(None).cast("string").alias("value"), F.col(k).alias("observed"), F.lit(n).cast("long").alias("needed")) for k, n in needed.items()))
    short = coverage(rows).select(F.explode(entries).alias("e")).select("e.*").where("observed < needed")
    dimensions = F.array(*(F.struct(F.lit(d).alias("requirement"), F.col(d).cast("string").alias("value")) for d in ("session_id", "camera_id", "lighting_id")))
    labels = rows.where("label IN ('normal', 'anomaly')").select("label", F.explode(dimensions).alias("e")).groupBy("e.requirement", "e.value").agg(F.countDistinct("label").alias("observed"))
    return short.unionByName(labels.where("observed < 2").select(F.concat(F.lit("both_labels_per_"), "requirement").alias("requirement"), "value", "observed", F.lit(2).cast("long").alias("needed")))


def digest_of(rows: DataFrame, order: list[str]) -> str:
    """One digest of a table's content: of the digests of its rows, whatever their order and partitioning.

    The rows' digests are summed by 32-bit pieces (with their number), so nothing is gathered. Rows may repeat.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(order)), {"ignoreNullFields": "false"}), 256)
    pieces = [F.sum(F.conv(F.substring(row, 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")).cast("string").alias(f"p{i}") for i in range(8)]
    total = rows.agg(F.count(F.lit(1)).cast("string").alias("n"), *pieces)
    return total.select(F.sha2(F.concat_ws(":", *(F.coalesce(c, F.lit("")) for c in total.columns)), 256).alias("d")).first().d


def freeze(spark: SparkSession, path: str, development: DataFrame, order: list[str], **tables: DataFrame) -> DataFrame:
    """Commit to the development captures and the registered ``tables`` (protocol, sessions): ``name, sha256`` under ``path``, once.

    Development needs captures of both labels. A study that is frozen can't be frozen again (FileExistsError).
    """
    if {r[0] for r in development.select("label").distinct().collect()} != {"normal", "anomaly"}:  # two labels, or the table is refused
        raise ContractError("development needs captures of both labels")
    rows = [("development", digest_of(development, order)), *((n, digest_of(t, t.columns)) for n, t in sorted(tables.items()))]
    sinks.publish(spark.createDataFrame(rows, "name string, sha256 string"), path, exclusive=True)
    return spark.read.parquet(path)


def changed_since(spark: SparkSession, path: str, development: DataFrame, order: list[str], **tables: DataFrame) -> list[str]:
    """The names whose content isn't what was frozen."""
    frozen = {r.name: r.sha256 for r in spark.read.parquet(path).collect()}  # a row a table
    now = {"development": digest_of(development, order)} | {n: digest_of(t, t.columns) for n, t in tables.items()}
    return sorted(n for n in frozen.keys() | now.keys() if frozen.get(n) != now.get(n))


def open_holdout(spark: SparkSession, path: str, evaluation: DataFrame, result: str, development: DataFrame, order: list[str], minimums: dict[str, int] | None = None, **tables: DataFrame) -> DataFrame:
    """The audited evaluation captures, published as ``result``, once: nothing may have changed since the freeze, and the coverage must be met."""
    if changed := changed_since(spark, path, development, order, **tables):
        raise ContractError(f"changed since the freeze: {changed}")
    require_empty(coverage_gaps(evaluation, minimums), "the evaluation lacks coverage")
    sinks.publish(evaluation, result, exclusive=True)
    return spark.read.parquet(result)

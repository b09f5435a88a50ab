"""Sources: trusted manifests, artifact CSV, provider split tables, runs and commits."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normspark.functions.predicates import safe_path
from normspark.operators.relations import ContractError, require_empty

MANIFEST = (
    "schema_version int, sample_id string, dataset_version string, category string, split string, source_split string, label string, image_path string, mask_path string, "
    "width int, height int, channels int, image_sha256 string, mask_sha256 string, mask_positive_pixels int, perceptual_hash string"
)
SPLIT_TABLE = "object string, split string, label string, image string, mask string"


def read_manifest(spark: SparkSession, path: str, digest: str | None = None) -> DataFrame:
    """A JSON Lines manifest with exactly the contract's fields; ``digest`` is the SHA-256 of the single file, if given.

    Raises ContractError for a wrong digest, unknown or missing fields, unsafe paths and repeated ids.
    """
    if digest is not None:
        files = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("d"))
        require_empty(files.where(F.col("d") != digest), "the manifest has another digest")
    found = set(spark.read.option("samplingRatio", 1.0).json(path).columns)
    wanted = [c.split()[0] for c in MANIFEST.split(", ")]
    if found != set(wanted):
        raise ContractError(f"manifest fields differ: {sorted(found ^ set(wanted))}")
    df = spark.read.schema(MANIFEST).option("mode", "FAILFAST").json(path)
    require_empty(df.where(~safe_path(F.col("image_path")) | (F.col("mask_path").isNotNull() & ~safe_path(F.col("mask_path")))).select("sample_id"), "unsafe paths")
    require_empty(df.groupBy("sample_id").count().where("count > 1"), "repeated sample ids")
    return df


def split_table_violations(rows: DataFrame, categories: list[str]) -> DataFrame:
    """``contract, n_rows`` of each broken contract of a provider split table; one pass over the rows."""
    bad = {
        "unknown_category": ~F.col("object").isin(categories),
        "unknown_split": ~F.col("split").isin("train", "test"),
        "unknown_label": ~F.col("label").isin("normal", "anomaly"),
        "unsafe_path": ~safe_path(F.col("image")),
        "path_not_in_category": ~F.col("image").startswith(F.concat("object", F.lit("/"))),
        "training_anomaly": (F.col("split") == "train") & (F.col("label") != "normal"),
        "mask_on_normal": (F.col("label") == "normal") & F.col("mask").isNotNull(),
        "anomaly_without_mask": (F.col("label") == "anomaly") & F.col("mask").isNull(),
    }
    flags = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in bad.items())))
    own = rows.select(F.explode(flags).alias("contract"))
    twice = rows.groupBy("image").count().where("count > 1").select(F.lit("repeated_image").alias("contract"))
    masks = rows.where("mask IS NOT NULL").groupBy("mask").count().where("count > 1").select(F.lit("repeated_mask").alias("contract"))
    return own.unionByName(twice).unionByName(masks).groupBy("contract").agg(F.count(F.lit(1)).alias("n_rows"))


def read_split_table(spark: SparkSession, path: str, categories: list[str]) -> DataFrame:
    """A provider split table (CSV with header) that keeps all contracts, else ContractError."""
    rows = spark.read.schema(SPLIT_TABLE).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    require_empty(split_table_violations(rows, categories), "split table")
    return rows


def read_artifact(spark: SparkSession, path: str, strings: list[str]) -> DataFrame:
    """An artifact CSV: the named columns stay strings, others become doubles where all their values are numbers; empty is null."""
    raw = spark.read.option("header", True).option("nullValue", "").csv(path)
    others = [c for c in raw.columns if c not in strings]
    if not others:
        return raw
    numeric = raw.agg(*(F.coalesce(F.bool_and(F.col(c).isNull() | F.expr(f"try_cast(`{c}` AS DOUBLE)").isNotNull()), F.lit(True)).alias(c) for c in others)).first()
    return raw.withColumns({c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in others if numeric[c]})


def latest_run(runs: DataFrame, mode: str = "full") -> DataFrame:
    """The run of greatest name among the complete ones of a mode (``name, status, mode``); no row if there is none."""
    return runs.where((F.col("status") == "complete") & (F.col("mode") == mode)).orderBy(F.desc("name")).limit(1)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, sha256`` of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def pending_units(units: DataFrame, commits: DataFrame, keys: list[str]) -> DataFrame:
    """Units of work that no commit holds yet."""
    return units.join(commits.select(*keys).distinct(), keys, "left_anti")


def broken_commits(commits: DataFrame, digests: DataFrame) -> DataFrame:
    """Commits (``path, sha256``) whose file is missing or has changed."""
    now = digests.select("path", F.col("sha256").alias("_now"))
    return commits.join(now, "path", "left").where("_now IS NULL OR _now <> sha256").drop("_now")


#: Rows of a study's table, at most.
MOST_CAPTURES = 500


def read_study_table(spark: SparkSession, path: str, fields: list[str], most: int = MOST_CAPTURES) -> DataFrame:
    """A hand-kept CSV with exactly the header ``fields``: trimmed strings, at most ``most`` rows, no row with missing or further values."""
    lines = [r.value for r in spark.read.text(path).coalesce(1).limit(most + 2).collect()]  # a table longer than that is refused
    rows = list(csv.reader([line.lstrip("\ufeff") if not i else line for i, line in enumerate(lines)]))
    if not rows or rows[0] != fields:
        raise ContractError(f"unexpected columns in {path}")
    if len(rows) > most + 1:
        raise ContractError(f"more than {most} rows in {path}")
    if any(len(r) != len(fields) for r in rows[1:]):
        raise ContractError(f"malformed rows in {path}")
    return spark.createDataFrame([tuple(v.strip() for v in r) for r in rows[1:]], ", ".join(f"`{f}` string" for f in fields))


def inventory(spark: SparkSession, path: str, folders: dict[str, str]) -> DataFrame:
    """``category, kind, image_path`` of the files below a provider's folder, kind by the folder in the path (name -> kind)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    own = F.regexp_extract("path", r"/([^/]+)/Data/(.+)$", 1)
    inner = F.regexp_extract("path", r"/([^/]+)/Data/(.+)$", 2)
    kind = F.lit(None).cast("string")
    for folder, name in folders.items():
        kind = F.when(F.startswith(inner, F.lit(f"{folder}/")), name).otherwise(kind)
    return files.select(own.alias("category"), kind.alias("kind"), F.concat_ws("/", own, F.lit("Data"), inner).alias("image_path")).where("category <> '' AND kind IS NOT NULL")


def paired_masks(files: DataFrame, path: str, suffix: str = "_GT") -> DataFrame:
    """``image, mask`` of files whose mask has the image's name with ``suffix``; images without a mask have null, masks without an image are a ContractError."""
    stem, end = F.regexp_extract(path, r"^(.*?)(\.[^./]*)?$", 1), F.regexp_extract(path, r"(\.[^./]*)?$", 1)
    named = files.select(F.col(path).alias("_p"), F.regexp_replace(stem, f"{suffix}$", "").alias("_s"), F.endswith(stem, F.lit(suffix)).alias("_m"), end.alias("_e"))
    images, masks = named.where("NOT _m").select("_s", F.col("_p").alias("image")), named.where("_m").select("_s", F.col("_p").alias("mask"))
    require_empty(masks.join(images, "_s", "left_anti").select("mask"), "masks without an image")
    return images.join(masks, "_s", "left").select("image", "mask")


def require_strata(rows: DataFrame, keys: list[str], strata: list[tuple]) -> DataFrame:
    """The rows of the given strata; one without rows is a ContractError."""
    wanted = rows.sparkSession.createDataFrame(strata, ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys))
    require_empty(wanted.join(rows, keys, "left_anti"), "strata without rows")
    return rows.join(F.broadcast(wanted), keys, "left_semi")  # the literal strata of a call


def value_problems(rows: DataFrame, finite: list[str], binary: list[str]) -> DataFrame:
    """``column, problem, n_rows``: nulls, NaN and infinities of the columns that must be finite, other values than 0 and 1 of the binary ones."""
    checks = {(c, "null"): F.col(c).isNull() for c in [*finite, *binary]}
    checks |= {(c, "not_finite"): F.isnan(c) | (F.abs(F.col(c)) == float("inf")) for c in finite}
    checks |= {(c, "not_binary"): ~F.col(c).isin(0, 1) for c in binary}
    found = F.array_compact(F.array(*(F.when(bad, F.struct(F.lit(c).alias("column"), F.lit(p).alias("problem"))) for (c, p), bad in checks.items())))
    return rows.select(F.explode(found).alias("e")).groupBy("e.column", "e.problem").agg(F.count(F.lit(1)).alias("n_rows"))

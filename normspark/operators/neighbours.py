"""Bounded nearest-neighbour memories: fit (sampling, k-center, balanced union) and scoring.

A memory (bank) is bounded by its parameters: ``size`` slots a category. Scoring therefore joins each
vector with at most that many slots and keeps the least distance, a partial aggregation without
any growing group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from normspark.functions.hashing import digest
from normspark.operators.relations import ContractError
from normspark.session import broadcast_if_small
from normspark.sources import sinks


def squared_distance(a: str, b: str) -> Column:
    """Squared Euclidean distance of two arrays in double arithmetic, never below 0."""
    return F.greatest(F.lit(0.0), F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> (CAST(x AS DOUBLE) - y) * (CAST(x AS DOUBLE) - y)), 0D, (s, v) -> s + v)"))


def random_bank(vectors: DataFrame, category: str, key: str, vec: str, size: int, seed: int) -> DataFrame:
    """``category, slot, vec``: the ``size`` vectors of lowest digest of seed and id in each category."""
    order = Window.partitionBy(category).orderBy(digest(F.lit(str(seed)), key, separator=":"), key)
    return vectors.withColumn("slot", F.row_number().over(order) - 1).where(F.col("slot") < size).select(category, "slot", F.col(vec).alias("vec"), F.col(key).alias("source"))


def unified_bank(bank: DataFrame, per_category: int) -> DataFrame:
    """The first ``per_category`` slots of each category as one bank."""
    return bank.where(F.col("slot") < per_category)


def nearest_score(queries: DataFrame, bank: DataFrame, category: str, key: str, vec: str, own: bool = True) -> DataFrame:
    """``key, category, score``: distance to the nearest slot of the own category (``own``) or of all others.

    The bank is joined as a bounded table (slots x categories); distances are reduced map-side. A query
    without a slot to compare with has no row.
    """
    slots = bank.select(F.col(category).alias("_bc"), F.col("vec").alias("_bv"))
    on = F.col(category) == F.col("_bc") if own else F.col(category) != F.col("_bc")
    joined = queries.select(key, category, F.col(vec).alias("_v")).join(broadcast_if_small(slots), on)
    return joined.groupBy(key, category).agg(F.sqrt(F.min(squared_distance("_v", "_bv"))).alias("score"))


def k_center(vectors: DataFrame, category: str, key: str, vec: str, size: int, candidates: int, seed: int) -> DataFrame:
    """``category, slot, source, vec, radius``: greedy k-center bank over at most ``candidates`` vectors a category.

    The first slot is the vector nearest the mean, each next one the farthest from the slots so far; the
    smallest id wins ties. Candidates are those of lowest digest, so a group fits one task by its parameter.
    """
    pool = random_bank(vectors, category, key, vec, candidates, seed).withColumnRenamed("source", key)
    kinds = dict(vectors.dtypes)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        x = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
        chosen = [int(((x - x.mean(0)) ** 2).sum(1).argmin())]
        least = ((x - x[chosen[0]]) ** 2).sum(1)
        while len(chosen) < min(size, len(x)):
            chosen.append(int(least.argmax()))
            least = np.minimum(least, ((x - x[chosen[-1]]) ** 2).sum(1))
        own = pdf.iloc[chosen]
        return pd.DataFrame({category: own[category].to_numpy(), "slot": range(len(chosen)), "source": own[key].to_numpy(), "vec": own["vec"].to_numpy(), "radius": np.sqrt(max(0.0, least.max()))})

    return pool.groupBy(category).applyInPandas(fit, f"{category} {kinds[category]}, slot int, source {kinds[key]}, vec array<float>, radius double")


def standardized_score(queries: DataFrame, train: DataFrame, bank: DataFrame, category: str, key: str, vec: str) -> DataFrame:
    """Nearest-neighbour distance after scaling each dimension by the category's training mean and deviation (0 counts as 1)."""
    moments = (
        train.select(category, F.posexplode(vec).alias("i", "x"))
        .groupBy(category, "i")
        .agg(F.avg(F.col("x").cast("double")).alias("m"), F.stddev_pop(F.col("x").cast("double")).alias("s"))
        .groupBy(category)
        .agg(F.sort_array(F.collect_list(F.struct("i", "m", F.when(F.col("s") > 0, F.col("s")).otherwise(1.0).alias("s")))).alias("_m"))
    )
    scale = "transform(zip_with({v}, _m, (x, p) -> (CAST(x AS DOUBLE) - p.m) / p.s), z -> z)"
    moments = broadcast_if_small(moments, 10_000)
    q = queries.join(moments, category).withColumn("_z", F.expr(scale.format(v=vec))).select(key, category, "_z")
    b = bank.join(moments, category).withColumn("vec", F.expr(scale.format(v="vec"))).select(category, "vec")
    return nearest_score(q, b, category, key, "_z")


def project(vectors: DataFrame, key: list[str], vec: str, dimension: int, target: int, seed: int) -> DataFrame:
    """``key, vec``: Gaussian random projection to ``target`` dimensions, scaled to length one; zero stays zero."""
    matrix = np.random.default_rng(seed + 1).standard_normal((dimension, target)) / np.sqrt(target)
    kinds = dict(vectors.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.stack(pdf[vec].to_numpy()).astype(np.float64) @ matrix if len(pdf) else np.empty((0, target))
            n = np.linalg.norm(x, axis=1, keepdims=True)
            yield pdf[key].assign(vec=list((x / np.where(n > 0, n, 1)).astype(np.float32)))

    usable = vectors.where(F.size(vec) == dimension).select(*key, vec)
    return usable.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in key) + ", vec array<float>")


def coverage_radius(vectors: DataFrame, bank: DataFrame, category: str, key: str, vec: str) -> DataFrame:
    """Per category the candidates and the largest distance of one to its nearest slot."""
    return nearest_score(vectors, bank, category, key, vec).groupBy(category).agg(F.count(F.lit(1)).alias("candidate_count"), F.max("score").alias("coverage_radius"))


def patch_sample(vectors: DataFrame, category: str, image: str, key: str, per_image: int, most: int, seed: int) -> DataFrame:
    """``category, image, key``: of each image the ``per_image`` patches of lowest digest, of a category at most ``most`` of these, lowest digest first."""
    h = digest(F.lit(str(seed)), key, separator=":")
    own = vectors.select(category, image, key, h.alias("_h"))
    few = own.withColumn("_r", F.row_number().over(Window.partitionBy(category, image).orderBy("_h", key))).where(F.col("_r") <= per_image)
    return few.withColumn("_r", F.row_number().over(Window.partitionBy(category).orderBy("_h", key))).where(F.col("_r") <= most).select(category, image, key)


def memory_statistics(vectors: DataFrame, bank: DataFrame, category: str, key: str, vec: str) -> DataFrame:
    """Per category the candidates, slots, dimension, bytes of candidates and bank (4 a value), and how far candidates are from their nearest slot."""
    slots = bank.groupBy(category).agg(F.count(F.lit(1)).alias("selected_count"))
    near = nearest_score(vectors, bank, category, key, vec).groupBy(category).agg(F.max("score").alias("coverage_radius"), F.avg("score").alias("mean_distance"))
    own = vectors.groupBy(category).agg(F.count(F.lit(1)).alias("candidate_count"), F.max(F.size(vec)).alias("dimension"))
    rows = own.join(slots, category).join(near, category)
    size = 4 * F.col("dimension").cast("long")
    return rows.withColumns({"raw_candidate_bytes": size * F.col("candidate_count"), "bank_bytes": size * F.col("selected_count")})


def write_bank(bank: DataFrame, path: str) -> None:
    """A bank as a table that appears whole."""
    sinks.publish(bank, path)


def read_bank(spark: SparkSession, path: str, vec: str = "vec") -> DataFrame:
    """A bank from its table: numeric vectors of one length without nulls or non-finite values, else ContractError."""
    bank = spark.read.parquet(path)
    bad = F.col(vec).isNull() | F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    if not bank.where(bad).isEmpty() or bank.agg(F.countDistinct(F.size(vec))).first()[0] > 1:
        raise ContractError("a bank's vectors must be finite and of one length")
    return bank

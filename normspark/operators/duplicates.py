"""Duplicate groups: exact digests, banded near-duplicates, connected components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normspark.session import broadcast_if_small, cut, require, small

#: Rounds of component labelling; it ends when nothing changes, far earlier.
MAX_ROUNDS = 60
#: Thumbnails of the near-duplicate check: side and number of grey values.
SIDE = 32
THUMB = SIDE * SIDE
#: Paths of candidates whose thumbnails are fetched by a broadcast; beyond, by a shuffled join.
BROADCAST_PATHS = 200_000


def exact_groups(df: DataFrame, digest: str, key: str) -> DataFrame:
    """``digest, n_rows, first_key`` of digests that several rows have; null digests match nothing."""
    return df.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.count(F.lit(1)).alias("n_rows"), F.min(key).alias("first_key")).where("n_rows > 1")


def banded_pairs(df: DataFrame, key: str, bits: str, within: list[str], distance: int) -> DataFrame:
    """``key_a, key_b, distance``: pairs whose 64-bit hashes differ in at most ``distance`` bits.

    The hash is cut into more words than bits may differ (four at least), so a pair has a word in common. Rows of equal hash are one node of the join; each class is
    linked to its representative (the least key), so a group of copies costs its size, not its square. Pairs are between representatives, and copies with theirs.
    """
    if not 0 <= distance < 64:
        raise ValueError("a distance of 0 to 63 bits")
    known = df.where(F.col(bits).isNotNull() & F.col(key).isNotNull()).select(key, bits, *within)
    reps = known.groupBy(*within, bits).agg(F.min(key).alias("rep"))
    n = max(4, distance + 1)
    cuts = [(64 * i // n, 64 * (i + 1) // n) for i in range(n)]
    words = F.array(*(F.struct(F.lit(i).alias("place"), F.shiftrightunsigned(bits, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("word")) for i, (a, b) in enumerate(cuts)))
    banded = reps.withColumn("_w", F.explode(words)).select(*within, F.col(bits).alias("h"), "rep", "_w.place", "_w.word")
    on = [*within, "place", "word"]
    other = banded.select(*on, F.col("h").alias("h2"), F.col("rep").alias("rep2"))
    gap = F.bit_count(F.col("h").bitwiseXOR(F.col("h2")))
    near = banded.join(other, on).where((F.col("rep") < F.col("rep2")) & (gap <= distance)).select(F.col("rep").alias("key_a"), F.col("rep2").alias("key_b"), gap.alias("distance")).distinct()
    copies = known.join(reps, [*within, bits]).where(F.col(key) != F.col("rep")).select(F.col("rep").alias("key_a"), F.col(key).alias("key_b"), F.lit(0).alias("distance"))
    return near.unionByName(copies)


def _lowered(batch: pa.RecordBatch, also: list[str]) -> tuple[list[pa.Array], np.ndarray]:
    """The usable thumbnails of a batch, each lowered by the whole part of its mean, and the columns ``also`` of their rows."""
    lists = batch.column("thumbnail")
    places = np.flatnonzero(np.asarray(lists.value_lengths().fill_null(0)) == THUMB)
    values = lists.take(pa.array(places)).flatten()
    whole = np.asarray(values.is_valid()).reshape(-1, THUMB).all(1)
    grey = np.asarray(values.fill_null(0), dtype=np.int32).reshape(-1, THUMB)[whole]
    kept = pa.array(places[whole])
    return [batch.column(c).take(kept) for c in also], grey - np.trunc(grey.sum(1) / THUMB).astype(np.int32)[:, None]


def _digests(lowered: np.ndarray) -> pa.Array:
    return pa.array([hashlib.blake2b(row.tobytes(), digest_size=16).digest() for row in np.ascontiguousarray(lowered)], pa.binary())


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the lowered values, and their sums over halves and middles, which differ by no more than the thumbnails do."""
    y, x = np.divmod(np.arange(THUMB), SIDE)
    half, quarter = SIDE // 2, SIDE // 4
    parts = np.stack([y < half, x < half, (y >= quarter) & (y < half + quarter), (x >= quarter) & (x < half + quarter), (y < half) == (x < half)], 1).astype(np.int32)
    for batch in batches:
        paths, lowered = _lowered(batch, ["image_path"])
        sums = lowered @ parts
        yield pa.RecordBatch.from_arrays([*paths, _digests(lowered), *(pa.array(sums[:, i], pa.int32()) for i in range(5))], ["image_path", "digest", *(f"s{i}" for i in range(5))])


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, lowered = _lowered(batch, [])
        yield pa.RecordBatch.from_arrays([_digests(lowered), pa.array([row.tobytes() for row in lowered], pa.binary())], ["digest", "values"])


def _near_thumbnails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int32).reshape(-1, THUMB) for c in ("a_values", "b_values"))
        near = np.abs(a - b).sum(1) / THUMB <= np.asarray(batch.column("mae"))
        yield batch.drop_columns(["a_values", "b_values", "mae"]).filter(pa.array(near))


def near_duplicates(records: DataFrame, groups: DataFrame, limits: DataFrame) -> DataFrame:
    """``key_a, key_b, distance``: all pairs of records of one dataset_version and category whose images look the same.

    A pair has the same 16-bit word at one of four places of its hashes, hashes that differ in at most the version's
    ``perceptual_max_dhash_distance`` bits, and thumbnails that, each lowered by the whole part of its mean, differ by at
    most ``perceptual_max_normalized_mae`` in the mean. ``records``: ``sample_id, dataset_version, category, image_path,
    bits``. Nulls, unusable thumbnails and versions without limits have no pairs; of several thumbnails any may match.

    Records of equal hash and lowered thumbnail are one class of the join, and the join also takes cells of two sums
    over the thumbnail (a partner lies in at most two cells each), so unlike images of a frequent word don't meet.
    """
    require(records, ["sample_id", "dataset_version", "category", "image_path", "bits"])
    require(groups, ["image_path", "thumbnail"])
    thumbs = groups.where("image_path IS NOT NULL AND thumbnail IS NOT NULL").select("image_path", "thumbnail")
    sketches = thumbs.mapInArrow(_sketch, "image_path string, digest binary, s0 int, s1 int, s2 int, s3 int, s4 int").distinct()
    limits = limits.where("dataset_version IS NOT NULL").groupBy("dataset_version").agg(F.max("perceptual_max_dhash_distance").alias("d"), F.max("perceptual_max_normalized_mae").alias("mae"))
    known = records.where("sample_id IS NOT NULL AND category IS NOT NULL AND bits IS NOT NULL").select("sample_id", "dataset_version", "category", "image_path", "bits")
    members = cut(known.join(broadcast_if_small(limits.where("d >= 0 AND mae >= 0")), "dataset_version").join(sketches, "image_path"))

    sums = [f"s{i}" for i in range(5)]
    within = ["dataset_version", "category"]
    classes = members.groupBy(*within, "bits", "digest").agg(F.min("image_path").alias("path"), *(F.first(c).alias(c) for c in ("d", "mae", *sums)))
    words = F.array(*(F.shiftrightunsigned("bits", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)))
    classes = classes.withColumns({"w": words, "budget": F.floor(F.col("mae") * THUMB + 1e-9)}).withColumn("width", 2 * F.col("budget") + 1)
    own = classes.select(*within, F.posexplode("w").alias("place", "word"), F.expr("floor(s0 / width)").alias("c0"), F.expr("floor(s1 / width)").alias("c1"), "bits", "digest", "path", "d", "mae", "budget", "w", *sums)
    cells = [F.expr(f"explode(array_distinct(array(floor(({c} - budget) / width), floor(({c} + budget) / width))))") for c in ("s0", "s1")]
    other = classes.withColumn("c0", cells[0]).withColumn("c1", cells[1]).select(
        *within, F.posexplode("w").alias("place", "word"), "c0", "c1", F.col("bits").alias("bits2"), F.col("digest").alias("digest2"), F.col("path").alias("path2"), F.col("w").alias("w2"), *(F.col(c).alias(f"{c}_2") for c in sums)
    )
    gap = F.bit_count(F.col("bits").bitwiseXOR(F.col("bits2")))
    near = (F.struct("bits", "digest") < F.struct(F.col("bits2").alias("bits"), F.col("digest2").alias("digest"))) & (gap <= F.col("d"))
    for c in sums:
        near = near & (F.abs(F.col(c) - F.col(f"{c}_2")) <= F.col("budget"))
    first = F.array_position(F.zip_with("w", "w2", lambda a, b: a == b), True) - 1 == F.col("place")  # a pair comes out at its first common word
    candidates = cut(own.join(other, [*within, "place", "word", "c0", "c1"]).where(near & first).select(*within, "bits", "digest", "path", "bits2", "digest2", "path2", gap.alias("distance"), "mae"))

    paths = candidates.select(F.explode(F.array("path", "path2")).alias("image_path")).distinct()
    paths = F.broadcast(paths) if small(paths, BROADCAST_PATHS) else paths
    values = thumbs.join(paths, "image_path", "left_semi").mapInArrow(_values, "digest binary, values binary").groupBy("digest").agg(F.first("values").alias("values"))
    kept = (
        candidates.drop("path", "path2")
        .join(values.withColumnRenamed("values", "a_values"), "digest")
        .join(values.select(F.col("digest").alias("digest2"), F.col("values").alias("b_values")), "digest2")
        .select(*within, "bits", "digest", "bits2", "digest2", "distance", "mae", "a_values", "b_values")
        .mapInArrow(_near_thumbnails, "dataset_version string, category string, bits long, digest binary, bits2 long, digest2 binary, distance int")
    )
    one = members.select(*within, "bits", "digest", F.col("sample_id").alias("x"))
    two = members.select(*within, F.col("bits").alias("bits2"), F.col("digest").alias("digest2"), F.col("sample_id").alias("y"))
    copies = one.join(two.withColumnsRenamed({"bits2": "bits", "digest2": "digest"}), [*within, "bits", "digest"]).where("x < y").select("x", "y", F.lit(0).alias("distance"))
    pairs = kept.join(one, [*within, "bits", "digest"]).join(two, [*within, "bits2", "digest2"]).where("x <> y").select("x", "y", "distance").unionByName(copies)
    return pairs.select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"), "distance").distinct()


def components(edges: DataFrame, a: str = "key_a", b: str = "key_b") -> DataFrame:
    """``node, component``: connected components, named by their least node.

    Alternating large- and small-star rounds: each links nodes straight to the least node in reach, so a
    chain shortens by half a round. No group is gathered; lineage is cut each round in the shared checkpoint folder.
    """
    links = cut(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    for _ in range(MAX_ROUNDS):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(lower.select("u", F.col("m").alias("v"))).distinct()
        new = cut(small)
        if new.count() == links.count() and new.exceptAll(links).isEmpty():
            break
        links = new
    else:
        raise RuntimeError("components did not converge")
    roots = links.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return roots.unionByName(roots.select(F.col("component").alias("node"), "component").distinct())


def cross_boundary(pairs: DataFrame, splits: DataFrame, key: str, split: str) -> DataFrame:
    """Pairs whose two sides are in different splits."""
    a = splits.select(F.col(key).alias("key_a"), F.col(split).alias("split_a"))
    b = splits.select(F.col(key).alias("key_b"), F.col(split).alias("split_b"))
    return pairs.join(a, "key_a").join(b, "key_b").where("split_a <> split_b")

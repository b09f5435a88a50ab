"""Same or near-same images across splits: evaluation grams are partitioned, training is scanned for hits.

The grams of an image are the words of its perceptual hash, each together with the coarse grey cell
of its thumbnail. Two hashes that differ in at most ``d`` of 64 bits have at least ``words - d`` of
``words > d`` words in common, and two thumbnails whose grey values, each lowered by its mean,
differ by at most ``b`` in sum differ by at most ``b`` in every signed sum over pixels; so the cells
of an evaluation image that a partner can lie in are known. Evaluation images are stored under all
these grams (at most four cells a word), training images under their own, and the hits are one
equi-join partitioned by gram. Each hit gets its containment, the share of the evaluation image's
words that the training image has; only the first common word emits it. What is left is compared by
hash distance, further signed sums and finally the whole thumbnails. A gram that more than ``HOT`` training classes share (frames that are
nearly uniform) is split: its training classes by a hash, with a copy of its evaluation classes for each part.

Copies (same hash and same lowered thumbnail) are one class, so a group of copies costs one
comparison; pairs are written out only in the result. The same file is found by an equi-join on the
number of its SHA-256.

Defined results: a record delivered again counts once, with its earliest delivery. A hash counts if
it is hexadecimal (any letter case, with or without 0x) of at most 64 bits; a thumbnail counts if it
has ``THUMB`` values without nulls. Records without split, or of another split, are in no pair; nulls
match nothing. A dataset_version without limits has only same-file pairs. If an image has several
thumbnails, any of them may match. Further columns are ignored; empty tables give no pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normspark.session import broadcast_if_small, cut, require

SIDE = 32
THUMB = SIDE * SIDE
#: Words of a hash, at least; more where the allowed distance needs it.
LEAST_WORDS = 4
#: Training classes of a gram in one part of the join.
HOT = 20_000
#: Images of candidate classes whose thumbnails are fetched by a broadcast of their paths; beyond, by a shuffled join.
BROADCAST_PATHS = 200_000


def hex_number(text: Column) -> Column:
    """A hexadecimal number in one notation: lower case, without 0x and leading zeros; null if it is none."""
    bare = F.regexp_replace(F.lower(F.trim(text)), "^0x", "")
    return F.when(bare.rlike("^[0-9a-f]+$"), F.regexp_replace(bare, "^0+(?=.)", ""))


def hash_bits(text: Column) -> Column:
    """A hexadecimal number of at most 64 bits as a (signed) long, else null."""
    number = hex_number(text)
    return F.when(F.length(number) <= 16, F.conv(number, 16, -10).cast("long"))


def _sign_patterns() -> np.ndarray:
    """Five 0/1 patterns over the thumbnail: top half, left half, middle rows, middle columns, checker."""
    y, x = np.divmod(np.arange(THUMB), SIDE)
    half, quarter = SIDE // 2, SIDE // 4
    return np.stack([y < half, x < half, (y >= quarter) & (y < half + quarter), (x >= quarter) & (x < half + quarter), (y < half) == (x < half)], 1).astype(np.int32)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    patterns = _sign_patterns()
    for batch in batches:
        lists = batch.column("thumbnail")
        usable = np.asarray(lists.value_lengths().fill_null(0)) == THUMB
        keep = lists.filter(pa.array(usable))
        paths = batch.column("image_path").filter(pa.array(usable))
        values = keep.flatten()
        if values.null_count:
            whole = np.asarray(values.is_valid()).reshape(-1, THUMB).all(1)
            keep, paths = keep.filter(pa.array(whole)), paths.filter(pa.array(whole))
            values = keep.flatten()
        grey = np.asarray(values, dtype=np.int32).reshape(-1, THUMB)
        lowered = grey - np.trunc(grey.mean(1, dtype=np.float64)).astype(np.int32)[:, None] if len(grey) else grey
        sums = lowered @ patterns
        digests = [hashlib.blake2b(row.tobytes(), digest_size=16).digest() for row in np.ascontiguousarray(lowered)]
        columns = [paths, pa.array(digests, pa.binary()), *(pa.array(sums[:, i], pa.int32()) for i in range(patterns.shape[1]))]
        yield pa.RecordBatch.from_arrays(columns, ["image_path", "digest", *(f"s{i}" for i in range(patterns.shape[1]))])


def sketches(groups: DataFrame) -> DataFrame:
    """``image_path, digest, s0..s4`` of each usable thumbnail: its lowered values' digest and signed sums."""
    return groups.where("image_path IS NOT NULL AND thumbnail IS NOT NULL").select("image_path", "thumbnail").mapInArrow(
        _sketch, "image_path string, digest binary, s0 int, s1 int, s2 int, s3 int, s4 int"
    )


def split_records(manifest: DataFrame) -> DataFrame:
    """Each record of the three splits once: ``sample_id, dataset_version, category, split, image_path, sha, bits``."""
    require(manifest, ["sample_id", "dataset_version", "category", "split", "image_path", "image_sha256", "perceptual_hash", "ingested_at"])
    columns = ["dataset_version", "category", "split", "image_path", "image_sha256", "perceptual_hash"]
    return (
        manifest.where("sample_id IS NOT NULL")
        .groupBy("sample_id")
        .agg(F.min(F.struct("ingested_at", *columns)).alias("d"))
        .select("sample_id", *(f"d.{c}" for c in columns))
        .withColumn("split", F.lower(F.trim("split")))
        .where(F.col("split").isin("train", "validation", "test"))
        .select("sample_id", "dataset_version", "category", "split", "image_path", hex_number(F.col("image_sha256")).alias("sha"), hash_bits(F.col("perceptual_hash")).alias("bits"))
    )


def same_file(records: DataFrame) -> DataFrame:
    """(train_id, eval_id) of records with the same file number, in any category."""
    known = records.where("sha IS NOT NULL").select("sample_id", "split", "sha")
    train = known.where("split = 'train'").select("sha", F.col("sample_id").alias("train_id"))
    held = known.where("split <> 'train'").select("sha", F.col("sample_id").alias("eval_id"))
    return train.join(held, "sha").select("train_id", "eval_id")


def _words(bits: str = "bits", words: str = "words") -> str:
    """SQL: the words of a 64-bit hash as an array."""
    return f"transform(sequence(0, {words} - 1), i -> shiftrightunsigned({bits}, CAST(64 * i DIV {words} AS INT)) & (shiftleft(1L, CAST(64 * (i + 1) DIV {words} - 64 * i DIV {words} AS INT)) - 1L))"


def classes(records: DataFrame, groups: DataFrame, limits: DataFrame) -> DataFrame:
    """Membership of images in classes of copies, with sketch and limits.

    ``side`` (train or eval), ``sample_id``, ``rep`` (the class's smallest id on its side) and
    ``image_path`` of the representative.
    """
    limits = limits.where("dataset_version IS NOT NULL").groupBy("dataset_version").agg(
        F.max("perceptual_max_dhash_distance").alias("d"), F.max("perceptual_max_normalized_mae").alias("mae")
    )
    return (
        records.where("bits IS NOT NULL AND category IS NOT NULL")
        .drop("sha")
        .join(broadcast_if_small(limits.where("d IS NOT NULL AND mae IS NOT NULL AND d BETWEEN 0 AND 63")), "dataset_version")
        .join(sketches(groups), "image_path")
        .withColumns({
            "side": F.when(F.col("split") == "train", "train").otherwise("eval"),
            "words": F.greatest(F.lit(LEAST_WORDS), F.col("d") + 1),
            "budget": F.floor(F.col("mae") * THUMB + 1e-9).cast("int"),
        })
    )


CLASS = ["side", "dataset_version", "category", "bits", "digest"]


def candidate_classes(members: DataFrame) -> DataFrame:
    """Pairs of classes (of one dataset_version and category) that pass the grams, the hash distance and the signed sums, with a path of each."""
    reps = members.groupBy(*CLASS).agg(
        F.min("image_path").alias("path"),
        *(F.first(c).alias(c) for c in ("d", "mae", "words", "budget", "s0", "s1", "s2", "s3", "s4")),
    )
    reps = reps.withColumn("w", F.expr(_words())).withColumn("width", 2 * F.col("budget") + 1)
    gram = ["dataset_version", "category", "place", "word", "c0", "c1"]
    train = (
        reps.where("side = 'train'")
        .withColumns({"c0": F.expr("floor(s0 / width)"), "c1": F.expr("floor(s1 / width)")})
        .select("dataset_version", "category", F.posexplode("w").alias("place", "word"), "c0", "c1", "path", "bits", "digest", *(f"s{i}" for i in range(5)))
    )
    held = (
        reps.where("side = 'eval'")
        .withColumn("c0", F.explode(F.expr("sequence(floor((s0 - budget) / width), floor((s0 + budget) / width))")))
        .withColumn("c1", F.explode(F.expr("sequence(floor((s1 - budget) / width), floor((s1 + budget) / width))")))
        .select("dataset_version", "category", F.posexplode("w").alias("place", "word"), "c0", "c1", F.col("path").alias("e_path"), F.col("bits").alias("e_bits"), F.col("digest").alias("e_digest"), F.col("w").alias("e_words"), "words", "d", "mae", "budget", *(F.col(f"s{i}").alias(f"e{i}") for i in range(5)))
    )
    parts = cut(train.groupBy(*gram).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT).select(*gram, F.ceil(F.col("_n") / HOT).cast("int").alias("_parts")))
    if not parts.isEmpty():
        parts = broadcast_if_small(parts)
        train = train.join(parts, gram, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64("digest", "bits"), F.col("_parts")), F.lit(0))).drop("_parts")
        held = held.join(parts, gram, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).withColumn("_part", F.col("_part").cast("long")).drop("_parts")
        gram = [*gram, "_part"]
    hits = train.join(held, gram)
    near = F.bit_count(F.col("bits").bitwiseXOR(F.col("e_bits"))) <= F.col("d")
    for i in range(5):
        near = near & (F.abs(F.col(f"s{i}") - F.col(f"e{i}")) <= F.col("budget"))
    shared = F.expr(f"transform(zip_with({_words()}, e_words, (a, b) -> a = b), (x, i) -> IF(x, i, NULL))")
    return (
        hits.where(near)
        .withColumn("_shared", F.array_compact(shared))
        .where(F.element_at("_shared", 1) == F.col("place"))
        .select("dataset_version", "category", "bits", "digest", "path", "e_bits", "e_digest", "e_path", "mae", (F.size("_shared") / F.col("words")).alias("containment"))
    )


def _lowered(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The lowered values of each thumbnail of ``THUMB`` values, and whether it has no null."""
    values = lists.flatten()
    whole = np.asarray(values.is_valid()).reshape(-1, THUMB).all(1)
    grey = np.asarray(values.fill_null(0), dtype=np.int32).reshape(-1, THUMB)
    return grey - np.trunc(grey.mean(1, dtype=np.float64)).astype(np.int32)[:, None], whole


def _digest(row: np.ndarray) -> bytes:
    return hashlib.blake2b(row.tobytes(), digest_size=16).digest()


PAIR = ["dataset_version", "category", "bits", "digest", "e_bits", "e_digest", "containment"]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose thumbnails are near; of an image with several thumbnails, the one that makes it a member of the class."""
    for batch in batches:
        if batch.num_rows:
            (a, a_whole), (b, b_whole) = _lowered(batch.column("t")), _lowered(batch.column("e_t"))
            near = (np.abs(a - b).sum(1) / THUMB <= np.asarray(batch.column("mae"))) & a_whole & b_whole
            for i in np.flatnonzero(near):
                near[i] = _digest(a[i]) == batch.column("digest")[i].as_py() and _digest(b[i]) == batch.column("e_digest")[i].as_py()
            yield batch.select(PAIR).filter(pa.array(near))


def near_same(members: DataFrame, groups: DataFrame) -> DataFrame:
    """(train_id, eval_id, containment) of near-same records, copies written out."""
    pairs = cut(candidate_classes(members))
    thumbs = groups.where(f"thumbnail IS NOT NULL AND size(thumbnail) = {THUMB}").select("image_path", "thumbnail")
    paths = pairs.select(F.explode(F.array("path", "e_path")).alias("image_path")).distinct()
    paths = F.broadcast(paths) if paths.limit(BROADCAST_PATHS + 1).count() <= BROADCAST_PATHS else paths
    wanted = thumbs.join(paths, "image_path", "left_semi")
    kept = (
        pairs.join(wanted.select(F.col("image_path").alias("path"), F.col("thumbnail").alias("t")), "path")
        .join(wanted.select(F.col("image_path").alias("e_path"), F.col("thumbnail").alias("e_t")), "e_path")
        .select(*PAIR, "mae", "t", "e_t")
        .mapInArrow(_verify, "dataset_version string, category string, bits long, digest binary, e_bits long, e_digest binary, containment double")
        .distinct()
    )
    # membership: the members of a class, not its list, go through the joins
    within = ["dataset_version", "category"]
    train = members.where("side = 'train'").select(*within, "bits", "digest", F.col("sample_id").alias("train_id"))
    held = members.where("side = 'eval'").select(*within, F.col("bits").alias("e_bits"), F.col("digest").alias("e_digest"), F.col("sample_id").alias("eval_id"))
    return kept.join(train, [*within, "bits", "digest"]).join(held, [*within, "e_bits", "e_digest"]).select("train_id", "eval_id", "containment").distinct()


def overlaps(manifest: DataFrame, groups: DataFrame, limits: DataFrame) -> DataFrame:
    """All cross-split overlaps: ``train_id, eval_id, same_file, containment`` (null for a same file only)."""
    require(groups, ["image_path", "thumbnail"])
    records = cut(split_records(manifest))
    files = same_file(records).select("train_id", "eval_id", F.lit(True).alias("same_file"), F.lit(None).cast("double").alias("containment"))
    near = near_same(cut(classes(records, groups, limits)), groups).select("train_id", "eval_id", F.lit(False).alias("same_file"), "containment")
    return files.unionByName(near).groupBy("train_id", "eval_id").agg(F.max("same_file").alias("same_file"), F.max("containment").alias("containment"))


def report(pairs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Overlapping pairs and records per evaluation split, dataset_version and category."""
    held = split_records(manifest).select(F.col("sample_id").alias("eval_id"), "split", "dataset_version", "category")
    return (
        pairs.join(held, "eval_id")
        .groupBy("split", "dataset_version", "category")
        .agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("eval_id").alias("n_eval_records"), F.sum(F.col("same_file").cast("long")).alias("n_same_file"))
    )

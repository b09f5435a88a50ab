"""Encoding of a corpus with a public byte-level BPE tokenizer, by overlapping chunks.

A text of up to ``CHUNK`` characters is one chunk and is encoded as it is. A longer one is cut into
chunks that each reach ``OVERLAP`` characters into the next one. The chunks are spread over the
cluster and pre-tokenised in parallel, each from its own first character. The pattern that splits a
text into pre-tokens never looks behind, so from the first boundary that a chunk and the next one
share in their overlap, both split the text alike: there the text is stitched. The piece from one
stitch to the next is encoded on its own, and a text's ids are its pieces' ids in order. Where two
chunks share no boundary (a pre-token longer than the overlap), the text is encoded as a whole, so the
ids are those of the whole text in every case. Decoding concatenates the bytes of the ids.

Special tokens' strings in a text are ordinary text. The vocabulary is a rank file (one base64 token
and its id a line) whose path is a parameter; it is read on the driver and sent to the executors (about
1 MB, the same for every corpus).

Defined results: an empty text and a null text have an empty list of ids. One row for each input row; ids
and texts may repeat. A null document id keeps its row; it is encoded as one chunk. Further columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normspark.session import cut, require

#: Characters of a chunk, and how far it reaches into the next.
CHUNK, OVERLAP = 2_048, 256
#: Boundaries this near to a chunk's end may be due to the end, and don't count.
MARGIN = 8
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the pattern that splits text before the merges of the byte-level rank files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The tokens of a rank file with their ids."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line.strip())}


def encoder(data: bytes):
    """The encoder of a rank file; a worker process keeps it for its later tasks."""
    import tiktoken
    import tiktoken.registry

    name = f"normspark-{hash(data)}"
    if name not in tiktoken.registry.ENCODINGS:
        tiktoken.registry.ENCODINGS[name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=read_ranks(data), special_tokens={})
    return tiktoken.registry.ENCODINGS[name]


def _id_lists(found: list[list[int]]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
    flat = np.fromiter((i for x in found for i in x), np.int32, count=int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))


def _encode(ranks, keys: list[str]):
    """For mapInArrow: ``keys`` and the ids of ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 1_000):
                part = batch.slice(i, 1_000)
                texts = [t or "" for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), _id_lists([enc.encode_ordinary(t) for t in texts])], [*keys, "ids"])

    return run


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of long texts: ``doc_id, key, chunk, n_chunks, text``, each with its overlap."""
    for batch in batches:
        for doc, key, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "text")), strict=True):
            n = -(-len(text) // CHUNK)
            for i in range(0, n, 512):
                own = range(i, min(n, i + 512))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([doc] * len(own), pa.int64()),
                        pa.array([key] * len(own), pa.binary()),
                        pa.array(own, pa.int32()),
                        pa.array([n] * len(own), pa.int32()),
                        pa.array([text[c * CHUNK : (c + 1) * CHUNK + OVERLAP] for c in own], pa.string()),
                    ],
                    ["doc_id", "key", "chunk", "n_chunks", "text"],
                )


def boundaries(text: str) -> list[int]:
    """Where pre-tokens begin, and the text's end."""
    return [0, *(m.end() for m in regex.finditer(PATTERN, text))]


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each seam (the end of chunk ``chunk``) the boundaries that either side sees in the overlap."""
    for batch in batches:
        docs, keys, seams, heads, tails = [], [], [], [], []
        for doc, key, chunk, n, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "chunk", "n_chunks", "text")), strict=True):
            at = boundaries(text)
            limit = len(text) if chunk == n - 1 else len(text) - MARGIN
            if chunk > 0:
                docs.append(doc)
                keys.append(key)
                seams.append(chunk - 1)
                heads.append([b for b in at if b <= min(OVERLAP, limit)])
                tails.append(None)
            if chunk < n - 1:
                docs.append(doc)
                keys.append(key)
                seams.append(chunk)
                heads.append(None)
                tails.append([b - CHUNK for b in at if CHUNK <= b <= limit])
        kind = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(docs, pa.int64()), pa.array(keys, pa.binary()), pa.array(seams, pa.int32()), pa.array(heads, kind), pa.array(tails, kind)], ["doc_id", "key", "seam", "head", "tail"]
        )


def encode_corpus(documents: DataFrame, ranks_path: str = RANKS) -> DataFrame:
    """``doc_id, ids``: the token ids of every document."""
    require(documents, ["doc_id", "text"])
    spark = documents.sparkSession
    with open(ranks_path, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    long = (F.length("text") > CHUNK) & F.col("doc_id").isNotNull()
    whole = docs.where(~F.coalesce(long, F.lit(False)))
    # a repeated document id would mix the chunks of two texts: the text's 128-bit digest keeps them apart
    cut_up = docs.where(long).withColumn("key", F.unhex(F.md5("text")))
    of = ["doc_id", "key"]
    keyed = cut_up.select(*of, "text").dropDuplicates(of)
    chunks = keyed.mapInArrow(_split, "doc_id long, key binary, chunk int, n_chunks int, text string").repartition(*of, "chunk")
    seams = cut(
        chunks.mapInArrow(_marks, "doc_id long, key binary, seam int, head array<int>, tail array<int>")
        .groupBy(*of, "seam")
        .agg(F.max("head").alias("head"), F.max("tail").alias("tail"))
        .select(*of, "seam", F.array_min(F.array_intersect("head", "tail")).alias("stitch"))
    )
    lost = seams.where("stitch IS NULL").select(*of).distinct()
    # where each chunk's piece begins and ends: after the seam before it, to the seam after it
    sides = F.array(F.struct(F.col("seam").alias("chunk"), F.lit(None).cast("int").alias("since"), F.col("stitch").alias("until")), F.struct((F.col("seam") + 1).alias("chunk"), F.col("stitch").alias("since"), F.lit(None).cast("int").alias("until")))
    bounds = seams.select(*of, F.explode(sides).alias("b")).groupBy(*of, "b.chunk").agg(F.max("b.since").alias("since"), F.max("b.until").alias("until"))
    pieces = (
        chunks.join(lost, of, "left_anti")
        .join(bounds, [*of, "chunk"])
        .select(
            *of,
            "chunk",
            F.substring(
                F.col("text"),
                F.coalesce("since", F.lit(0)) + 1,
                F.when(F.col("until").isNull(), F.length("text")).otherwise(F.col("until") + CHUNK) - F.coalesce("since", F.lit(0)),
            ).alias("text"),
        )
    )
    stitched = (
        pieces.mapInArrow(_encode(ranks, [*of, "chunk"]), "doc_id long, key binary, chunk int, ids array<int>")
        .groupBy(*of)
        .agg(F.sort_array(F.collect_list(F.struct("chunk", "ids"))).alias("p"))
        .select(*of, F.flatten("p.ids").alias("ids"))
    )
    unsplit = keyed.join(lost, of, "left_semi").mapInArrow(_encode(ranks, of), "doc_id long, key binary, ids array<int>")
    named = cut_up.select(*of).join(stitched.unionByName(unsplit), of).select("doc_id", "ids")
    return whole.mapInArrow(_encode(ranks, ["doc_id"]), "doc_id long, ids array<int>").unionByName(named)


def decode(encoded: DataFrame, ranks_path: str = RANKS) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``: the bytes of the ids, one after the other, as UTF-8."""
    spark = encoded.sparkSession
    with open(ranks_path, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = {i: b for b, i in read_ranks(ranks.value).items()}
        for batch in batches:
            texts = [None if ids is None else b"".join(of[i] for i in ids).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")

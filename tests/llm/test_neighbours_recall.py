"""Recall of the neighbour search against brute force over whole tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from normspark.llm import nearest_vectors
from normspark.session import table

DATA = "/root/testdata/sf0.1"
K = 10


@pytest.fixture(scope="module")
def unit(spark):
    """Ids and unit vectors of the usable patches, each id once."""
    dims = table(spark, DATA, "memory_stats").select("category", F.col("projected_dimension").alias("n"))
    rows = table(spark, DATA, "patches").join(F.broadcast(dims), "category").where("size(vec) = n").select("patch_id", "vec").toArrow()
    ids = np.asarray(rows.column("patch_id").combine_chunks())
    places, x = nearest_vectors.unit_vectors(rows.column("vec"), 64)
    ids, first = np.unique(ids[places], return_index=True)
    return ids, x[first]


def _recall(spark, unit, asked):
    ids, x = unit
    found: dict[int, set[int]] = {}
    for r in nearest_vectors.patch_neighbours(table(spark, DATA, "patches"), table(spark, DATA, "memory_stats"), asked, K).collect():
        found.setdefault(r.query_id, set()).add(r.id)
    own = np.flatnonzero(np.isin(ids, [r.id for r in asked.distinct().collect()]))
    assert set(found) == set(ids[own].tolist())
    hits = 0
    for i in range(0, len(own), 256):
        cosines = x[own[i : i + 256]] @ x.T
        cosines[np.arange(len(cosines)), own[i : i + 256]] = -2
        best = np.argpartition(-cosines, K, axis=1)[:, :K]
        hits += sum(len(found[ids[q]] & set(ids[b].tolist())) for q, b in zip(own[i : i + 256], best, strict=True))
    return hits / (K * len(own))


def test_probes(spark, unit):
    assert _recall(spark, unit, table(spark, DATA, "probe_patches").select(F.col("patch_id").alias("id"))) >= 0.99


def test_vectors_without_near_neighbours(spark, unit):
    asked = table(spark, DATA, "patches").where("patch_id % 100 = 0").select(F.col("patch_id").alias("id"))
    assert _recall(spark, unit, asked) >= 0.95


def test_second_set_of_lines(spark, unit, monkeypatch):
    """Cells of two lines, as used for more vectors than the first set of lines has room for."""
    monkeypatch.setattr(nearest_vectors, "FIRST_LINES", 256)
    monkeypatch.setattr(nearest_vectors, "CELL_ROWS", 100)
    assert _recall(spark, unit, table(spark, DATA, "probe_patches").select(F.col("patch_id").alias("id"))) >= 0.97

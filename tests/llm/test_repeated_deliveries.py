"""Vectors that are delivered many times."""

import numpy as np

from normspark.llm import nearest_vectors


def test_patches_delivered_often_do_not_displace_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((200, 24)).astype(np.float32)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {0: [int(i) for i in np.argsort(-(unit @ unit[0]), kind="stable") if i][:10]}
    for times in (3, 50):
        near = want[0][:4]  # the nearest are delivered again and again
        rows = [(int(i), x[i].tolist()) for i in range(200)] + [(i, x[i].tolist()) for i in near for _ in range(times)]
        df = spark.createDataFrame(rows, "id long, vec array<float>").coalesce(1)
        got = nearest_vectors.neighbours(df, spark.createDataFrame([(0,)], "id long"), 24).orderBy("place").collect()
        assert [r.id for r in got] == want[0]


def test_best_of_a_batch_counts_an_id_once():
    for times in (3, 30, 500):
        best = nearest_vectors._Best(np.array([99]), 10)
        ids = np.repeat(np.arange(60), times)
        best.add(0, ids, (1 - ids / 100).astype(np.float32))
        assert best.ids[0].tolist() == list(range(10))

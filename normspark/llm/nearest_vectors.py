"""Most similar vectors by collision-counting hashing over single-projection sorted arrays.

Every vector is scaled to length one and projected on random lines. The work is partitioned by the
lines on which a vector lies far out: a vector is stored under its ``STORE`` most extreme signed
lines, a query looks under its ``PROBE`` most extreme ones (a near vector lies far out where the
query does). Within such a cell, a second set of ``COUNTED`` projections is kept as sorted arrays.
For each query, a window centred on the query's own value is cut from every array, and the vectors
are counted by how many windows they fall in; those with at least ``THRESHOLD`` collisions are
verified by their cosine. While fewer than ``k`` verified vectors lie within the radius that the
windows stand for, the windows are widened (virtual rehashing: the same arrays, a larger radius).

A query with ``k`` verified vectors within ``RADII[-1]`` is settled. The others go into the last
rehashing: the radius is unbounded there, so the windows are whole arrays, every vector of a cell
collides, and all are verified, as one matrix product for all queries of the cell; each vector
is stored under its most extreme line only, and the query looks under the share ``WIDE`` of the lines on which it lies
farthest out. Its work is that share of the vectors, not a constant: neighbours hardly nearer than chance can't be
found by much less at the recall that is asked for (README has the measurement). Only improvements on what the first
windows found leave a cell. Up to ``SENT`` numbers of such queries are sent to the tasks that read the vectors, which compare
the same pairs, so the vectors aren't shuffled again; more queries are shuffled with the vectors by line. With ``share=1`` the result is exact, at the price of a comparison with every vector.

Partitions: the number of lines grows with the number of vectors, so that a cell holds about
``CELL_ROWS``. Beyond ``FIRST_LINES`` a cell is a line of a first set and one of a second set: a
vector is stored under its most extreme line of the second set, a query looks under
``SECOND_PROBE`` of them. The vectors per line are counted first, and a line with more than four times
``CELL_ROWS`` is split by a hash of the vector's id into parts, to each of which its queries are copied. Hence a line
that holds a third of all vectors is many cells, a task never holds more than ``BLOCK`` rows of a
cell as one block, and the shuffle has a partition for each ``TASK_ROWS`` rows. Shuffled are ``STORE`` copies of each vector and ``PROBE`` of each query.

Recall against brute force is measured by ``tests/llm/test_neighbours_recall.py`` and given in the README.

Defined results: a vector is usable if it is not null, has the asked length, no null or non-finite
value and not only zeros. An id counts once: of several usable deliveries of one id, the most similar
one. Equal similarity is ordered by id. Null ids are left out. Fewer than ``k`` other usable vectors give all
that are found. Further columns are ignored; empty tables give no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from normspark.session import broadcast_if_small, cut, require, small, spread

#: Fixed seed of the lines; the index is the same in every run.
SEED = 20250117
#: Signed lines under which a vector is stored and a query looks.
STORE, PROBE = 2, 10
#: Vectors per cell aimed at, the most that are held as one block of sorted arrays, and rows of a task of the shuffle.
CELL_ROWS, BLOCK, TASK_ROWS = 2_000, 16_384, 40_000
#: Signed lines at least, signed lines of the first set at most, and lines of the second set that a query looks under.
LEAST_LINES, FIRST_LINES, SECOND_PROBE = 256, 4_096, 4
#: Counted projections, the collisions a candidate needs, and the radii of the windows.
COUNTED, THRESHOLD = 16, 8
RADII = (0.30, 0.45, 0.70)
#: Share of the lines that a query looks under once the radius is unbounded.
WIDE = 0.5
#: Window half width for a radius: near vectors fall into it with a chance of about 0.77 per projection.
WIDTH_FACTOR = 1.2
#: Query ids that are broadcast at most (16 MB); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Numbers of the vectors of unsettled queries that are sent to the tasks at most (16 MB).
SENT = 1 << 22


def _lines(dimension: int, count: int, salt: int) -> np.ndarray:
    """``count`` random lines as columns, the same everywhere."""
    return np.random.default_rng([SEED, salt, dimension]).standard_normal((dimension, count), dtype=np.float32)


def unit_vectors(lists: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``lists`` that are usable vectors (as places), and those vectors at length one."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    places = np.flatnonzero(np.asarray(lists.value_lengths().fill_null(-1)) == dimension)
    values = lists.take(pa.array(places)).flatten()
    x = np.asarray(values.fill_null(float("nan")), dtype=np.float64).reshape(-1, dimension)
    usable = np.isfinite(x).all(1) & (x != 0).any(1)
    x, places = x[usable], places[usable]
    x = x / np.abs(x).max(1, keepdims=True) if len(x) else x
    return places, (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32) if len(x) else x.astype(np.float32)


def extreme_lines(x: np.ndarray, lines: np.ndarray, count: int) -> np.ndarray:
    """For each row the ``count`` signed lines on which it lies farthest out, farthest first.

    Signed lines are numbered from 0: the lines, then their opposites.
    """
    n = lines.shape[1]
    count = min(count, 2 * n)
    out = np.empty((len(x), count), np.int32)
    for i in range(0, len(x), 2_048):
        p = x[i : i + 2_048] @ lines
        size = np.abs(p)
        if count < n:
            far = np.argpartition(size, n - count, axis=1)[:, n - count :]
            far = np.take_along_axis(far, np.argsort(-np.take_along_axis(size, far, 1), axis=1, kind="stable"), 1)
        else:
            far = np.argsort(-size, axis=1, kind="stable")
        signed = np.where(np.take_along_axis(p, far, 1) < 0, far + n, far)
        if count > n:  # beyond its own sides of all lines come the other sides, the nearest first
            signed = np.concatenate([signed, (signed[:, ::-1] + n) % (2 * n)], 1)[:, :count]
        out[i : i + 2_048] = signed
    return out


def _count_lines(dimension: int, lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, n = _lines(dimension, lines // 2, 1), np.zeros(lines, np.int64)
        for batch in batches:
            _, x = unit_vectors(batch.column("vec"), dimension)
            if len(x):
                n += np.bincount(extreme_lines(x, a, STORE).ravel(), minlength=lines)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used], pa.int64())], ["line", "n"])

    return run


class _Layout:
    """The lines, and into how many parts each line of the first set is split."""

    def __init__(self, dimension: int, total: int) -> None:
        self.dimension, self.first, self.second = dimension, LEAST_LINES, 1
        while self.first < FIRST_LINES and total * STORE > self.first * CELL_ROWS:
            self.first *= 2
        while total * STORE > self.first * self.second * CELL_ROWS:
            self.second *= 2
        self.parts = np.ones(self.first, np.int64)

    def split(self, counts: dict[int, int]) -> None:
        for line, n in counts.items():
            self.parts[line] = max(1, round(n / (4 * CELL_ROWS * self.second)))

    def second_lines(self, x: np.ndarray, count: int) -> np.ndarray:
        """The most extreme lines of the second set (one column of zeros where there is none)."""
        return extreme_lines(x, _lines(self.dimension, max(1, self.second // 2), 3), count) if self.second > 1 else np.zeros((len(x), 1), np.int64)

    def keys(self, line: np.ndarray, second: np.ndarray, part: np.ndarray) -> np.ndarray:
        return (line.astype(np.int64) * self.second + second) << 24 | part


def _spread(layout: _Layout, share: float | None):
    """Rows of the cells: each vector under its ``STORE`` extreme lines, each query under ``PROBE`` of its own.

    With a ``share`` each vector is stored once, and a query looks under that share of the lines.
    """
    wide = share is not None
    dimension, store, probe = layout.dimension, 1 if wide else STORE, max(PROBE, round(share * layout.first)) if wide else PROBE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _lines(dimension, layout.first // 2, 1)
        for batch in batches:
            ids = np.asarray(batch.column("id"))
            places, x = unit_vectors(batch.column("vec"), dimension)
            if not len(x):
                continue
            ids, kept = ids[places], pa.array(places)
            asked = np.asarray(batch.column("is_query").take(kept), dtype=bool)
            floors = np.asarray(batch.column("floor").take(kept))
            line = extreme_lines(x, a, store)
            mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            row = np.repeat(np.arange(len(x)), store)
            key_line = line.ravel()
            key_second = np.repeat(layout.second_lines(x, 1)[:, 0], store)
            key_part = (mixed[row] % layout.parts[key_line].astype(np.uint64)).astype(np.int64)
            groups = [(True, row, layout.keys(key_line, key_second, key_part))]
            q = np.flatnonzero(asked)
            if len(q):
                q_first = extreme_lines(x[q], a, probe)
                q_second = layout.second_lines(x[q], layout.second if wide else SECOND_PROBE)
                n1, n2 = q_first.shape[1], q_second.shape[1]
                q_line, q_second = np.repeat(q_first.ravel(), n2), np.repeat(q_second[:, None, :], n1, 1).ravel()
                times = layout.parts[q_line]
                q_row = np.repeat(np.repeat(q, n1 * n2), times)
                q_part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                groups.append((False, q_row, layout.keys(np.repeat(q_line, times), np.repeat(q_second, times), q_part)))
            for own, row, key in groups:
                for i in range(0, len(row), 8_192):
                    r = row[i : i + 8_192]
                    vec = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * dimension), len(r), [None, pa.py_buffer(np.ascontiguousarray(x[r]))]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(key[i : i + 8_192], pa.int64()), pa.array(np.full(len(r), own)), pa.array(ids[r], pa.int64()), pa.array(floors[r], pa.float32()), vec], ["cell", "stored", "id", "floor", "unit"])

    return run


class _Best:
    """The best ``k`` distinct ids of each query, updated block by block."""

    def __init__(self, queries: np.ndarray, k: int) -> None:
        self.k, self.queries = k, queries
        self.ids = [np.empty(0, np.int64)] * len(queries)
        self.cosines = [np.empty(0, np.float32)] * len(queries)

    def add(self, q: int, ids: np.ndarray, cosines: np.ndarray) -> None:
        other = ids != self.queries[q]
        ids, cosines = np.concatenate([self.ids[q], ids[other]]), np.concatenate([self.cosines[q], cosines[other]])
        near = 4 * self.k
        while len(ids) > near:
            # ties with the last place stay until ids decide; an id delivered often must not take the places of others
            kept = cosines >= np.partition(cosines, -near)[-near]
            if len(np.unique(ids[kept])) >= self.k:
                ids, cosines = ids[kept], cosines[kept]
                break
            near *= 4
        order = np.lexsort((ids, -cosines))
        ids, cosines = ids[order], cosines[order]
        _, first = np.unique(ids, return_index=True)
        first = np.sort(first)[: self.k]
        self.ids[q], self.cosines[q] = ids[first], cosines[first]

    def table(self) -> pa.RecordBatch:
        sizes = [len(i) for i in self.ids]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(self.queries, sizes), pa.int64()), pa.array(np.concatenate(self.ids or [np.empty(0, np.int64)]), pa.int64()), pa.array(np.concatenate(self.cosines or [np.empty(0)]).astype(np.float64), pa.float64())],
            ["query_id", "id", "cosine"],
        )


class _Block:
    """Vectors of a cell with one sorted array for each counted projection."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, counted: np.ndarray) -> None:
        self.ids, self.x = ids, x
        p = x @ counted
        order = np.argsort(p, axis=0, kind="stable")
        self.arrays = np.ascontiguousarray(np.take_along_axis(p, order, 0).T)
        self.order = np.ascontiguousarray(order.T)

    def search(self, best: _Best, asked: np.ndarray, k: int, counted: np.ndarray) -> None:
        """Count collisions in windows around each query, widen them while too little is near, verify."""
        h = asked @ counted
        m = counted.shape[1]
        bounds = []
        for radius in RADII:
            w = np.float32(radius * WIDTH_FACTOR)
            low = np.stack([np.searchsorted(self.arrays[j], h[:, j] - w, "left") for j in range(m)], 1)
            high = np.stack([np.searchsorted(self.arrays[j], h[:, j] + w, "right") for j in range(m)], 1)
            bounds.append((low.tolist(), high.tolist()))
        for q in range(len(asked)):
            for (low, high), radius in zip(bounds, RADII, strict=True):
                windows = [self.order[j, a:b] for j, (a, b) in enumerate(zip(low[q], high[q], strict=True))]
                found = np.flatnonzero(np.bincount(np.concatenate(windows), minlength=len(self.x)) >= THRESHOLD)
                cosines = self.x[found] @ asked[q]
                if radius == RADII[-1] or (cosines >= 1 - radius * radius / 2).sum() > k:
                    if len(found):
                        best.add(q, self.ids[found], cosines)
                    break


def _verify_all(best: _Best, ids: np.ndarray, x: np.ndarray, asked: np.ndarray, floors: np.ndarray, k: int) -> None:
    """All vectors of a block collide: its best ``k`` of each query that are better than the query's floor."""
    for i in range(0, len(asked), 1_024):
        cosines = asked[i : i + 1_024] @ x.T
        near = min(k + 1, len(ids))  # the query itself may be one of them
        least = np.maximum(np.partition(cosines, len(ids) - near, axis=1)[:, len(ids) - near], floors[i : i + 1_024])
        q, at = np.nonzero(cosines >= least[:, None])
        for j, s, e in zip(*_runs(q), strict=True):
            best.add(i + j, ids[at[s:e]], cosines[j, at[s:e]])


def _runs(values: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """The values of a sorted array, and where the run of each begins and ends."""
    if not len(values):
        return [], [], []
    starts = np.concatenate([[0], np.flatnonzero(np.diff(values)) + 1])
    return values[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(values)]


def _search(dimension: int, k: int, wide: bool):
    """Over rows sorted by cell, stored vectors before queries: each cell's best ``k`` of each query.

    The cell's vectors are held, in blocks; its queries only pass by. ``wide``: with an unbounded radius.
    """
    counted = _lines(dimension, COUNTED, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, blocks = None, []
        ids: list[np.ndarray] = []
        vecs: list[np.ndarray] = []

        def close() -> None:
            """The vectors gathered so far become a block, each id once."""
            if ids:
                own, first = np.unique(np.concatenate(ids), return_index=True)
                vectors = np.concatenate(vecs)[first]
                blocks.append((own, vectors) if wide else _Block(own, vectors, counted))
                ids.clear()
                vecs.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            cells = np.asarray(batch.column("cell"))
            stored = np.asarray(batch.column("stored"))
            row_ids = np.asarray(batch.column("id"))
            floors = np.asarray(batch.column("floor"))
            x = np.frombuffer(b"".join(batch.column("unit").to_pylist()), np.float32).reshape(-1, dimension)
            starts = np.concatenate([[0], np.flatnonzero((np.diff(cells) != 0) | (stored[1:] != stored[:-1])) + 1, [len(cells)]])
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                if cells[s] != current:
                    current = cells[s]
                    blocks.clear()
                    ids.clear()
                    vecs.clear()
                if stored[s]:
                    ids.append(row_ids[s:e])
                    vecs.append(x[s:e])
                    if sum(map(len, ids)) >= BLOCK:
                        close()
                else:
                    close()
                    if blocks:
                        own, first = np.unique(row_ids[s:e], return_index=True)
                        best = _Best(own, k)
                        for block in blocks:
                            if wide:
                                _verify_all(best, *block, x[s:e][first], floors[s:e][first], k)
                            else:
                                block.search(best, x[s:e][first], k, counted)
                        yield best.table()

    return run


def _search_sent(layout: _Layout, k: int, share: float, sent):
    """The last rehashing over vectors as they are read: the best ``k`` in a task of each query that was sent.

    A vector is compared with the queries that look under its most extreme line.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, floors, asked = sent.value
        floors, best = floors.copy(), _Best(queries, k)
        a = _lines(layout.dimension, layout.first // 2, 1)
        looks = []
        for i in range(0, len(asked), 1_024):
            lines = extreme_lines(asked[i : i + 1_024], a, max(PROBE, round(share * layout.first)))
            own = np.zeros((len(lines), layout.first), bool)
            np.put_along_axis(own, lines, True, 1)
            looks.append(np.packbits(own, axis=1))
        for batch in batches:
            places, x = unit_vectors(batch.column("vec"), layout.dimension)
            if not len(x):
                continue
            ids, line = np.asarray(batch.column("id"))[places], extreme_lines(x, a, 1)[:, 0]
            near = min(len(ids), k + 1 + len(ids) - len(np.unique(ids)))  # the query itself and repeated ids may be among them
            for i, packed in zip(range(0, len(asked), 1_024), looks, strict=True):
                cosines = asked[i : i + 1_024] @ x.T
                cosines[~np.unpackbits(packed, axis=1).view(bool)[:, line]] = -3
                least = floors[i : i + 1_024]
                if (least < -1.5).any():
                    least = np.maximum(np.partition(cosines, len(ids) - near, axis=1)[:, len(ids) - near], least)
                q, at = np.nonzero(cosines >= least[:, None])
                for j, s, e in zip(*_runs(q), strict=True):
                    best.add(i + j, ids[at[s:e]], cosines[j, at[s:e]])
                    if len(best.cosines[i + j]) == k:
                        floors[i + j] = max(floors[i + j], best.cosines[i + j][-1])
        yield best.table()

    return run


def _unsettled(rows: DataFrame, left: DataFrame, dimension: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Ids, floors and unit vectors of the queries ``left``, or None if they are more than ``SENT`` numbers."""
    most = SENT // dimension
    if not small(left, most):
        return None
    found = rows.join(F.broadcast(left), "id").select("id", "floor", "vec").distinct().limit(most + 1).toArrow()
    if found.num_rows > most:
        return None
    places, x = unit_vectors(found.column("vec"), dimension)
    return np.asarray(found.column("id"))[places], np.asarray(found.column("floor"))[places], x


def _best_of(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each query over all cells, each id once."""
    once = found.groupBy("query_id", "id").agg(F.max("cosine").alias("cosine"))
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def neighbours(vectors: DataFrame, queries: DataFrame, dimension: int, k: int = 10, share: float = WIDE) -> DataFrame:
    """``query_id, id, cosine, place``: the ``k`` most similar other vectors of each query.

    ``vectors``: ``id, vec``, whose usable rows are searched. ``queries``: ``id`` of the vectors to
    search for; ids without a usable vector have no rows. ``share``: of the lines that a query looks under which
    the windows don't settle; 1 is exact.
    """
    require(vectors, ["id", "vec"])
    asked = queries.select(F.col("id").cast("long").alias("id")).where("id IS NOT NULL").distinct()
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<float>").alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL")
    total = rows.count()
    layout = _Layout(dimension, total)
    # rows per line: at most FIRST_LINES numbers
    n = rows.select("vec").mapInArrow(_count_lines(dimension, layout.first), "line int, n long").groupBy("line").agg(F.sum("n").alias("n")).collect()
    layout.split({r.line: r.n for r in n})

    def search(queries: DataFrame, wide: float | None) -> DataFrame:
        """``queries``: ``id, floor``; only neighbours at least as near as the floor are of interest."""
        known = queries.withColumn("is_query", F.lit(True))
        marked = rows.join(broadcast_if_small(known, BROADCAST_IDS), "id", "left").select("id", "vec", F.coalesce("is_query", F.lit(False)).alias("is_query"), F.coalesce("floor", F.lit(-2.0).cast("float")).alias("floor"))
        cells = marked.mapInArrow(_spread(layout, wide), "cell long, stored boolean, id long, floor float, unit binary")
        return (
            cells.repartition(max(1, round(total * STORE / TASK_ROWS)), "cell")
            .sortWithinPartitions("cell", F.desc("stored"))
            .mapInArrow(_search(dimension, k, wide is not None), "query_id long, id long, cosine double")
        )

    nothing = F.lit(-2.0).cast("float")
    best = cut(_best_of(search(asked.withColumn("floor", nothing), None), k))
    # the last rehashing, for the queries that the last radius doesn't settle
    settled = best.where((F.col("place") == k) & (F.col("cosine") >= 1 - RADII[-1] ** 2 / 2)).select(F.col("query_id").alias("id"))
    floors = best.where(F.col("place") == k).select(F.col("query_id").alias("id"), F.col("cosine").cast("float").alias("floor"))
    left = cut(asked.join(settled, "id", "left_anti").join(floors, "id", "left").select("id", F.coalesce("floor", nothing).alias("floor")))
    if left.isEmpty():
        return best
    sent = _unsettled(rows, left, dimension)
    if sent is None:
        last = search(left, share)
    else:
        last = spread(rows).mapInArrow(_search_sent(layout, k, share, rows.sparkSession.sparkContext.broadcast(sent)), "query_id long, id long, cosine double")
    return _best_of(best.select("query_id", "id", "cosine").unionByName(last), k)


def usable_dimension(stats: DataFrame) -> list[int]:
    """The distinct projected dimensions; vectors of different length are never neighbours."""
    return sorted(r[0] for r in stats.where("projected_dimension > 0").select("projected_dimension").distinct().collect())


def patch_neighbours(patches: DataFrame, stats: DataFrame, queries: DataFrame, k: int = 10, share: float = WIDE) -> DataFrame:
    """``query_id, id, cosine, place`` over all patches whose length is their category's dimension."""
    require(patches, ["patch_id", "category", "vec"])
    dims = stats.where("category IS NOT NULL AND projected_dimension > 0").groupBy("category").agg(F.max("projected_dimension").alias("dimension"))
    fit = patches.select(F.col("patch_id").alias("id"), "category", "vec").join(broadcast_if_small(dims), "category").where(F.size("vec") == F.col("dimension"))
    out = None
    for dimension in usable_dimension(stats):
        part = neighbours(fit.where(F.col("dimension") == dimension).select("id", "vec"), queries, dimension, k, share)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = neighbours(fit.select("id", "vec"), queries.limit(0), 1, k)
    return out

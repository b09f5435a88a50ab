"""Reproducible sample that stays as the data grows: a persisted selection ledger.

The ledger holds the drawn keys of each (experiment, category). A draw keeps every earlier key by
join and fills the growth quotas that are still open from keys the ledger doesn't hold, lowest hash
priority first. The quota grows with the number of distinct records that have arrived: slot ``k`` of
``quick_train`` opens once about ``k + SPREAD * k² / (2 * quick_train)`` have, the last one once about 3.5 times
``quick_train`` have (``A``); from then on each doubling of the arrivals opens ``GROWTH`` of ``quick_train`` more slots, so the
sample stays about as large as asked for and no record comes too late to be drawn. A slot is filled by
the unseen key of lowest priority (a hash of seed, category and key) among all that had arrived when it opened.

So a draw depends only on what had arrived by then, a draw without a ledger replays those before it, and each is part of
every later one: a new record can win no slot that was ever filled. A record arrives with its earliest delivery; later deliveries of its key change
nothing. Arrivals at the same instant are ordered by an unseeded hash of the key. Nothing depends on row order or partitioning.

Scaling: arrivals are numbered in ranges (a category with a third of all rows is many ranges). What goes to the replay of a category are the
first ``A`` arrivals and, of each later doubling, as many keys of lowest priority as the quota has slots (the limit is applied in every map
task): no other key could be drawn. Both are bounded by ``quick_train`` and the logarithm of the arrivals, and no arrival is left out of consideration.

Defined results: rows without key, category or arrival time are not drawn, nor is any row whose
split is not the asked one (trimmed, in lower case). Null or negative quotas draw nothing. Empty
tables give an empty sample. A ledger's keys stay even if the records have none of them. Further columns are ignored.
"""

from __future__ import annotations

import heapq
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from normspark.functions import ordered
from normspark.session import broadcast_if_small, checkpoint_dir, cut, require
from normspark.sources import sinks

#: Arrivals that the last slots of ``quick_train`` wait for, each, about; and the share of it that each doubling adds.
SPREAD, GROWTH = 6, 0.05
LEDGER = ["experiment", "category", "slot", "sample_id", "arrived_at"]


def slot_table(settings: DataFrame, spread: int = SPREAD) -> DataFrame:
    """``experiment, seed, quota, first, per_doubling, opens``: the arrivals at which each slot of the quota opens, in order.

    ``first`` (``A``) is the last of them; each doubling from there opens ``per_doubling`` more.
    """
    slots = settings.where("name IS NOT NULL AND quick_train > 0").groupBy(F.col("name").alias("experiment")).agg(F.max(F.struct("quick_train", F.coalesce(F.col("seed"), F.lit(0)).cast("long").alias("seed"))).alias("s"))
    slots = slots.select("experiment", "s.seed", F.col("s.quick_train").alias("quota"))
    widths = f"transform(sequence(1, quota), k -> CAST(1 + floor({spread} * (k - 1) / quota) AS BIGINT))"
    opens = f"transform(sequence(1, quota), k -> aggregate(slice({widths}, 1, k), 0L, (a, x) -> a + x))"
    return slots.withColumn("opens", F.expr(opens)).withColumns({"first": F.element_at("opens", -1), "per_doubling": F.greatest(F.lit(1), F.round(F.col("quota") * F.lit(GROWTH)).cast("int"))})


def arrivals(records: DataFrame, split: str) -> DataFrame:
    """The distinct records of each category in the order of arrival: ``category, sample_id, arrived_at, arrival``."""
    require(records, ["sample_id", "category", "split", "ingested_at"])
    first = (
        records.where(F.col("sample_id").isNotNull() & F.col("category").isNotNull() & F.col("ingested_at").isNotNull())
        .groupBy("sample_id")
        .agg(F.min(F.struct("ingested_at", "category", "split")).alias("d"))
        .where(F.lower(F.trim("d.split")) == split)
        .select("sample_id", "d.category", F.col("d.ingested_at").alias("arrived_at"), F.sha2("sample_id", 256).alias("_h"))
    )
    return ordered.places(first, ["category"], ["arrived_at", "_h", "sample_id"], "arrival").drop("_h")


def replay(opens: list[tuple[int, int]], arrived: list[tuple[int, str, object]], held: set[int]) -> list[tuple[int, object]]:
    """(slot, record) of the slots that open and aren't held.

    ``opens``: (arrivals, slots) in order; ``arrived``: (arrival, priority, record) in order.
    """
    waiting: list[tuple[str, int, object]] = []
    drawn, slot, at = [], 0, 0
    for moment, slots in opens:
        while at < len(arrived) and arrived[at][0] <= moment:
            number, priority, record = arrived[at]
            heapq.heappush(waiting, (priority, number, record))
            at += 1
        for _ in range(slots):
            slot += 1
            if slot not in held and waiting:
                drawn.append((slot, heapq.heappop(waiting)[2]))
    return drawn


def _fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    held = {int(s) for s in pdf["slot"] if not pd.isna(s)}
    rows = pdf[pdf["slot"].isna()].sort_values("arrival")
    drawn = []
    if len(rows):
        own = rows.iloc[0]
        opens, moment = [(int(a), 1) for a in own.opens], int(own["first"]) * 2
        while moment <= own.arrived:
            opens.append((moment, int(own.per_doubling)))
            moment *= 2
        opens = [(a, n) for a, n in opens if a <= own.arrived]
        drawn = replay(opens, list(zip(rows["arrival"], rows["priority"], zip(rows["sample_id"], rows["arrived_at"], strict=True), strict=True)), held)
    out = [(*key, slot, *record) for slot, record in drawn] + list(zip(*(pdf[pdf["slot"].notna()][c] for c in LEDGER), strict=True))
    return pd.DataFrame(out, columns=LEDGER)


def draw(records: DataFrame, settings: DataFrame, ledger: DataFrame | None = None, split: str = "train", spread: int = SPREAD) -> DataFrame:
    """The ledger after a draw: ``experiment, category, slot, sample_id, arrived_at``.

    ``ledger`` is what an earlier draw returned and the caller persisted (``publish``). Its rows are all kept;
    only slots that it leaves open are filled, only with keys it doesn't hold.
    """
    require(settings, ["name", "seed", "quick_train"])
    slots = slot_table(settings, spread)
    seen = cut(arrivals(records, split))
    total = seen.groupBy("category").agg(F.max("arrival").alias("arrived"))
    offered = seen.crossJoin(broadcast_if_small(slots)).withColumn("priority", F.sha2(F.concat_ws(":", F.col("seed").cast("string"), "category", "sample_id"), 256))
    if ledger is not None:
        ledger = ledger.select(*LEDGER)
        offered = offered.join(ledger.select("experiment", "category", "sample_id"), ["experiment", "category", "sample_id"], "left_anti")
    # the doubling in which a record arrived: 0 for the first A
    doubling = F.when(F.col("arrival") > F.col("first"), F.length(F.bin(F.expr("(arrival - 1) DIV first")))).otherwise(0)
    doublings = F.length(F.bin(F.expr("arrived DIV first"))) - 1
    offered = offered.withColumn("_d", doubling).join(broadcast_if_small(total), "category")
    lowest = Window.partitionBy("experiment", "category", "_d").orderBy("priority", "sample_id")
    able = offered.withColumn("_r", F.row_number().over(lowest)).where((F.col("_d") == 0) | (F.col("_r") <= F.col("quota") + F.col("per_doubling") * F.greatest(doublings, F.lit(0))))
    moment = dict(records.dtypes)["ingested_at"]
    rows = able.select("experiment", "category", F.lit(None).cast("int").alias("slot"), "sample_id", "arrived_at", "arrival", "priority", "opens", "first", "per_doubling", "arrived")
    if ledger is not None:
        rows = rows.unionByName(ledger, allowMissingColumns=True)
    return rows.groupBy("experiment", "category").applyInPandas(_fill, f"experiment string, category string, slot int, sample_id string, arrived_at {moment}")


def publish(ledger: DataFrame, path: str) -> DataFrame:
    """The ledger written whole under ``path`` (an older one is set aside), and read back."""
    sinks.publish(ledger.select(*LEDGER), path)
    return read(ledger.sparkSession, path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The ledger that an earlier draw published."""
    return spark.read.parquet(path).select(*LEDGER)


def ledger_growth(records: DataFrame, settings: DataFrame, at: list, path: str | None = None) -> DataFrame:
    """The ledger after draws at the given moments, each keeping the one before, and at the end.

    Each draw is published under ``path`` (a folder of its own in the shared checkpoint folder where none is given), and the next one reads it from there.
    ``drawn_by`` is the number of the draw (from 0) that first held the record.
    """
    spark = records.sparkSession
    path = path or f"{checkpoint_dir(spark)}/ledger-{uuid.uuid4().hex}"
    ledger, marks = None, []
    for i, moment in enumerate([*at, None]):
        part = records if moment is None else records.where(F.col("ingested_at") <= F.lit(moment))
        ledger = publish(draw(part, settings, ledger), f"{path}/draw-{i:04}")
        marks.append(ledger.withColumn("drawn_by", F.lit(i)))
    out = marks[0]
    for after in marks[1:]:
        out = out.unionByName(after)
    return out.groupBy(*LEDGER).agg(F.min("drawn_by").alias("drawn_by"))

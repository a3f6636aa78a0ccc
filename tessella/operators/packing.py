"""Best-fit packing of token sequences into rows of T + 1 ids, and the training pairs of rows."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pack(docs: Iterable[list[int]], capacity: int, buffer: int = 1000, batch: int = 128) -> Iterator[list[int]]:
    """Full rows of `capacity` ids.

    Before each placement the buffer is filled, by batches, to `buffer` documents or more. The longest document
    that fits goes next, the first of equals; if none fits, the shortest is cropped and its tail dropped. At
    the end of the documents the last row that isn't full is dropped.
    """
    source, lengths, queues, held, over = iter(docs), [], {}, 0, False

    def fill() -> None:
        nonlocal held, over
        while held < buffer and not over:
            for _ in range(batch):
                d = next(source, None)
                if d is None:
                    over = True
                    break
                if not d:
                    continue
                if len(d) not in queues:
                    insort(lengths, len(d))
                    queues[len(d)] = deque()
                queues[len(d)].append(d)
                held += 1

    def take(n: int) -> list[int]:
        nonlocal held
        d = queues[n].popleft()
        if not queues[n]:
            del queues[n]
            lengths.remove(n)
        held -= 1
        return d

    row: list[int] = []
    while True:
        fill()
        if not held:
            return
        room = capacity - len(row)
        i = bisect_right(lengths, room)
        row += take(lengths[i - 1]) if i else take(lengths[0])[:room]
        if len(row) == capacity:
            yield row
            row = []


#: Neighbouring keys that are packed together: a group's size has this bound, whatever the table's.
BLOCK = 2048


def packed_rows(docs: DataFrame, key: str, tokens: str, length: int, block: int = BLOCK) -> DataFrame:
    """(pack_group, row_id, tokens): each block of keys packs its documents in key order by itself, so results don't depend on the cluster."""

    def run(k: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows = list(pack((list(map(int, x)) for x in frame.sort_values(key)[tokens]), length + 1))
        return pd.DataFrame({"pack_group": k[0], "row_id": range(len(rows)), "tokens": rows}) if rows else pd.DataFrame({"pack_group": [], "row_id": [], "tokens": []})

    d = docs.where(F.col(key).isNotNull()).select(key, tokens).withColumn("pack_group", F.floor(F.col(key) / block).cast("long"))
    return d.groupBy("pack_group").applyInPandas(run, "pack_group long, row_id long, tokens array<int>")


def training_pairs(rows: DataFrame) -> DataFrame:
    n = F.size("tokens") - 1
    return rows.withColumns({"inputs": F.slice("tokens", 1, n), "targets": F.slice("tokens", 2, n)})


def epochs(docs: DataFrame, n: int) -> DataFrame:
    """Each row once for every epoch, numbered from 1."""
    return docs.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(n))))


def char_budget(docs: DataFrame, order: str, text: str, budget: int, doc_cap: int = 10_000, block: int = 1024) -> DataFrame:
    """Documents in order until their capped characters reach the budget, the one that crosses it included.

    A null text has no characters; rows without an order are left out and cost nothing.
    Sums of blocks of ids are added up first and only within a block row by row; the single-task
    window sees a row for each block of `block` ids.
    """
    from pyspark.sql import Window

    d = docs.where(F.col(order).isNotNull()).withColumn(text, F.substring(text, 1, doc_cap)).withColumn("_n", F.coalesce(F.length(text), F.lit(0))).withColumn("_b", F.floor(F.col(order) / block))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = d.groupBy("_b").agg(F.sum("_n").alias("_s")).withColumn("_before", F.coalesce(F.sum("_s").over(before), F.lit(0))).where(F.col("_before") < budget).select("_b", "_before")
    within = Window.partitionBy("_b").orderBy(order, text).rowsBetween(Window.unboundedPreceding, -1)
    d = d.join(sums, "_b").withColumn("chars_before", F.col("_before") + F.coalesce(F.sum("_n").over(within), F.lit(0)))
    return d.where(F.col("chars_before") < budget).drop("_n", "_b", "_before")

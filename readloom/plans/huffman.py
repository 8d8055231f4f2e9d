"""Huffman code lengths of small histograms, one group at a time."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lengths(counts: dict[int, int]) -> dict[int, int]:
    """Code length of each symbol with a count. Of equal counts the smaller symbol is taken first; one symbol gets length 1."""
    present = sorted((n, s) for s, n in counts.items() if n > 0)
    if len(present) == 1:
        return {present[0][1]: 1}
    heap: list[tuple[int, int, list[int]]] = [(n, s, [s]) for n, s in present]
    heapq.heapify(heap)
    out = dict.fromkeys((s for _, s in present), 0)
    fresh = max(out, default=0) + 1
    while len(heap) > 1:
        (n, _, a), (m, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        for s in a + b:
            out[s] += 1
        heapq.heappush(heap, (n + m, fresh, a + b))
        fresh += 1
    return out


def code_lengths(histogram: DataFrame, by: str, symbol: str, count: str) -> DataFrame:
    """by, symbol, code_length. A group has as many rows as its alphabet has symbols."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        found = lengths(dict(zip(rows["symbol"].tolist(), rows["n"].tolist())))
        return pd.DataFrame({"by": rows["by"].iloc[0], "symbol": list(found), "code_length": list(found.values())})

    rows = histogram.select(F.col(by).cast("long").alias("by"), F.col(symbol).cast("long").alias("symbol"), F.col(count).cast("long").alias("n"))
    out = rows.groupBy("by").applyInPandas(one, "by long, symbol long, code_length int")
    return out.select(F.col("by").alias(by), F.col("symbol").alias(symbol), "code_length")

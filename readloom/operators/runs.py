"""Operators that depend on the order of rows: deltas, runs, and what follows what. A window never crosses a block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from readloom.operators import bytescan as B
from readloom.plans.names import free_name

#: The most rows that one stored run holds, of qualities and of tag values.
QUALITY_RUN, VALUE_RUN = 255, 256


def islands(rows: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """rows with the column run: from 0, one more wherever the value differs from the row before."""
    w = W.Window.partitionBy(*by).orderBy(*order)
    name = free_name(rows, "break")
    # The first row of a group begins a run, null or not.
    begins = F.lag(F.lit(1)).over(w).isNull() | ~F.col(value).eqNullSafe(F.lag(value).over(w))
    broke = rows.withColumn(name, begins.cast("int"))
    return broke.withColumn("run", F.sum(name).over(w.rowsBetween(W.Window.unboundedPreceding, 0)) - 1).drop(name)


def runs(rows: DataFrame, value: str, by: list[str], order: list[str], longest: int | None = None) -> DataFrame:
    """One row for each run of equal values: by, run, part, value, length. Runs over `longest` are stored in parts of it."""
    marked = islands(rows, value, by, order)
    w = W.Window.partitionBy(*by, "run").orderBy(*order)
    part = F.floor((F.row_number().over(w) - 1) / longest) if longest else F.lit(0)
    return marked.withColumn("part", part.cast("bigint")).groupBy(*by, "run", "part").agg(F.first(value).alias(value), F.count("*").alias("length"))


def runs_by_chunk(rows: DataFrame, value: str, by: list[str], order: list[str], chunk: Column) -> DataFrame:
    """runs() without `longest`, for groups that may hold a large share of all rows: by, run, part (0), value, length.

    chunk: a number that doesn't fall along the order of a group, such as an id divided by a constant. Only the rows of a chunk
    meet in a task; of each chunk one row, its first and last value and its number of runs, says where its runs count on.
    """
    cut = rows.withColumn("chunk", chunk)
    local = runs(cut, value, [*by, "chunk"], order).drop("part")
    ends = local.groupBy(*by, "chunk").agg(F.min_by(value, "run").alias("head"), F.max_by(value, "run").alias("tail"), F.count("*").alias("n"))
    w = W.Window.partitionBy(*by).orderBy("chunk")
    goes_on = F.coalesce(F.lag(F.lit(1)).over(w), F.lit(0)).cast("boolean") & F.lag("tail").over(w).eqNullSafe(F.col("head"))
    ends = ends.withColumn("less", F.when(goes_on, 1).otherwise(0))
    so_far = w.rowsBetween(W.Window.unboundedPreceding, 0)
    base = ends.select(*by, "chunk", (F.sum("n").over(so_far) - F.col("n") - F.sum("less").over(so_far)).alias("base"))
    whole = local.join(base, [*by, "chunk"]).withColumn("run", F.col("base") + F.col("run"))
    out = whole.groupBy(*by, "run").agg(F.first(value).alias(value), F.sum("length").alias("length"))
    return out.select(*by, "run", F.lit(0).cast("bigint").alias("part"), value, "length")


def quality_runs(reads: DataFrame, offset: int = 33) -> DataFrame:
    """Runs of equal qualities over a block's reads put together: block_id, run, part, q, length (stored: one less)."""
    return B.quality_runs(reads, offset, QUALITY_RUN)


def run_transitions(quality_runs: DataFrame) -> DataFrame:
    """block_id, previous, q, n: which quality's run follows which. The first run of a block follows its least quality."""
    w = W.Window.partitionBy("block_id")
    before = F.coalesce(F.lag("q").over(w.orderBy("run", "part")), F.min("q").over(w))
    return quality_runs.select("block_id", before.alias("previous"), "q").groupBy("block_id", "previous", "q").agg(F.count("*").alias("n"))


def run_lengths(quality_runs: DataFrame) -> DataFrame:
    return quality_runs.groupBy("block_id", "q", (F.col("length") - 1).alias("stored")).agg(F.count("*").alias("n"))


def expand_runs(runs: DataFrame, value: str, by: list[str]) -> DataFrame:
    """The inverse of runs(): a row for each value, with its position in the group."""
    w = W.Window.partitionBy(*by).orderBy("run", "part").rowsBetween(W.Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("length").over(w), F.lit(0))
    one = runs.withColumn("_start", start).select(*by, value, "_start", F.posexplode(F.expr("array_repeat(0, int(length))")).alias("i", "_"))
    return one.select(*by, (F.col("_start") + F.col("i")).alias("at"), value)


def deltas(rows: DataFrame, value: str, by: list[str], order: str) -> DataFrame:
    """rows with the column delta: the value less the one before; null for the first."""
    return rows.withColumn("delta", F.col(value) - F.lag(value).over(W.Window.partitionBy(*by).orderBy(order)))

"""Positions and neighbouring rows inside series of any length.

A window over a whole series runs in one task. Here every window is partitioned by
(series, stretch of the series), so the longest series spreads over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelag.staging import stage

STRETCH = 1 << 18


def with_halo(df: DataFrame, before: int = 0, after: int = 0, stretch: int = STRETCH):
    """Cut each series into stretches of consecutive ``i`` and copy the ``before`` rows
    ahead of a stretch and the ``after`` rows behind it into that stretch.

    Returns (rows with ``_stretch`` and ``_own``, window ordered by ``i``). Evaluate window
    functions reaching at most that far, then keep rows with ``_own``."""
    stretch = max(stretch, 2 * (before + after), 1)
    home, place = f"i div {stretch}", f"i % {stretch}"
    copies = [home]
    if before:
        copies.append(f"CASE WHEN {place} >= {stretch - before} THEN {home} + 1 END")
    if after:
        copies.append(f"CASE WHEN {place} < {after} AND i >= {stretch} THEN {home} - 1 END")
    where = f"explode(array_compact(array({', '.join(copies)})))" if len(copies) > 1 else home
    spread = df.selectExpr("*", f"{where} AS _stretch").selectExpr("*", f"_stretch = {home} AS _own")
    return spread, Window.partitionBy("series_id", "_stretch").orderBy("i")


def dense_rank_of(
    df: DataFrame, keys: list[str], value: str, tiebreak: str, name: str = "i", total: str | None = None
) -> DataFrame:
    """0-based position of each row when every key group, or without ``keys`` the whole table, is
    sorted by (value, tiebreak); missing values first, NaN last. ``total``, if given, names a column for the number of
    rows of the key group.

    Rows are range-partitioned by (keys, value, tiebreak), so neither a hot key nor a hot
    value fills a task, sorted, and staged with their place in the partition. Staging pins
    the partitions: the cuts come from a sample, and would not be the same when computed
    twice. All that is left is to add up the counts of earlier partitions per key."""
    keys = list(keys)
    order = list(dict.fromkeys([*keys, value, tiebreak]))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stage(
        df.repartitionByRange(tasks, *order)
        .sortWithinPartitions(*order)
        .selectExpr("*", "spark_partition_id() AS _part", f"monotonically_increasing_id() & {(1 << 33) - 1}L AS _row")
    )
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(*keys, "_part").agg(F.expr("min(_row) AS _from"), F.expr("count(*) AS _rows"))
        .select(
            *[F.col(k).alias(f"_key{j}") for j, k in enumerate(keys)], F.col("_part").alias("_at"),
            (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_from")).alias("_shift"),
            F.sum("_rows").over(Window.partitionBy(*keys)).alias("_total"),
        )
    )
    same = [F.col(k).eqNullSafe(F.col(f"_key{j}")) for j, k in enumerate(keys)]
    columns = [F.col(f"`{c}`") for c in df.columns]
    return placed.join(starts, [F.col("_part") == F.col("_at"), *same]).select(
        *columns, (F.col("_row") + F.col("_shift")).alias(name), *([F.col("_total").alias(total)] if total else [])
    )

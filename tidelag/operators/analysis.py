"""Tables made from skill rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

POINT = ["series_id", "E", "tau", "L"]


def convergence(skill: DataFrame) -> DataFrame:
    """Skill against library size: mean and spread of rho over the draws of a grid point."""
    return skill.groupBy(*POINT).agg(
        F.count(F.lit(1)).alias("draws"),
        F.avg("rho").alias("mean_rho"),
        F.stddev_pop("rho").alias("std_rho"),
        F.avg("rho_nonneg").alias("mean_rho_nonneg"),
        F.avg("mae").alias("mean_mae"),
    )


def mean_at_max_l(skill: DataFrame, keys=("series_id", "E", "tau")) -> DataFrame:
    """Mean of rho_nonneg over the draws at the largest library size of each group."""
    means = skill.groupBy(*keys, "L").agg(F.avg("rho_nonneg").alias("mean_rho"))
    best = F.max(F.struct("L", "mean_rho")).alias("_b")
    return means.groupBy(*keys).agg(best).select(*keys, F.col("_b.L").alias("L"), F.col("_b.mean_rho").alias("mean_rho"))


def density(skill: DataFrame, value: str = "rho", bins: int = 100, keys=("series_id", "E", "tau")) -> DataFrame:
    """Counts on a grid of library size x ``value``. Columns keys, l_bin, value_bin, n.

    The step between library sizes is the second gap in their sorted list (the first may be
    odd), or the only gap; there are max(L) / step bins over the range of L and ``bins``
    over the range of the value. The top end belongs to the last bin."""
    keys = list(keys)
    # ``skill`` is read once; library sizes and the range of values go along with its rows
    whole = Window.partitionBy(*keys)
    counted = skill.groupBy(*keys, "L", value).agg(F.count(F.lit(1)).alias("_n"))
    sizes = F.array_sort(F.collect_set("L").over(whole))
    second = F.try_element_at(sizes, F.lit(3)) - F.try_element_at(sizes, F.lit(2))
    first = F.try_element_at(sizes, F.lit(2)) - F.try_element_at(sizes, F.lit(1))
    counted = counted.select(
        "*", F.coalesce(second, first, F.lit(1)).alias("_step"), F.min("L").over(whole).alias("_lo_l"),
        F.max("L").over(whole).alias("_hi_l"), F.min(value).over(whole).alias("_lo"), F.max(value).over(whole).alias("_hi"),
    )

    def bin_of(x, lo, hi, count):
        width = (hi - lo) / count
        return F.when(width > 0, F.least(F.floor((x - lo) / width), F.ceil(count) - 1)).otherwise(F.lit(0)).cast("int")

    l_bins = F.greatest(F.col("_hi_l") / F.col("_step"), F.lit(1.0))
    return (
        counted.where(F.col(value).isNotNull())
        .select(
            *keys, "_n",
            bin_of(F.col("L"), F.col("_lo_l"), F.col("_hi_l"), l_bins).alias("l_bin"),
            bin_of(F.col(value), F.col("_lo"), F.col("_hi"), F.lit(float(bins))).alias("value_bin"),
        )
        .groupBy(*keys, "l_bin", "value_bin").agg(F.sum("_n").alias("n"))
    )


def pivot_mean(means: DataFrame, E, row: str = "width", value: str = "mean_rho", keys=("series_id",)) -> DataFrame:
    """One row per ``row`` value, one column E_<e> per embedding dimension. ``E`` is given,
    so no pass is spent on finding the column names."""
    wide = means.groupBy(*keys, row).pivot("E", list(E)).agg(F.first(value))
    return wide.select(*keys, row, *[F.col(f"`{e}`").alias(f"E_{e}") for e in E])


def unpivot_mean(wide: DataFrame, row: str = "width", keys=("series_id",)) -> DataFrame:
    """pivot_mean back to long form: row, variable, value."""
    columns = [c for c in wide.columns if c not in (row, *keys)]
    return wide.unpivot([*keys, row], columns, "variable", "value")


def compare_skill(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean rho of two result sets side by side; grid points missing on one side stay."""
    left = convergence(a).select(*POINT, F.col("draws").alias("draws_a"), F.col("mean_rho").alias("mean_a"))
    right = convergence(b).select(*POINT, F.col("draws").alias("draws_b"), F.col("mean_rho").alias("mean_b"))
    return left.join(right, POINT, "full_outer").withColumn("difference", F.col("mean_b") - F.col("mean_a"))


def runtime_compare(runs: DataFrame, a: str, b: str, key: str = "lib_size") -> DataFrame:
    """Two run times per library size with their totals and speed-up. Columns are taken as
    ``<a>_query``, ``<a>_overhead`` and so on; the overhead is part of the total."""
    def total(name):
        return F.col(f"{name}_query") + F.col(f"{name}_overhead")

    return runs.select(
        key, F.col(f"{a}_query").alias("query_a"), F.col(f"{b}_query").alias("query_b"),
        total(a).alias("total_a"), total(b).alias("total_b"),
        F.try_divide(F.col(f"{a}_query"), F.col(f"{b}_query")).alias("query_speedup"),
        F.try_divide(total(a), total(b)).alias("total_speedup"),
    )


def runtime_totals(compared: DataFrame) -> DataFrame:
    """Sums over all library sizes, the overhead counted once."""
    once = [F.max(F.col(f"total_{s}") - F.col(f"query_{s}")) for s in "ab"]
    return compared.agg(
        (F.sum("query_a") + once[0]).alias("total_a"), (F.sum("query_b") + once[1]).alias("total_b")
    ).withColumn("speedup", F.try_divide("total_a", "total_b"))

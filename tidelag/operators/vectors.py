"""Vector tables: all-pairs measures, row against row, and sort order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelag.operators.neighbors import pair_distances
from tidelag.operators.ordering import dense_rank_of


def _as_manifold(df: DataFrame, id: str, vec: str) -> DataFrame:
    rows = df.select(
        F.lit("all").alias("series_id"), F.lit(1).alias("E"), F.lit(1).alias("tau"), F.col(id).cast("bigint").alias("i"),
        F.lit(None).cast("double").alias("y"), F.col(vec).cast("array<double>").alias("v"),
    )
    return dense_rank_of(rows, ["series_id"], "i", "i", "pos", total="n")


def _pairwise(df: DataFrame, id: str, vec: str, measure: str, summarise: bool) -> DataFrame:
    points = _as_manifold(df, id, vec)
    width = points.agg(F.max(F.size("v"))).first()[0] or 1 if summarise else 1
    cells = pair_distances(points, summarise, measure, str(width)).drop("series_id", "E", "tau").withColumnRenamed("p", id)
    if not summarise:
        return cells
    return cells.selectExpr(f"`{id}`", "pairs", "try_divide(total, pairs) AS mean", "low", "high")


def pairwise_euclidean(df: DataFrame, id: str, vec: str, summarise: bool = False) -> DataFrame:
    """Distance of every row to every other row: id, q_block, and arrays q, d over a block of
    other rows. With ``summarise``: id, pairs, mean, low, high."""
    return _pairwise(df, id, vec, "euclidean", summarise)


def pairwise_pearson(df: DataFrame, id: str, vec: str, summarise: bool = False) -> DataFrame:
    """As pairwise_euclidean with the Pearson correlation of the two vectors; 0 when one of
    them is constant."""
    return _pairwise(df, id, vec, "pearson", summarise)


def array_pearson(a: Column, b: Column) -> Column:
    """Pearson correlation of two arrays; 0 when the denominator is at most 1e-10. Values are
    taken from their means, and one pass adds up all three sums."""
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)
    ma, mb = mean(a), mean(b)
    pairs = F.zip_with(a, b, lambda v, w: F.struct((v - ma).alias("v"), (w - mb).alias("w")))
    zero = F.struct(F.lit(0.0).alias("aa"), F.lit(0.0).alias("bb"), F.lit(0.0).alias("ab"))
    sums = F.aggregate(
        pairs, zero,
        lambda s, p: F.struct(
            (s["aa"] + p["v"] * p["v"]).alias("aa"), (s["bb"] + p["w"] * p["w"]).alias("bb"), (s["ab"] + p["v"] * p["w"]).alias("ab")
        ),
    )
    def ratio(s: Column) -> Column:
        spread = F.sqrt(s["aa"] * s["bb"])
        return F.when(spread * F.size(a) > 1e-10, F.try_divide(s["ab"], spread)).otherwise(F.lit(0.0))

    return F.element_at(F.transform(F.array(sums), ratio), 1)


def rowwise_pearson(a: DataFrame, b: DataFrame, id: str, vec: str) -> DataFrame:
    """Correlation of vector A[id] with B[id]: id, rho."""
    left = a.select(id, F.col(vec).cast("array<double>").alias("_a"))
    right = b.select(id, F.col(vec).cast("array<double>").alias("_b"))
    return left.join(right, id).select(id, array_pearson(F.col("_a"), F.col("_b")).alias("rho"))


def argsort(df: DataFrame, keys, value: str, idx: str) -> DataFrame:
    """The order that sorts ``value`` (ties by ``idx``): keys, rank (from 0), idx, value."""
    keys = list(keys)
    return dense_rank_of(df.select(*keys, value, idx), keys, value, idx, "rank").select(
        *keys, "rank", idx, value
    )

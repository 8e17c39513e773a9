"""Series to lagged vectors, rolling sums and shifted targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelag.operators.ordering import STRETCH, with_halo

#: Steps of a series that are embedded together; vectors do not depend on it.
EMBEDDED = 1 << 15


def with_length(series: DataFrame) -> DataFrame:
    """Add column ``n``, the number of rows of the series, unless it is there already.
    Sources that know it while building a series set it, which saves this pass."""
    if "n" in series.columns:
        return series
    return series.join(series.groupBy("series_id").agg(F.count(F.lit(1)).alias("n")), "series_id")


def embed(series: DataFrame, pairs, drop_missing: bool = False, stretch: int = EMBEDDED) -> DataFrame:
    """Lag vectors ``v = [x(i), x(i-tau), ...]`` for every (E, tau) in ``pairs``.

    Columns: series_id, E, tau, n, i, pos, v, y. A manifold has ``n`` points, and ``pos``
    numbers them from 0. All pairs share one pass over the series and one shuffle."""
    lags = sorted({j * tau for E, tau in pairs for j in range(E)})
    rows, w = with_halo(
        with_length(series).select("series_id", "n", "i", "x", "y"), before=max(lags), stretch=stretch
    )
    lagged = rows.select(
        "series_id", "n", "i", "y", "_own",
        *[(F.lag("x", lag).over(w) if lag else F.col("x")).alias(f"_x{lag}") for lag in lags],
    ).where("_own")
    choices = ", ".join(
        f"struct({E} AS E, {tau} AS tau, array({', '.join(f'_x{j * tau}' for j in range(E))}) AS v)" for E, tau in pairs
    )
    points = valid_points(lagged.selectExpr("series_id", "n", "i", "y", f"inline(array({choices}))")).selectExpr(
        "series_id", "E", "tau", "n - (E - 1) * tau AS n", "i", "i - (E - 1) * tau AS pos", "v", "y"
    )
    return _renumber(drop_invalid(points), stretch) if drop_missing else points


def valid_points(points: DataFrame) -> DataFrame:
    """Points whose lag vector reaches back no further than the start of the series."""
    return points.where("i >= (E - 1) * tau")


def drop_invalid(points: DataFrame) -> DataFrame:
    """Drop lag vectors with a missing coordinate."""
    return points.where(~F.exists("v", lambda a: a.isNull() | F.isnan(a)))


def _renumber(points: DataFrame, stretch: int) -> DataFrame:
    keys = ["series_id", "E", "tau"]
    points = points.withColumn("_stretch", F.expr(f"i div {stretch}"))
    by_stretch = Window.partitionBy(*keys).orderBy("_stretch")
    offsets = (
        points.groupBy(*keys, "_stretch").agg(F.count(F.lit(1)).alias("_rows"))
        .select(
            *keys, "_stretch",
            F.coalesce(F.sum("_rows").over(by_stretch.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
            F.sum("_rows").over(Window.partitionBy(*keys)).alias("n"),
        )
    )
    inside = Window.partitionBy(*keys, "_stretch").orderBy("i")
    return (
        points.drop("n").withColumn("_r", F.row_number().over(inside))
        .join(offsets, [*keys, "_stretch"])
        .select(*keys, "n", "i", (F.col("_before") + F.col("_r") - 1).alias("pos"), "v", "y")
    )


def lengths(series: DataFrame, pairs) -> DataFrame:
    """Manifold sizes without building vectors: series_id, E, tau, series_n, n."""
    grid = ", ".join(f"struct({E} AS E, {tau} AS tau)" for E, tau in pairs)
    return (
        with_length(series).where("i = 0")
        .selectExpr("series_id", "n AS series_n", f"inline(array({grid}))")
        .selectExpr("*", "series_n - (E - 1) * tau AS n")
        .where("n > 0")
    )


def manifold_lengths(manifold: DataFrame) -> DataFrame:
    """Manifold sizes read from the points, for manifolds with dropped vectors."""
    return manifold.where("pos = 0").select("series_id", "E", "tau", F.col("n").alias("series_n"), "n")


#: Sums of this many values or fewer, if they are not exact, are added value by value.
NARROW = 64


class _Running:
    """Trailing sums of column ``col`` in a halo window.

    A sum is the difference of two running sums, which start anew in each stretch, so its cost
    does not depend on the width and all widths share one pass. With ``decimals``, or for whole
    numbers, running sums are whole numbers and the differences exact. For others they carry the
    rounding of up to a stretch of values, so narrow sums are added value by value instead. Null,
    NaN and infinite values are missing; a sum of missing values only is missing."""

    def __init__(self, rows: DataFrame, col: str, window, decimals: int | None):
        kind = rows.schema[col].dataType.simpleString()
        self.window, self.scale = window, 10 ** (decimals or 0)
        whole = kind in ("tinyint", "smallint", "int", "bigint")
        self.exact = whole or decimals is not None
        c = f"`{col}`"
        if whole:
            value, self.scale = f"CAST({c} AS BIGINT)", 1
        else:
            finite = f"CASE WHEN NOT isnan(CAST({c} AS DOUBLE)) AND abs(CAST({c} AS DOUBLE)) < double('inf') THEN CAST({c} AS DOUBLE) END"
            value = finite
            if decimals is not None:
                fixed = f"try_cast({finite} AS DECIMAL(18,{decimals}))"
                message = f"concat('value ', CAST({c} AS STRING), ' does not fit {decimals} decimals')"
                odd = f"({finite}) IS NOT NULL AND NOT coalesce(CAST({fixed} AS DOUBLE) = {c}, false)"
                value = f"CASE WHEN {odd} THEN raise_error({message}) ELSE CAST({fixed} * {self.scale} AS BIGINT) END"
        upto = window.rowsBetween(Window.unboundedPreceding, 0)
        self.rows = rows.withColumn("_value", F.expr(value))
        self.columns = [F.sum("_value").over(upto).alias("_sum"), F.count("_value").over(upto).alias("_held")]

    def running(self) -> DataFrame:
        return self.rows.select("*", *self.columns)

    def of(self, width: int):
        """The sum of the last ``width`` values, as a column of ``running()``."""
        if not self.exact and width <= NARROW:
            return F.sum("_value").over(self.window.rowsBetween(1 - width, 0))
        total = F.coalesce("_sum", F.lit(0)) - F.coalesce(F.lag("_sum", width).over(self.window), F.lit(0))
        some = F.col("_held") - F.coalesce(F.lag("_held", width).over(self.window), F.lit(0)) > 0
        return F.when(some, total.cast("double") / self.scale if self.exact else total)


def rolling_sum(df: DataFrame, col: str, width: int, stretch: int = STRETCH, decimals: int | None = None) -> DataFrame:
    """Sum of the last ``width`` values; the first width-1 rows of a series are dropped. With
    ``decimals`` sums are exact, and a value that has more is an error."""
    rows, w = with_halo(df, before=width, stretch=stretch)
    sums = _Running(rows, col, w, decimals)
    out = sums.running().withColumn("rolling_sum", sums.of(width))
    return out.where(F.col("_own") & (F.col("i") >= width - 1)).drop("_own", "_stretch", "_value", "_sum", "_held")


def accumulate_vs_next(df: DataFrame, col: str, widths, ahead, stretch: int = STRETCH, decimals: int | None = None) -> DataFrame:
    """Pair the trailing sum of ``width`` values with the value ``ahead`` steps later.

    Columns: series_id, width, ahead, n, i (from 0), x (the sum), y (the later value). Every
    width is a difference of the same running sums, so all are computed in one pass."""
    widths, ahead = list(widths), list(ahead)
    counted = with_length(df).select("series_id", "n", "i", F.col(col).alias("_c"))
    rows, w = with_halo(counted, max(widths), max(ahead), stretch)
    sums = _Running(rows, "_c", w, decimals)
    rows = sums.running().select(
        "*",
        *[F.lead("_c", a).over(w).alias(f"_y{a}") for a in ahead],
        *[sums.of(width).alias(f"_s{width}") for width in widths],
    )
    choices = ", ".join(
        f"struct({width} AS width, {a} AS ahead, CAST(_s{width} AS DOUBLE) AS x, _y{a} AS y)" for width in widths for a in ahead
    )
    return (
        rows.where("_own").selectExpr("series_id", "n", "i", f"inline(array({choices}))")
        .where("i >= width - 1 AND i + ahead < n")
        .selectExpr("series_id", "width", "ahead", "n - ahead - width + 1 AS n", "i - (width - 1) AS i", "x", "y")
    )

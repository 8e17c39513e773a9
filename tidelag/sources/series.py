"""From tables and files to series: series_id, n (length), i (0, 1, ... n-1), x, y."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelag.functions import epoch_seconds, explode_range
from tidelag.operators.ordering import dense_rank_of

SECONDS = {"minute": 60, "hour": 3600, "day": 86400}


def bin_rows(
    df: DataFrame, ts: str, x: Column, y: Column, every: str | int = "hour", series_id: Column | None = None,
    how: str = "sum", decimals: int | None = None,
) -> DataFrame:
    """The one pass over the raw rows: 'sum', 'count' or 'avg' of x and y per series and
    step. Columns series_id, slot, x, y. Map-side sums keep a hot series from piling up.

    NaN and infinite values count as missing; a step that had no others is NaN here, and
    missing in the series. Sums are DOUBLE sums, whose last digits depend on the order of
    rows. With ``decimals`` they are exact sums of values of so many decimals, and a value
    that has more, or no room in 24 digits, is an error."""
    step = SECONDS[every] if isinstance(every, str) else every
    key = F.lit("all") if series_id is None else series_id.cast("string")

    def finite(c: str) -> str:
        return f"CASE WHEN NOT isnan(CAST({c} AS DOUBLE)) AND abs(CAST({c} AS DOUBLE)) < double('inf') THEN {c} END"

    def exact(c: str) -> str:
        value = f"try_cast({c} AS DECIMAL(24,{decimals}))"
        message = f"concat('value ', CAST({c} AS STRING), ' does not fit {decimals} decimals')"
        return f"CASE WHEN {c} IS NOT NULL AND NOT coalesce(CAST({value} AS DOUBLE) = {c}, false) THEN raise_error({message}) ELSE {value} END"

    def measure(c: str) -> str:
        total = f"CAST(sum({c}) AS DOUBLE)"
        if how == "count":
            return f"CAST(count({c}) AS DOUBLE) AS {c}"
        if how == "avg":
            total = f"try_divide({total}, CAST(count({c}) AS DOUBLE))"
        elif how != "sum":
            raise ValueError(f"how must be sum, count or avg, got {how!r}")
        return f"CASE WHEN count({c}) = 0 AND bool_or(_bad_{c}) THEN double('nan') ELSE {total} END AS {c}"

    rows = df.where(F.col(ts).isNotNull()).select(
        key.alias("series_id"), F.expr(_slot_of(ts, step)).alias("slot"), x.alias("x"), y.alias("y")
    )
    rows = rows.selectExpr(
        "series_id", "slot", *[f"{finite(c)} AS {c}" for c in "xy"], *[f"{c} IS NOT NULL AND ({finite(c)}) IS NULL AS _bad_{c}" for c in "xy"]
    )
    if decimals is not None and how != "count":
        rows = rows.withColumns({c: F.expr(exact(c)) for c in "xy"})
    return rows.groupBy("series_id", "slot").agg(F.expr(measure("x")), F.expr(measure("y")))


def fill_calendar(
    binned: DataFrame, fill: float | None = 0.0, every: str | int = "hour", bounds: tuple[str, str] | None = None
) -> DataFrame:
    """Evenly spaced series from bin_rows: steps without rows are there too, holding
    ``fill``. Each series runs from its first to its last step, or over ``bounds`` (first
    and last time stamp as text).

    Without bounds the binned rows are read twice. On large inputs stage them first, so
    that the raw rows are not."""
    if bounds is None:
        span = binned.groupBy("series_id").agg(F.expr("min(slot) AS _first"), F.expr("max(slot) AS _last"))
    else:
        step = SECONDS[every] if isinstance(every, str) else every
        first, last = (_slot_of(f"TIMESTAMP_NTZ'{b}'", step) for b in bounds)
        span = binned.select("series_id").distinct().selectExpr("series_id", f"{first} AS _first", f"{last} AS _last")
    spine = explode_range(span.selectExpr("*", "_last - _first + 1 AS n"), "i", "n")
    spine = spine.selectExpr("series_id", "n", "i", "_first + i AS slot")
    x, y = (f"nullif({c if fill is None else f'coalesce({c}, {float(fill)!r}D)'}, double('nan')) AS {c}" for c in "xy")
    return spine.join(binned, ["series_id", "slot"], "left").selectExpr("series_id", "n", "i", x, y)


def _slot_of(time: str, step: int) -> str:
    seconds = epoch_seconds(time)
    return f"({seconds} - pmod({seconds}, {step})) div {step}"


def make_series(
    df: DataFrame, ts: str, x: Column, y: Column, every: str | int = "hour", series_id: Column | None = None,
    how: str = "sum", fill: float | None = 0.0, bounds: tuple[str, str] | None = None, decimals: int | None = None,
) -> DataFrame:
    """Rows to evenly spaced series: bin_rows, then fill_calendar."""
    return fill_calendar(bin_rows(df, ts, x, y, every, series_id, how, decimals), fill, every, bounds)


def read_series_csv(
    spark: SparkSession, path: str, x: str, y: str, order_by: str | None = None, series_id: str = "all"
) -> DataFrame:
    """Two columns of CSV files, picked by header name. Rows are ordered by column
    ``order_by`` (numbers or time stamps; text that is neither is an error); without it by
    file name, and then as they stand in the file. Text that is no number, and NaN, become
    NULL. A range sort numbers the rows; it is written when this is called."""

    def number(c: str) -> Column:
        value = F.col(f"`{c}`").try_cast("double")
        return F.when(~F.isnan(value), value)

    table = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    for name in (x, y, *([order_by] if order_by else [])):
        if name not in table.columns:
            raise ValueError(f"column {name!r} is not in {path}: {table.columns}")
    if order_by:
        key = F.col(f"`{order_by}`")
        # the exact number after the rounded one keeps whole numbers beyond 2^53 apart
        parts = F.struct(number(order_by).alias("d"), key.try_cast("decimal(38,9)").alias("n"), key.try_cast("timestamp_ntz").alias("t"))
        odd = key.isNotNull() & parts["d"].isNull() & parts["n"].isNull() & parts["t"].isNull()
        order = F.when(odd, F.raise_error(F.concat(F.lit(f"{order_by} is neither number nor time: "), key))).otherwise(parts)
    else:
        order = F.struct("_metadata.file_path", "_metadata.file_block_start")
    rows = table.select(
        F.lit(series_id).alias("series_id"), number(x).alias("x"), number(y).alias("y"),
        F.monotonically_increasing_id().alias("_line"), order.alias("_order"),
    )
    return dense_rank_of(rows, ["series_id"], "_order", "_line", total="n").select("series_id", "n", "i", "x", "y")


TASK = (
    "name string, observations array<double>, targets array<double>, e int, tau int, l int, samples int, multil int, "
    "genoutput int, lstart int, lend int, linterval int, gpu int, outputpath string"
)


def read_tasks_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """JSON task lines to (series, tasks). A line may name its series (name); equal pairs of
    value arrays without a name are one series. Tasks have series_id, E, tau, L, samples: one row
    per library size, whether a line names one (l) or a range (lstart, lend, linterval; lend
    included); and genoutput and outputpath, which write_task_results honours."""
    lines = spark.read.schema(TASK).json(path).withColumn(
        "series_id", F.coalesce("name", F.md5(F.to_json(F.struct("observations", "targets"))))
    )
    uneven = F.size("observations") != F.size("targets")
    values = F.struct("observations", "targets")
    series = (
        lines.groupBy("series_id").agg(F.first(values).alias("s"), F.count_distinct(F.md5(F.to_json(values))).alias("_versions"))
        .select("series_id", "s.*", "_versions")
        .where(F.when(uneven, F.raise_error("observations and targets differ in length")).otherwise(True))
        .where(F.when(F.col("_versions") > 1, F.raise_error("one name for different series")).otherwise(True))
        .select("series_id", "observations", F.posexplode(F.arrays_zip("observations", "targets")).alias("i", "_v"))
        .select(
            "series_id", F.size("observations").cast("bigint").alias("n"), F.col("i").cast("bigint").alias("i"), F.col("_v.observations").alias("x"), F.col("_v.targets").alias("y")
        )
    )
    ranged = F.sequence("lstart", "lend", "linterval")
    sizes = F.when(F.coalesce("multil", F.lit(0)) == 0, F.array("l")).otherwise(ranged)
    tasks = lines.select("series_id", F.col("e").alias("E"), "tau", F.explode(sizes).alias("L"), "samples", "genoutput", "outputpath")
    return series, tasks


def require_paired(series: DataFrame) -> DataFrame:
    """Fail when a row of a series has only one of its two values: x and y must be equally
    long."""
    paired = F.col("x").isNull() == F.col("y").isNull()
    message = F.concat(F.lit("unpaired value in series "), "series_id", F.lit(" at "), F.col("i").cast("string"))
    return series.where(F.assert_true(paired, message).isNull())

"""Skill tables on disk and as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_skill(skill: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """One folder per (E, tau), written by the executors. CSV files have the header
    L,rho plus the other columns; E and tau come back from the folder names."""
    writer = skill.repartition("E", "tau", F.col("L")).write.mode(mode).partitionBy("E", "tau")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt in ("parquet", "json", "orc"):
        writer.format(fmt).save(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def read_skill(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Skill rows as E, tau, lib_size, rho. CSV headers may carry spaces after the commas;
    folders written by write_skill and plain files with all four columns both work."""
    if fmt == "csv":
        rows = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    else:
        rows = spark.read.format(fmt).load(path)
    return rows.select(
        F.col("E").cast("int").alias("E"), F.col("tau").cast("int").alias("tau"),
        F.col("L").cast("int").alias("lib_size"), F.col("rho").try_cast("double").alias("rho"),
    )


def skill_to_json(skill: DataFrame, digits: int | None = None) -> DataFrame:
    """One JSON record per (series_id, E, tau, L): {"e", "tau", "l", "result": [rho, ...]}
    with the values in sample order, written with ``digits`` decimals if given."""
    rho = F.col("rho") if digits is None else F.round("rho", digits).cast(f"decimal({digits + 3},{digits})")
    packed = skill.groupBy("series_id", "E", "tau", "L").agg(
        F.sort_array(F.collect_list(F.struct("sample", rho.alias("rho")))).alias("_r")
    )
    return packed.select(
        "series_id", "E", "tau", "L",
        F.to_json(F.struct(
            F.col("E").alias("e"), "tau", F.col("L").alias("l"), F.col("_r.rho").alias("result")
        )).alias("json"),
    )


RESULT = "series_id string, L int, sample int, n_pred bigint, rho double, rho_nonneg double, mae double"


def write_task_results(skill: DataFrame, tasks: DataFrame, folder: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    """The results of tasks that ask for output (genoutput 1), each where its task says, below
    ``folder``: outputpath, then a folder per E and tau. One job writes all of them; tasks that
    name the same path share its folder, told apart by series_id. Of a task's draws its own
    number of samples is written. Other tasks write nothing."""
    wanted = tasks.where("genoutput = 1").select(
        "series_id", "E", "tau", "L", F.col("samples").alias("_samples"), F.coalesce("outputpath", F.lit("")).alias("outputpath")
    )
    wanted = wanted.groupBy("series_id", "E", "tau", "L", "outputpath").agg(F.max("_samples").alias("_samples"))
    rows = skill.join(wanted, ["series_id", "E", "tau", "L"]).where("sample < _samples").drop("_samples")
    rows = rows.selectExpr("outputpath", "E", "tau", *[f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in RESULT.split(", ")])
    writer = rows.repartition("outputpath", "E", "tau", "L").write.mode(mode).partitionBy("outputpath", "E", "tau")
    if fmt == "csv":
        writer.option("header", True).csv(folder)
    elif fmt in ("parquet", "json", "orc"):
        writer.format(fmt).save(folder)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def read_task_results(spark: SparkSession, folder: str, fmt: str = "csv") -> DataFrame:
    """What write_task_results wrote: outputpath, E, tau, series_id, L, sample, n_pred, rho,
    rho_nonneg, mae. A filter on outputpath, E or tau reads those folders only."""
    reader = spark.read.schema(f"{RESULT}, outputpath string, E int, tau int")
    rows = reader.option("header", True).csv(folder) if fmt == "csv" else reader.format(fmt).load(folder)
    return rows.select("outputpath", "series_id", "E", "tau", *[c.split()[0] for c in RESULT.split(", ")[1:]])

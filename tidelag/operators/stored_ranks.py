"""Rank tables that outlive a run: written once, probed by later runs for any library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelag.functions import explode_range
from tidelag.operators import neighbors, ranking, tiles
from tidelag.operators.library import runs_of
from tidelag.operators.neighbors import FOUND, MANIFOLD, NEIGHBOURS, UNIT
from tidelag.spec import Spec
from tidelag.staging import shuffles_cleaned, stage

#: Points of a manifold that share a bucket.
RANGE = 1024
KEY = [*MANIFOLD, "block"]
COLUMNS = (
    "series_id STRING, E INT, tau INT, block BIGINT, pos BIGINT, y DOUBLE, q ARRAY<BIGINT>, d ARRAY<DOUBLE>, "
    "yq ARRAY<DOUBLE>, low BIGINT, high BIGINT"
)


class RankTable:
    """The ``depth`` nearest points of every point, in table ``name`` under ``path``.

    Rows are bucketed and sorted by (series_id, E, tau, range of point numbers), so runs that
    probe them read each bucket where it lies. A row holds the nearest of the candidates
    numbered low .. high - 1. Time steps that a series gained later add rows: the new points'
    nearest of all points, and the old points' nearest of the new ones; what is stored stays as
    it is, and a point's rows are put together when they are read, without an exchange.

    Opened again in a later session the table is read where it lies. Points are numbered as
    in manifolds without dropped vectors; a series must not change but by growing."""

    def __init__(self, spark: SparkSession, name: str, path: str, depth: int = 64, buckets: int = 16):
        self.spark, self.name, self.depth, self.buckets = spark, name, depth, buckets
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS `{name}` ({COLUMNS}) USING parquet "
            f"CLUSTERED BY ({', '.join(KEY)}) SORTED BY ({', '.join(KEY)}, pos) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(f"`{self.name}`")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS `{self.name}`")

    def add(self, manifold: DataFrame) -> None:
        """Rank what the table lacks of ``manifold`` (all points of all time steps so far)."""
        known = stage(self.rows().groupBy(*MANIFOLD).agg(F.expr("max(pos) + 1 AS known")))
        points = manifold.select(*MANIFOLD, "n", "i", "pos", "v", "y")
        shifted = "i <> pos + (E - 1) * tau"
        points = points.where(f"IF({shifted}, raise_error('vectors were dropped from the manifold'), true)")
        first = points.join(known, MANIFOLD, "left_anti")
        ranked = ranking.ranked_arrays(first, self.depth)
        self._write(ranked.join(first.select(*MANIFOLD, "n", "pos", F.col("i").alias("p")), [*MANIFOLD, "p"]).withColumn("low", F.lit(0).cast("bigint")), "n")
        if known.isEmpty():
            return
        grown = points.join(known, MANIFOLD).where("n > known")
        new, old = grown.where("pos >= known"), grown.where("pos < known")
        for mine, others, low in ((new, grown, "0L"), (old, new, "known")):
            found = _meet(mine, others, self.depth)
            held = mine.select(*MANIFOLD, "n", "known", "pos", F.col("i").alias("p"))
            self._write(found.join(held, [*MANIFOLD, "p"]).withColumn("low", F.expr(low)), "n")

    def _write(self, found: DataFrame, high: str) -> None:
        rows = found.select(
            *MANIFOLD, F.expr(f"pos div {RANGE} AS block"), "pos", "y", "q", "d", "yq", "low", F.col(high).alias("high"),
        )
        with shuffles_cleaned(self.spark):
            parts = rows.repartition(self.buckets, *KEY)
            writer = parts.write.bucketBy(self.buckets, *KEY).sortBy(*KEY, "pos")
            writer.mode("append").format("parquet").saveAsTable(f"`{self.name}`")

    def points(self) -> DataFrame:
        """One row per point: pos, y, parts (its rows, each with q, d, yq, low, high)."""
        return self.rows().groupBy(*KEY, "pos").agg(F.first("y").alias("y"), F.expr("collect_list(struct(q, d, yq, high - low AS seen)) AS parts"))

    def knn(self, manifold: DataFrame, spec: Spec, k: int | None = None, runs: DataFrame | None = None, sizes: DataFrame | None = None) -> DataFrame:
        """As knn_in_library for the points of ``manifold``, from the stored ranks. A point walks
        down its ranks until its places are filled. Where they end before, or a tie may go on
        behind them, distances to the members of that draw are measured; this is looked up when
        this is called, and the answers from the ranks are written."""
        sizes = manifold.where("pos = 0") if sizes is None else sizes
        sizes = sizes.select(*MANIFOLD, "n")
        sizes = sizes.withColumn("runs", F.expr(runs_of(spec))) if runs is None else sizes.join(runs.select(*MANIFOLD, "runs"), MANIFOLD)
        kernel = tiles.walk_kernel(
            k, self.depth, spec.ties == "include", spec.exclude_zero_distance, spec.distinct_library, spec.replacement, spec.seed
        )
        # one row per manifold; the optimizer's own size check decides on a broadcast
        held = self.points().join(sizes.where("size(runs) > 0"), MANIFOLD).where("pos < n")
        columns = [*MANIFOLD, "n", "runs", "pos", "y", "parts"]
        walked = stage(held.select(*columns).mapInArrow(kernel, f"{NEIGHBOURS}, open boolean"))
        done, short = walked.where("NOT open").select(*FOUND), walked.where("open").select(*MANIFOLD, "L", "sample", "p")
        if short.isEmpty():
            return done
        again = short.select(*MANIFOLD, F.col("p").alias("i")).distinct()
        points = manifold.join(again, [*MANIFOLD, "i"], "left_semi")
        measured = neighbors.knn_in_library(manifold, spec, k, runs, sizes, points=points)
        return done.unionByName(measured.join(short, [*MANIFOLD, "L", "sample", "p"], "left_semi").select(*FOUND))


def _meet(points: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """The k nearest ``candidates`` of each of ``points``, both parts of the same manifolds."""
    blocks = neighbors._packed(points, neighbors._per_block(), "block").select(*UNIT[:-1], F.lit(-1).cast("bigint").alias("chunk"), "points")
    chunks = neighbors._packed(candidates, str(neighbors.TILE), "chunk")
    chunks = explode_range(chunks, "block", neighbors._block_count()).join(blocks.select(*UNIT[:-1]), UNIT[:-1], "left_semi")
    rows = neighbors.deal_out(blocks.unionByName(chunks.select(*UNIT[:-1], "chunk", "points")), *UNIT[:-1])
    found = rows.sortWithinPartitions(*UNIT[:-1], "chunk").mapInArrow(tiles.every_kernel(k, False), NEIGHBOURS)
    return neighbors.nearest_of_all(found, str(k))


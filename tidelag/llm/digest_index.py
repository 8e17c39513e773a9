"""Exact dedup against a persistent digest index.

The index is a table of one row per distinct text, bucketed and sorted by digest. New data is
reduced to one row per digest by partial aggregates, joined with the index bucket by bucket
without moving the index, and what the index lacks is appended. DataFrame functions only.

Texts are equal when identical after deleting ``\\x20`` and ``\\x09-\\x0D``; null counts as
empty. Of equal texts in one batch the row with the most code points, then the smallest doc_id,
stays (rows without doc_id last); texts the index already holds stay with the row it names.
Repeated rows are members like any other; ``kept`` is true for every row that carries the id
that stays. Empty tables give empty results. Extra columns are ignored."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import shared_folder, shuffles_cleaned, stage

SPACES = " \t\n\x0b\x0c\r"
#: Bytes of index rows a bucket should hold, to choose the number of buckets of a new index.
BUCKET_ROWS = 2_000_000


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), SPACES, ""), 256))


class DigestIndex:
    """A bucketed table ``name`` under ``path`` with digest, keep_id, chars.

    Opened again in a later session it is read where it lies. Appending writes new files to
    the same buckets, so neither lookups nor appends shuffle what is already indexed."""

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = 16):
        self.spark, self.name = spark, name
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS `{name}` (digest BINARY, keep_id BIGINT, chars INT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        self.buckets = buckets

    def rows(self) -> DataFrame:
        return self.spark.table(f"`{self.name}`")

    def add(self, docs: DataFrame) -> DataFrame:
        """Decide on every row of ``docs`` and append the digests not yet indexed.

        Returns doc_id, keep_id, group_size (rows of the batch with an equal text), kept,
        digest. Eager: the decisions and the appended part are written when this is called."""
        rows = stage(docs.select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).alias("chars"), digest(F.col("text")).alias("digest")))
        rank = F.struct("chars", F.col("doc_id").isNotNull(), -F.col("doc_id"))
        groups = rows.groupBy("digest").agg(F.max_by("doc_id", rank).alias("own_id"), F.max("chars").alias("chars"), F.count("*").alias("group_size"))
        groups = stage(groups)
        known = self.rows().select("digest", F.lit(True).alias("known"), F.col("keep_id").alias("old_id"))
        decided = stage(groups.hint("merge").join(known, "digest", "left"))
        new = decided.where("known IS NULL").select("digest", F.col("own_id").alias("keep_id"), "chars")
        with shuffles_cleaned(self.spark):
            parts = new.repartition(self.buckets, "digest")
            parts.write.bucketBy(self.buckets, "digest").sortBy("digest").mode("append").format("parquet").saveAsTable(f"`{self.name}`")
        keep = F.when(F.col("known"), F.col("old_id")).otherwise(F.col("own_id"))
        decided = decided.select("digest", keep.alias("keep_id"), "group_size", F.col("known").isNotNull().alias("known"))
        # hot groups: both sides are plain exchanges, so the skew join splits them
        found = rows.hint("merge").join(decided, "digest")
        kept = ~F.col("known") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
        return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS `{self.name}`")


def buckets_for(docs: DataFrame) -> int:
    return max(1, -(-docs.select("doc_id").count() // BUCKET_ROWS)) * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """Decisions on a table against a new index of its own in the shared folder."""
    spark, name = docs.sparkSession, f"digests_{uuid.uuid4().hex}"
    index = DigestIndex(spark, name, f"{shared_folder(spark)}/{name}", buckets_for(docs))
    decided = index.add(docs)
    index.drop()
    return decided


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, with all its columns."""
    decided = deduplicate(docs).where("kept").select("doc_id", "digest").distinct()
    mark = docs.withColumn("_digest", digest(F.col("text")))
    same = mark["_digest"].eqNullSafe(decided["digest"]) & mark["doc_id"].eqNullSafe(decided["doc_id"])
    kept = mark.join(decided.hint("shuffle_merge"), same, "left_semi")
    return kept.dropDuplicates(["_digest"]).select(*docs.columns)

"""What several operators share: row identity, tables by document, bounded broadcasts."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_ID = -(1 << 63)
#: A side of a join is broadcast only if it was counted and holds no more bytes than this.
BROADCAST_BYTES = 32 << 20


def places(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, _doc, _tag, _text of every row, null texts as empty ones. (_doc, _tag) names a
    row without nulls: rows that share a doc_id, or have none, differ by 64 bits of their text's hash.
    Other columns, whatever their names, stay behind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_doc"),
        F.xxhash64(text).alias("_tag"),
        text.alias("_text"),
        *more,
    )


def has_at_most(df: DataFrame, rows: int) -> bool:
    return df.limit(rows + 1).count() <= rows


def small_side(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df``, a staged table, with a broadcast hint if its counted size is within the bound;
    else as it is, for a sort-merge join that splits skewed partitions."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df



def by_document(found: DataFrame, value: Column) -> DataFrame:
    """One row per (_doc, _tag) of ``found`` (doc, tag, at): what ``value`` gives, as a list that no
    document of bounded length makes long."""
    return found.groupBy(F.col("doc").alias("_doc"), F.col("tag").alias("_tag")).agg(F.collect_list(value).alias("_marks"))


def only_marked(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows that have marks, with them. Where the ids fit a bounded broadcast, the texts
    of other rows are never shuffled."""
    ids = marks.select("_doc", "_tag")
    near = rows.join(small_side(ids, 32), ["_doc", "_tag"], "left_semi")
    return near.join(marks.hint("shuffle_merge"), ["_doc", "_tag"])


def all_with_marks(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """All rows; _marks is null without any. Texts are shuffled as in only_marked."""
    ids = small_side(marks.select("_doc", "_tag"), 32)
    rest = rows.join(ids, ["_doc", "_tag"], "left_anti").withColumn("_marks", F.lit(None).cast(marks.schema["_marks"].dataType))
    return only_marked(rows, marks).unionByName(rest)


def tokenizer_file(name: str) -> str:
    """A public vocabulary file: in the folder that TOKENIZER_DIR names if it is set, else where
    its package has it. Every node has it."""
    if "TOKENIZER_DIR" in os.environ:
        return os.path.join(os.environ["TOKENIZER_DIR"], name)
    import public_tokenizers

    return public_tokenizers.path(name)

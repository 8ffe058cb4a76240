"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Whole texts are compared at every stage; the digest only says where rows meet:

1. Each input partition combines its equal texts (the map side of the first aggregation).
2. Groups are merged by (digest, salt, text). The salt is the input partition modulo ``salts``, so the
   copies of a hot text meet in ``salts`` places, with at most one row for each input partition.
3. The salt winners, at most ``salts`` rows for each text, are combined by (digest, text).

That gives one class per distinct text, written to the shared folder without its text. Rows then find their
class by digest. If a digest ever had two texts, the rows of that digest find their class by whole text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, shuffle_partitions, texts, unused, written


def _digested(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return texts(df, id_col, text_col).withColumn("digest", F.unhex(F.sha2("text", 256)))


def text_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row for each distinct text: digest, text, keep_id (largest id), group_size."""
    local = _digested(df, id_col, text_col).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    salted = local.groupBy("digest", "salt", "text").agg(F.max("doc_id").alias("winner"), F.count("*").alias("rows"))
    return (salted.repartition(shuffle_partitions(df.sparkSession), "digest")
            .groupBy("digest", "text").agg(F.max("winner").alias("keep_id"), F.sum("rows").alias("group_size")))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; of equal texts the row with the largest id stays. A null text counts as
    empty. Null ids never win over others; a group of null ids only has a null keep_id and keeps them. Rows
    that repeat both id and text are all marked kept (they are one document); ``drop_copies`` leaves one.
    An empty table gives no rows. Other columns are not read, whatever their names.
    """
    classes = written(
        text_classes(df, id_col, text_col, salts).groupBy("digest")
        .agg(F.count("*").alias("texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")),
        "dedup-classes")
    rows = _digested(df, id_col, text_col)
    out = rows.drop("text").join(classes.filter("texts = 1").drop("texts"), "digest")
    shared = classes.filter("texts > 1").select("digest")
    if not shared.isEmpty():  # a digest of several texts: compare the texts themselves
        members = rows.join(shared, "digest", "left_semi")
        out = out.unionByName(members.join(
            text_classes(members, "doc_id", "text", salts), ["digest", "text"]).drop("text"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                      F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """``df`` without the rows whose text another row keeps; all columns unchanged.

    Rows that repeat both id and text leave one row, the smallest by the other columns' hash; that choice
    needs a shuffle of these rows only. A null text counts as empty; a null id is an id like any other, below all. Texts are
    compared whole, however long. An empty table stays empty; no name of a column can clash.
    """
    digest, row_hash, key, sha, copies = unused(df, "digest", "row_hash", "key", "sha", "copies")
    kept = (exact_dedup(df, id_col, text_col, salts).filter("kept")
            .groupBy(F.col("doc_id").alias(key), F.col("text_sha256").alias(sha)).agg(F.count("*").alias(copies)))
    kept = written(kept, "dedup-kept")
    tagged = df.withColumn(digest, F.sha2(F.coalesce(col(text_col).cast("string"), F.lit("")), 256))
    same = col(id_col).cast("long").eqNullSafe(F.col(key)) & (F.col(digest) == F.col(sha))
    once = tagged.join(kept.filter(F.col(copies) == 1), same, "left_semi").drop(digest)
    repeated = kept.filter(F.col(copies) > 1)
    if repeated.isEmpty():
        return once
    whole = F.struct(*[col(c) for c in df.columns])
    rows = tagged.join(repeated, same, "left_semi").withColumn(row_hash, F.xxhash64(F.to_json(whole)))
    best = rows.groupBy(col(id_col).alias(key), F.col(digest)).agg(F.min_by(whole, F.col(row_hash)).alias("row"))
    return once.unionByName(best.select(*[F.col("row").getField(c).alias(c) for c in df.columns]))

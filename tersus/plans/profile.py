"""Profiling P2-P6: what a caller sees after each cleaning step, as DataFrames.

* null counts and the row count of a table come from ONE aggregation, unpivoted;
* the duplicate count is the rows less the distinct ones: one scan and one
  exchange, with copies collapsed on the map side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tersus.functions.parse import col, missing

MAX_ISSUES = 12


def null_counts(df: DataFrame, table: str = "t") -> DataFrame:
    """P2 + P4: (table_name, ordinal, column_name, null_count, row_count)."""
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("__rows")] + \
        [F.count_if(missing(df, c)).alias(f"__n{i}") for i, c in enumerate(cols)]
    one = df.agg(*aggs)
    each = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column_name"), F.col(f"__n{i}").alias("null_count"))
                     for i, c in enumerate(cols)])
    return one.select(F.lit(table).alias("table_name"), F.col("__rows").alias("row_count"), F.explode(each).alias("c")) \
        .select("table_name", "c.ordinal", "c.column_name", "c.null_count", "row_count")


def duplicate_count(df: DataFrame, table: str = "t") -> DataFrame:
    """P3: rows after the first copy, as (table_name, duplicate_count)."""
    dup = df.groupBy(*[col(c) for c in df.columns]).count().agg(F.sum(F.col("count") - 1).alias("d"))
    return dup.select(F.lit(table).alias("table_name"),
                      F.coalesce(F.col("d"), F.lit(0)).cast("bigint").alias("duplicate_count"))


def profile(df: DataFrame, table: str = "t") -> DataFrame:
    """Per-column profile: (table_name, ordinal, column_name, dtype, null_count, row_count)."""
    dtypes = F.create_map(*[x for c, t in df.dtypes for x in (F.lit(c), F.lit(t))]) if df.columns \
        else F.create_map()
    return null_counts(df, table).withColumn("dtype", dtypes[F.col("column_name")]) \
        .select("table_name", "ordinal", "column_name", "dtype", "null_count", "row_count")


def profile_all(tables) -> DataFrame:
    """P6: profiles of every table of a set, plus a table-level duplicate count."""
    parts = []
    for i, (name, df) in enumerate(tables.items()):
        # the duplicate count is one number: fetch it as a literal instead of joining a one-row table
        dups = duplicate_count(df, name).first()["duplicate_count"]
        parts.append(profile(df, name).withColumn("table_ordinal", F.lit(i))
                     .withColumn("duplicate_count", F.lit(dups).cast("bigint")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def issue_list(tables, limit: int = MAX_ISSUES) -> DataFrame:
    """P5: "t.c: n nulls" per column, then "t: n duplicates", in table then column
    order, first ``limit`` issues: (rank, issue)."""
    parts = []
    for i, (name, df) in enumerate(tables.items()):
        nc = null_counts(df, name).where(F.col("null_count") > 0).select(
            F.lit(i).alias("t"), F.col("ordinal").alias("o"),
            F.format_string("%s.%s: %d nulls", F.col("table_name"), F.col("column_name"),
                            F.col("null_count")).alias("issue"))
        dc = duplicate_count(df, name).where(F.col("duplicate_count") > 0).select(
            F.lit(i).alias("t"), F.lit(len(df.columns)).alias("o"),
            F.format_string("%s: %d duplicates", F.col("table_name"), F.col("duplicate_count")).alias("issue"))
        parts += [nc, dc]
    allp = reduce(lambda a, b: a.unionByName(b), parts)
    return (allp.orderBy("t", "o").limit(limit)
            # the window runs over at most `limit` rows
            .select(F.row_number().over(Window.orderBy("t", "o")).alias("rank"), "issue"))

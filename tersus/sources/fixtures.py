"""Deterministic dirty views over the supplied tables (see FIXTURES.md).

Dirt is planted by key arithmetic so Spark and a SQL oracle produce the same
rows. Each view reads a whole base table; its size grows with it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tersus.sources.catalog import TableSet


def _k(c, m):
    return F.col(c) % F.lit(m)


def _fields(text: str, year_at: int, *fields):
    """``text`` % ``fields`` (whole numbers, the year in four digits, the others in two) by concatenation, several times
    as fast as the formatter, which is left what has no such year (NULL gives the word null)."""
    slots = re.split("%0[24]d", text)
    parts = [F.lit(slots[0])]
    for i, (f, after) in enumerate(zip(fields, slots[1:])):
        parts += [F.lpad(f.cast("string"), 4 if i == year_at else 2, "0"), F.lit(after)]
    return F.when(fields[year_at].between(0, 9999), F.concat(*parts)).otherwise(F.format_string(text, *fields))


def _ymd(d, sep="-", day_first=False):
    """Date text of a timestamp_ntz from its fields (no session time zone involved)."""
    if day_first:
        return _fields(f"%02d{sep}%02d{sep}%04d", 2, F.dayofmonth(d), F.month(d), F.year(d))
    return _fields(f"%04d{sep}%02d{sep}%02d", 0, F.year(d), F.month(d), F.dayofmonth(d))


def _ymd_hms(d):
    return _fields("%04d-%02d-%02d %02d:%02d:%02d", 0, F.year(d), F.month(d), F.dayofmonth(d),
                   F.hour(d), F.minute(d), F.second(d))


def orders_dirty_base(orders: DataFrame) -> DataFrame:
    k, price, d = "o_orderkey", F.col("o_totalprice"), F.col("o_orderdate")
    amount_num = (F.when(_k(k, 101) == 5, price * 16).when(_k(k, 101) == 6, -price).otherwise(price))
    amount = (F.when(_k(k, 17) == 0, F.lit(None).cast("string"))
              .when(_k(k, 17) == 1, "N/A").when(_k(k, 17) == 2, "missing").when(_k(k, 17) == 3, "")
              .otherwise(amount_num.cast("string")))
    order_date = (F.when(_k(k, 3) == 0, _ymd(d, "/", day_first=True))
                  .when(_k(k, 7) == 1, _ymd(d, "/"))
                  .otherwise(_ymd(d)))
    pri = F.col("o_orderpriority")
    priority = (F.when(_k(k, 4) == 0, F.lower(pri)).when(_k(k, 4) == 1, F.concat(F.lit("  "), pri))
                .otherwise(pri))
    status = F.when(_k(k, 13) != 0, F.col("o_orderstatus"))
    return orders.select(F.col(k).alias("order_id"), F.col("o_custkey").alias("customer_id"),
                         amount.alias("amount"), order_date.alias("order_date"),
                         priority.alias("priority"), status.alias("status"))


def orders_dirty(orders: DataFrame) -> DataFrame:
    """Base rows plus exact copies of every tenth order (planted duplicates)."""
    base = orders_dirty_base(orders)
    return base.unionByName(base.where(F.col("order_id") % 10 == 0))


def customers_dirty(customer: DataFrame, nation: DataFrame) -> DataFrame:
    k = "c_custkey"
    age = F.when(_k(k, 12) == 0, "N/A").otherwise((F.lit(18) + _k(k, 52)).cast("string"))
    return (customer.join(nation, customer.c_nationkey == nation.n_nationkey)
            .select(F.col(k).alias("customer_id"), F.col("c_name").alias("name"),
                    age.alias("age"), F.col("n_name").alias("country")))


def stream_dirty(events: DataFrame, with_day: bool = False) -> DataFrame:
    """Scenario-4 shape. ``with_day`` adds the arrival day, used to cut micro-batches."""
    k, v, ts = "event_id", F.col("value"), F.col("ts")
    amount = (F.when(_k(k, 20) <= 2, F.lit(None).cast("string")).when(_k(k, 20) == 3, "N/A")
              .when(_k(k, 20) == 4, (-v).cast("string")).when(_k(k, 20) == 5, (v * 1000).cast("string"))
              .otherwise(v.cast("string")))
    category = F.when(_k(k, 7) != 0, F.col("event_type"))
    u = F.col("user_id") % 5
    region = F.when(_k(k, 10) != 0, F.when(u == 0, "North").when(u == 1, "South").when(u == 2, "East")
                    .when(u == 3, "West").otherwise("Central"))
    event_ts = (F.when(_k(k, 5) == 0, _ymd(ts, "/"))
                .when(_k(k, 9) == 1, _ymd(ts, "/", day_first=True))
                .otherwise(_ymd_hms(ts)))
    cols = [F.concat(F.lit("TXN_"), F.col(k).cast("string")).alias("txn_id"),
            F.col("user_id").alias("customer_id"), amount.alias("amount"),
            category.alias("category"), region.alias("region"), event_ts.alias("event_ts")]
    if with_day:
        cols.append(F.to_date(ts).alias("arrival_day"))
    return events.select(*cols)


def people_dirty(customer: DataFrame) -> DataFrame:
    """Scenario-1 shape (id, name, age as text with markers, salary with NULLs, city)."""
    k = "c_custkey"
    m = _k(k, 25)
    age = (F.when(m == 0, "").when(m == 1, "N/A").when(m == 2, "null").when(m == 3, "missing")
           .when(m == 4, "NaN").otherwise((F.lit(18) + _k(k, 57)).cast("string")))
    salary = F.when(_k(k, 6) != 0, F.col("c_acctbal"))
    return customer.select(F.col(k).alias("id"), F.col("c_name").alias("name"), age.alias("age"),
                           salary.alias("salary"), F.col("c_mktsegment").alias("city"))


def parts_dirty(part: DataFrame) -> DataFrame:
    """A mostly-text column with some numbers and NULLs (for N8), plus text noise."""
    k = "p_partkey"
    spec = (F.when(_k(k, 11) == 0, F.lit(None).cast("string"))
            .when(_k(k, 3) == 0, F.col("p_size").cast("string")).otherwise(F.col("p_type")))
    name = F.when(_k(k, 2) == 0, F.concat(F.lit("\t"), F.col("p_name"), F.lit(" "))).otherwise(F.col("p_name"))
    return part.select(F.col(k).alias("part_id"), spec.alias("spec"), name.alias("name"),
                       F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price"))


def dirty_tables(base: TableSet) -> TableSet:
    return TableSet({
        "orders_dirty": orders_dirty(base["orders"]),
        "customers_dirty": customers_dirty(base["customer"], base["nation"]),
        "stream_dirty": stream_dirty(base["events"]),
        "people_dirty": people_dirty(base["customer"]),
        "parts_dirty": parts_dirty(base["part"]),
    })

"""DuckDB SQL for the oracle check: dirty views and parser fragments.

These mirror ``tersus.sources.fixtures`` and ``tersus.functions.parse`` in
plain SQL so that each query of the suite has an independent statement over
the same base tables.
"""

from __future__ import annotations

# Fixed values, as in tersus.functions.parse.
MARKERS_SQL = "('N/A', 'n/a', 'null', 'NULL', 'None', 'none', 'missing', '', 'NaN', 'nan')"

VIEWS = {
    "orders_dirty_base": """
SELECT o_orderkey AS order_id, o_custkey AS customer_id,
  CASE o_orderkey % 17 WHEN 0 THEN NULL WHEN 1 THEN 'N/A' WHEN 2 THEN 'missing' WHEN 3 THEN ''
    ELSE CAST(CASE WHEN o_orderkey % 101 = 5 THEN o_totalprice * 16
                   WHEN o_orderkey % 101 = 6 THEN -o_totalprice
                   ELSE o_totalprice END AS VARCHAR) END AS amount,
  CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%d/%m/%Y')
       WHEN o_orderkey % 7 = 1 THEN strftime(o_orderdate, '%Y/%m/%d')
       ELSE strftime(o_orderdate, '%Y-%m-%d') END AS order_date,
  CASE o_orderkey % 4 WHEN 0 THEN lower(o_orderpriority)
                      WHEN 1 THEN concat('  ', o_orderpriority) ELSE o_orderpriority END AS priority,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderstatus END AS status
FROM orders""",
    "orders_dirty": """
SELECT * FROM orders_dirty_base UNION ALL SELECT * FROM orders_dirty_base WHERE order_id % 10 = 0""",
    "customers_dirty": """
SELECT c_custkey AS customer_id, c_name AS name,
  CASE WHEN c_custkey % 12 = 0 THEN 'N/A' ELSE CAST(18 + c_custkey % 52 AS VARCHAR) END AS age,
  n_name AS country
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "stream_dirty": """
SELECT concat('TXN_', CAST(event_id AS VARCHAR)) AS txn_id, user_id AS customer_id,
  CASE event_id % 20 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN 'N/A'
    WHEN 4 THEN CAST(-value AS VARCHAR) WHEN 5 THEN CAST(value * 1000 AS VARCHAR)
    ELSE CAST(value AS VARCHAR) END AS amount,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS category,
  CASE WHEN event_id % 10 = 0 THEN NULL ELSE
    CASE user_id % 5 WHEN 0 THEN 'North' WHEN 1 THEN 'South' WHEN 2 THEN 'East'
                     WHEN 3 THEN 'West' ELSE 'Central' END END AS region,
  CASE WHEN event_id % 5 = 0 THEN strftime(ts, '%Y/%m/%d')
       WHEN event_id % 9 = 1 THEN strftime(ts, '%d/%m/%Y')
       ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS event_ts
FROM events""",
    "stream_dirty_days": """
SELECT s.*, CAST(e.ts AS DATE) AS arrival_day
FROM stream_dirty s JOIN events e ON s.txn_id = concat('TXN_', CAST(e.event_id AS VARCHAR))""",
    "people_dirty": """
SELECT c_custkey AS id, c_name AS name,
  CASE c_custkey % 25 WHEN 0 THEN '' WHEN 1 THEN 'N/A' WHEN 2 THEN 'null' WHEN 3 THEN 'missing'
    WHEN 4 THEN 'NaN' ELSE CAST(18 + c_custkey % 57 AS VARCHAR) END AS age,
  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_acctbal END AS salary,
  c_mktsegment AS city
FROM customer""",
    "parts_dirty": """
SELECT p_partkey AS part_id,
  CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN CAST(p_size AS VARCHAR)
       ELSE p_type END AS spec,
  CASE WHEN p_partkey % 2 = 0 THEN concat(chr(9), p_name, ' ') ELSE p_name END AS name,
  p_brand AS brand, p_retailprice AS price
FROM part""",
}

_DEPS = {"orders_dirty": ["orders_dirty_base"], "stream_dirty_days": ["stream_dirty"]}


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with the CTEs of the dirty views it uses."""
    order = []

    def visit(n):
        if n in order:
            return
        for d in _DEPS.get(n, []):
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order)
    return f"WITH {ctes}\n{body}" if ctes else body


def k1(x: str) -> str:
    """Numeric parse, unparseable -> NULL, NaN -> NULL."""
    return f"(CASE WHEN isnan(TRY_CAST({x} AS DOUBLE)) THEN NULL ELSE TRY_CAST({x} AS DOUBLE) END)"


def k2(x: str) -> str:
    return (f"coalesce(try_strptime({x}, '%Y-%m-%d %H:%M:%S'), try_strptime({x}, '%Y-%m-%d'), "
            f"try_strptime({x}, '%Y/%m/%d'), try_strptime({x}, '%d/%m/%Y'))")


def k3(x: str) -> str:
    return f"(CASE WHEN {x} IN {MARKERS_SQL} THEN NULL ELSE {x} END)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"

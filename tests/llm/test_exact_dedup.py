import duckdb
import pytest
from pyspark.sql import functions as F

from tersus.llm import exact_dedup as dedup
from tersus.llm.suite import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
ROWS = [(1, "a"), (2, "a"), (3, "A"), (4, None), (5, ""), (6, " "), (7, "b" * 100_000), (8, "b" * 100_000), (9, "é"), (10, "é"),
        (11, "a"), (None, "a"), (None, "only null ids"), (None, "only null ids"), (11, "a"), (12, "x\0y"), (13, "x")]


def plain(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[t or ""]), i == keep))
    return sorted(out, key=str)


def result(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in df.collect()), key=str)


def frame(spark, rows=ROWS, parts=3):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


def test_equals_plain_version(spark):
    assert result(dedup.exact_dedup(frame(spark))) == plain(ROWS)


def test_hot_group_over_partitions(spark):
    rows = [(i, "hot") for i in range(3000)] + [(3000 + i, f"t{i % 50}") for i in range(500)]
    assert result(dedup.exact_dedup(frame(spark, rows, 7), salts=4)) == plain(rows)


def test_digest_shared_by_different_texts(spark, monkeypatch):
    monkeypatch.setattr(dedup, "_digested", lambda df, i, t: dedup.texts(df, i, t).withColumn("digest", F.lit(b"same")))
    assert result(dedup.exact_dedup(frame(spark))) == plain(ROWS)


def test_empty_table_and_clashing_columns(spark):
    assert dedup.exact_dedup(frame(spark, [], 1)).count() == 0
    names = ["digest", "salt", "winner", "keep_id", "copies", "__id", "a.b", "kept"]
    df = spark.createDataFrame([(1, "a", *range(8)), (2, "a", *range(8)), (3, None, *range(8))],
                               "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    assert result(dedup.exact_dedup(df)) == plain([(1, "a"), (2, "a"), (3, None)])
    kept = dedup.drop_copies(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3]


def test_drop_copies_leaves_one_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a", "p"), (1, "a", "q"), (1, "a", "q"), (2, "b", "r"), (None, "c", "s"), (None, "c", "t"), (0, "a", "u")],
                               "doc_id long, text string, source string")
    rows = [tuple(r) for r in dedup.drop_copies(df).collect()]
    assert sorted(str((r[0], r[1])) for r in rows) == sorted(["(1, 'a')", "(2, 'b')", "(None, 'c')"])
    assert set(rows) <= {tuple(r) for r in df.collect()}
    assert dedup.drop_copies(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql_queries_equal_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = con.execute(ORACLE[name])
    columns = [c[0] for c in got.description]
    assert sorted(map(str, got.fetchall())) == sorted(str(tuple(r[c] for c in columns)) for r in QUERIES[name](spark, SF).collect())


def test_main_path_is_native(spark):
    plan = dedup.exact_dedup(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

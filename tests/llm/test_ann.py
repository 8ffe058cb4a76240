import numpy as np
import pytest

from tersus.llm import ann
from tersus.llm.suite import QUERIES


def brute(rows, every, k):
    """All cosines in double precision."""
    good = sorted({(i, tuple(float(np.float32(x)) for x in v)) for i, v in rows
                   if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    out = {}
    for i, v in good:
        if i % every == 0:
            v = np.array(v)
            found = sorted((-float((v * u).sum() / (np.sqrt((u * u).sum()) * np.sqrt((v * v).sum()))), j)
                           for j, u in ((j, np.array(u)) for j, u in good) if j != i)
            out[i] = [(j, -s) for s, j in found[:k]]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_whole_scan_equals_brute_force(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in r.standard_normal(12)]) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)]  # one vector many times
    rows += [(50, None), (2000, [0.0] * 12), (2050, [1.0, None] * 6), (2100, [float("nan")] * 12), (2150, [float("inf")] + [1.0] * 11),
             (None, rows[1][1]), (2200, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id long, embedding array<float>, `list` int, bound int")
    got = result(ann.nearest_neighbours(df, every=50, k=5, probe_share=1.0, looseness=50.0, chunk_rows=16, block=4, lists=6))
    expected = brute([x for x in rows if x[0] != 2200], 50, 5)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in expected.items()}
    assert all(a[1] == pytest.approx(b[1], rel=1e-12) for q in got for a, b in zip(got[q], expected[q]))


def test_each_length_is_searched_within_itself(spark):
    r = np.random.default_rng(8)
    long, short = ([(start + i, [float(x) for x in r.standard_normal(n)]) for i in range(count)] for start, n, count in ((0, 8, 120), (500, 5, 60)))
    df = spark.createDataFrame(long + short, "vec_id long, embedding array<double>")
    got = result(ann.nearest_neighbours(df, every=50, k=3, probe_share=1.0, looseness=50.0))
    def near(rows):
        good = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
        return {q: [j for _, j in sorted((-float(good[q] @ u), j) for j, u in good.items() if j != q)[:3]] for q in good if q % 50 == 0}
    assert {q: [i for i, _ in v] for q, v in got.items()} == near(long) | near(short) and 500 in got


def test_few_rows_and_empty_table(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [i for i, _ in result(ann.nearest_neighbours(df))[0]] == [1, 2]
    assert ann.nearest_neighbours(df.filter("vec_id = 0")).count() == 0
    assert ann.nearest_neighbours(df.limit(0)).count() == 0
    huge = spark.createDataFrame([(0, [1e200, 0.0]), (1, [1e-200, 1e-200])], "vec_id long, embedding array<double>")
    found = ann.nearest_neighbours(huge).collect()
    assert [(r["query_id"], r["vec_id"]) for r in found] == [(0, 1)] and abs(found[0]["score"] - 0.5 ** 0.5) < 1e-15
    far = np.array([[1e200, 3e200], [2.0, 1.0], [1e-320, 0.0], [1e-200, -1e-200]])
    plain = np.array([[1.0, 3.0], [2.0, 1.0], [1.0, 0.0], [1.0, -1.0]])
    assert np.allclose(ann.cosines(far, far[::-1].copy()), ann.cosines(plain, plain[::-1].copy()), rtol=1e-12)


def test_scan_abandons_but_keeps_the_nearest():
    r = np.random.default_rng(0)
    x = ann.unit(r.standard_normal((2000, 64)))
    q = ann.unit(r.standard_normal((20, 64)))
    d = ((q[:, None] - x) ** 2).sum(axis=2)
    bounds = np.sort(d, axis=1)[:, 4]
    xt = np.ascontiguousarray(x.T)
    query, candidate, distance = ann.adaptive_scan(q, [xt[a:a + 16] for a in range(0, 64, 16)], bounds, 1.5)
    assert len(query) < 0.7 * d.size
    assert np.allclose(distance, d[query, candidate])
    kept = set(zip(query.tolist(), candidate.tolist()))
    true = [(i, j) for i in range(20) for j in np.argsort(d[i])[:5].tolist()]
    assert sum(t in kept for t in true) >= 0.95 * len(true)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_of_the_query(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    ids, x = table["vec_id"].to_numpy(), ann.unit(np.array(table["embedding"].tolist(), float))
    got = result(QUERIES["op6_adaptive_ann"](spark, sf))
    hits = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        s = x @ x[i]
        s[i] = -9
        true = set(ids[np.argsort(-s)[:5]].tolist())
        hits += len(true & {j for j, _ in got[ids[i]]})
        total += 5
    assert hits >= 0.9 * total

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tersus.llm import crc, importance
from tersus.llm.suite import QUERIES

SF = "/root/testdata/sf0.001"


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_buckets(text, order=3, buckets=10_000):
    w = plain_words(text)
    return [zlib.crc32(" ".join(w[i:i + k]).encode()) % buckets for k in range(1, order + 1) for i in range(len(w) - k + 1)]


def plain_resample(docs, target, least_words=20):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(plain_buckets(text))
    for text in target:
        t.update(plain_buckets(text))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)}
    rows = []
    for i, text in docs:
        found = plain_buckets(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = [r for r, (_, text) in zip(rows, docs) if len(plain_words(text)) >= least_words]
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(able[:5 * len(able) // 100], 1):
        r[4] = k
    return sorted(map(tuple, rows), key=repr)


def got(df):
    return sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect()), key=repr)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=200), st.binary(max_size=200)), min_size=1, max_size=8))
def test_crc_of_joined_strings(pairs):
    first, second = zip(*pairs)
    out = crc.joined(crc.crc32s(first), crc.crc32s(second), np.array([len(b) for b in second]))
    assert out.tolist() == [zlib.crc32(a + b) for a, b in pairs]


def test_crc_past_a_very_long_string():
    a, b = b"start", bytes(random.Random(1).randrange(256) for _ in range(100_003))
    assert crc.joined(crc.crc32s([a]), crc.crc32s([b]), np.array([len(b)])).tolist() == [zlib.crc32(a + b)]


TEXTS = ["", "one", "One two", "a b c d", "ünï-CÖDE \0 nul\0nul", "...", "x" * 300 + " " + "y" * 70 + " z", "tail\n", "a_b{c}d 12 3", "\0"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab Z9é\0\n[", max_size=30), max_size=6), st.integers(1, 4))
def test_batch_features_keep_to_their_documents(batch, order):
    check_batch(batch, order)


def check_batch(batch, order):
    bucket, doc, words = importance.batch_features(pa.array(batch, pa.string()), order, 997)
    assert words.tolist() == [len(plain_words(t)) for t in batch]
    for i, t in enumerate(batch):
        assert sorted(bucket[doc == i].tolist()) == sorted(plain_buckets(t, order, 997))


def test_batch_of_odd_texts():
    check_batch(TEXTS, 3)


def documents(size, seed=5):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(r.choices(vocabulary, k=r.choice([0, 5, 19, 20, 21, 200])))) for i in range(size)]
    return docs + [(size + i, t) for i, t in enumerate(TEXTS)] + [(None, "same words here " * 10), (-3, None), docs[7], (7, docs[7][1] + " more")]


def test_resample_equals_plain_version(spark):
    docs, target = documents(400), ["w1 w2 w3 w4", "same words here", None, ""]
    df = spark.createDataFrame([(i, t, 0, "r") for i, t in docs], "doc_id long, text string, score int, rank string").repartition(7)
    out = importance.importance_resample(df, spark.createDataFrame([(t, 1) for t in target], "text string, n int"))
    assert got(out) == plain_resample(docs, target)


def test_slices_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(importance, "SLICE", 50)
    docs = documents(60)
    out = importance.importance_resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("w1 w2",)], "text string"))
    assert got(out) == plain_resample(docs, ["w1 w2"])


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_ranks_over_ranges(spark, parts):
    rows = [(i, i % 7) for i in range(500)]
    placed, size = importance.ranked(spark.createDataFrame(rows, "doc_id long, score long").repartition(parts),
                                     [F.desc("score"), F.asc_nulls_last("doc_id")], "rank")
    want = {i: k for k, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
    assert size == 500 and {r["doc_id"]: r["rank"] for r in placed.collect()} == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.importance_resample(none, none).collect() == []
    docs = documents(50)
    assert got(importance.importance_resample(spark.createDataFrame(docs, "doc_id long, text string"), none)) == plain_resample(docs, [])


def test_very_long_text(spark):
    docs = [(1, "long Word " * 300_000), (2, "x" * 3_000_000)]
    out = importance.importance_resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("long word",)], "text string"))
    assert got(out) == plain_resample(docs, ["long word"])


def test_query_equals_plain_version(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    target = [t for t, in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    assert got(QUERIES["op12_importance_resampling"](spark, SF)) == plain_resample(docs, target)

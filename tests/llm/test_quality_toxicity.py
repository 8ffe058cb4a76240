import zlib

import numpy as np
import pyarrow as pa
import pytest

from tersus.llm import quality, toxicity
from tersus.llm.suite import QUERIES

SF = "/root/testdata/sf0.01"


def fold_of(i, n=5):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n


def held_out_errors(spark, name, label, threshold):
    rows = {r["doc_id"]: r for r in QUERIES[name](spark, SF).collect()}
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold) for r in rows.values())
    assert all(r["held_out"] == (fold_of(i) == 0) for i, r in rows.items())
    held = [(rows[i]["predicted"], y) for i, y in labels.items() if rows[i]["held_out"]]
    return sum(p != y for p, y in held), len(held), sum(y for _, y in held)


def test_quality_on_held_out_labels(spark):
    wrong, n, _ = held_out_errors(spark, "op5_quality_discriminant", "quality", 0.3)
    assert n > 50 and wrong <= 0.03 * n


def test_toxicity_on_held_out_labels(spark):
    wrong, n, toxic = held_out_errors(spark, "op8_toxicity_ngrams", "toxic", 0.5)
    assert toxic > 3 and wrong <= 0.05 * n


# ------------------------------------------------------------------ quality
def test_scores_equal_gaussian_posterior(spark):
    r = np.random.default_rng(2)
    docs = [(i, " ".join(r.choice(["word", "word,", "AND", "12", "!!", "some", "text."], r.integers(0, 40)))) for i in range(300)]
    y = {i: int(r.random() < 0.6 + 0.3 * (len(t) > 60)) for i, t in docs}
    df = spark.createDataFrame([(i, t, 1.0, [0.0]) for i, t in docs], "doc_id long, text string, score double, x array<double>")
    labels = spark.createDataFrame([*y.items(), (5, y[5]), (None, 1), (7, None)], "doc_id long, quality int")
    got = {row["doc_id"]: row["score"] for row in quality.quality_scores(df, labels).collect()}
    x = {i: np.array(quality.statistics(t)) for i, t in docs}
    density = {}
    train = {c: np.array([x[i] for i in y if y[i] == c and fold_of(i) != 0]) for c in (0, 1)}
    spread = {c: np.cov(v.T, bias=True) for c, v in train.items()}
    pooled = sum(len(train[c]) * spread[c] for c in train) / sum(map(len, train.values()))
    for c, v in train.items():
        s = 0.7 * spread[c] + 0.3 * pooled
        s = 0.8 * s + 0.2 * np.diag(np.diag(s)) + 1e-3 * np.eye(len(s))
        inverse, log_det = np.linalg.inv(s), np.linalg.slogdet(s)[1]
        density[c] = {i: -0.5 * ((z - v.mean(axis=0)) @ inverse @ (z - v.mean(axis=0)) + log_det) + np.log(len(v)) for i, z in x.items()}
    for i, _ in docs:
        assert got[i] == pytest.approx(1 / (1 + np.exp(density[0][i] - density[1][i])), rel=1e-6, abs=1e-12)


def test_quality_edge_cases(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, None), (3, "")], "doc_id long, text string")
    one = spark.createDataFrame([(i, 1) for i in range(1, 9)], "doc_id long, quality int")
    none = one.limit(0)
    assert {r["score"] for r in quality.quality_scores(df, none).collect()} == {0.5}
    assert len(quality.quality_scores(df, one).collect()) == 4
    assert quality.quality_scores(df.limit(0), one).count() == 0
    assert quality.keep_good(df, none).count() == 4
    assert quality.keep_good(df.limit(0), one).columns == df.columns
    assert all(np.isfinite(quality.statistics(t)).all() for t in ("", " ", "a", "!" * 10_000, "x " * 100_000))


# ------------------------------------------------------------------ toxicity
def plain_ngrams(text):
    return {f" {w} "[i:i + n] for w in text.lower().split() for n in toxicity.SIZES for i in range(len(w) + 3 - n)}


def hash_of(gram):  # the rolling hash
    h = 0
    for c in gram:
        h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) % (1 << 64)
    return h


def test_ngrams_equal_plain_version():
    texts = ["You are Éa bad", "", "bad bad\nbad \t x", "\U0001f600 nul\0nul", "abcdefghij klm"]
    words, which, offsets = toxicity._documents(pa.array(texts))
    hashes, whose = toxicity.word_ngrams(words)
    doc, grams = toxicity._distinct(hashes, whose, len(words), which, offsets)
    for i, t in enumerate(texts):
        assert sorted(grams[doc == i].tolist()) == sorted(hash_of(g) for g in plain_ngrams(t.replace("\0", " ")))


def test_counts_features_and_scores(spark):
    docs = [(i, f"plain words number {i} of text" + (" nasty insult" if i % 4 == 0 else "")) for i in range(200)]
    df = spark.createDataFrame([(i, t, 1, 0.0) for i, t in docs], "doc_id long, text string, label int, score double")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in docs], "doc_id long, toxic int")
    sample, sizes = toxicity.training_sample(df, labels, "toxic", 5, 1000, "doc_id", "text")
    train = [(i, t) for i, t in docs if fold_of(i) != 0]
    assert sizes == {1: sum(i % 4 == 0 for i, _ in train), 0: sum(i % 4 != 0 for i, _ in train)}
    counts = {r["ngram"] % (1 << 64): (r["toxic"], r["clean"]) for r in toxicity.ngram_counts(sample).collect()}
    for gram in (" nas", "insult", "plain", "words"):
        assert counts[hash_of(gram)] == (sum(gram in f" {t} " and i % 4 == 0 for i, t in train), sum(gram in f" {t} " and i % 4 != 0 for i, t in train))
    rows = toxicity.toxicity_scores(df, labels).collect()
    assert all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in rows)
    kept = toxicity.keep_clean(df, labels)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [i for i, _ in docs if i % 4]
    few, _ = toxicity.training_sample(df, labels, "toxic", 5, 20, "doc_id", "text")
    assert sorted(r["label"] for r in few.collect()) == [0] * 20 + [1] * 20


def test_sample_is_bounded_in_rows(spark):
    docs = [(i, f"text {i}") for i in range(100)] + [(7, "text 7")] * 500 + [(8, f"other {i}") for i in range(300)] + [(None, "x"), (9, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, toxic int")
    sample, sizes = toxicity.training_sample(df, labels, "toxic", 5, 30, "doc_id", "text")
    train = {(i, t or "") for i, t in docs if i is not None and fold_of(i) != 0}
    assert sizes == {c: sum(i % 2 == c for i, _ in train) for c in (0, 1)}
    rows = [(r["doc_id"], r["text"]) for r in sample.collect()]
    assert len(rows) == len(set(rows)) == 60 and set(rows) <= train
    whole, _ = toxicity.training_sample(df, labels, "toxic", 5, 10_000, "doc_id", "text")
    assert {(r["doc_id"], r["text"]) for r in whole.collect()} == train


def plain_toxicity(train, texts, least_documents=2, least_ratio=6.0, penalty=1e-4, steps=400):
    """Scores by dense arrays over every n-gram on its own."""
    grams = [plain_ngrams(t) for t, _ in train]
    y = np.array([label for _, label in train], float)
    n1, n0 = int(y.sum()), int((1 - y).sum())
    def cell(k, n, share):
        return (k * np.log(k / (n * share)) if k else 0) + ((n - k) * np.log((n - k) / (n * (1 - share))) if k < n else 0)
    chosen, ratio = [], []
    for g in sorted(set().union(*grams)):
        k1, k0 = sum(g in d for d, label in zip(grams, y) if label), sum(g in d for d, label in zip(grams, y) if not label)
        share = (k1 + k0) / (n1 + n0)
        if least_documents <= k1 + k0 < n1 + n0 and 2 * (cell(k1, n1, share) + cell(k0, n0, share)) >= least_ratio:
            chosen.append(g)
            ratio.append(np.log(((k1 + 1) / (n1 + 2)) / ((k0 + 1) / (n0 + 2))))
    x = np.array([[r * (g in d) for g, r in zip(chosen, ratio)] + [1.0] for d in grams])
    rate = 1 / (0.25 * (x * x).sum(axis=1).max() + penalty)
    w = v = np.zeros(len(chosen) + 1)
    for step in range(1, steps + 1):
        slope = x.T @ (1 / (1 + np.exp(-x @ v)) - y) / len(y) + penalty * np.append(v[:-1], 0)
        before, w = w, v - rate * slope
        v = w + (step - 1) / (step + 2) * (w - before)
    scores = [w[-1] + sum(wi * r for g, r, wi in zip(chosen, ratio, w) if g in plain_ngrams(t)) for t in texts]
    return len(chosen), 1 / (1 + np.exp(-np.array(scores)))


def test_scores_equal_a_plain_classifier(spark, monkeypatch):
    import random
    r = random.Random(4)
    plain, marked = "some words that are quite plain and long Enough".split(), "nasty vile Öde scum".split()
    docs = [(i, " ".join(r.choices(plain, k=9) + (r.choices(marked, k=2) if i % 3 == 0 or r.random() < 0.1 else []))) for i in range(160)]
    labels = {i: int(i % 3 == 0) for i, _ in docs}
    df = spark.createDataFrame(docs + docs[:5], "doc_id long, text string").repartition(3)
    monkeypatch.setattr(toxicity, "SLICE", 2000)
    model = toxicity.fit(df, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"))
    chosen, want = plain_toxicity([(t, labels[i]) for i, t in docs if fold_of(i) != 0], [t for _, t in docs])
    assert len(model.ngrams) == chosen > 20
    assert model.scores(pa.array([t for _, t in docs])) == pytest.approx(want, rel=1e-6)


def test_very_long_texts_are_read_whole(spark):
    docs = [(i, f"plain words number {i}" + (" nasty insult" if i % 2 else "")) for i in range(100)]
    long = [(1000, "plain words " * 200_000 + "nasty insult " * 20), (1001, "plain words " * 200_000), (1002, "w" * 2_000_000)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id long, toxic int")
    rows = toxicity.toxicity_scores(spark.createDataFrame(docs + long, "doc_id long, text string"), labels).collect()
    assert {r["doc_id"]: r["predicted"] for r in rows if r["doc_id"] >= 1000} == {1000: 1, 1001: 0, 1002: 0}


def test_every_telling_word_of_a_large_vocabulary_counts(spark):
    import random
    r = random.Random(9)
    marked = ["".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(9)) for _ in range(500)]
    toxic = [(i, "some plain words " + " ".join(marked[(7 * i + j) % 500] for j in range(20))) for i in range(400)]
    clean = [(1000 + i, f"some plain words number {i}") for i in range(400)]
    df = spark.createDataFrame(toxic + clean, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _ in toxic + clean], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    assert len(model.ngrams) > 3000
    telling = [sum(hash_of(g) in set(model.ngrams.tolist()) for g in plain_ngrams(w)) for w in marked[:40]]
    assert min(telling) > 10
    assert (model.scores(pa.array([f"some plain words {w}" for w in marked])) > model.scores(pa.array(["some plain words"]))).all()


def test_toxicity_edge_cases(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, None), (3, "")], "doc_id long, text string")
    one = spark.createDataFrame([(i, 1) for i in range(1, 9)], "doc_id long, toxic int")
    assert all(r["score"] < 1e-9 for r in toxicity.toxicity_scores(df, one.limit(0)).collect())
    assert len(toxicity.toxicity_scores(df, one).collect()) == 4
    assert toxicity.toxicity_scores(df.limit(0), one).count() == 0

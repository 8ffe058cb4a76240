"""The n-gram model against a plain implementation of interpolated modified Kneser-Ney."""
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tersus.llm import ngram_lm
from tersus.llm.suite import QUERIES

TEXTS = ["the cat sat on the mat", "The cat sat on the hat", "a dog sat on a log", None, "", "the\tcat\nsat", "dog dog dog dog",
         "unique words only here", "the cat sat on the mat", "  spaced   out  ", "Été été", "the the the the the cat",
         "a cat and a dog and a log", "on the mat the cat sat", "mat hat log dog cat", "a a b b a b a"] * 2 + ["x y z"]
ROWS = list(enumerate(TEXTS))


def words(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", text) + ["\n"]


def plain_model(texts, order):
    raw = {k: Counter() for k in range(1, order + 1)}
    for t in texts:
        w = ["<s>"] * (order - 1) + words(t)
        for i in range(order - 1, len(w)):
            for k in range(1, order + 1):
                raw[k][tuple(w[i - k + 1:i + 1])] += 1
    count = {order: dict(raw[order])}
    for k in range(order - 1, 0, -1):
        left = defaultdict(set)
        for g in raw[k + 1]:
            left[g[1:]].add(g[0])
        count[k] = {g: raw[k][g] if g[0] == "<s>" else len(left[g]) for g in raw[k]}
    d = {}
    for k in count:
        n = [sum(1 for c in count[k].values() if c == i) for i in (1, 2, 3, 4)]
        d[k] = (0, *ngram_lm.discounts(n))
    vocabulary = {g[0] for g in raw[1]}

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / (len(vocabulary) + 1)
        context = {h: c for h, c in count[k].items() if h[:-1] == g[:-1]}
        total = sum(context.values())
        if not total:
            return p(g[1:])
        c = count[k].get(g, 0)
        rest = sum(d[k][min(x, 3)] for x in context.values()) / total
        return max(c - d[k][min(c, 3)], 0) / total + rest * p(g[1:])
    return p, raw[1], vocabulary


@pytest.mark.parametrize("order", [2, 3, 4])
def test_probabilities_equal_the_plain_model(spark, order):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = {r["doc_id"]: r for r in ngram_lm.held_out_scores(df, order).collect()}
    train = [t for i, t in ROWS if zlib.crc32(str(i).encode()) % 7 != 2]
    p, unigrams, vocabulary = plain_model(train, order)
    n, v = sum(unigrams.values()), len(vocabulary)
    assert sorted(got) == [i for i, _ in ROWS]
    for i, t in ROWS:
        w, r = words(t), got[i]
        padded = ["<s>"] * (order - 1) + [x if x in vocabulary else "<unk>" for x in w]
        expected = sum(math.log10(p(tuple(padded[j - order + 1:j + 1]))) for j in range(order - 1, len(padded)))
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(x in vocabulary for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((unigrams[(x,)] + 1) / (n + v + 1)) for x in w), rel=1e-12)
        assert r["score"] == pytest.approx(expected, rel=1e-6)


def test_probabilities_sum_to_one(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    model = ngram_lm.train(df, 2)
    known = sorted({w for _, t in ROWS for w in words(t)} - {"\n"})
    for before in ["the", "cat", "nowhere"]:
        probe = spark.createDataFrame([(i, f"{before} {w}") for i, w in enumerate([*known, "<new>"])] + [(-1, before)], "doc_id long, text string")
        rows = {r["doc_id"]: r["score"] for r in ngram_lm.score(probe, model).collect()}
        tails = {r["doc_id"]: r["score"] for r in ngram_lm.score(
            spark.createDataFrame([(i, w) for i, w in enumerate([*known, "<new>"])], "doc_id long, text string"), model).collect()}
        assert len(rows) == len(tails) + 1
        # p(w | before) = p(before, w, end) / p(before) / p(end | w); summed with p(end | before) it must be 1
        import numpy as np
        from tersus.llm.ngram_lm import tokens
        import pyarrow as pa
        used, token, doc, sizes = tokens(pa.array([f"{before} {w}" for w in [*known, "<new>"]] + [before]))
        ids, counts = model.number(used)
        columns = ngram_lm.ngrams(ids[token], doc, sizes, 2, model.start)
        p = model.probabilities(columns, ngram_lm.ngrams(counts[token], doc, sizes, 2, model.documents))
        starts = np.cumsum(sizes) - sizes
        assert sum(p[starts[:-1] + 1]) + p[starts[-1] + 1] == pytest.approx(1, rel=1e-5)


def test_hot_context_over_many_shards(spark):
    rows = [(i, " ".join(f"hot w{i}x{j}" for j in range(200))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    few, many = ngram_lm.train(df, 2, shards=1), ngram_lm.train(df, 2, shards=4, part_tokens=-(-12_031 // 16))
    a = {r["doc_id"]: r["score"] for r in ngram_lm.score(df, few).collect()}
    b = {r["doc_id"]: r["score"] for r in ngram_lm.score(df, many).collect()}
    assert a == pytest.approx(b, rel=1e-9)
    assert (few.parts, many.parts) == (1, 16)
    sizes = [len(many.ngram_arrays[2].array(s, "low", "u4")) for s in range(16)]
    assert max(sizes) < 3 * sum(sizes) / 16  # the context that has a third of all n-grams is spread


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_lm.held_out_scores(empty).count() == 0
    df = spark.createDataFrame([(1, "a b", 5, "x"), (None, "a b", 6, "y")], "doc_id long, text string, score long, shard string")
    assert sorted(ngram_lm.held_out_scores(df).columns) == sorted(
        ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    assert ngram_lm.held_out_scores(df).count() == 2


def test_blocks_round_trip():
    import numpy as np
    arrays = [np.array([1, 2, 2**40], np.uint64), np.array([0, 0, 255], np.uint64), np.array([7, 2**63, 1], np.uint64)]
    assert all((a == b).all() for a, b in zip(arrays, ngram_lm.unpack(ngram_lm.pack(arrays))))


def test_query_on_small_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = QUERIES["op7_kneser_ney_lm"](spark, sf).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_query_uses_the_trigram_model(spark):
    sf = "/root/testdata/sf0.001"
    def scores(rows):
        return sorted((r["doc_id"], r["n_tokens"], round(r["score"], 6)) for r in rows.collect())
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    assert scores(QUERIES["op7_kneser_ney_lm"](spark, sf)) == scores(ngram_lm.held_out_scores(documents, order=3))


def test_very_long_texts_are_counted_and_scored_whole(spark):
    """A text of 300,000 words and one of a single word of a megabyte, held out and not, repeated and beside a null id."""
    many = " ".join(f"w{i % 997} w{i % 13}" for i in range(150_000))
    texts = [(0, many), (2, many), (3, "x" * 1_000_000), (5, many + " tail"), (None, "w1 w1"), (7, None)]
    got = {r["doc_id"]: r for r in ngram_lm.held_out_scores(spark.createDataFrame(texts, "doc_id long, text string"), 3).collect()}
    train = [words(t) for i, t in texts if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    counts = Counter(w for t in train for w in t)
    total, distinct = sum(counts.values()), len(counts)
    for i, t in texts:
        r, w = got[i], words(t)
        base = math.fsum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in w)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(counts[x] > 0 for x in w), total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0 and math.isfinite(r["score"])
    assert math.isclose(got[0]["score"], got[2]["score"], rel_tol=1e-12)

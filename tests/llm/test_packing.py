import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tersus.llm import packing
from tersus.llm.suite import QUERIES

FILE = P.path("byte_bpe_50k.json")
TOK = Tokenizer.from_file(FILE)
TOK.encode_special_tokens = True
SF = "/root/testdata/sf0.001"


def placed(plan):
    out = defaultdict(list)
    for length, rank, count, sequence, offset in plan.segments:
        for i in range(count):
            out[sequence + i].append((offset, length))
    return out


def check_plan(counts, plan, capacity):
    seen = np.zeros(capacity + 1, int)
    ranks = defaultdict(list)
    for length, rank, count, _, _ in plan.segments:
        seen[length] += count
        ranks[length].append((rank, count))
    assert (seen == counts).all()
    for r in ranks.values():  # ranks of a length are dealt out once each
        assert [a for a, _ in sorted(r)] == [sum(c for _, c in sorted(r)[:i]) for i in range(len(r))]
    bins = placed(plan)
    assert len(bins) == plan.sequences
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


def exact_optimum(items, capacity):
    """Fewest bins by full search, for a few items."""
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + items[i] <= capacity and bins[b] not in bins[:b]:
                go(i + 1, bins[:b] + [bins[b] + items[i]] + bins[b + 1:])
        go(i + 1, bins + [items[i]])
    go(0, [])
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=9))
def test_plan_is_valid_and_near_the_optimum(items):
    counts = np.bincount(items, minlength=41) if items else np.zeros(41, int)
    plan = packing.best_plan(counts, 40)
    check_plan(counts, plan, 40)
    optimum = exact_optimum(sorted(items, reverse=True), 40) if items else 0
    assert optimum <= plan.sequences <= optimum + 1


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 400), st.integers(1, 100), st.integers(2, 12))
def test_plans_of_many_pieces(seed, many, least, groups):
    r = np.random.default_rng(seed)
    counts = np.bincount(r.integers(least, 129, many), minlength=129)
    plan = packing.plan_packing(counts, 128, groups=groups)
    check_plan(counts, plan, 128)


def test_configurations_beat_best_fit_where_it_is_poor():
    counts = np.bincount(np.random.default_rng(1).integers(400, 1000, 20_000), minlength=2049)
    grouped = packing.best_plan(counts, 2048).sequences
    assert grouped < 0.97 * packing.plan_packing(counts, 2048, small_up_to=2048).sequences
    assert grouped < 1.02 * (counts * np.arange(2049)).sum() / 2048


def check_table(rows, docs, capacity):
    """Every row against plain encoding and cutting; every sequence gapless and within capacity."""
    texts = defaultdict(list)
    for i, t in docs:
        texts[i].append(t or "")
    expected = []
    for i, t in docs:
        ids = TOK.encode(t or "", add_special_tokens=False).ids + [0]
        head = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(head, len(ids) + 1, capacity)]
        expected += [(str(i), n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(expected)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_query_equals_plain_version(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = QUERIES["op2_best_fit_packing"](spark, SF).collect()
    used = check_table(rows, docs, 2048)
    assert used <= 1.02 * sum(r["length"] for r in rows) / 2048 + 1


def test_nulls_repeats_long_texts_and_clashing_columns(spark):
    docs = [(1, "some words here"), (1, "some words here"), (2, None), (3, ""), (None, "x y z"), (None, None), (4, "many words " * 2000),
            (5, "a" * 5000), (6, "q  r\n\n s")]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], "doc_id long, text string, length int, rank int, bucket int")
    check_table(packing.pack_documents(df, FILE, 64).collect(), docs, 64)
    assert packing.pack_documents(df.limit(0), FILE, 64).count() == 0


def test_frequent_length_is_ranked_in_many_buckets(spark):
    df = spark.createDataFrame([(i, "same length") for i in range(700)] + [(1000, "a longer text of some words")], "doc_id long, text string")
    cut = packing.written(packing.pieces(df, FILE, 16), "test-pieces")
    rows = packing.pack_pieces(cut, 16, rank_rows=8).collect()
    check_table(rows, [(r["doc_id"], r["text"]) for r in df.collect()], 16)

import zlib

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tersus.llm import repair
from tersus.llm.suite import QUERIES

FILE = P.path("word_bpe_49k.json")
TOK = Tokenizer.from_file(FILE)
TOK.encode_special_tokens = True
SF = "/root/testdata/sf0.001"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=60), max_size=8), st.integers(1, 30))
def test_grammar_round_trip(docs, pairs):
    ids = np.array([x for d in docs for x in d], np.int32)
    lengths = np.array([len(d) for d in docs], np.int64)
    left, right, expansion, seq, symbols = repair.compress(ids, lengths, 6, pairs_a_round=pairs, least_count=2, least_gain=0.0)
    assert symbols.sum() == len(seq)
    data = repair.shard_bytes(np.arange(len(docs)), np.zeros(len(docs), bool), ids, lengths, 6)
    shard = repair.Shard(data)
    assert shard.decode().tolist() == ids.tolist()
    for i, d in enumerate(docs):
        assert shard.document(i).tolist() == d
        assert shard.document(i, 2, 5).tolist() == d[2:5] or len(d) < 5

    def expand(symbol):
        return [symbol] if symbol < 6 else expand(left[symbol - 6]) + expand(right[symbol - 6])
    assert [x for s in seq.tolist() for x in expand(s)] == ids.tolist()
    assert expansion.tolist() == [len(expand(6 + i)) for i in range(len(left))]
    at = 0
    for d, n in zip(docs, symbols):  # no symbol crosses documents
        assert [x for s in seq[at:at + n].tolist() for x in expand(s)] == d
        at += n


def test_frequent_pairs_shorten_the_sequence():
    ids = np.array([1, 2, 3, 4] * 1000 + [5] * 1000, np.int32)
    _, _, _, seq, _ = repair.compress(ids, np.array([len(ids)]), 6)
    assert len(seq) < len(ids) / 8


def test_repair_goes_on_until_no_pair_occurs_twice():
    r = np.random.default_rng(5)
    phrases = [r.integers(0, 49_408, 40) for _ in range(900)]  # 35,100 pairs and more: symbols pass two bytes
    docs = [np.concatenate([phrases[i] for i in r.integers(0, 900, 20)]) for _ in range(400)]
    ids, lengths = np.concatenate(docs).astype(np.int32), np.array([len(d) for d in docs], np.int64)
    _, _, expansion, seq, symbols = repair.compress(ids, lengths, 49_408)
    ends = np.cumsum(symbols)
    inside = np.ones(len(seq), bool)
    inside[ends - 1] = False
    pairs = np.stack([seq[:-1], seq[1:]], 1)[inside[:-1]]
    found, count = np.unique(pairs, axis=0, return_counts=True)
    assert all(a == b for a, b in found[count > 1])  # only in a run may a pair overlap itself
    assert 49_408 + len(expansion) > 0xFFFF and expansion.max() >= 40 and len(seq) < len(ids) / 30
    data = repair.shard_bytes(np.arange(400), np.zeros(400, bool), ids, lengths, 49_408)
    shard = repair.Shard(data)
    assert (shard.decode() == ids).all() and (shard.document(7, 30, 500) == docs[7][30:500]).all()


def test_a_document_is_read_without_the_rest_of_the_grammar(monkeypatch):
    """Of 2,000 documents one's range looks up few symbols, however many rules there are."""
    r = np.random.default_rng(3)
    phrases = [r.integers(0, 5_000, 30) for _ in range(3_000)]
    docs = [np.concatenate([phrases[i] for i in r.integers(0, 3_000, 12)]) for _ in range(2_000)]
    ids, lengths = np.concatenate(docs).astype(np.int32), np.array([len(d) for d in docs], np.int64)
    shard = repair.Shard(repair.shard_bytes(np.arange(2_000), np.zeros(2_000, bool), ids, lengths, 5_000))
    looked_up, lengths_of = [], shard.lengths
    monkeypatch.setattr(shard, "lengths", lambda symbols: (looked_up.append(len(symbols)), lengths_of(symbols))[1])
    assert len(shard.left) > 50_000
    for i, a, b in [(0, 0, None), (1999, 100, 101), (7, 359, 360), (9, 50, 50), (5, 400, 500), (3, 350, 900)]:
        looked_up.clear()
        assert shard.document(i, a, b).tolist() == docs[i][a:b].tolist()
        assert sum(looked_up) <= 360 * 12


def test_a_very_long_text_among_short_ones(spark):
    docs = [(0, "a b"), (1, "some words again " * 60_000), (2, "x" * 200_000), (3, "c")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, repair.token_files(df, FILE, 1, shard_tokens=1000).collect())) == plain(docs)


def test_rare_pairs_are_replaced():
    ids = np.array([1, 2, 3, 4, 9, 1, 2, 3, 4, 8], np.int32)
    left, _, _, seq, _ = repair.compress(ids, np.array([10]), 10)
    assert len(left) == 3 and len(seq) == 4


def plain(docs):
    out, start = [], 0
    for i, t in docs:
        ids = TOK.encode(t or "", add_special_tokens=False).ids + [1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_equals_plain_version(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    assert sorted(map(tuple, QUERIES["op9_repair_token_files"](spark, SF).collect())) == plain(docs)


def test_many_shards_nulls_repeats_and_clashing_columns(spark):
    docs = [(i, f"text number {i} of a few words") for i in range(200)] + [(200, "same"), (200, "same"), (201, None), (202, "")]
    df = spark.createDataFrame([(i, t, 0, "p") for i, t in docs], "doc_id long, text string, part int, path string").repartition(5)
    got = sorted(map(tuple, repair.token_files(df, FILE, 1, shard_tokens=100).collect()))
    assert got == plain(docs)
    null = spark.createDataFrame([(None, "x"), (1, "y"), (None, None)], "doc_id long, text string")
    rows = sorted(map(tuple, repair.token_files(null, FILE, 1).collect()), key=lambda r: r[1])
    assert [r[0] for r in rows] == [None, None, 1] and rows[-1][1] == 3
    assert repair.token_files(df.limit(0), FILE, 1).count() == 0

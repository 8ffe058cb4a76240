import hashlib

import public_tokenizers as P
from hypothesis import given, settings, strategies as st

from tersus.llm import bpe_codec
from tersus.llm.suite import QUERIES

RANKS = P.path("byte_bpe_50k.tiktoken")
ENC = bpe_codec.encoding(RANKS, P.PATTERN)
SF = "/root/testdata/sf0.001"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "word", "'ll", " ", "  ", "\n", "12", "é", " ", "!?", "\U0001f600", "<|endoftext|>", "\t", "x y"]),
                max_size=40).map("".join), st.integers(1, 9))
def test_pieces_give_the_whole_texts_ids(text, size):
    assert "".join(bpe_codec.safe_pieces(text, size)) == text
    ids = bpe_codec.encode(ENC, text, size)
    assert ids == ENC.encode_ordinary(text)
    assert bpe_codec.decode(ENC, ids) == text.encode()


def test_table_round_trip_and_cut_ids(spark):
    rows = [(1, "Hello <|endoftext|> world"), (2, ""), (3, None), (None, "é" * 3), (1, "Hello <|endoftext|> world"), (5, "a b " * 60_000), (6, "z" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "'x' AS n_tokens")
    ids = bpe_codec.encode_table(df, RANKS, P.PATTERN)
    back = bpe_codec.decode_table(ids, RANKS, P.PATTERN)
    assert sorted((str(r[0]), bytes(r[1])) for r in back.collect()) == sorted((str(i), (t or "").encode()) for i, t in rows)
    first = bpe_codec.encode(ENC, "é\U0001f600")[:1]
    assert "é\U0001f600".encode().startswith(bpe_codec.decode(ENC, first))
    assert bpe_codec.round_trip(df.limit(0), RANKS, P.PATTERN).count() == 0


def test_query_equals_tiktoken(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in QUERIES["op1_byte_bpe_codec"](spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids = ENC.encode_ordinary(d["text"] or "")
        r = got[d["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()

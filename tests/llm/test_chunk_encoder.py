import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from tersus.llm.chunk_encoder import ChunkEncoder, by_size

BYTE = ChunkEncoder(P.path("byte_bpe_50k.json"), 0, False, max_chunks=50)
WORD = ChunkEncoder(P.path("word_bpe_49k.json"), 1, True, max_chunks=50)
PIECES = ["a", "word", "Word.", "'ll", "'", " ", "  ", "\n", "\n\n", "12", "é", "É", "é", "H̱", " ", "!?", ".", ",", "\U0001f600",
          "<|endoftext|>", "<|startoftext|>", "\t", "\x0b", "\x1c", "\x1f", "™", "İ", "Σ", "x y", " ", "ﬁ", "0", "ŉ", "ſ", "ß", "x̂", "q.", "Ω", "я", "ŸZ!!"]


@pytest.mark.parametrize("encoder", [BYTE, WORD])
@settings(max_examples=500, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(PIECES), max_size=15).map("".join), max_size=6))
def test_ids_equal_the_whole_texts(encoder, texts):
    ids, at = encoder.encode(pa.array(texts, pa.string()))
    expected = [row + [encoder.end_id] for row in encoder._ids(texts)] if texts else []
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == expected


def test_slices_hold_all_rows_in_order():
    batch = pa.RecordBatch.from_arrays([pa.array(["aa", "", "b" * 50, "c", "", "dd"])], ["text"])
    parts = list(by_size([batch, batch.slice(0, 0)], max_bytes=4))
    assert [x for p in parts for x in p.column("text").to_pylist()] == batch.column("text").to_pylist()
    assert len(parts) > 1


def test_new_chunks_are_looked_up_among_the_new_ones_alone(monkeypatch):
    """The dictionary is searched once a call, however many chunks are new; ids are those of the whole texts."""
    import pyarrow.compute as pc
    from tokenizers import Tokenizer
    from tersus.llm import chunk_encoder as ce
    path = P.path("word_bpe_49k.json")
    whole, encoder = Tokenizer.from_file(path), ce.ChunkEncoder(path, 1, True)
    whole.encode_special_tokens = True
    searched, index_in = [], pc.index_in
    monkeypatch.setattr(ce.pc, "index_in", lambda x, value_set: (searched.append(len(value_set)), index_in(x, value_set=value_set))[1])
    first = [" ".join(f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{i // 100 * 'x'}" for i in range(1000)), "Ünïcode naïve été 12-ab é"]
    for texts in (first, ["naïve newcomer Newcomer newcömer, 77", first[0]]):
        ids, at = encoder.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == \
            [whole.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    assert searched[2] > 1000 and searched[3] < 10


def test_odd_chunks_are_those_with_white_space_at_an_edge():
    from tersus.llm.chunk_encoder import _odd

    def plain(chunk):
        body = chunk[1:] if chunk[:1] == " " else chunk
        return chunk != "\n" and (not body or body[0].isspace() or body[-1].isspace())
    spaces = [chr(i) for i in range(0x3100) if chr(i).isspace()]
    chunks = [a + b + c for a in ["", " ", "x", *spaces] for b in ["", "x", *spaces, "​"] for c in ["", " ", "x", "\n"]]
    assert _odd(pa.array(chunks)).tolist() == [plain(c) for c in chunks]


def test_the_library_gets_bounded_lots(monkeypatch):
    """Many new words, and many texts that are encoded whole, go to the tokenizer in lots; the ids stay the same."""
    from tokenizers import Tokenizer
    from tersus.llm import chunk_encoder as ce
    monkeypatch.setattr(ce, "LOT_CHARACTERS", 200, raising=False)
    monkeypatch.setattr(ce, "LOT_WORDS", 10, raising=False)
    texts = [" ".join(f"{'abcdefghij'[i % 10]}{'klmnopqrst'[j % 10]}{'uvwxyz'[j // 10]}" for j in range(60)) for i in range(10)]
    texts += [f"white  space \t {i} x" for i in range(60)] + ["a very long  one " * 40, ""]
    for path, end_id, dropped in ((P.path("byte_bpe_50k.json"), 0, False), (P.path("word_bpe_49k.json"), 1, True)):
        whole, encoder, sizes = Tokenizer.from_file(path), ce.ChunkEncoder(path, end_id, dropped), []

        class Noted:
            def __init__(self, inner):
                self.inner = inner

            def encode_batch_fast(self, lot, **more):
                sizes.append((sum(map(len, lot)), len(lot)))
                return self.inner.encode_batch_fast(lot, **more)
        for name in ("tokenizer", "plain", "ascii"):
            if hasattr(encoder, name):
                setattr(encoder, name, Noted(getattr(encoder, name)))
        ids, at = encoder.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == \
            [whole.encode(t, add_special_tokens=False).ids + [end_id] for t in texts]
        assert all(size <= 200 or many == 1 and size <= len(texts[-2]) for size, many in sizes)
        assert sorted(s for s, _ in sizes)[-2] <= 200

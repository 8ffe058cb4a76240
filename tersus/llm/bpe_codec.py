"""Byte-level BPE encoding and decoding with tiktoken and a local rank file."""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from .common import prepare_workers, texts

#: A text is cut only before a single space between two visible characters. The pre-splitting pattern never
#: matches across such a place: a space starts a match there, and no alternative holds a space after a
#: visible character. So the pieces' ids are the whole text's ids.
SAFE = re.compile(r"(?<=[!-~\w]) (?=[!-~\w])")


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int = 65536):
    """The whole text in pieces of about ``size`` characters or more, cut at safe boundaries only."""
    at = 0
    while len(text) - at > size:
        cut = SAFE.search(text, at + size)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:]


def encode(enc: tiktoken.Encoding, text: str, piece_chars: int = 65536) -> list[int]:
    ids: list[int] = []
    for piece in safe_pieces(text, piece_chars):
        ids += enc.encode_ordinary(piece)
    return ids


def decode(enc: tiktoken.Encoding, ids: list[int]) -> bytes:
    """Raw bytes of the ids; a cut id list need not be valid UTF-8."""
    return enc.decode_bytes(ids)


def encode_table(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                 piece_chars: int = 65536) -> DataFrame:
    """doc_id, ids (array of int) for every row; a null text counts as empty and has no ids."""
    def run(batches):
        enc = encoding(rank_file, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                ids = [encode(enc, t, piece_chars) for t in rows.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])
    return texts(df, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode_table(df: DataFrame, rank_file: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """doc_id, bytes (binary) for every row of ``encode_table``'s form; null ids give null bytes."""
    def run(batches):
        enc = encoding(rank_file, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                data = [None if ids is None else decode(enc, ids) for ids in rows.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "bytes"])
    prepare_workers(df.sparkSession)
    return df.selectExpr("doc_id", f"`{ids_col}` AS ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
               piece_chars: int = 65536) -> DataFrame:
    """Encode every text and decode its ids again, in one pass and one row at a time.

    doc_id, n_tokens, ids_sha256 (of the decimal ids joined by one space), decoded_sha256 (of the decoded
    bytes). Null and empty texts have no ids and the digests of the empty string. Repeated rows repeat,
    null ids stay null, an empty table gives no rows, other columns are not read.
    """
    def run(batches):
        enc = encoding(rank_file, pattern)
        decimal = [b"%d" % i for i in range(enc.n_vocab)]
        for batch in batches:
            counts, encoded, decoded = [], [], []
            for text in batch.column("text"):
                ids = encode(enc, text.as_py(), piece_chars)
                counts.append(len(ids))
                encoded.append(hashlib.sha256(b" ".join([decimal[i] for i in ids])).hexdigest())
                decoded.append(hashlib.sha256(decode(enc, ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()),
                                              pa.array(decoded, pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return texts(df, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

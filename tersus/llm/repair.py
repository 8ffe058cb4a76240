"""Token ids on disk, compressed by Re-Pair grammars with random access.

A shard holds whole documents in order. Frequent pairs of adjacent symbols, never across documents, are
replaced by new symbols (nonterminals) again and again until no pair occurs twice; the shard stores the rules,
the expansion length of every symbol and the remaining sequence. Each round replaces a batch of the most
frequent pairs at once: where occurrences overlap, the more frequent pair wins.

File: ``MAGIC``, the header's length (4 bytes), the header (JSON: counts and array types), then the arrays in
``ARRAYS`` order, little-endian.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tersus.session import scratch_dir

from .chunk_encoder import by_size, chunk_encoder, ragged
from .common import mounted, shuffle_partitions, texts, write_atomically

MAGIC = b"TRPG0001"
#: Marks of a place in a shard's sequence: its pair may occur again; its document ends there.
ALIVE, LAST = 1, 2
ARRAYS = ("doc_ids", "doc_tokens", "doc_symbols", "left", "right", "expansion", "sequence")


def compress(ids: np.ndarray, doc_lengths: np.ndarray, alphabet: int, pairs_a_round: int = 8000,
             least_count: int = 2, least_gain: float = 0.0, rounds: int | None = None):
    """(left, right, expansion, sequence, symbols of each document). Goes on until no pair occurs ``least_count``
    times (2 or more). ``least_gain`` (share of the sequence that a round must save) and ``rounds`` stop it earlier.

    A round replaces ``pairs_a_round`` pairs, or all that are at least half as frequent as the first if those are
    more. Pairs are counted as 32-bit numbers while symbols fit two bytes, then as 64-bit numbers."""
    least_count = max(2, least_count)
    kind, shift, limit = np.uint32, 16, 0xFFFF
    seq = ids.astype(np.uint32)
    flags = np.full(len(seq), ALIVE, np.uint8)
    flags[np.cumsum(doc_lengths)[doc_lengths > 0] - 1] = ALIVE | LAST
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    expansion = np.ones(alphabet, np.int64)
    top, done = alphabet, 0
    while len(seq) > 1 and (rounds is None or done < rounds):
        done += 1
        if shift == 16 and top + pairs_a_round > limit:
            kind, shift, limit = np.uint64, 32, 0xFFFFFFFF
        none = np.iinfo(kind).max  # no pair: the highest symbol is never given
        live = np.flatnonzero(flags[:-1] == ALIVE)
        code = seq[live].astype(kind, copy=False) << kind(shift)
        code |= seq[live + 1]
        # a pair of old symbols never gets more frequent: one that is alone by hash is not looked at again (in the first
        # round hardly any is, and to look for them every other round is cheaper)
        if done % 2 == 0:
            slot = _slot(code, max(10, len(live).bit_length() + 1))
            some = np.bincount(slot)[slot] > 1
            flags[live[~some]] = 0
            live, code = live[some], code[some]
        # in a run of one symbol the pair overlaps itself: take every other place
        again = np.flatnonzero((code[1:] == code[:-1]) & (live[1:] == live[:-1] + 1)) + 1
        if len(again):
            runs = np.flatnonzero(np.diff(again, prepend=-1) > 1)
            nth = np.arange(len(again)) - np.repeat(runs, np.diff(runs, append=len(again)))
            code[again[nth % 2 == 0]] = none
        ordered = np.sort(code)
        edge = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[:len(ordered)])
        counts = np.diff(edge, append=len(ordered))
        if len(ordered) and ordered[-1] == none:
            edge, counts = edge[:-1], counts[:-1]
        frequent = np.flatnonzero(counts >= least_count)
        if not len(frequent):
            break
        # most frequent first; 16 bits, which numpy sorts by digits (beyond them the order does not matter)
        frequent = frequent[np.argsort((0xFFFF - np.minimum(counts[frequent], 0xFFFF)).astype(np.uint16), kind="stable")]
        batch = max(pairs_a_round, int((2 * counts[frequent] >= counts[frequent].max()).sum()))
        pair = ordered[edge[frequent[:min(batch, limit - top)]]]  # most frequent first
        # rank of each live pair: a table by hash, of which the most frequent pair of a slot is the entry
        bits = max(18, len(pair).bit_length() + 2)
        table = np.full(1 << bits, len(pair), np.int32)
        table[_slot(pair, bits)[::-1]] = np.arange(len(pair) - 1, -1, -1, dtype=np.int32)
        own = table[_slot(code, bits)]
        found = np.flatnonzero(own < len(pair))
        found = found[pair[own[found]] == code[found]]
        own, place = own[found], live[found]
        rank = np.full(len(seq) + 1, len(pair), np.int32)  # the last place stands for none, also before the first
        rank[place] = own
        at = place[(own < rank[place - 1]) & (own <= rank[place + 1])]  # never two neighbours
        uses = np.bincount(rank[at], minlength=len(pair))
        at = at[uses[rank[at]] > 1]  # never empty: the most frequent pair has all its places
        if len(at) < least_gain * len(seq):
            break
        chosen = rank[at]
        used = np.flatnonzero(uses > 1)
        symbol = np.zeros(len(pair), np.uint32)
        symbol[used] = top + np.arange(len(used))
        left.append((pair[used] >> kind(shift)).astype(np.int64))
        right.append((pair[used] & kind((1 << shift) - 1)).astype(np.int64))
        expansion = np.append(expansion, expansion[left[-1]] + expansion[right[-1]])
        seq[at] = symbol[chosen]
        flags[at] = flags[at + 1] | ALIVE  # new pairs: after a new symbol and before it
        flags[at[at > 0] - 1] |= ALIVE
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, flags = seq[keep], flags[keep]
        top += len(used)
    ends = np.flatnonzero(flags & LAST) + 1
    symbols = np.zeros(len(doc_lengths), np.int64)
    symbols[doc_lengths > 0] = np.diff(ends, prepend=0)
    return np.concatenate(left), np.concatenate(right), expansion[alphabet:], seq, symbols


def _slot(code: np.ndarray, bits: int) -> np.ndarray:
    if code.dtype == np.uint32:
        return (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
    return (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


class Shard:
    """A shard's bytes, opened for random access."""

    def __init__(self, data):
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a token shard")
        size = struct.unpack("<I", data[8:12])[0]
        self.header = json.loads(bytes(data[12:12 + size]))
        at = 12 + size
        for name in ARRAYS:
            kind, n = self.header[name]
            setattr(self, name, np.frombuffer(data, np.dtype(kind), n, at))
            at += n * np.dtype(kind).itemsize
        self.alphabet = self.header["alphabet"]
        self.doc_at = np.cumsum(self.doc_symbols) - self.doc_symbols

    def lengths(self, symbols: np.ndarray) -> np.ndarray:
        """How many ids each symbol stands for."""
        out = np.ones(len(symbols), np.int64)
        rules = symbols >= self.alphabet
        out[rules] = self.expansion[symbols[rules] - self.alphabet]
        return out

    def decode(self) -> np.ndarray:
        """Ids of all documents, one after the other, by a table of every rule's expansion."""
        lengths = np.concatenate([np.ones(self.alphabet, np.int64), self.expansion.astype(np.int64)])
        starts = np.cumsum(lengths) - lengths
        table = np.zeros(int(lengths.sum()), np.int32)
        table[:self.alphabet] = np.arange(self.alphabet)
        a, b = self.left.astype(np.int64), self.right.astype(np.int64)
        parts, part_lengths = (np.stack([x[a], x[b]], 1).ravel() for x in (starts, lengths))
        newest, at = np.maximum(a, b), 0
        while at < len(a):  # rules that need only symbols before them, at once
            later = newest[at:] >= self.alphabet + at
            end = at + int(later.argmax()) if later.any() else len(a)
            first, stop = starts[self.alphabet + at], starts[self.alphabet + end - 1] + lengths[self.alphabet + end - 1]
            table[first:stop] = table[ragged(parts[2 * at:2 * end], part_lengths[2 * at:2 * end])]
            at = end
        return table[ragged(starts[self.sequence], lengths[self.sequence])]

    def document(self, i: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``stop`` of document ``i``. Rules are expanded one level at a time, and by their expansion
        lengths only those that cover the range: the work follows the document's symbols and the ids asked for,
        not the grammar."""
        symbols = self.sequence[self.doc_at[i]:self.doc_at[i] + self.doc_symbols[i]].astype(np.int64)
        stop = int(self.doc_tokens[i]) if stop is None else stop
        before = 0  # ids of the document before the first symbol at hand
        while len(symbols):
            lengths = self.lengths(symbols)
            ends = before + np.cumsum(lengths)
            inside = np.flatnonzero((ends > start) & (ends - lengths < stop))
            if not len(inside):
                return np.zeros(0, np.int32)
            before, symbols = int((ends - lengths)[inside[0]]), symbols[inside]
            rules = symbols >= self.alphabet
            if not rules.any():
                break
            wide = np.where(rules, 2, 1)
            first = np.cumsum(wide) - wide
            level = np.repeat(symbols, wide)
            level[first[rules]] = self.left[symbols[rules] - self.alphabet]
            level[first[rules] + 1] = self.right[symbols[rules] - self.alphabet]
            symbols = level
        return symbols.astype(np.int32)


def shard_bytes(doc_ids: np.ndarray, null_id: np.ndarray, ids: np.ndarray, lengths: np.ndarray, alphabet: int) -> bytes:
    left, right, expansion, seq, symbols = compress(ids, lengths, alphabet)
    def least(a):
        return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0).newbyteorder("<"))
    arrays = dict(zip(ARRAYS, (doc_ids.astype("<i8"), least(lengths), least(symbols), least(left), least(right),
                               least(expansion), least(seq))))
    header = {name: [a.dtype.str, len(a)] for name, a in arrays.items()}
    header |= {"alphabet": alphabet, "null_ids": np.flatnonzero(null_id).tolist()}
    text = json.dumps(header).encode()
    return b"".join([MAGIC, struct.pack("<I", len(text)), text, *(a.tobytes() for a in arrays.values())])


def write_shards(df: DataFrame, tokenizer_file: str, end_id: int, folder: str, shard_tokens: int = 2_000_000,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and write all documents in ascending id order; one row per shard: part, shard, path, tokens.

    Documents are range-partitioned by id (then a hash of the text, so that even a repeated id spreads), and
    a shard is closed at ``shard_tokens``. A retried task writes the same files again.
    """
    def run(batches):
        encoder = chunk_encoder(tokenizer_file, end_id, True)
        alphabet = encoder.tokenizer.get_vocab_size()
        part, shard, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close():
            doc_ids, null, ids, lengths = (np.concatenate(x) for x in zip(*held))
            path = f"{folder}/part-{part:06d}-{shard:06d}.rpg"
            write_atomically(mounted(path), shard_bytes(doc_ids, null, ids, lengths, alphabet))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()),
                                               "path": [path], "tokens": pa.array([len(ids)], pa.int64())})
        for batch in by_size(batches):
            ids, at = encoder.encode(batch.column("text"))
            doc_id = batch.column("doc_id")
            held.append((doc_id.fill_null(0).to_numpy(), doc_id.is_null().to_numpy(zero_copy_only=False), ids, np.diff(at)))
            size += len(ids)
            if size >= shard_tokens:
                yield close()
                shard, held, size = shard + 1, [], 0
        if held:
            yield close()
    rows = texts(df, id_col, text_col).withColumn("spread", F.xxhash64("text"))
    ordered = (rows.repartitionByRange(shuffle_partitions(df.sparkSession), F.asc_nulls_first("doc_id"), "spread")
               .sortWithinPartitions(F.asc_nulls_first("doc_id"), "spread").drop("spread"))
    return ordered.mapInArrow(run, "part int, shard int, path string, tokens long")


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files that ``shards`` lists."""
    parts = shards.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    before = parts.select("part", (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("shard")
    placed = shards.withColumn("inside", F.sum("tokens").over(inside) - F.col("tokens")).join(before, "part").select(
        "path", (F.col("part_start") + F.col("inside")).alias("start"))

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                shard = Shard(np.memmap(mounted(path), np.uint8, "r"))
                ids = memoryview(shard.decode().astype("<u4").tobytes())
                ends = np.cumsum(shard.doc_tokens.astype(np.int64))
                begins = ends - shard.doc_tokens
                crc = [zlib.crc32(ids[a:b]) for a, b in zip((4 * begins).tolist(), (4 * ends).tolist())]
                null = np.zeros(len(ends), bool)
                null[shard.header["null_ids"]] = True
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.asarray(shard.doc_ids), mask=null), pa.array(start + begins),
                     pa.array(shard.doc_tokens.astype(np.int64)), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])
    return placed.repartition(max(1, min(shuffle_partitions(shards.sparkSession), shards.count()))).mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(df: DataFrame, tokenizer_file: str, end_id: int, shard_tokens: int = 2_000_000,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the documents' ids and read them back: doc_id, start, n_tokens, ids_crc32.

    A null or empty text is the end id alone. Null ids come first. Rows that repeat an id follow each other,
    by text hash. An empty table gives no rows. Other columns are not read. Files go to the shared folder. A very long
    text is encoded whole and never cut: it closes the shard that it is in, which one task holds in memory.
    """
    folder = scratch_dir(df.sparkSession, "llm", "token-files")
    listing = f"{folder}/shards.parquet"
    write_shards(df, tokenizer_file, end_id, folder, shard_tokens, id_col, text_col).write.parquet(listing)
    return read_shards(df.sparkSession.read.schema("part int, shard int, path string, tokens long").parquet(listing))

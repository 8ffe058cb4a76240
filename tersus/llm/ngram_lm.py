"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, kept as sorted hash arrays in the shared
folder, memory-mapped by the workers that score texts.

Counting. Each task counts the words (then the n-grams) of its training texts and sends, for every shard, one
compressed block of sorted arrays; a shard's task merges its blocks and writes its arrays. N-grams are dealt by their
context, so a context's totals are summed where its n-grams are, then sent with the lower order's n-grams to where
the context itself is one of them: its arrays hold them beside its own count. A context whose last word is frequent
is dealt over several shards; its partial totals meet there too. One job counts all orders, the highest first. Words are
numbered by their place in the sorted hash arrays, so n-grams travel as numbers. Lower orders count distinct left
neighbours (raw counts after the start of a text), as the method asks.

An n-gram's hash in a shard's sorted array is stored without its leading bits: an index by them tells where each of
their values begins. Counts and totals take a byte, and larger ones a place in a short list.

Scoring. A batch's distinct words, and its n-grams, are looked up in hash order, so reads of a mapped array move
forward. Two words whose 64-bit hashes agree would count as one; n-grams likewise (with 44 bits in a shard).
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tersus.session import scratch_dir

from .chunk_encoder import by_size
from .common import fold, keep_freed_memory, mounted, shuffle_partitions, texts, write_atomically, written

#: A word cannot hold a line feed, so this stands for the end of a text.
END = xxhash.xxh64_intdigest(b"\n")
BLOCK = "kind string, shard int, block binary"
#: Of the n-grams that go on from a context: the sum of their counts, and how many have the count 1, 2, 3 or more.
TOTALS = ["sum", "n1", "n2", "n3"]
HELD = 6_000_000  # n-grams or words that a task holds before it sends blocks
SCORED = 6 << 20  # bytes of text that are scored at once


# ------------------------------------------------------------------ arrays in blocks and files
def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays of equal length as one compressed block; the bytes of a column lie together."""
    parts = [len(arrays).to_bytes(2, "little"), len(arrays[0]).to_bytes(8, "little")]
    for a in arrays:
        a = a.astype(np.min_scalar_type(int(a.max())) if len(a) else np.uint8)
        data = zstandard.compress(a.view(np.uint8).reshape(len(a), -1).T.tobytes(), 1)
        parts += [a.itemsize.to_bytes(1, "little"), len(data).to_bytes(8, "little"), data]
    return b"".join(parts)


def unpack(block: bytes) -> list[np.ndarray]:
    count, n, at, out = int.from_bytes(block[:2], "little"), int.from_bytes(block[2:10], "little"), 10, []
    for _ in range(count):
        width, size = block[at], int.from_bytes(block[at + 1:at + 9], "little")
        data = zstandard.decompress(block[at + 9:at + 9 + size], max_output_size=max(1, width * n)) if n else b""
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, n).T).view(f"<u{width}").ravel().astype(np.uint64))
        at += 9 + size
    return out


def merged(blocks: list[bytes]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*map(unpack, blocks))]


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards are equal ranges of the hash, so the arrays of all shards, one after the other, are sorted."""
    return ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def write_array(folder: str, name: str, shard: int, column: str, a: np.ndarray) -> None:
    write_atomically(mounted(f"{folder}/{name}-{shard:06d}.{column}"), np.ascontiguousarray(a).tobytes())


def write_counts(folder: str, name: str, shard: int, column: str, counts: np.ndarray) -> None:
    """One byte for each count; 255 refers to a short list of larger ones."""
    write_array(folder, name, shard, column, np.minimum(counts, 255).astype(np.uint8))
    large = np.flatnonzero(counts >= 255)
    if len(large):
        write_array(folder, name, shard, column + "-large", np.concatenate([large.astype(np.uint64), counts[large].astype(np.uint64)]))


#: An n-gram's key in its shard, and the part of it that is stored.
KEY_BITS, STORED_BITS = 44, 32
#: Bits of a context's hash that, moved on by the salt, choose the shard.
SHARD_BITS = 20


@dataclass
class HashArrays:
    """Arrays ``name`` of ``folder``, mapped on first use. Pickled without the maps."""
    folder: str
    name: str
    shards: int
    maps: dict = field(default_factory=dict)

    def __getstate__(self):
        return {"folder": self.folder, "name": self.name, "shards": self.shards, "maps": {}}

    def array(self, shard: int, column: str, kind) -> np.ndarray:
        if (shard, column) not in self.maps:
            path = mounted(f"{self.folder}/{self.name}-{shard:06d}.{column}")
            empty = not os.path.exists(path) or not os.path.getsize(path)  # a shard without keys has no file
            self.maps[shard, column] = np.zeros(0, kind) if empty else np.memmap(path, kind, "r").view(np.ndarray)
        return self.maps[shard, column]

    def counts(self, shard: int, column: str, places: np.ndarray) -> np.ndarray:
        """The counts at these places of a shard's column."""
        out = self.array(shard, column, np.uint8)[places].astype(np.int64)
        big = np.flatnonzero(out == 255)
        if len(big):
            large = self.array(shard, column + "-large", np.uint64)
            out[big] = large[len(large) // 2:][np.searchsorted(large[:len(large) // 2], places[big].astype(np.uint64))]
        return out


class WordArrays(HashArrays):
    """64-bit hashes in ascending order; a word's shard is told by its hash."""

    def find(self, keys: np.ndarray):
        """For ascending ``keys``: (slice of the keys, shard, places, found), shard by shard."""
        edges = np.searchsorted(shard_of(keys, self.shards), np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(edges)):
            part = slice(edges[s], edges[s + 1])
            own = self.array(int(s), "key", np.uint64)
            at = np.searchsorted(own, keys[part])
            found = at < len(own)
            found[found] = own[at[found]] == keys[part][found]
            yield part, int(s), at, found


class NgramArrays(HashArrays):
    """Keys of ``ngram_keys``: the shard, then ``KEY_BITS`` bits."""

    @staticmethod
    def write(folder: str, name: str, shard: int, keys: np.ndarray, columns: dict[str, np.ndarray]) -> None:
        """Ascending distinct keys of one shard, without the shard, and their counts by column."""
        bits = max(KEY_BITS - STORED_BITS, len(keys).bit_length() - 4)  # about a dozen keys for each value
        rest = np.uint64(KEY_BITS - bits)
        write_array(folder, name, shard, "index", np.searchsorted(keys >> rest, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.uint32))
        write_array(folder, name, shard, "low", (keys & ((np.uint64(1) << rest) - np.uint64(1))).astype(np.uint32))
        for column, counts in columns.items():
            write_counts(folder, name, shard, column, counts)

    def look_up(self, keys: np.ndarray, columns: list[str]) -> list[np.ndarray]:
        """Of ascending ``keys``: their counts in each column, 0 for unknown ones."""
        out = [np.zeros(len(keys), np.int64) for _ in columns]
        edges = np.searchsorted(keys >> np.uint64(KEY_BITS), np.arange(self.shards + 1, dtype=np.uint64))
        for s in np.flatnonzero(np.diff(edges)):
            index, low = self.array(int(s), "index", np.uint32), self.array(int(s), "low", np.uint32)
            if not len(low):
                continue
            bits = (len(index) - 1).bit_length() - 1
            own = keys[edges[s]:edges[s + 1]] & np.uint64((1 << KEY_BITS) - 1)
            rest = np.uint64(KEY_BITS - bits)
            first, wanted = (own >> rest).astype(np.int64), (own & ((np.uint64(1) << rest) - np.uint64(1))).astype(np.uint32)
            at, end = index[first].astype(np.int64), index[first + 1].astype(np.int64)
            size = int((end - at).max())
            while size > 0:  # halve all ranges at once
                half = (size + 1) // 2
                probe = at + half - 1
                ahead = (probe < end) & (low[np.minimum(probe, len(low) - 1)] < wanted)
                at, size = np.where(ahead, probe + 1, at), size // 2
            found = np.flatnonzero((at < end) & (low[np.minimum(at, len(low) - 1)] == wanted))
            for o, column in zip(out, columns):
                o[edges[s] + found] = self.counts(int(s), column, at[found])
        return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _hash(columns: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(columns[0]), len(columns), np.uint64)
    for c in columns:
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + c + np.uint64(1))
    return h


def _order(columns: list[np.ndarray]) -> np.ndarray:
    """The order of the rows by their columns, in one sort where they fit 64 bits and in a sort of 64 and one of 16
    where they fit 80."""
    bits = [int(c.max()).bit_length() if len(c) else 0 for c in columns]
    if sum(bits) > 80:
        return np.lexsort(columns[::-1])
    spare = max(0, sum(bits) - 64)
    if spare > bits[-1]:
        return np.lexsort(columns[::-1])
    joined = np.zeros(len(columns[0]), np.uint64)
    for c, b in zip(columns[:-1], bits):
        joined = (joined << np.uint64(b)) | c
    joined = (joined << np.uint64(bits[-1] - spare)) | (columns[-1] >> np.uint64(spare))
    if not spare:
        return np.argsort(joined)
    return np.lexsort(((columns[-1] & np.uint64((1 << spare) - 1)).astype(np.uint16), joined))


def _distinct(columns: list[np.ndarray], *weights: np.ndarray) -> tuple[list[np.ndarray], ...]:
    """Distinct rows of the columns in ascending order, then each of the weights summed."""
    order = _order(columns)
    columns = [c[order] for c in columns]
    first = _starts(columns)
    return [c[first] for c in columns], *[np.add.reduceat(w[order], first) if len(first) else w[:0] for w in weights]


def _starts(columns: list[np.ndarray]) -> np.ndarray:
    """Where a row of sorted columns differs from the one before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


# ------------------------------------------------------------------ tokens
def tokens(batch_texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes ascending, each token's index in them, document of each token, tokens of each document):
    words of the texts with A-Z lower-cased, and one end after each."""
    plain = pc.replace_substring_regex(pc.ascii_lower(batch_texts), "[\t-\r]+", " ")
    cut = pc.split_pattern(plain, " ")
    coded = cut.flatten().dictionary_encode()
    words = coded.dictionary.cast(pa.binary()).to_pylist()
    which = coded.indices.to_numpy(zero_copy_only=False)
    counts = np.diff(cut.offsets.to_numpy().astype(np.int64))
    doc = np.repeat(np.arange(len(counts)), counts)
    word = np.fromiter(map(bool, words), bool, len(words))
    if not word.all():  # what lies between two spaces in a row
        some = word[which]
        which, doc = (np.cumsum(word) - 1)[which[some]], doc[some]
        counts, words = np.bincount(doc, minlength=len(counts)), [w for w in words if w]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    ends = np.cumsum(counts)
    hashes = np.append(hashes, np.uint64(END))
    which = np.insert(which, ends, len(words))
    doc = np.insert(doc, ends, np.arange(len(counts)))
    used, token = np.unique(hashes, return_inverse=True)
    return used, token[which], doc, counts + 1


def ngrams(token: np.ndarray, doc: np.ndarray, sizes: np.ndarray, order: int, start: int) -> list[np.ndarray]:
    """Columns of the ``order``-gram that ends at each token; ``start`` fills places before the text."""
    place = np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    columns = []
    for back in range(order - 1, 0, -1):
        c = np.roll(token, back)
        c[place < back] = start
        columns.append(c)
    return [*columns, token]


def ngram_keys(columns: list[np.ndarray], salt: np.ndarray, shards: int) -> np.ndarray:
    """The shard, told by the context's hash moved on by ``salt``, then ``KEY_BITS`` bits of the whole n-gram's."""
    context = ((_hash(columns[:-1]) >> np.uint64(64 - SHARD_BITS)) + salt) & np.uint64((1 << SHARD_BITS) - 1)
    shard = (context * np.uint64(shards)) >> np.uint64(SHARD_BITS)
    return (shard << np.uint64(KEY_BITS)) | (_hash(columns) >> np.uint64(64 - KEY_BITS))


def salts(last_count: np.ndarray, word: np.ndarray, total: int, shards: int) -> np.ndarray:
    """In which of its context's places an n-gram lies: a context whose last word has ``last_count`` uses has one
    for each shard's load, at equal steps round the range of hashes."""
    places = 1 + (last_count.astype(np.uint64) * np.uint64(shards)) // np.uint64(max(total, 1))
    return (_mix(word.astype(np.uint64) + np.uint64(7)) % places) * (np.uint64(1 << SHARD_BITS) // places)


def blocks_by_shard(kind: str, shard: np.ndarray, columns: list[np.ndarray]):
    """One block row for each shard, its rows in the order given."""
    order = np.argsort(shard.astype(np.uint16) if len(shard) and shard.max() < 1 << 16 else shard, kind="stable")
    shard = shard[order]
    edges = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(shard))
    for a, b in zip(edges, edges[1:]):
        yield kind, int(shard[a]), pack([c[order[a:b]] for c in columns])


def block_batch(rows) -> pa.RecordBatch:
    kinds, shards, blocks = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(shards, pa.int32()), pa.array(blocks, pa.binary())],
                                      ["kind", "shard", "block"])


def in_shards(blocks: DataFrame, merge, schema: str) -> DataFrame:
    """``merge(shard, blocks)`` for every shard; its rows. A shard's blocks are a bounded share of the data."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(key, table):
        rows = list(merge(key[0].as_py(), table.column("block").to_pylist()))
        kinds = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]])
                           for n, c in zip(names, schema.split(", "))])
        return pa.Table.from_pylist([dict(zip(names, r)) for r in rows], schema=kinds)
    return blocks.groupBy("shard").applyInArrow(run, schema)


# ------------------------------------------------------------------ the model
@dataclass
class Model:
    folder: str
    order: int
    shards: int  # of the word arrays
    parts: int  # of the n-gram and context arrays
    words: int  # distinct training tokens (V)
    total: int  # training tokens (N)
    documents: int  # training texts
    bases: np.ndarray  # number of the first word of each shard
    discounts: dict = field(default_factory=dict)  # order -> discounts of counts 1, 2, 3 and more
    unigram_total: int = 0
    unigram_rest: float = 1.0  # probability that order 1 leaves to all words alike

    start_totals: tuple = (0, 0, 0, 0)  # totals of the start of a text as a context

    def __post_init__(self):
        self.word_arrays = WordArrays(self.folder, "words", self.shards)
        self.ngram_arrays = {k: NgramArrays(self.folder, f"ngrams{k}", self.parts) for k in range(2, self.order + 1)}

    @property
    def start(self) -> int:
        return self.words

    @property
    def unknown(self) -> int:
        return self.words + 1

    def number(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and count of words given by ascending hashes; unknown words have the number ``unknown``."""
        ids, counts = np.full(len(hashes), self.unknown, np.uint64), np.zeros(len(hashes), np.int64)
        for part, s, at, found in self.word_arrays.find(hashes):
            ids[part][found] = (at[found] + self.bases[s]).astype(np.uint64)
            counts[part][found] = self.word_arrays.counts(s, "count", at[found])
        return ids, counts

    def of_words(self, ids: np.ndarray, columns: list[str]) -> list[np.ndarray]:
        """What the word arrays hold of each number; 0 for numbers that are no words."""
        used, back = np.unique(ids, return_inverse=True)
        out = [np.zeros(len(used), np.int64) for _ in columns]
        edges = np.searchsorted(used, np.append(self.bases, self.words).astype(np.uint64))
        for s in range(self.shards):
            part = slice(edges[s], edges[s + 1])
            if edges[s] < edges[s + 1]:
                places = used[part].astype(np.int64) - self.bases[s]
                for o, column in zip(out, columns):
                    o[part] = self.word_arrays.counts(s, column, places)
        return [o[back] for o in out]

    def word_counts(self, ids: np.ndarray) -> np.ndarray:
        """Uses of each word in the training texts; the start of a text has one for each."""
        return np.where(ids == self.start, self.documents, self.of_words(ids, ["count"])[0])

    def keys(self, columns: list[np.ndarray], last_counts: np.ndarray) -> np.ndarray:
        """Keys of n-grams; ``last_counts``: uses of the context's last word."""
        return ngram_keys(columns, salts(last_counts, columns[-1], self.total, self.parts), self.parts)

    def context_totals(self, columns: list[np.ndarray], counts: list[np.ndarray]) -> list[np.ndarray]:
        """Sum of the counts of the n-grams that go on from each context, and how many were seen once, twice, more often."""
        if len(columns) == 1:
            at_start = columns[0] == self.start
            return [np.where(at_start, t, x) for t, x in zip(self.start_totals, self.of_words(columns[0], TOTALS))]
        keys, back = np.unique(self.keys(columns, counts[-2]), return_inverse=True)
        return [x[back] for x in self.ngram_arrays[len(columns)].look_up(keys, TOTALS)]

    def unigrams(self, ids: np.ndarray) -> np.ndarray:
        """Probability of order 1 for each word number."""
        left = self.of_words(ids, ["left"])[0]
        return self.discounted(1, left) / max(self.unigram_total, 1) + self.unigram_rest / (self.words + 1)

    def discounted(self, order: int, counts: np.ndarray) -> np.ndarray:
        d = np.array([0.0, *self.discounts[order]])
        return np.maximum(counts - d[np.minimum(counts, 3)], 0)

    def probabilities(self, columns: list[np.ndarray], counts: list[np.ndarray]) -> np.ndarray:
        """Probability of each n-gram's last word given the others. ``counts``: uses of the words of each column."""
        p = self.unigrams(columns[-1])
        for k in range(2, self.order + 1):
            own = columns[-k:]
            total, *n = self.context_totals(own[:-1], counts[-k:-1])
            keys = self.keys(own, counts[-2])
            order = np.argsort(keys)
            seen = np.empty(len(keys), np.int64)
            seen[order] = self.ngram_arrays[k].look_up(keys[order], ["count"])[0]
            rest = sum(d * x for d, x in zip(self.discounts[k], n))
            p = np.where(total > 0, (self.discounted(k, seen) + rest * p) / np.maximum(total, 1), p)
        return p


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Discounts for counts 1, 2, 3 and more from the numbers of n-grams seen 1, 2, 3, 4 times. Where one of them
    is missing the usual estimate is undefined and 0.5, 1 and 1.5 are used."""
    n1, n2, n3, n4 = n
    if min(n1, n2, n3, n4) <= 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(d if 0 < d < k else k / 2 for k, d in enumerate(found, 1))


def _task_blocks(batches, count, send):
    """Feed ``count(batch)`` results, (columns, weights), to ``send`` in distinct lots of bounded size."""
    keep_freed_memory()
    held, size = [], 0

    def lot():
        columns = [np.concatenate(x) for x in zip(*[h[0] for h in held])]
        weights = np.concatenate([h[1] for h in held])
        held.clear()
        return send(*_distinct(columns, weights))
    for batch in by_size(batches):
        columns, weights = count(batch)
        held.append(_distinct(columns, weights))
        size += len(held[-1][1])
        if size >= HELD:
            yield block_batch(lot())
            size = 0
    if size:
        yield block_batch(lot())


def count_words(rows: DataFrame, folder: str, order: int, shards: int, part_tokens: int) -> Model:
    def run(batches):
        def count(batch):
            used, token, _, sizes = tokens(batch.column("text"))
            return [used], np.bincount(token, minlength=len(used)).astype(np.uint64)

        def send(columns, counts):
            return blocks_by_shard("word", shard_of(columns[0], shards).astype(np.int64), [columns[0], counts])
        yield from _task_blocks(batches, count, send)

    def merge(shard, blocks):
        keys, counts = merged(blocks)
        (keys,), counts = _distinct([keys], counts)
        write_array(folder, "words", shard, "key", keys)
        write_counts(folder, "words", shard, "count", counts)
        yield shard, len(keys), int(counts.sum())
    sizes = written(in_shards(rows.select("text").mapInArrow(run, BLOCK), merge, "shard int, words long, total long"),
                    "lm-words").collect()  # one row for each shard
    number = np.zeros(shards + 1, np.int64)
    for r in sizes:
        number[r["shard"] + 1] = r["words"]
    bases = np.cumsum(number)
    total = sum(r["total"] for r in sizes)
    return Model(folder, order, shards, max(shards, -(-total // part_tokens)), int(bases[-1]), total, 0, bases)


def count_ngrams(rows: DataFrame, model: Model) -> None:
    """Write the arrays of all orders, the highest first, and fill in the model's discounts.

    A block's columns are the n-gram's words, its count, and its ``TOTALS`` as a context. Shards below 0 are no
    shards: -k collects what order k has for the model."""
    order, shards, start, folder = model.order, model.parts, model.start, model.folder

    def blocks(columns, values):
        """Blocks for the shards that hold these n-grams (words, for one column)."""
        if len(columns) > 1:
            shard = (model.keys(columns, model.word_counts(columns[-2])) >> np.uint64(KEY_BITS)).astype(np.int64)
        else:
            shard = np.searchsorted(model.bases[1:], columns[0].astype(np.int64), "right")
            shard[columns[0] == start] = model.shards  # the start is no word
        return blocks_by_shard("ngram", shard, [*columns, *values])

    def run(batches):
        def count(batch):
            used, token, doc, sizes = tokens(batch.column("text"))
            ids, _ = model.number(used)
            if model.unknown < 1 << 32:  # what a task holds takes half the room
                ids = ids.astype(np.uint32)
            return ngrams(ids[token], doc, sizes, order, start), np.ones(len(token), np.uint32)

        def send(columns, counts):
            return list(blocks(columns, [counts, *[np.zeros(len(counts), np.uint64)] * len(TOTALS)]))
        yield from _task_blocks(batches, count, send)

    def statistics(k, counts):
        found = [(counts == n).sum() for n in range(1, 5)] + [(counts > 2).sum(), counts.sum()]
        return "n", -k, np.array(found, np.int64).tobytes()

    def merge(shard, parts, k):
        if shard < 0:
            yield "n", shard, np.sum([np.frombuffer(p, np.int64) for p in parts], axis=0).tobytes()
            return
        arrays = merged(parts)
        columns, counts, *totals = _distinct(arrays[:k], *arrays[k:])
        keys = model.keys(columns, model.word_counts(columns[-2])) & np.uint64((1 << KEY_BITS) - 1)
        by_key = np.argsort(keys)
        first = _starts([keys[by_key]])
        kept = {"count": counts, **(dict(zip(TOTALS, totals)) if k < order else {})}
        NgramArrays.write(folder, f"ngrams{k}", shard, keys[by_key][first],
                          {c: np.add.reduceat(x[by_key], first) if len(first) else x for c, x in kept.items()})
        some = counts > 0  # others are contexts alone
        columns, counts = [c[some] for c in columns], counts[some]
        yield statistics(k, counts)
        at = _starts(columns[:-1])
        if not len(at):
            return
        none = np.zeros(len(at), np.uint64)
        yield from blocks([c[at] for c in columns[:-1]], [none, *[np.add.reduceat(w.astype(np.uint64), at)
                                                               for w in (counts, counts == 1, counts == 2, counts > 2)]])
        # distinct left neighbours; what starts a text has none and keeps its count
        seen = np.where(columns[1] == start, counts, np.uint64(1)) if k > 2 else np.ones(len(counts), np.uint64)
        lower, seen = _distinct(columns[1:], seen)
        yield from blocks(lower, [seen, *[np.zeros(len(seen), np.uint64)] * len(TOTALS)])

    def merge_words(shard, parts):
        if shard < 0:
            yield "n", shard, np.sum([np.frombuffer(p, np.int64) for p in parts], axis=0).tobytes()
            return
        (ids,), *values = (lambda a: _distinct(a[:1], *a[1:]))(merged(parts))
        if shard == model.shards:
            yield "start", 0, np.array([v.sum() for v in values[1:]], np.int64).tobytes()
            return
        size = int(model.bases[shard + 1] - model.bases[shard])
        for column, v in zip(["left", *TOTALS], values):
            whole = np.zeros(size, np.uint64)
            whole[ids.astype(np.int64) - model.bases[shard]] = v
            write_counts(folder, "words", shard, column, whole)
        yield statistics(1, values[0])

    counted = rows.select("text").mapInArrow(run, BLOCK)
    for k in range(order, 1, -1):
        counted = in_shards(counted, lambda shard, parts, k=k: merge(shard, parts, k), BLOCK)
    found = {k: np.zeros(6, np.int64) for k in range(1, order + 1)}
    for r in written(in_shards(counted, merge_words, BLOCK), "lm-statistics").collect():  # one row for each shard of words and order
        if r["kind"] == "start":
            model.start_totals = tuple(np.frombuffer(r["block"], np.int64).tolist())
        else:
            found[-r["shard"]] = found[-r["shard"]] + np.frombuffer(r["block"], np.int64)
    for k, n in found.items():
        model.discounts[k] = discounts(n[:4].tolist())
    n1, n2, _, _, more, model.unigram_total = found[1].tolist()
    if model.unigram_total:
        d = model.discounts[1]
        model.unigram_rest = (d[0] * n1 + d[1] * n2 + d[2] * more) / model.unigram_total


def train(df: DataFrame, order: int = 2, shards: int | None = None, part_tokens: int = 8_000_000,
          text_col: str = "text", id_col: str = "doc_id") -> Model:
    """Count all texts of ``df`` (null texts count as empty). Needs order 2 or more. Words lie in ``shards`` arrays
    (the session's shuffle partitions if not given), n-grams in as many or one for each ``part_tokens`` tokens."""
    if order < 2:
        raise ValueError("order must be 2 or more")
    rows = texts(df, id_col, text_col)
    folder = scratch_dir(df.sparkSession, "llm", "ngram-model")
    model = count_words(rows, folder, order, shards or shuffle_partitions(df.sparkSession), part_tokens)
    model.documents = rows.count()
    if model.total:
        count_ngrams(rows, model)
    else:
        model.discounts = {k: discounts([0] * 4) for k in range(1, order + 1)}
    return model


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score (log10 probability) of every row."""
    def run(batches):
        keep_freed_memory()
        for batch in by_size(batches, max_bytes=SCORED):
            if not batch.num_rows:
                continue
            used, token, doc, sizes = tokens(batch.column("text"))
            ids, counts = model.number(used)
            base = np.log10((counts + 1) / (model.total + model.words + 1))
            columns = ngrams(ids[token], doc, sizes, model.order, model.start)
            uses = ngrams(counts[token], doc, sizes, model.order, model.documents)
            p = np.log10(model.probabilities(columns, uses))
            def summed(x):
                return np.bincount(doc, x, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(summed(counts[token] > 0).astype(np.int64)),
                 pa.array(summed(base[token])), pa.array(summed(p))], ["doc_id", "n_tokens", "n_known", "base_score", "score"])
    return texts(df, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def held_out_scores(df: DataFrame, order: int = 2, folds: int = 7, held_out_fold: int = 2,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from every row outside ``held_out_fold`` (crc32 of the id as text, modulo ``folds``). Null texts
    count as empty: one end token. Repeated rows are counted and scored again each; null ids count as the
    empty text in the fold. Without training rows every word is unknown and alike. An empty table gives no
    rows. Other columns are not read. A text is read whole, however long, its n-grams across all of it; equal texts score
    alike, so there are no ties to settle.
    """
    rows = texts(df, id_col, text_col)
    model = train(rows.filter(fold("doc_id", folds) != held_out_fold), order)
    return score(rows, model).select("doc_id", (fold("doc_id", folds) == held_out_fold).alias("held_out"), "n_tokens", "n_known",
                                     F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")

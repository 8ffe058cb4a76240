"""Spelling variants: words one edit apart, found by one-edit neighbourhoods over a reduced alphabet.

Every letter is hashed to one of a few symbols. Words one edit apart have reduced words that are equal or one edit
apart themselves, so the whole neighbourhood of a reduced word is small: it is generated and joined with the reduced
vocabulary, and the original strings of what meets are compared. A reduced word and its neighbour reach each other,
so each such pair is generated from its longer end (by deletions, the other end's insertions) or, at equal lengths,
from the end with the larger symbol. The number of symbols follows the vocabulary, so that a reduced word stands for
few words at any size. Reduced words travel as 64-bit polynomial hashes: a collision is one more pair to compare.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunk_encoder import by_size, ragged
from .common import prepare_workers, texts, written

RUN = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words up to this length travel with their neighbours and are compared in the join; longer ones are looked up after it.
CARRIED = 64
BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Neighbours that a worker generates at once.
GENERATED = 250_000


def spelled(run: Column, doc_id: Column, one_in: int) -> Column:
    """The run in lower case (A-Z only), less one code point where the crc32 of ``<doc_id>:<run>`` is a multiple of
    ``one_in``."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run)
    h = F.crc32(key.cast("binary"))
    at = (h % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % F.lit(one_in) == 0, cut).otherwise(run)


def vocabulary(df: DataFrame, least_length: int, least_count: int, one_in: int, id_col: str, text_col: str) -> DataFrame:
    """word, n: the words of all texts with their occurrences."""
    rows = texts(df, id_col, text_col)
    # a shorter run cannot give a word that is long enough
    runs = rows.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"{RUN}{{{least_length},}}"), F.lit(0))).alias("run"))
    runs = runs.select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    words = runs.select(spelled(F.col("run"), F.col("doc_id"), one_in).alias("word")).filter(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def alphabet_size(words: int, least_length: int) -> int:
    """Symbols for which the shortest words have about four reduced words for each word, at least 4."""
    return max(4, math.ceil((4 * max(words, 1)) ** (1 / least_length)))


def reduced(words: pa.Array, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols (from 1) of all the words' letters, one word after the other, and the words' lengths."""
    code = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    return (((code + np.uint64(1)) * BASE) >> np.uint64(40)) % np.uint64(symbols) + np.uint64(1), lengths


def _hashes(symbol: np.ndarray, lengths: np.ndarray):
    """Of each letter: the power of its place and its word's hash up to it; of each word: its hash."""
    ends = np.cumsum(lengths)
    place = np.arange(len(symbol)) - np.repeat(ends - lengths, lengths)
    powers = np.cumprod(np.full(int(lengths.max(initial=0)) + 1, BASE, np.uint64), dtype=np.uint64)
    power = powers[place]
    whole = np.append(np.uint64(0), np.cumsum(symbol * power, dtype=np.uint64))
    start = whole[ends - lengths]
    upto = whole[:-1] - np.repeat(start, lengths)
    return place, power, upto, whole[ends] - start


def word_keys(words: pa.Array, symbols: int) -> np.ndarray:
    """One hash for each word: of its reduced word."""
    return _hashes(*reduced(words, symbols))[3].view(np.int64)


def neighbours(words: pa.Array, symbols: int):
    """Lots of (index of the word, hash of a reduced word, whether it is the word's own): each word's reduced word; that
    less one letter; and that with one symbol replaced by a smaller one."""
    symbol, lengths = reduced(words, symbols)
    place, power, upto, own = _hashes(symbol, lengths)
    yield np.arange(len(lengths)), own.view(np.int64), True
    word = np.repeat(np.arange(len(lengths)), lengths)
    # of equal symbols in a row one deletion stands for all
    new = np.append(True, symbol[1:] != symbol[:-1])[:len(symbol)] | (place == 0)
    for a in range(0, len(symbol), max(1, GENERATED // symbols)):
        part = np.arange(a, min(a + max(1, GENERATED // symbols), len(symbol)))
        gone = part[new[part]]
        before = upto[gone]
        after = own[word[gone]] - before - symbol[gone] * power[gone]  # moves up by one place
        yield word[gone], (before + after * UNBASE).view(np.int64), False
        smaller = (symbol[part] - np.uint64(1)).astype(np.int64)
        letter = np.repeat(part, smaller)
        less = (ragged(np.zeros(len(part), np.int64), smaller) + 1).astype(np.uint64)
        yield word[letter], (own[word[letter]] - less * power[letter]).view(np.int64), False


def _keyed(words: DataFrame, symbols: int, carried: dict) -> DataFrame:
    """key, then the ``carried`` columns (from name to new name) of each word of the table (id, word, n)."""
    def run(batches):
        for batch in by_size(batches, "word"):
            yield pa.RecordBatch.from_arrays([pa.array(word_keys(batch.column("word"), symbols)), *[batch.column(c) for c in carried]],
                                             ["key", *carried.values()])
    return words.mapInArrow(run, "key long, " + ", ".join(f"{new} {words.schema[c].dataType.simpleString()}" for c, new in carried.items()))


def _around(words: DataFrame, symbols: int, carried: dict) -> DataFrame:
    """key, own, then the ``carried`` columns, for each key of the neighbourhoods of the words."""
    def run(batches):
        for batch in by_size(batches, "word", max_bytes=GENERATED // 2):
            for at, keys, own in neighbours(batch.column("word"), symbols):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(np.full(len(keys), own)), *[batch.column(c).take(pa.array(at)) for c in carried]],
                    ["key", "own", *carried.values()])
    return words.mapInArrow(run, "key long, own boolean, " + ", ".join(f"{new} {words.schema[c].dataType.simpleString()}" for c, new in carried.items()))


def near_pairs(words: DataFrame, symbols: int) -> DataFrame:
    """a, n_a, b, n_b: every two words of the table (id, word, n) that differ by one inserted, deleted or replaced code
    point, once. The words that a key brings together are joined in place and compared there; of words over ``CARRIED``
    code points only the ids meet, and the strings are fetched for them."""
    length = F.length("word")
    once = ~F.col("own") | (F.col("a") < F.col("b"))  # equal reduced words meet from both ends
    one_edit = F.levenshtein("a", "b", 1) == 1
    left = _around(words.filter(length <= CARRIED), symbols, {"word": "a", "n": "n_a"})
    right = _keyed(words.filter(length <= CARRIED), symbols, {"word": "b", "n": "n_b"}).hint("shuffle_hash")
    pairs = left.join(right, "key").filter(once & one_edit).select("a", "n_a", "b", "n_b")

    left = _around(words.filter(length > CARRIED), symbols, {"id": "id_a"})
    right = _keyed(words.filter(length >= CARRIED), symbols, {"id": "id_b"})
    met = left.join(right, "key").filter("id_a != id_b").select("own", "id_a", "id_b")
    for side in "ab":
        met = met.join(words.select(F.col("id").alias(f"id_{side}"), F.col("word").alias(side), F.col("n").alias(f"n_{side}")), f"id_{side}")
    return pairs.unionByName(met.filter(once & one_edit).select("a", "n_a", "b", "n_b"))


def spelling_variants(words: DataFrame, ratio: int = 10, symbols: int | None = None, least_length: int = 1) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of a table (word, n).

    Two words are near if they differ by one inserted, deleted or replaced code point; ``n_near`` counts a word's near
    words. ``form``: the near word of largest ``n`` (ties: the smallest in code-point order) if it has at least
    ``ratio`` times the word's ``n``, else null; ``form_n`` is its ``n``. ``root`` follows forms to the last one. The
    words must be distinct and not null; an empty table gives no rows; other columns are not read.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, so that forms lead to ever larger counts")
    prepare_workers(words.sparkSession)
    words = written(words.select(F.monotonically_increasing_id().alias("id"), "word", F.col("n").cast("long").alias("n")), "spelling-words")
    size, most = words.agg(F.count("*"), F.max("n")).first()
    pairs = near_pairs(words, symbols or alphabet_size(size, least_length))
    ends = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")),
                   F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    best = (pairs.select(F.explode(ends).alias("x")).select("x.*").groupBy("word")
            .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("best")))
    best_n = -F.col("best.order")
    enough = best_n >= ratio * F.col("n")
    forms = written(words.join(best, "word", "left").select(
        "word", F.when(enough, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, best_n).alias("form_n")), "spelling-forms")
    # each step multiplies n by the ratio at least, so chains are short
    steps = forms.filter("form IS NOT NULL").select("word", "form")
    roots, reached = steps.select("word", F.col("form").alias("root")), 1
    while (most or 0) >= ratio ** (reached + 1):
        onward = steps.select(F.col("word").alias("root"), F.col("form").alias("next"))
        roots = roots.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
        reached += 1
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_groups(df: DataFrame, least_length: int = 7, least_count: int = 2, one_in: int = 31, ratio: int = 10,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``spelling_variants`` of the words of all whole texts.

    Words are the maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF) of at least ``least_length`` code points, A-Z
    lower-cased, that occur ``least_count`` times; one run in ``one_in``, told by the crc32 of its document's id and
    itself, loses a letter. Null texts have no words; repeated rows count again each; a null id counts as the empty
    text; an empty table gives no rows; a very long text or run is read whole. Other columns are not read.
    """
    words = vocabulary(df, least_length, least_count, one_in, id_col, text_col)
    return spelling_variants(words, ratio, least_length=least_length)

"""Target-distribution importance resampling over hashed word n-grams.

A document's features are its runs of one to ``order`` words, hashed into buckets. All documents and all target texts
are counted by bucket; a bucket's gain is the log ratio of the two smoothed shares, a document's weight the sum of its
features' gains. Gumbel noise, drawn from a hash of the id, turns the weights into scores whose largest are a draw
without replacement in proportion to the importance weights.

A batch's texts are joined with sentinels between them and one regex pass finds all words and sentinels. Runs are
then made for the whole batch at once; searching the sentinels' places tells each word's document, and runs that
span two documents are masked out before they are counted.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunk_encoder import by_size
from .common import texts, written
from .crc import crc32s, joined

SENTINEL = b"\0"
#: Fixed value: words of UTF-8 bytes, A-Z lower-cased before; or a sentinel.
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+|\x00")


def batch_words(batch_texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words, index in them of each word of the batch, document of each word)."""
    if not len(batch_texts):
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    # a text's own NUL parts words just as a space does
    one = pa.ListArray.from_arrays(pa.array([0, len(batch_texts)], pa.int32()), pc.replace_substring(batch_texts, "\0", " "))
    whole = pc.binary_join(one, "\0")[0].as_buffer().to_pybytes().lower() + SENTINEL
    coded = pa.array(WORDS.findall(whole), pa.binary()).dictionary_encode()
    which, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
    sentinel = words.index(SENTINEL)
    place = np.flatnonzero(which != sentinel)
    return words, which[place], np.searchsorted(np.flatnonzero(which == sentinel), place)


def batch_features(batch_texts: pa.Array, order: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each feature, document of each feature, words of each document)."""
    words, which, doc = batch_words(batch_texts)
    lengths = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))[which]
    alone, spaced = crc32s(words)[which], crc32s(words, b" ")[which]
    found, whose, run, at = [alone], [doc], alone, np.arange(len(which))
    for size in range(2, order + 1):
        inside = at[at + size - 1 < len(which)]
        keep = doc[inside] == doc[inside + size - 1]  # not across two documents
        run, at = run[:len(inside)][keep], inside[keep]
        run = joined(run, spaced[at + size - 1], lengths[at + size - 1])
        found.append(run)
        whose.append(doc[at])
    return (np.concatenate(found) % np.uint32(buckets)).astype(np.int64), np.concatenate(whose), np.bincount(doc, minlength=len(batch_texts))


#: Text whose features are in memory at once.
SLICE = 4 << 20


def bucket_counts(rows: DataFrame, order: int, buckets: int) -> np.ndarray:
    """Features of all texts by bucket: at most ``buckets`` rows from each task, and to the driver."""
    def run(batches):
        counts = np.zeros(buckets, np.int64)
        for batch in by_size(batches, max_bytes=SLICE):
            counts += np.bincount(batch_features(batch.column("text"), order, buckets)[0], minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some])], ["bucket", "n"])
    found = rows.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """floor(scale * ln((t+1) (S+buckets) / ((s+1) (T+buckets)))) for each bucket."""
    s_all, t_all = float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array([math.floor(scale * math.log((t + 1) * s_all / ((s + 1) * t_all)))
                     for s, t in zip(source.astype(float).tolist(), target.astype(float).tolist())], np.int64)


def importance_weights(rows: DataFrame, gain: np.ndarray, order: int) -> DataFrame:
    """doc_id, n_words, n_features, weight of each row (doc_id, text)."""
    buckets = len(gain)

    def run(batches):
        for batch in by_size(batches, max_bytes=SLICE):
            bucket, doc, words = batch_features(batch.column("text"), order, buckets)
            features = np.bincount(doc, minlength=batch.num_rows)
            weight = np.bincount(doc, gain[bucket], minlength=batch.num_rows).astype(np.int64)  # whole numbers, exact to 2**53
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (words, features, weight))],
                                             ["doc_id", "n_words", "n_features", "weight"])
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, order: list, rank: str) -> tuple[DataFrame, int]:
    """``rows`` with their place (from 1) in the given order as column ``rank``, and how many they are. Rows are dealt
    and sorted by ranges of the order; a row's place is its place in its range after the rows of earlier ranges."""
    place = F.monotonically_increasing_id()  # partition number, then 33 bits of the place in it
    spread = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(rank, place), "importance-ranked")
    part, inside = F.shiftright(rank, 33).cast("int"), F.col(rank).bitwiseAND((1 << 33) - 1)
    sizes = sorted((r["part"], r["n"]) for r in spread.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # one for each range
    before, starts = 0, []
    for p, n in sizes:
        starts.append((p, before))
        before += n
    start = rows.sparkSession.createDataFrame(starts, "__part int, __start long")
    placed = spread.join(F.broadcast(start), part == F.col("__part")).withColumn(rank, F.col("__start") + inside + 1)
    return placed.drop("__part", "__start"), before


def importance_resample(df: DataFrame, target: DataFrame, order: int = 3, buckets: int = 10_000, seed: int = 42,
                        least_words: int = 20, share: tuple[int, int] = (5, 100), id_col: str = "doc_id",
                        text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of ``df``.

    ``rank`` (1, 2, 3 ...) is set for the drawn documents: of those with at least ``least_words`` words the given share
    (rounded down) with the largest scores, ties going to the smaller id (null ids last; equal rows in any order).
    Null texts have no words, no features and the weight 0; a null id is the empty text in the noise. Repeated rows
    count and rank each by itself. Without target texts all shares of the target are smoothing alone. Without
    documents there are no rows. Texts are read whole, however long; other columns are not read.
    """
    rows = texts(df, id_col, text_col)
    gain = gains(bucket_counts(rows, order, buckets), bucket_counts(target.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")),
                                                                   order, buckets))
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8),
                   16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0)))
    scored = written(importance_weights(rows, gain, order).withColumn("score", (F.col("weight") + gumbel).cast("long")),
                     "importance-scores")
    eligible = F.col("n_words") >= least_words
    placed, size = ranked(scored.filter(eligible), [F.desc("score"), F.asc_nulls_last("doc_id"), "weight", "n_features", "n_words"], "rank")
    drawn = share[0] * size // share[1]
    return (placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
            .unionByName(scored.filter(~eligible).withColumn("rank", F.lit(None).cast("long"))))

"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A document's features are the distinct character n-grams inside its words (each word with a space on either
side). Of a bounded sample of labelled training documents, Spark counts in how many of each class every
n-gram occurs. N-grams that tell the classes apart beyond chance (log-likelihood ratio) become features, each
scaled by its log-count ratio, and a logistic regression is trained on them. All whole texts are scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunk_encoder import by_size, ragged, release_encoders
from .common import col, fold, texts, written
from .quality import labelled

SIZES = (3, 4, 5, 6, 7)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Texts of about this size are in memory at once, with all their n-grams.
SLICE = 1 << 20


def _place(h: np.ndarray) -> np.ndarray:
    """20 well-mixed bits of a rolling hash."""
    return ((h * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(44)).astype(np.int64)


def _characters(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the padded words, one after the other: characters, the word each is from, how many are left in it."""
    one = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
    joined = " " + pc.binary_join(one, " \0 ")[0].as_py() + " \0"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    stops = np.flatnonzero(code == 0)
    word = np.repeat(np.arange(len(stops)), np.diff(stops, prepend=-1))
    return code, word, stops[word] - np.arange(len(code))


def _rolling(code: np.ndarray):
    """(size, hash of the n-gram at each place) for every size of ``SIZES``."""
    h = np.zeros(len(code), np.uint64)
    for size in range(1, max(SIZES) + 1):
        h = h[:len(code) - size + 1] * MULTIPLIER + code[size - 1:] + np.uint64(1)
        if size in SIZES:
            yield size, h


def word_ngrams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all character n-grams of the padded words, and the word each is from."""
    hashes, whose = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    if len(words):
        code, word, room = _characters(words)
        for size, h in _rolling(code):
            inside = np.flatnonzero(room[:len(h)] >= size)
            hashes.append(h[inside])
            whose.append(word[inside])
    return np.concatenate(hashes), np.concatenate(whose)


def _documents(batch_texts: pa.Array):
    """Distinct words of the texts (lower case, so that each is hashed once) and, of each text, its words."""
    cut = pc.utf8_split_whitespace(pc.replace_substring(pc.utf8_lower(batch_texts), "\0", " "))
    offsets = cut.offsets.to_numpy().astype(np.int64)
    coded = cut.flatten().dictionary_encode()
    which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return coded.dictionary, which, offsets - offsets[0]


def _by_document(features: np.ndarray, whose: np.ndarray, words: int, which: np.ndarray, offsets: np.ndarray):
    """(document, feature) of each document's distinct words; a feature of several words comes several times."""
    order = np.argsort(whose, kind="stable")
    features, whose = features[order], whose[order]
    counts = np.bincount(whose, minlength=words)
    starts = np.cumsum(counts) - counts
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    some = counts[which] > 0
    doc, which = doc[some], which[some]
    pair = np.sort(doc * words + which)
    pair = pair[np.append(True, pair[1:] != pair[:-1])[:len(pair)]]
    doc, word = pair // words if words else pair, pair % words if words else pair
    return np.repeat(doc, counts[word]), features[ragged(starts[word], counts[word])]


def _distinct(features: np.ndarray, whose: np.ndarray, words: int, which: np.ndarray, offsets: np.ndarray):
    """Distinct (document, feature) pairs, ascending."""
    doc, features = _by_document(features, whose, words, which, offsets)
    order = np.lexsort((features, doc))
    doc, features = doc[order], features[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (features[1:] != features[:-1])
    return doc[new], features[new]


#: Cells of the table of documents and features that marks which features a document has.
CELLS = 1 << 24


def _marked(doc: np.ndarray, index: np.ndarray, documents: int, size: int):
    """``_distinct`` for features that are numbers under ``size``, without sorting: lots of documents, a byte for each
    document and feature."""
    lot = max(1, CELLS // max(size, 1))
    edges = np.searchsorted(doc, np.arange(0, documents + lot, lot))
    cells = [np.zeros(0, np.int64)]
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        marks = np.zeros(min(lot, documents - k * lot) * size, bool)
        marks[(doc[a:b] - k * lot) * size + index[a:b]] = True
        cells.append(np.flatnonzero(marks) + k * lot * size)
    cells = np.concatenate(cells)
    return cells // max(size, 1), cells % max(size, 1)


def _dealt_out(doc: np.ndarray, values: np.ndarray, rows: int, kind: pa.DataType) -> pa.Array:
    offsets = np.searchsorted(doc, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


@dataclass
class LinearModel:
    """Selected n-gram hashes (sorted) with their weights (log-count ratio times coefficient), and the bias."""
    ngrams: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        # a hash table: the n-grams in order of 20 bits of their hashes, and where each value's n-grams begin
        place = _place(self.ngrams)
        self.by_place = np.argsort(place, kind="stable")
        self.first = np.searchsorted(place[self.by_place], np.arange((1 << 20) + 1)).astype(np.int32)
        self.seen = np.diff(self.first) > 0

    def __getstate__(self):
        return self.ngrams, self.weights, self.bias  # workers make the table themselves

    def __setstate__(self, state):
        self.__init__(*state)

    def find(self, hashes: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are n-grams of the model, and their indices."""
        own, at, end = self.ngrams[self.by_place], self.first[place], self.first[place + 1]
        which, found, index = np.arange(len(hashes)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(which):  # the first n-gram of each place, then the second ...
            hit = own[at] == hashes
            found.append(which[hit])
            index.append(self.by_place[at[hit]])
            on = ~hit & (at + 1 < end)
            which, hashes, at, end = which[on], hashes[on], at[on] + 1, end[on]
        return np.concatenate(found), np.concatenate(index)

    def features(self, batch_texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, feature index) pairs of the texts."""
        words, which, offsets = _documents(batch_texts)
        index, whose = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(words) and len(self.ngrams):
            code, word, room = _characters(words)
            for size, h in _rolling(code):
                place = _place(h)
                at = np.flatnonzero(self.seen[place] & (room[:len(h)] >= size))
                found, i = self.find(h[at], place[at])
                index.append(i)
                whose.append(word[at[found]])
        doc, index = _by_document(np.concatenate(index), np.concatenate(whose), len(words), which, offsets)
        return _marked(doc, index, len(offsets) - 1, len(self.ngrams))

    def scores(self, batch_texts: pa.Array) -> np.ndarray:
        doc, index = self.features(batch_texts)
        z = self.bias + np.bincount(doc, self.weights[index], minlength=len(batch_texts))
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def training_sample(df: DataFrame, labels: DataFrame, label_col: str, folds: int, rows_per_class: int,
                    id_col: str, text_col: str) -> tuple[DataFrame, dict[int, int]]:
    """Labelled training documents (doc_id, text, label, place): of each class the ``rows_per_class`` whose hash of id and
    text, ``place``, is smallest; and how many of each class there are. Rows with equal id and text count as one."""
    place = F.xxhash64("doc_id", "text").alias("place")
    rows = texts(df, id_col, text_col).select("doc_id", "text", place)
    known = written(labelled(rows.select("doc_id", "place").distinct(), labels, label_col, folds), "toxicity-labelled")
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}  # two classes
    chosen = [known.filter(F.col("label") == c).orderBy("place", "doc_id").limit(rows_per_class) for c in (0, 1)]
    # at most 2 * rows_per_class ids, so texts need not be shuffled to meet them
    sample = rows.join(F.broadcast(chosen[0].unionByName(chosen[1])), ["doc_id", "place"])
    return sample.dropDuplicates(["doc_id", "place"]).select("doc_id", "text", "label", "place"), sizes


def ngram_counts(sample: DataFrame) -> DataFrame:
    """ngram (hash as a signed long), toxic, clean: in how many sampled documents of each class it occurs; together:
    the xor of their places, equal for n-grams of the same documents."""
    def run(batches):
        release_encoders()
        for batch in by_size(batches, max_bytes=SLICE // 8):  # every n-gram of every document is held
            words, which, offsets = _documents(batch.column("text"))
            hashes, whose = word_ngrams(words)
            doc, grams = _distinct(hashes, whose, len(words), which, offsets)
            order = np.argsort(grams)
            doc, grams = doc[order], grams[order]
            first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])[:len(grams)])
            if len(first):
                toxic, place = batch.column("label").to_numpy()[doc] == 1, batch.column("place").to_numpy()[doc]
                ones = np.add.reduceat(toxic.astype(np.int64), first)
                both = np.diff(np.append(first, len(grams)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams[first].view(np.int64)), pa.array(ones), pa.array(both - ones), pa.array(np.bitwise_xor.reduceat(place, first))],
                    ["ngram", "toxic", "clean", "together"])
    counted = sample.mapInArrow(run, "ngram long, toxic long, clean long, together long")
    return counted.groupBy("ngram").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.bit_xor("together").alias("together"))


def select_ngrams(counts: DataFrame, documents: dict[int, int], features: int | None, least_documents: int,
                  least_ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams that tell at least ``least_ratio`` (the best ``features`` of them, if given), sorted, their
    log-count ratios, and a number for each that n-grams of the same documents share. They are bounded by the sample."""
    n1, n0 = documents[1], documents[0]
    def term(k, n, share):
        return F.when(k > 0, k * F.log(k / (n * share))).otherwise(0.0)
    def absent(k, n, share):
        return F.when(k < n, (n - k) * F.log((n - k) / (n * (1 - share)))).otherwise(0.0)
    toxic, clean = F.col("toxic").cast("double"), F.col("clean").cast("double")
    share = (toxic + clean) / float(n1 + n0)
    telling = 2 * (term(toxic, n1, share) + term(clean, n0, share) + absent(toxic, n1, share) + absent(clean, n0, share))
    best = (counts.filter((toxic + clean >= least_documents) & (toxic + clean < n1 + n0))
            .select("ngram", telling.alias("telling"), "toxic", "clean", "together",
                    F.log(((toxic + 1) / float(n1 + 2)) / ((clean + 1) / float(n0 + 2))).alias("ratio"))
            .filter(F.col("telling") >= least_ratio))
    if features is not None:
        best = best.orderBy(F.desc("telling"), "ngram").limit(features)
    found = best.select("ngram", "ratio", "toxic", "clean", "together").toArrow()
    ngrams, ratio, *same = (found.column(c).to_numpy() for c in found.column_names)
    order = np.argsort(ngrams.view(np.uint64))
    groups = np.unique(np.stack([x[order] for x in same]), axis=1, return_inverse=True)[1] if len(order) else order
    return ngrams.view(np.uint64)[order], ratio[order], groups.ravel()


def train(sample: DataFrame, sizes: dict[int, int], features: int | None, least_documents: int, least_ratio: float,
          penalty: float, steps: int) -> LinearModel:
    """Logistic regression by accelerated gradient on the mean log loss with an L2 penalty. N-grams of exactly the same
    documents have the same gradient and so the same weight at every step: one of them stands for all."""
    used = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}  # two classes
    if set(used) != {0, 1}:  # one class or none is known: its score everywhere, or 0
        return LinearModel(np.zeros(0, np.uint64), np.zeros(0), 700.0 if 1 in used else -700.0)
    ngrams, every_ratio, group = select_ngrams(ngram_counts(sample), used, features, least_documents, least_ratio)
    one, group, times = np.unique(group, return_index=True, return_inverse=True, return_counts=True)[1:]
    ratio, by_ngram = every_ratio[one], np.argsort(one).astype(np.int32)
    standing = LinearModel(ngrams[one[by_ngram]], np.zeros(len(one)), 0.0)

    def run(batches):
        release_encoders()
        for batch in by_size(batches, max_bytes=SLICE):
            doc, index = standing.features(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), _dealt_out(doc, by_ngram[index], batch.num_rows, pa.int32())], ["label", "index"])
    # the bounded sample: four bytes for each document and group of n-grams, worked on batch by batch
    blocks = []
    for batch in sample.mapInArrow(run, "label int, index array<int>").toArrow().to_batches():
        lists = batch.column("index")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        blocks.append((batch.column("label").to_numpy().astype(float), offsets - offsets[0], lists.flatten().to_numpy(zero_copy_only=False)))

    def sums(values, offsets, index):  # of each document
        return np.diff(np.append(0.0, np.cumsum(values[index]))[offsets])
    size = sum(len(y) for y, _, _ in blocks)
    norm = max(sums(times * ratio * ratio, offsets, index).max(initial=0) for _, offsets, index in blocks) + 1
    rate = 1 / (0.25 * norm + penalty)
    w = v = np.zeros(len(ratio) + 1)
    for step in range(1, steps + 1):
        slope, value = np.append(penalty * v[:-1], 0.0), times * ratio * v[:-1]
        for y, offsets, index in blocks:
            p = 1 / (1 + np.exp(-np.clip(v[-1] + sums(value, offsets, index), -700, 700)))
            error = (p - y) / size
            slope[:-1] += np.bincount(index, np.repeat(error, np.diff(offsets)), minlength=len(ratio)) * ratio
            slope[-1] += error.sum()
        before, w = w, v - rate * slope
        v = w + (step - 1) / (step + 2) * (w - before)
    # the sample holds the classes in other proportions than the labelled documents
    shift = np.log(sizes[1] / used[1]) - np.log(sizes[0] / used[0])
    return LinearModel(ngrams, w[:-1][group] * every_ratio, float(w[-1] + shift))


def fit(df: DataFrame, labels: DataFrame, label_col: str = "toxic", folds: int = 5, rows_per_class: int = 8000,
        features: int | None = None, least_documents: int = 2, least_ratio: float = 6.0, penalty: float = 1e-4, steps: int = 400,
        id_col: str = "doc_id", text_col: str = "text") -> LinearModel:
    """The model of at most ``rows_per_class`` labelled training documents of each class."""
    sample, sizes = training_sample(df, labels, label_col, folds, rows_per_class, id_col, text_col)
    return train(written(sample, "toxicity-sample"), sizes, features, least_documents, least_ratio, penalty, steps)


def keep_clean(df: DataFrame, labels: DataFrame, label_col: str = "toxic", threshold: float = 0.5, folds: int = 5,
               id_col: str = "doc_id", text_col: str = "text", **training) -> DataFrame:
    """The rows of ``df`` that score under ``threshold``, all columns unchanged; each is scored by its own text, which is read
    whole, however long. A null text scores as an empty one; equal texts score alike, so there are no ties to settle. An
    empty table stays empty."""
    model = fit(df, labels, label_col, folds, id_col=id_col, text_col=text_col, **training)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        release_encoders()
        batch = pa.RecordBatch.from_arrays([text.fill_null("")], ["text"])
        return pa.array(np.concatenate([model.scores(x.column("text")) for x in by_size([batch], max_bytes=SLICE)] or [np.zeros(0)]))
    return df.filter(score(col(text_col).cast("string")) < threshold)


def toxicity_scores(df: DataFrame, labels: DataFrame, label_col: str = "toxic", threshold: float = 0.5, folds: int = 5,
                    id_col: str = "doc_id", text_col: str = "text", **training) -> DataFrame:
    """One row for each input row: doc_id, held_out, score (0 to 1, of label 1), predicted (score >= threshold).

    ``training``: the parameters of ``fit``, which learns from a bounded sample of labelled documents outside fold 0; rows
    of equal id and text are one document there. Null texts count as empty and score by the bias alone. Repeated rows
    repeat, with equal scores; there are no ties to settle. Null ids count as the empty text in the fold; an empty
    table gives no rows; a text is read whole, however long; other columns of either table are not read.
    """
    model = fit(df, labels, label_col, folds, id_col=id_col, text_col=text_col, **training)

    def run(batches):
        release_encoders()
        for batch in by_size(batches, max_bytes=SLICE):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(batch.column("text")))],
                                             ["doc_id", "score"])
    return texts(df, id_col, text_col).mapInArrow(run, "doc_id long, score double").select(
        "doc_id", (fold("doc_id", folds) == 0).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))

"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints are split into ``blocks`` bit blocks. Two fingerprints that differ in at most ``max_bits`` bits
agree on at least ``blocks - max_bits`` whole blocks, so they meet under one of the keys made of that many
blocks; candidates under a key are then verified by their Hamming distance.

Only distinct fingerprints are linked; copies share one. A key with more than ``pairs_up_to`` fingerprints
is not paired: its fingerprints differ only in the blocks outside the key, so clearing every choice of
``max_bits`` bits there groups exactly those within that distance of a common fingerprint -- at most
2 ** max_bits fingerprints a group -- and misses no link, at a cost that grows with the fingerprints, not
their square. Components come from large-star/small-star rounds over tables in the shared folder.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, texts, unused, written

#: Lower-cases A-Z and leaves every other byte.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Shingles whose bits are counted at once; bounds memory for long texts, not the text.
PIECE = 50_000


def fingerprint(text: str, shingle_words: int = 3) -> int:
    """The 64-bit SimHash over word shingles (XXH64, seed 42); 0 for a text without words."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        starts, ends = [0], [len(joined)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        stops = np.cumsum(lengths + 1) - 1
        starts = (stops - lengths)[:len(words) - shingle_words + 1].tolist()
        ends = stops[shingle_words - 1:].tolist()
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), PIECE):
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at:at + PIECE], ends[at:at + PIECE])], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """doc_id, text_hash and fp, the fingerprint as a signed long, for every row."""
    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, shingle_words) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(fps.view(np.int64))],
                                             ["doc_id", "text_hash", "fp"])
    rows = texts(df, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def block_masks(blocks: int, bits: int = 64) -> list[int]:
    edges = [round(bits * i / blocks) for i in range(blocks + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_links(fps: DataFrame, max_bits: int = 2, blocks: int = 5, pairs_up_to: int = 32) -> DataFrame:
    """Links (a, b), a < b, that join all of ``fps`` (column fp, distinct) within ``max_bits`` bits."""
    if blocks <= max_bits:
        raise ValueError("there must be more blocks than differing bits")
    masks = block_masks(blocks)
    keys = [sum(chosen) for chosen in combinations(masks, blocks - max_bits)]
    whole = (1 << 64) - 1
    entries = F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("block"))
                        for i, m in enumerate(keys)])
    keyed = fps.select("fp", F.explode(entries).alias("e")).select("fp", "e.mask", "e.block")
    sizes = keyed.groupBy("mask", "block").agg(F.count("*").alias("size")).filter("size > 1")
    met = written(keyed.join(sizes, ["mask", "block"]), "simhash-blocks")

    few = met.filter(F.col("size") <= pairs_up_to)
    left, right = few.select("mask", "block", F.col("fp").alias("a")), few.select("mask", "block", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    pairs = left.join(right, ["mask", "block"]).filter((F.col("a") < F.col("b")) & near).select("a", "b")

    # crowded keys: clear each choice of max_bits free bits and meet on what is left
    free = [[1 << i for i in range(64) if (whole ^ key) >> i & 1] for key in keys]
    cleared = F.array(*[F.array(*[F.lit(_signed(sum(c))) for c in combinations(bits, max_bits)]) for bits in free])
    crowded = (met.filter(F.col("size") > pairs_up_to)
               .select("fp", F.explode(F.element_at(cleared, F.col("mask") + 1)).alias("cleared"))
               .select("fp", "cleared", F.col("fp").bitwiseAND(F.bitwise_not("cleared")).alias("rest"))
               .groupBy("cleared", "rest").agg(F.collect_set("fp").alias("members"))  # at most 2 ** max_bits
               .filter(F.size("members") > 1))
    stars = crowded.select(F.array_min("members").alias("a"), F.explode("members").alias("b")).filter("a < b")
    return pairs.unionByName(stars).distinct()


def connected_components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the smallest node that it can reach.

    Each round is one large-star and one small-star step, written to the shared folder; it ends when a round
    changes no link. A node's neighbours are only ever aggregated or joined, never gathered in a list.
    """
    def star(edges: DataFrame) -> DataFrame:  # every node's smallest neighbour, itself included
        return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))

    def tally(edges: DataFrame) -> tuple:
        row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(row)

    current = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    seen = tally(current)
    while seen[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (both.join(star(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u != v").distinct())  # u > v throughout
        low = star(large)
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct())
        current = written(small, name)
        before, seen = seen, tally(current)
        if seen == before:
            break
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _components(rows: DataFrame, max_bits: int, blocks: int, pairs_up_to: int) -> DataFrame:
    """fp, root, component_id for every distinct fingerprint of ``rows``, written."""
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    roots = connected_components(fingerprint_links(fps, max_bits, blocks, pairs_up_to))
    rooted = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return written(rooted.join(smallest, "root").select("fp", "root", "component_id"), "simhash-roots")


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3,
                       max_bits: int = 2, blocks: int = 5, pairs_up_to: int = 32) -> DataFrame:
    """One row for each input row: doc_id, fingerprint (16 hex digits), component_id.

    ``component_id`` is the smallest doc_id that links reach, the row's own included. Null texts count as
    empty; texts without words have fingerprint zero and link like any other. Null ids are ignored when the
    smallest is taken; a component of null ids only has a null component_id. Repeated rows repeat in the
    result. An empty table gives no rows. Other columns are not read.
    """
    rows = written(fingerprints(df, id_col, text_col, shingle_words), "simhash-fingerprints")
    return (rows.join(_components(rows, max_bits, blocks, pairs_up_to), "fp")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3,
                     max_bits: int = 2, blocks: int = 5, pairs_up_to: int = 32) -> DataFrame:
    """``df`` with one document of each component, all columns unchanged: the smallest id, then the smallest text
    hash; null ids come last. Rows that repeat both id and text are one document and stay together. A null text counts as
    empty, and empty texts are near copies of each other; a text is read whole, however long. An empty table stays empty."""
    rows = written(fingerprints(df, id_col, text_col, shingle_words), "simhash-fingerprints")
    rooted = rows.join(_components(rows, max_bits, blocks, pairs_up_to), "fp")
    place = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_hash")
    key, own_hash = unused(df, "key", "own_hash")
    best = written(rooted.groupBy("root").agg(F.min(place).alias("best")).select(
        F.col("best.doc_id").alias(key), F.col("best.text_hash").alias(own_hash)), "simhash-kept")
    text_hash = F.xxhash64(F.coalesce(col(text_col).cast("string"), F.lit("")))
    return df.join(best, col(id_col).cast("long").eqNullSafe(F.col(key)) & (text_hash == F.col(own_hash)), "left_semi")

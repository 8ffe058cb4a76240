"""Best-fit packing by linear grouping.

Only the counts of each piece length go to the driver (at most ``capacity`` numbers, whatever the rows):

1. Lengths above ``small_up_to`` are sorted and cut into at most ``groups`` groups of equal cardinality, each
   rounded up to its largest length.
2. With so few sizes, the number of sequences of each configuration (multiset of sizes that fits) is
   optimised as a linear program by column generation; its counts are rounded down.
3. The actual lengths of each group are substituted for its rounded size.
4. Small lengths, and large ones that rounding left over, go one by one, longest first, to the sequence with
   the least sufficient room.

All four steps handle runs of equal sequences, so their work depends on the number of lengths. The outcome
says which ranks of which length go to which sequences; pieces are ranked within their length in Spark.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .chunk_encoder import by_size, chunk_encoder
from .common import texts, written

#: Chunks that a worker's dictionary holds before it is refilled, bytes of text that it encodes at once, and bytes
#: that it keeps free between slices. Arrays of a slice are many times its size, and every task of an executor has them.
MAX_CHUNKS, SLICE, KEPT = 300_000, 2 << 20, 32 << 20


@dataclass
class Plan:
    """Segments: ``count`` pieces of ``length``, from rank ``rank``, go to sequences ``sequence``, ``sequence`` + 1
    ..., each at ``offset``."""
    capacity: int
    sequences: int = 0
    segments: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    taken: dict[int, int] = field(default_factory=lambda: defaultdict(int))

    def place(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.segments.append((length, self.taken[length], count, sequence, offset))
        self.taken[length] += count

    def arrays(self) -> tuple[np.ndarray, ...]:
        table = np.array(sorted(self.segments), np.int64).reshape(-1, 5)
        return tuple(np.ascontiguousarray(table[:, i]) for i in range(5))


def equal_groups(counts: np.ndarray, small_up_to: int, groups: int) -> list[list[tuple[int, int]]]:
    """Large lengths, longest first, as groups of (length, count) with the same number of pieces each."""
    lengths = [int(n) for n in np.flatnonzero(counts)[::-1] if n > small_up_to]
    total = int(sum(counts[n] for n in lengths))
    if len(lengths) <= groups:
        return [[(n, int(counts[n]))] for n in lengths]
    out, each, left = [[]], -(-total // groups), 0
    left = each
    for n in lengths:
        c = int(counts[n])
        while c:
            if not left:
                out.append([])
                left = each
            k = min(c, left)
            out[-1].append((n, k))
            c, left = c - k, left - k
    return out


def configurations(sizes: list[int], demand: np.ndarray, capacity: int, rounds: int = 3000) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often each is used: the linear relaxation, by column generation.

    A revised simplex whose new column solves a knapsack over the dual prices. ``rounds`` bounds the pivots;
    any basis reached is feasible, so stopping early costs sequences, never correctness.
    """
    k = len(sizes)
    most = capacity // min(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    inverse = np.diag(1 / np.diag(basis))
    use = inverse @ demand
    for _ in range(rounds):
        prices = np.maximum(inverse.sum(axis=0), 0)
        worth = np.zeros(capacity + 1)
        picks = []
        for _ in range(most):  # worth[w]: best value of as many items in room w
            options = np.full((k + 1, capacity + 1), -1.0)
            options[k] = worth
            for j, s in enumerate(sizes):
                options[j, s:] = worth[:capacity + 1 - s] + prices[j]
            pick = options.argmax(axis=0)
            picks.append(pick)
            worth = options[pick, np.arange(capacity + 1)]
        if worth[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(k), capacity
        for pick in reversed(picks):
            if (j := int(pick[room])) < k:
                column[j] += 1
                room -= sizes[j]
        change = inverse @ column
        rising = change > 1e-9
        if not rising.any():
            break
        steps = np.where(rising, use / np.where(rising, change, 1), np.inf)
        out = int(steps.argmin())
        use = use - steps[out] * change
        use[out] = steps[out]
        use = np.maximum(use, 0)
        basis[:, out] = column
        inverse[out] /= change[out]
        for i in np.flatnonzero(np.abs(change) > 1e-12):
            if i != out:
                inverse[i] -= change[i] * inverse[out]
    return [(basis[:, i].astype(int), float(use[i])) for i in range(k)]


def plan_packing(counts: np.ndarray, capacity: int, small_up_to: int | None = None, groups: int = 120) -> Plan:
    """``counts[n]``: pieces of length n, 1 <= n <= capacity."""
    plan = Plan(capacity)
    small_up_to = capacity // 8 if small_up_to is None else small_up_to
    left = counts.astype(np.int64).copy()
    room: dict[int, list[list[int]]] = defaultdict(list)  # free tokens -> runs [first sequence, how many]
    rooms: list[int] = []

    def leave(free: int, first: int, many: int) -> None:
        if many and free:
            if not room[free]:
                insort(rooms, free)
            room[free].append([first, many])

    grouped = equal_groups(left, small_up_to, groups)
    if grouped:
        sizes = [g[0][0] for g in grouped]
        demand = np.array([sum(c for _, c in g) for g in grouped], float)
        pending = [list(g) for g in grouped]
        for shape, use in sorted(configurations(sizes, demand, capacity), key=lambda x: x[0].tolist(), reverse=True):
            many = int(use + 1e-6)
            if not many:
                continue
            slots = []
            for j in np.flatnonzero(shape):
                for _ in range(shape[j]):  # the next ``many`` actual lengths of the group, as runs
                    runs, need = [], many
                    while need and pending[j]:
                        n, c = pending[j][0]
                        k = min(c, need)
                        runs.append((n, k))
                        need -= k
                        pending[j][0] = (n, c - k)
                        if c == k:
                            pending[j].pop(0)
                    if need:
                        runs.append((0, need))
                    slots.append(runs)
            cuts = sorted({0, many}.union(*[np.cumsum([c for _, c in runs]).tolist() for runs in slots]))
            ends = [np.cumsum([c for _, c in runs]) for runs in slots]
            for a, b in zip(cuts, cuts[1:]):
                first, used = plan.sequences + a, 0
                for runs, end in zip(slots, ends):
                    n = runs[int(np.searchsorted(end, a, "right"))][0]
                    if n:
                        plan.place(n, b - a, first, used)
                        left[n] -= b - a
                        used += n
                leave(capacity - used, first, b - a)
            plan.sequences += many

    for n in np.flatnonzero(left)[::-1]:
        n, many = int(n), int(left[n])
        while many:
            at = bisect_left(rooms, n)
            if at < len(rooms):
                free = rooms[at]
                first, bins = room[free].pop()
                if not room[free]:
                    rooms.pop(at)
            else:
                free, first, bins = capacity, plan.sequences, -(-many // (capacity // n))
                plan.sequences += bins
            each = free // n  # after one piece the same sequence still has the least sufficient room
            full, rest = min(bins, many // each), 0
            for i in range(each):
                if full:
                    plan.place(n, full, first, capacity - free + i * n)
            many -= full * each
            leave(free - each * n, first, full)
            if full < bins and many:
                rest = min(each, many)  # fewer than ``each`` are left: one more sequence takes them
                for i in range(rest):
                    plan.place(n, 1, first + full, capacity - free + i * n)
                many -= rest
                leave(free - rest * n, first + full, 1)
                full += 1
            leave(free, first + full, bins - full)
    return plan


def best_plan(counts: np.ndarray, capacity: int, groups: int = 120, shares: tuple[int, ...] = (8, 4, 2)) -> Plan:
    """The plan with the fewest sequences over a few choices of what counts as small (capacity // share). Many
    small pieces fill what rounding leaves, so few lengths need configurations; without them, most do."""
    return min((plan_packing(counts, capacity, capacity // share, groups) for share in shares), key=lambda p: p.sequences)


def pieces(df: DataFrame, tokenizer_file: str, capacity: int = 2048, end_id: int = 0,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and ``end_id``, cut from its end into pieces of
    ``capacity`` if longer than that, so that only the first piece may be shorter."""
    def run(batches):
        encoder = chunk_encoder(tokenizer_file, end_id, False, MAX_CHUNKS, KEPT)
        for batch in by_size(batches, max_bytes=SLICE):
            ids, at = encoder.encode(batch.column("text"))
            data, width = memoryview(ids.astype("<u4").tobytes()), 4
            sizes = np.diff(at)
            number = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), number)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
            head = (sizes - 1) % capacity + 1
            start = np.where(piece > 0, head[row] + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, head[row])
            begin = (at[:-1][row] + start) * width
            crc = [zlib.crc32(data[a:b]) for a, b in zip(begin.tolist(), (begin + length * width).tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"])
    return texts(df, id_col, text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_pieces(cut: DataFrame, capacity: int = 2048, groups: int = 120, rank_rows: int = 1024) -> DataFrame:
    """``cut`` (a written table) with sequence_id and offset. ``rank_rows``: about how many pieces of one length
    are ranked together; a frequent length is dealt over as many buckets as that needs."""
    spark = cut.sparkSession
    counts = np.zeros(capacity + 1, np.int64)
    for row in cut.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["count"]
    segments = best_plan(counts, capacity, groups).arrays()
    buckets = spark.createDataFrame([(int(n), int(-(-counts[n] // rank_rows))) for n in np.flatnonzero(counts)],
                                    "length long, buckets int")
    dealt = cut.join(F.broadcast(buckets), "length").withColumn(  # ``buckets`` has at most ``capacity`` rows
        "bucket", F.pmod(F.xxhash64("doc_id", "piece"), "buckets")).drop("buckets")
    before = (dealt.groupBy("length", "bucket").agg(F.count("*").alias("rows")).select(
        "length", "bucket", (F.sum("rows").over(Window.partitionBy("length").orderBy("bucket")) - F.col("rows")).alias("before")))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("nth", F.row_number().over(inside)).join(before, ["length", "bucket"]).select(
        *cut.columns, (F.col("before") + F.col("nth") - 1).alias("rank"))

    kept = cut.columns

    def run(batches):
        length, rank, _, sequence, offset = segments  # a few for each length, whatever the rows
        key = (length << 44) | rank
        for batch in batches:
            n, r = (batch.column(c).to_numpy() for c in ("length", "rank"))
            i = np.searchsorted(key, (n << 44) | r, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(sequence[i] + r - rank[i], pa.int64()),
                 pa.array(offset[i], pa.int64())], [*kept, "sequence_id", "offset"])
    return ranked.mapInArrow(run, StructType([*cut.schema, StructField("sequence_id", LongType()),
                                               StructField("offset", LongType())]))


def pack_documents(df: DataFrame, tokenizer_file: str, capacity: int = 2048, end_id: int = 0, groups: int = 120,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. Repeated rows and null ids are packed like any others; with
    equal length, id, piece and ids either may take either place. An empty table gives no rows. Other
    columns are not read. A very long text is encoded whole, by one task, and all its pieces are packed.
    """
    return pack_pieces(written(pieces(df, tokenizer_file, capacity, end_id, id_col, text_col), "pieces"), capacity, groups)

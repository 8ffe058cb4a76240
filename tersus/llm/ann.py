"""Nearest neighbours by cosine: inverted lists scanned with adaptive dimensions.

Vectors are scaled to length one and rotated by a random orthogonal matrix, so that any few coordinates of a
difference estimate its whole length. Rows are dealt to the lists of a k-means on a bounded sample. Within a
probed list, vectors lie in blocks of columns; after each block a hypothesis test compares the distance so
far, scaled up to all dimensions, with the best distances known, and abandons candidates that are almost
surely too far. A query's nearest list is scanned first; its distances are the other lists' first bounds.

A list is cut into chunks of bounded size, and so are its queries. Of rows with the very same vector only the
smallest ids can be among the nearest, so only they are candidates; and such queries are searched once.
Scores are computed in double precision on the original vectors.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, prepare_workers, written

RESULT = "query_id long, rank int, vec_id long, score double"


@dataclass
class Index:
    rotation: np.ndarray
    centroids: np.ndarray


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, vector (array of double) of the rows that take part: no null id, vector or component, all finite,
    not zero."""
    vector = col(vector_col).cast("array<double>")
    return df.select(col(id_col).cast("long").alias("vec_id"), vector.alias("vector")).filter(
        "vec_id IS NOT NULL AND size(vector) > 0 AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) "
        "AND abs(x) < double('Infinity')) AND exists(vector, x -> x != 0)")


def as_matrix(column: pa.Array) -> np.ndarray:
    rows = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps squares of tiny and huge components in range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosines(query: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of each row of ``query`` with the same row of ``x``, in double precision. Where squares leave the range of doubles
    the components are scaled by powers of two first, which changes no cosine."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore", divide="ignore"):
        own, other = (x * x).sum(axis=1), (query * query).sum(axis=1)
        out = (x * query).sum(axis=1) / (np.sqrt(own) * np.sqrt(other))
    small, large = 1e-250, 1e250
    far = np.flatnonzero(~((own > small) & (own < large) & (other > small) & (other < large)))
    if len(far):
        a, b = (np.ldexp(v[far], -np.frexp(np.abs(v[far]).max(axis=1, keepdims=True))[1]) for v in (x, query))
        out[far] = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
    return out


def fit_index(rows: DataFrame, total: int, lists: int | None, sample_rows: int, rounds: int = 12, seed: int = 7) -> Index:
    """k-means on about ``sample_rows`` rows, chosen by a hash of the id."""
    place = F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) / 1e6
    sample = rows.filter(place < min(1.0, sample_rows / max(total, 1))).select("vector").toArrow().combine_chunks()
    if not sample.num_rows:
        sample = rows.select("vector").limit(1).toArrow().combine_chunks()
    x = unit(as_matrix(sample.column("vector").combine_chunks()))
    rng = np.random.default_rng(seed)
    lists = min(lists or int(np.ceil(total ** 0.5)), max(1, len(x) // 4))
    centroids = x[np.sort(rng.permutation(len(x))[:lists])]
    for _ in range(rounds):
        own = (x @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centroids)
    rotation = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))[0]
    return Index(rotation, centroids)


def assigned(rows: DataFrame, index: Index) -> DataFrame:
    """``rows`` (vec_id, vector) with the list of each."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                own = (unit(as_matrix(batch.column("vector"))) @ index.centroids.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32())], ["vec_id", "vector", "list"])
    return rows.mapInArrow(run, "vec_id long, vector array<double>, list int")


def probes(queries: DataFrame, index: Index, sizes: np.ndarray, probe_share: float, least_candidates: int) -> DataFrame:
    """vec_id, vector, list, near: the lists each query scans, its nearest one marked: at least ``probe_share`` of
    all lists, and until they hold ``least_candidates`` rows or all there are."""
    share = max(1, int(np.ceil(probe_share * len(sizes))))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            order = np.argsort(-(unit(as_matrix(batch.column("vector"))) @ index.centroids.T), axis=1, kind="stable")
            held = np.cumsum(sizes[order], axis=1)
            need = 1 + (held < min(least_candidates, sizes.sum())).sum(axis=1)
            many = np.minimum(np.maximum(need, share), len(sizes))
            row = np.repeat(np.arange(len(many)), many)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            lists = order[row, nth]
            first = np.argmax(sizes[order] > 0, axis=1)  # the nearest list that has rows
            some = sizes[lists] > 0
            row, nth, lists = row[some], nth[some], lists[some]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(row)), batch.column("vector").take(pa.array(row)),
                 pa.array(lists, pa.int32()), pa.array(nth == first[row])], ["vec_id", "vector", "list", "near"])
    return queries.mapInArrow(run, "vec_id long, vector array<double>, list int, near boolean")


def adaptive_scan(queries: np.ndarray, blocks: list[np.ndarray], bounds: np.ndarray,
                  looseness: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, squared distance) of the pairs that are not abandoned. ``queries``: rotated, one a row;
    ``blocks``: the candidates' rotated coordinates in blocks of columns, stored one dimension a row.

    After d of D dimensions a pair goes if its partial squared distance, times D / d, is over the query's
    bound * (1 + looseness / sqrt(d)) ** 2: the test's error falls with both d and ``looseness``.
    """
    total, done = queries.shape[1], 0
    query = candidate = partial = None
    for x in blocks:
        z = queries[:, done:done + len(x)]
        done += len(x)
        if query is None or len(query) > 0.2 * len(z) * x.shape[1]:  # most pairs live: whole matrix products
            part = (z * z).sum(axis=1)[:, None] + (x * x).sum(axis=0) - 2 * (z @ x)
            if query is None:
                query, candidate = (i.ravel() for i in np.indices(part.shape))
                partial = part.ravel()
            else:
                partial = partial + part[query, candidate]
        else:
            difference = x[:, candidate] - z.T[:, query]
            partial = partial + (difference * difference).sum(axis=0)
        if done < total:
            live = partial * (total / done) <= bounds[query] * (1 + looseness / done ** 0.5) ** 2
            query, candidate, partial = query[live], candidate[live], partial[live]
    return query, candidate, partial


def _first_of_each(group: np.ndarray, top: int) -> np.ndarray:
    """Which places hold one of the first ``top`` entries of their group; ``group`` ascends."""
    start = np.searchsorted(group, group)
    return np.arange(len(group)) - start < top


def scan(candidates: DataFrame, queries: DataFrame, index: Index, top: int, block: int, looseness: float,
         pairs: int = 200_000) -> DataFrame:
    """query_id, vec_id, score: for each query and chunk, the nearest candidates that the scan finds. ``pairs``: about
    how many are in memory at once."""
    def run(key, left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids = left.column("vec_id").to_numpy()
        x = as_matrix(left.column("vector").combine_chunks())
        rotated = np.ascontiguousarray((unit(x) @ index.rotation).T)
        blocks = [rotated[a:a + block] for a in range(0, len(rotated), block)]
        askers = right.column("vec_id").to_numpy()
        wanted = as_matrix(right.column("vector").combine_chunks())
        turned = unit(wanted) @ index.rotation
        bounds = right.column("bound").combine_chunks().fill_null(np.inf).to_numpy(zero_copy_only=False).copy()
        unknown = np.flatnonzero(np.isinf(bounds))
        if len(unknown) and len(ids) > 4 * top:  # a first bound from a few candidates
            d = 2 - 2 * turned[unknown] @ rotated[:, :4 * top]
            bounds[unknown] = np.partition(d, top - 1, axis=1)[:, top - 1] + 1e-9
        out = [], [], []
        step = max(1, pairs // len(ids))
        for a in range(0, len(askers), step):
            q, c, distance = adaptive_scan(turned[a:a + step], blocks, bounds[a:a + step], looseness)
            order = np.lexsort((distance, q))
            q, c, distance = q[order], c[order], distance[order]
            last = np.minimum(np.searchsorted(q, q) + top, np.searchsorted(q, q, "right")) - 1
            near = distance <= distance[last] + 1e-9  # whoever could tie is kept for the exact score
            q, c = q[near], c[near]
            score = cosines(wanted[a + q], x[c])
            order = np.lexsort((ids[c], -score, q))
            order = order[_first_of_each(q[order], top)]
            for column, values in zip(out, (askers[a + q[order]], ids[c[order]], score[order])):
                column.append(values)
        return pa.table({n: np.concatenate(v) for n, v in zip(("query_id", "vec_id", "score"), out)})
    keys = ["list", "chunk", "part"]
    return candidates.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score double")


def nearest_of(found: DataFrame, top: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)


def nearest_neighbours(df: DataFrame, every: int = 50, k: int = 5, lists: int | None = None, sample_rows: int = 20_000,
                       probe_share: float = 0.6, block: int = 16, looseness: float = 1.5, chunk_rows: int = 4096,
                       least_candidates: int = 1000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for each row whose id ``every`` divides.

    ``lists``: inverted lists, the square root of the rows if not given. ``sample_rows``: bound of the k-means
    sample; every row is indexed. ``probe_share``: share of the lists that a query scans, more
    if they hold fewer than ``least_candidates`` rows. ``looseness``: of
    the test that abandons candidates. Ties go to smaller ids. Null, zero and non-finite vectors and
    null ids take no part. Vectors of each length are searched among themselves, one length after the other. Rows that repeat an id with other vectors are rows of their own, but no row with a
    query's id is its neighbour. With fewer than ``k`` other rows, all are returned; an empty table gives no
    rows. Other columns are not read.
    """
    spark = df.sparkSession
    prepare_workers(spark)
    rows = usable(df, id_col, vector_col).distinct()
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy("n").collect()  # one row for each length
    if not lengths:
        return spark.createDataFrame([], RESULT)
    found = [_of_one_length(rows.filter(F.size("vector") == r["n"]), r["count"], every, k, lists, sample_rows, probe_share,
                            block, looseness, chunk_rows, least_candidates) for r in lengths]
    answers = reduce(DataFrame.unionByName, found)
    if len(found) > 1:  # rows of several lengths may share a query's id
        answers = nearest_of(answers.drop("rank"), k)
    return answers.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _of_one_length(rows: DataFrame, total: int, every: int, k: int, lists: int | None, sample_rows: int, probe_share: float,
                   block: int, looseness: float, chunk_rows: int, least_candidates: int) -> DataFrame:
    """``nearest_neighbours`` of distinct usable ``rows`` whose vectors have one length."""
    spark = rows.sparkSession
    same = Window.partitionBy("vector").orderBy("vec_id")
    smallest = rows.withColumn("nth", F.row_number().over(same)).filter(F.col("nth") <= k + 1).drop("nth")
    index = fit_index(rows, total, lists, sample_rows)
    placed = written(assigned(smallest, index), "ann-lists")
    sizes = np.zeros(len(index.centroids), np.int64)
    for r in placed.groupBy("list").count().collect():  # one row for each list
        sizes[r["list"]] = r["count"]

    queries = rows.filter(F.pmod(F.col("vec_id"), F.lit(every)) == 0)
    first = queries.groupBy("vector").agg(F.min("vec_id").alias("same_as"))
    asked = written(queries.join(first, "vector"), "ann-queries")
    distinct = asked.filter("vec_id = same_as").select("vec_id", "vector")
    probed = written(probes(distinct, index, sizes, probe_share, least_candidates), "ann-probes")

    def cut(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Candidates and queries dealt to (list, chunk, part), each of bounded size."""
        askers = np.zeros(len(sizes), np.int64)
        for r in queries.groupBy("list").count().collect():  # one row for each list
            askers[r["list"]] = r["count"]
        plan = spark.createDataFrame([(int(i), int(-(-sizes[i] // chunk_rows)), int(-(-askers[i] // chunk_rows)))
                                      for i in np.flatnonzero(askers)], "list int, chunks int, parts int")
        c = placed.join(plan, "list").select("vec_id", "vector", "list", F.pmod(F.xxhash64("vec_id"), "chunks").cast("int").alias("chunk"),
                                             F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        q = queries.join(plan, "list").select("vec_id", "vector", "bound", "list",
                                              F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
                                              F.pmod(F.xxhash64("vec_id"), "parts").cast("int").alias("part"))
        return c, q

    near = probed.filter("near").withColumn("bound", F.lit(None).cast("double"))
    found = written(scan(*cut(near), index, k + 1, block, looseness), "ann-near")
    bounds = nearest_of(found, k + 1).groupBy("query_id").agg(F.count("*").alias("n"), (2 - 2 * F.min("score")).alias("bound")).select(
        F.col("query_id").alias("vec_id"), F.when(F.col("n") == k + 1, F.greatest("bound", F.lit(0.0)) + 1e-12).alias("bound"))
    far = written(probed.filter("NOT near").join(bounds, "vec_id", "left"), "ann-far")
    best = nearest_of(found.unionByName(scan(*cut(far), index, k + 1, block, looseness)), k + 1).drop("rank")

    answers = asked.select(F.col("vec_id").alias("asker"), "same_as").join(
        best.withColumnRenamed("query_id", "same_as"), "same_as").filter("asker != vec_id")
    return nearest_of(answers.select(F.col("asker").alias("query_id"), "vec_id", "score"), k)

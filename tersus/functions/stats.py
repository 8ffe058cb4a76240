"""Fitting: statistics a step needs, computed by bounded distributed jobs.

``FitBatch`` gathers the aggregate expressions of several fits over one
DataFrame and runs them as ONE aggregation (one scan, map-side partial
aggregation, a one-row result). Two statistics are not a plain global aggregate
and get grouped jobs, shared by all requests of the batch:

* exact quantiles: selection by narrowing. A pass counts values by at most 65,536 ordered buckets
  (partial aggregation on the map side, so a hot value is one row); the bucket that holds a wanted
  rank is the range that the next pass looks at. First come logarithmic buckets, which cover all
  doubles, then equal parts of the range, and single values once a range holds few. Nothing is
  sorted or shuffled but bucket counts. Two passes are enough up to some millions of values, four for any input. The
  first works out the values (joins and parsing) and keeps them as numbers on the executors' disks for the others.
* modes: ``groupBy(value).count()`` followed by a top-1 per request; no task
  ever holds all values.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

APPROX_ACCURACY = 10_000       # percentile_approx accuracy of approximate fits


@dataclass
class _Quantile:
    key: str
    expr: Column
    probs: tuple
    approx: bool = False
    accuracy: int = APPROX_ACCURACY
    present: Column | None = None


@dataclass
class _Mode:
    key: str
    num: Column | None
    txt: Column | None
    whole: bool = False   # numbers are integers, to be counted as such
    form: object = None   # (results so far) -> "num" or "txt": the only form worth counting


@dataclass
class FitBatch:
    df: DataFrame
    aggs: dict = field(default_factory=dict)
    quantiles: list = field(default_factory=list)
    modes: list = field(default_factory=list)

    def agg(self, key: str, expr: Column) -> str:
        self.aggs[key] = expr
        return key

    def quantile(self, key: str, expr: Column, probs, approx: bool = False,
                 accuracy: int = APPROX_ACCURACY, present: Column | None = None) -> str:
        """``present``, if given, adds to the results, from the same pass: ``key + '.values'``, the number of the
        expression's values, ``key + '.range'``, the least and the largest, and ``key + '.present'``, the number of rows
        where ``present`` is not NULL."""
        self.quantiles.append(_Quantile(key, expr, tuple(float(p) for p in probs), approx, accuracy, present))
        return key

    def mode(self, key: str, num: Column | None = None, txt: Column | None = None, form=None, whole: bool = False) -> str:
        """Most frequent value, smallest on ties: ``key + '.num'`` and / or ``key + '.txt'``. ``form``
        picks one of the two from the batch's aggregates, so the other is not counted at all. ``whole``: numbers
        are integers and stay exact."""
        self.modes.append(_Mode(key, num, txt, whole, form))
        return key

    # ------------------------------------------------------------------ run
    def run(self) -> dict:
        res: dict = {}
        approx = [q for q in self.quantiles if q.approx]
        exact = [q for q in self.quantiles if not q.approx]
        cols = [e.alias(f"a{i}") for i, e in enumerate(self.aggs.values())]
        cols += [x for j, q in enumerate(approx) if q.present is not None
                 for x in (F.count(q.expr).alias(f"v{j}"), F.count(q.present).alias(f"p{j}"), F.min(q.expr).alias(f"l{j}"), F.max(q.expr).alias(f"h{j}"))]
        cols += [F.percentile_approx(q.expr, list(q.probs), q.accuracy).alias(f"q{j}") for j, q in enumerate(approx)]
        if cols:
            row = self.df.agg(*cols).first()
            res.update({k: row[f"a{i}"] for i, k in enumerate(self.aggs)})
            for j, q in enumerate(approx):
                res[q.key] = [None] * len(q.probs) if row[f"q{j}"] is None else [float(v) for v in row[f"q{j}"]]
                if q.present is not None:
                    res.update({f"{q.key}.values": row[f"v{j}"], f"{q.key}.present": row[f"p{j}"], f"{q.key}.range": (row[f"l{j}"], row[f"h{j}"])})
        if exact:
            found, counts = select_quantiles(self.df, [(q.expr, q.probs) for q in exact], present=[q.present for q in exact])
            for q, values, (n, present, span) in zip(exact, found, counts):
                res.update({q.key: values, f"{q.key}.values": n, f"{q.key}.present": present, f"{q.key}.range": span})
        if self.modes:
            res.update(_run_modes(self.df, self.modes, res))
        return res


def _run_modes(df: DataFrame, modes, known: dict) -> dict:
    """All mode requests in one grouped job: explode (request, value) pairs,
    count per pair with partial aggregation, keep the top pair per request."""
    items = []
    names = []
    out = {}
    for m in modes:
        only = m.form(known) if m.form else None
        for suffix, expr in ((".num", m.num), (".txt", m.txt)):
            out[m.key + suffix] = None
            if expr is None or only not in (None, suffix[1:]):
                continue
            whole = suffix == ".num" and m.whole
            items.append(F.struct(F.lit(len(names)).alias("k"),
                                  (expr.cast("long") if whole else F.lit(None).cast("long")).alias("w"),
                                  (expr.cast("double") if suffix == ".num" and not whole else F.lit(None).cast("double")).alias("d"),
                                  (expr if suffix == ".txt" else F.lit(None).cast("string")).alias("s")))
            names.append(m.key + suffix)
    if not items:
        return out
    pairs = (df.select(F.explode(F.array(*items)).alias("it")).select("it.*")
             .where("w IS NOT NULL OR d IS NOT NULL OR s IS NOT NULL"))
    counts = pairs.groupBy("k", "w", "d", "s").count()
    best = counts.groupBy("k").agg(
        F.min_by(F.struct("w", "d", "s"), F.struct((-F.col("count")).alias("nc"), "w", "d", "s")).alias("b"))
    for r in best.collect():  # at most one row per request
        name = names[r["k"]]
        out[name] = next(v for v in r["b"] if v is not None)
    return out


def _interpolate(value_at: dict, n: int, p: float) -> float:
    pos = (n - 1) * p
    lo, hi = math.floor(pos), math.ceil(pos)
    lv, hv = value_at[lo], value_at[hi]
    if lo == hi or lv == hv:
        return float(lv)
    return (hi - pos) * lv + (pos - lo) * hv


#: Buckets of a pass, for each range that it looks at; a range of at most so many values is counted value by value.
BUCKETS = 1 << 16


def _log_bucket(v: Column) -> Column:
    """A bucket for any double, ascending with it: 15 to each doubling, on both sides of zero. Infinity has its own."""
    size = F.floor((F.least(F.log2(F.abs(v)), F.lit(1025.0)) + 1080) * 15).cast("double") + 1
    return F.when(v == 0, F.lit(0.0)).when(v > 0, size).otherwise(-size)


def _pass(df: DataFrame, items: list) -> dict:
    """Count by bucket. ``items``: (id, value, bucket, flag) as columns, value NULL where a row is not to be counted; ``n``
    of the rows is their weight. Gives, per id: ascending (least value, largest value, number) arrays of its buckets, and
    the flagged rows."""
    structs = [F.struct(F.lit(i).alias("i"), b.alias("b"), v.alias("v"), p.alias("p")) for i, v, b, p in items]
    rows = df.select(F.explode(F.array(*structs)).alias("it"), "n").select("it.*", "n").where("v IS NOT NULL OR p")
    found = rows.groupBy("i", "b").agg(F.sum(F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0)).alias("n"), F.min("v").alias("lo"),
                                       F.max("v").alias("hi"), F.sum(F.col("p").cast("long")).alias("p")).toArrow()
    column = {c: found.column(c).to_numpy() for c in ("i", "n", "lo", "hi", "p")}  # at most BUCKETS rows for each item
    out = {}
    for i, *_ in items:
        own = column["i"] == i
        some = own & (column["n"] > 0)
        lo, hi, n = (column[c][some] for c in ("lo", "hi", "n"))
        order = np.argsort(lo)
        out[i] = (lo[order], hi[order], n[order], int(column["p"][own].sum()))
    return out


def select_quantiles(df: DataFrame, requests, weight: Column | None = None, present=None, stored: bool = False) -> tuple[list, list]:
    """Exact linear-interpolated quantiles (as pandas and ``quantile_cont``) of several expressions over the same
    passes: ``requests`` is a list of (expression, probabilities); an expression without values gives a None for
    each probability, NaN counts as none. ``weight``: how many times each row counts. Also gives, for each request, the
    number of values, the number of rows where its ``present`` expression is not NULL, and (least, largest) value.
    ``stored``: the values are as cheap to read again as to keep."""
    present = present or [None] * len(requests)
    values = [e.cast("double").alias(f"e{k}") for k, (e, _) in enumerate(requests)]
    values += [p.isNotNull().alias(f"p{k}") for k, p in enumerate(present) if p is not None]
    df = df.select(*values, *([] if weight is None else [weight.cast("long").alias("n")]))
    if stored:
        return _select(df, requests, weight, present)
    df = df.persist(StorageLevel.DISK_ONLY)
    try:
        return _select(df, requests, weight, present)
    finally:
        df.unpersist()


def _select(df: DataFrame, requests, weight, present) -> tuple[list, list]:
    df = df if weight is not None else df.withColumn("n", F.lit(1).cast("long"))
    exprs = [F.when(~F.isnan(f"e{k}"), F.col(f"e{k}")) for k in range(len(requests))]
    flags = [F.lit(False) if p is None else F.col(f"p{k}") for k, p in enumerate(present)]
    first = _pass(df, [(k, e, _log_bucket(e), p) for k, (e, p) in enumerate(zip(exprs, flags))])
    total = {k: int(first[k][2].sum()) for k in first}
    wanted = {(k, r) for k, (_, probs) in enumerate(requests) if total[k]
              for p in probs for r in (math.floor((total[k] - 1) * p), math.ceil((total[k] - 1) * p))}
    value: dict = {}

    def narrow(ranges: dict, seen: dict) -> dict:
        """From the buckets seen in each range to the ranges that still hold an unknown rank."""
        out: dict = {}
        for i, ranks in ranges.items():
            lo, hi, n, _ = seen[i]
            upto = np.cumsum(n)
            for k, r, below in ranks:
                at = int(np.searchsorted(upto, r - below, "right"))
                if lo[at] == hi[at]:
                    value[k, r] = float(lo[at])
                else:
                    start = below + int(upto[at] - n[at])
                    out.setdefault((k, float(lo[at]), float(hi[at]), int(n[at])), []).append((k, r, start))
        return out

    left = narrow({k: [(k, r, 0) for kk, r in sorted(wanted) if kk == k] for k in total if total[k]}, first)
    while left:
        items, numbered = [], {}
        for i, ((k, lo, hi, n), ranks) in enumerate(left.items()):
            v = F.when(exprs[k].between(F.lit(lo), F.lit(hi)), exprs[k])
            part = v if n <= BUCKETS else F.floor((v - F.lit(lo)) / F.lit(hi - lo) * F.lit(BUCKETS - 1.0)).cast("double")
            items.append((i, v, part, F.lit(False)))
            numbered[i] = ranks
        left = narrow(numbered, _pass(df, items))
    out = []
    for k, (_, probs) in enumerate(requests):
        at = {r: v for (kk, r), v in value.items() if kk == k}
        out.append([_interpolate(at, total[k], p) if total[k] else None for p in probs])
    spans = [(float(first[k][0][0]), float(first[k][1][-1])) if total[k] else (None, None) for k in range(len(requests))]
    return out, [(total[k], first[k][3], spans[k]) for k in range(len(requests))]


def exact_quantiles(df: DataFrame, requests, weight: Column | None = None, stored: bool = False) -> list:
    """``select_quantiles`` without the counts."""
    return select_quantiles(df, requests, weight, stored=stored)[0]

"""ST2/ST3: apply a fitted cleaning recipe to every micro-batch; stream dedup.

``fit_recipe`` runs a step list once over a batch table (the history), fitting
each step's statistics exactly as ``apply_steps`` would, and freezes them. The
resulting ``FittedRecipe`` is a pure row-wise transform (filters with literal
bounds, coalesces with literal fills, casts), so applying it to a stream gives,
batch by batch, exactly the rows the batch recipe gives on the same input --
independent of where batch boundaries fall (H8: statistics are frozen).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tersus.errors import CleaningError
from tersus.functions.parse import DATE_FORMATS, col, to_timestamp
from tersus.operators.casts import cast_column
from tersus.operators.derive import add_derived_column
from tersus.operators.mapping import map_values
from tersus.operators.normalize import normalize_values
from tersus.operators.nulls import drop_nulls
from tersus.operators.outliers import filter_range
from tersus.session import let_workers_import
from tersus.streaming.ingest import run_stream, state_on_disk

STREAM_SAFE = {"fill_nulls", "cast_column", "normalize_values", "filter_outliers", "add_derived_column",
               "drop_nulls", "filter_range", "map_values"}


@dataclass
class FittedRecipe:
    steps: list = field(default_factory=list)   # fitted objects or plain step dicts

    def apply(self, df: DataFrame) -> DataFrame:
        for st in self.steps:
            if isinstance(st, dict):
                df = _plain(df, st)
            else:
                df = st.apply(df)
        return df

    transform = apply


def _plain(df: DataFrame, st: dict) -> DataFrame:
    op = st["operation"]
    if op == "cast_column":
        return cast_column(df, st["column"], st.get("dtype"), check="lazy", formats=st.get("formats") or DATE_FORMATS)
    if op == "normalize_values":
        return normalize_values(df, st["column"], st.get("method"), st.get("pattern"), st.get("replacement"))
    if op == "map_values":
        given = {n: st[n] for n in ("value", "canonical", "fold", "broadcast_bytes") if st.get(n) is not None}
        return map_values(df, st["column"], st["mapping"], **given)
    if op == "add_derived_column":
        return add_derived_column(df, st["column_name"], st["source_column"], st.get("transform"),
                                  formats=st.get("formats") or DATE_FORMATS)
    if op == "drop_nulls":
        return drop_nulls(df, st.get("subset") or [st["column"]])
    if op == "filter_range":
        return filter_range(df, st["column"], st["lo"], st["hi"])
    raise CleaningError(f"operation '{op}' cannot run per micro-batch")


def fit_recipe(history: DataFrame, steps) -> FittedRecipe:
    """Fit a single-table step list on ``history`` exactly as the batch recipe
    runner does (same sequential fits, same batching of independent fits) and
    keep the fitted steps for replay on micro-batches."""
    steps = [s for s in steps if s.get("operation") != "submit"]
    for st in steps:
        op = st["operation"]
        if op not in STREAM_SAFE:
            raise CleaningError(f"operation '{op}' is not allowed in a streaming recipe")
        if op == "fill_nulls" and (st.get("strategy") or "mean").lower() in ("forward_fill", "ffill",
                                                                             "backward_fill", "bfill"):
            raise CleaningError("order-based fills need a total order and cannot run per micro-batch")
    from tersus.plans.recipes import apply_steps

    record: dict = {}
    apply_steps({"history": history}, [dict(st, table_name="history") for st in steps],
                default_table="history", record=record)
    return FittedRecipe(record.get("history", []))


def _earliest(keys: list[str], order: list[str], apart: bool):
    """Of the rows of one key the first by ``order`` (NULL last), among those of an Arrow batch (``apart``: so few rows of a
    hot key are shuffled) or of a whole partition, of which one row for each key is held."""
    place = "__place"

    def numbered(rows):
        return rows.select(keys).append_column(place, pa.array(np.arange(rows.num_rows))).group_by(keys, use_threads=False)

    def first(rows):
        groups = numbered(rows).aggregate([(place, "min"), (place, "count")])
        alone = groups.filter(pc.equal(groups.column(place + "_count"), 1)).column(place + "_min").to_numpy()
        if len(alone) == rows.num_rows:
            return rows
        more = np.ones(rows.num_rows, bool)
        more[alone] = False
        several = rows.filter(pa.array(more))
        several = several.take(pc.sort_indices(several, [(c, "ascending") for c in order]))
        several = several.take(numbered(several).aggregate([(place, "min")]).column(place + "_min"))
        return pa.concat_tables([rows.take(pa.array(alone)), several])

    def run(batches):
        held, size = [], 0  # rows that came, after a table with one row for each key before
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            size += batch.num_rows
            if apart or size > max(1 << 17, 2 * held[0].num_rows):
                held = [first(pa.concat_tables(held)).combine_chunks()]
                size = held[0].num_rows
            if apart:
                yield from held.pop().to_batches()
                size = 0
        if held:
            yield from first(pa.concat_tables(held)).to_batches()
    return run


def dedup_to_sink(stream: DataFrame, keys, sink: str, checkpoint: str, event_time: str, formats=DATE_FORMATS,
                  trigger: dict | None = None):
    """ST3: append to ``sink`` the rows whose keys have not come before, however late they arrive.

    Of the rows of a new key in one micro-batch the earliest by ``event_time`` is kept (a time that does not parse comes
    last; ties: the smallest by the other columns, as text, NULL last): a batch's rows are dealt by key, and a task holds
    one row for each of its keys. The keys seen so far, without rows, are the state of the query, Spark's own
    deduplication: a RocksDB store on the executors' disks, partitioned by key and checkpointed by its changes. A batch
    looks up its own keys there and nothing that earlier batches wrote is read again, so its cost follows the batch and
    not the history. A key is kept for good, whatever its time; nothing is dropped for being late; a retried batch starts
    from the same state and replaces its output. The number of state partitions is the session's shuffle partitions when
    the query first starts, and stays.
    """
    spark, keys = stream.sparkSession, list(keys)
    # what rows are compared by, as columns that compare alike in Python: seconds, then texts
    others = [c for c in stream.columns if c not in keys]
    order = [to_timestamp(event_time, stream.schema[event_time].dataType, formats).cast("timestamp").cast("double")]
    order += [F.to_json(F.struct(col(c).alias("v"))) for c in others]
    names = [f"__order{i}" for i in range(len(order))]
    ordered = stream.withColumns(dict(zip(names, order)))
    schema = StructType([StructField(f.name, f.dataType, True) for f in ordered.schema])
    let_workers_import(spark)
    few = ordered.mapInArrow(_earliest(keys, names, True), schema)
    one = few.repartition(*[col(k) for k in keys]).mapInArrow(_earliest(keys, names, False), schema)
    first = one.drop(*names).dropDuplicates(keys)
    with state_on_disk(spark):
        return run_stream(first.writeStream.outputMode("append").foreachBatch(
            lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")), checkpoint, trigger)


def read_deduplicated(spark: SparkSession, sink: str, schema: StructType) -> DataFrame:
    """The rows that ``dedup_to_sink`` has written so far."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(sink)

"""Forward fill on a stream (N6 keyed by entity): the last value of each entity is keyed state."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import StructField, StructType

from tersus.errors import CleaningError, require_column
from tersus.functions.parse import col, std_nulls
from tersus.session import let_workers_import
from tersus.streaming.ingest import run_stream, state_on_disk


class _LastValue(StatefulProcessor):
    """State of one entity: its latest value and the place (the order columns) that this came at."""

    def __init__(self, names: list[str], column: int, order: list[int], schema: StructType):
        self.names, self.column, self.order, self.schema = names, column, order, schema

    def init(self, handle) -> None:
        self.latest = handle.getValueState("latest", self.schema)

    def place(self, values) -> list:
        return [(v is not None, v) for v in values]  # NULL first, as in the batch fill

    def handleInputRows(self, key, rows, timerValues):
        known = self.latest.get() if self.latest.exists() else None
        values, gaps = [], []
        for row in rows:  # a row with a value passes at once; of it only value and place are kept
            at = [row[i] for i in self.order]
            if row[self.column] is None:
                gaps.append((at, row))
            else:
                values.append((self.place(at), row[self.column], at))
                yield row
        values.sort(key=lambda v: v[:2])
        if known is not None:
            *at, value = known
            old = (self.place(at), value, at)
            values.insert(bisect_right(values, old[:2], key=lambda v: v[:2]), old)
        places = [v[0] for v in values]
        for at, row in gaps:
            before = bisect_right(places, self.place(at))
            filled = dict(zip(self.names, row))
            filled[self.names[self.column]] = values[before - 1][1] if before else None
            yield Row(**filled)
        if values:
            self.latest.update((*values[-1][2], values[-1][1]))

    def close(self) -> None:
        pass


def forward_fill_stream(stream: DataFrame, column: str, partition_by, order_by) -> DataFrame:
    """Each NULL (or marker text) of ``column`` becomes the entity's last value at or before its own place.

    ``partition_by``: the columns of an entity, NULL being one; ``order_by``: columns that Python compares as Spark does
    (numbers, dates, times, text), NULL first. Of values at one place the largest counts. With rows in order, however they
    are cut into micro-batches, the result is that of the batch fill. A row that comes late, with a place before the latest
    value of earlier batches, is filled from rows of its own micro-batch alone, and stays NULL if none of those has a value at
    or before it; a late value fills rows of its own micro-batch but does not replace the latest one.

    State is one value an entity, kept for good. Of an entity's rows in a micro-batch those to fill are held in the
    memory of one task, and the places of the others, so the source's limit on a micro-batch bounds it.
    """
    keys = [partition_by] if isinstance(partition_by, str) else list(partition_by)
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    for c in [*keys, *order, column]:
        require_column(stream, c)
    if not keys or not order:
        raise CleaningError("a fill on a stream needs the columns of an entity and those of its order")
    if column in keys or column in order:
        raise CleaningError(f"column {column!r} cannot be filled by its own order or entity")
    let_workers_import(stream.sparkSession)
    clean = stream.withColumn(column, std_nulls(col(column), stream.schema[column].dataType))
    out = StructType([StructField(f.name, f.dataType, True) for f in clean.schema])
    state = StructType([*[StructField(f"place{i}", clean.schema[c].dataType, True) for i, c in enumerate(order)],
                        StructField("value", clean.schema[column].dataType, True)])
    names = clean.columns
    processor = _LastValue(names, names.index(column), [names.index(c) for c in order], state)
    return clean.groupBy(*[col(k) for k in keys]).transformWithState(processor, out, "append", "none")


def forward_fill_to_sink(stream: DataFrame, column: str, partition_by, order_by, sink: str, checkpoint: str,
                         trigger: dict | None = None):
    """``forward_fill_stream`` appended to ``sink``, state in RocksDB and checkpointed by its changes; a batch that is
    tried again starts from the same state and replaces its output."""
    filled = forward_fill_stream(stream, column, partition_by, order_by)
    with state_on_disk(stream.sparkSession):
        return run_stream(filled.writeStream.outputMode("append").foreachBatch(
            lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")), checkpoint, trigger)

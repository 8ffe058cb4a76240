"""S1/S3: a named, immutable set of tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from tersus.errors import MissingTableError


class TableSet(Mapping):
    """Immutable ``name -> DataFrame`` mapping. ``bind`` returns a new set (S3)."""

    def __init__(self, tables: Mapping[str, DataFrame] | None = None):
        self._t = dict(tables or {})

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._t:
            raise MissingTableError(name, self._t.keys())
        return self._t[name]

    def __iter__(self):
        return iter(self._t)

    def __len__(self):
        return len(self._t)

    def table(self, name: str) -> DataFrame:
        return self[name]

    def bind(self, name: str, df: DataFrame) -> "TableSet":
        t = dict(self._t)
        t[name] = df
        return TableSet(t)

    def __repr__(self):
        return f"TableSet({list(self._t)})"

from tersus.operators.casts import cast_column, standardize_nulls
from tersus.operators.dedup import remove_duplicates
from tersus.operators.derive import add_derived_column
from tersus.operators.joins import merge_tables
from tersus.operators.mapping import map_values, unmapped_values
from tersus.operators.normalize import normalize_values
from tersus.operators.nulls import drop_nulls, fill_nulls
from tersus.operators.outliers import filter_outliers, filter_range

__all__ = ["cast_column", "standardize_nulls", "remove_duplicates", "add_derived_column",
           "merge_tables", "normalize_values", "drop_nulls", "fill_nulls", "filter_outliers",
           "filter_range", "map_values", "unmapped_values"]

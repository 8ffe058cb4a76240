from tersus.functions.parse import (DATE_FORMATS, NULL_MARKERS, is_mostly_numeric,
                                    std_nulls, to_double, to_timestamp)
from tersus.functions.text import strip_ws, title_case

__all__ = ["DATE_FORMATS", "NULL_MARKERS", "is_mostly_numeric", "std_nulls", "to_double",
           "to_timestamp", "strip_ws", "title_case"]

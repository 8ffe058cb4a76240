"""tersus: Spark-native cleaning, profiling and data-quality scoring.

Every operator is a function ``DataFrame -> DataFrame`` built from
``pyspark.sql.functions``; statistics a step needs (means, medians,
quantile bounds, modes) are fitted once by a bounded aggregation and
frozen into literals, so the same fitted step runs on a batch table or on
Structured Streaming micro-batches.
"""

from tersus.errors import CleaningError
from tersus.session import get_spark, scratch_dir

__all__ = ["CleaningError", "get_spark", "scratch_dir"]

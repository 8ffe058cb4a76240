from tersus.streaming.clean import FittedRecipe, dedup_to_sink, fit_recipe, read_deduplicated
from tersus.streaming.fill import forward_fill_stream, forward_fill_to_sink
from tersus.streaming.ingest import read_stream, run_stream
from tersus.streaming.monitor import (clean_to_sink, clean_with_refit, drift_batch_counts, drift_report, drift_to_sink,
                                      fit_drift_baseline, frozen_fences, running_profile, running_score,
                                      running_score_frozen, running_score_table)

__all__ = ["FittedRecipe", "dedup_to_sink", "read_deduplicated", "fit_recipe", "read_stream", "run_stream",
           "clean_to_sink", "clean_with_refit", "drift_batch_counts", "drift_report", "drift_to_sink",
           "fit_drift_baseline", "running_profile", "running_score", "frozen_fences", "running_score_frozen",
           "running_score_table", "forward_fill_stream", "forward_fill_to_sink"]

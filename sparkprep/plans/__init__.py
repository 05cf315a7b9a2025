from .clean import CleanConfig, CleanResult, RowPlan, apply_rows, clean, fit_rows, run
from .history import append_manifest, read_manifest, run_history, run_status_counts

__all__ = [
    "CleanConfig", "CleanResult", "RowPlan", "append_manifest", "apply_rows", "clean", "fit_rows",
    "read_manifest", "run", "run_history", "run_status_counts",
]

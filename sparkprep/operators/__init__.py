from .cells import (
    drop_empty_rows,
    nan_to_null,
    normalize_nulls,
    normalize_nulls_for_conversion,
    trim_cells,
)
from .dedupe import count_duplicates, remove_duplicates
from .fills import fill_ordered
from .filters import FilterPlan, apply_filters, compile_filters, filter_by_date_range
from .missing import (
    analyze_missing,
    apply_missing,
    fit_missing,
    handle_missing,
    missing_report,
    missing_summary,
)
from .names import resolve_column, standardize_columns
from .outliers import flag_outliers, outlier_report, remove_outliers
from .profile import (
    compare_profiles,
    correlations,
    histogram,
    interactions,
    missing_patterns,
    preview,
    profile_alerts,
    profile_columns,
    profile_dates,
    profile_numeric,
    profile_overview,
    profile_text,
    top_values,
)
from .quality import error_rate_score, measure_quality, quality_score
from .quantiles import exact_modes, exact_quantiles
from .ranges import apply_ranges, count_range_violations, validate_ranges
from .rowid import ROW_ID, with_row_id
from .types import (
    apply_types,
    coerce_numeric,
    conversion_errors,
    detect_column_types,
    enforce_types,
    fit_types,
    normalize_types,
)
from .validate import quality_issues, split_valid, type_ok, validate_schema, validation_errors
from .vectors import (
    apply_vectors,
    embed_text,
    fit_vectors,
    one_hot,
    standardize,
    vector_info,
    vectorize,
)

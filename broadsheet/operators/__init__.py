from .currency import in_rupees
from .fanout import fanout_sums
from .fill import forward_fill
from .inspection import case_insensitive, distinct_values, head, sample_rows
from .ordering import (
    exact_quantiles,
    global_ntile,
    global_ntiles,
    global_row_number,
    quantile_search,
    rank_at_most,
    running_total,
)
from .pinning import checked, local_rows, pin, scratch_dir
from .profiling import (
    categorical_profile,
    column_types,
    counted,
    duplicate_rows,
    null_counts,
    numeric_profile,
    profile,
    shape,
)
from .skew import sliced_join

__all__ = [
    "case_insensitive",
    "categorical_profile",
    "checked",
    "column_types",
    "counted",
    "distinct_values",
    "duplicate_rows",
    "exact_quantiles",
    "fanout_sums",
    "forward_fill",
    "global_ntile",
    "global_ntiles",
    "global_row_number",
    "head",
    "in_rupees",
    "local_rows",
    "null_counts",
    "numeric_profile",
    "pin",
    "profile",
    "quantile_search",
    "rank_at_most",
    "running_total",
    "sample_rows",
    "scratch_dir",
    "shape",
    "sliced_join",
]

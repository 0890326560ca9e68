from .readers import (
    RESCUED,
    Split,
    does_not_fit,
    load_all,
    load_table,
    malformed_rows,
    observing,
    path_of,
    split_rows,
)
from .writers import (
    STATUS_SCHEMA,
    PublishError,
    current_set,
    point_to,
    publish,
    publish_together,
    read_set,
    use_database,
    write_clean,
    write_jdbc,
)

__all__ = [
    "RESCUED",
    "STATUS_SCHEMA",
    "PublishError",
    "Split",
    "current_set",
    "does_not_fit",
    "load_all",
    "load_table",
    "malformed_rows",
    "observing",
    "path_of",
    "point_to",
    "publish",
    "publish_together",
    "read_set",
    "split_rows",
    "use_database",
    "write_clean",
    "write_jdbc",
]

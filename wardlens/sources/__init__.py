"""Reading, choosing and joining tables; writing results."""

from wardlens.sources.settings import from_environment
from wardlens.sources.sinks import (
    ChangedMeanwhile,
    durable,
    overwrite_days,
    overwrite_table,
    safe_replace,
    shared_folder,
    table_version,
    write_report,
)
from wardlens.sources.tables import (
    fetch_optional,
    fetch_table,
    first_with_column,
    join_pages,
    list_tables,
    load_snapshot,
    prune_pages,
)

__all__ = [
    "ChangedMeanwhile",
    "durable",
    "fetch_optional",
    "fetch_table",
    "first_with_column",
    "from_environment",
    "join_pages",
    "list_tables",
    "load_snapshot",
    "overwrite_days",
    "overwrite_table",
    "prune_pages",
    "safe_replace",
    "shared_folder",
    "table_version",
    "write_report",
]

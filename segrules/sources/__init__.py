"""Scans, projections and sinks (tables in, tables out)."""

from segrules.sources.tables import (
    empty_frame,
    funnel_fixture,
    project_columns,
    quote_name,
    read_csv,
    read_table,
    replace_table,
    save_table,
    scan_table,
    sql_rows,
    write_csv,
)

__all__ = [
    "empty_frame",
    "funnel_fixture",
    "project_columns",
    "quote_name",
    "read_csv",
    "read_table",
    "replace_table",
    "save_table",
    "scan_table",
    "sql_rows",
    "write_csv",
]

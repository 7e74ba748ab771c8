"""Writers of tables, nested records and refreshed columns."""

from .writers import (
    refresh_field,
    write_analysis,
    write_by_department,
    write_csv,
    write_hierarchy,
    write_json_records,
    write_yearly_csv,
)

__all__ = [name for name in dir() if not name.startswith("_")]

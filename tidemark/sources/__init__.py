"""Reading and writing version tables and rule tables."""

from tidemark.sources.tables import (
    load_rules,
    load_table,
    preview,
    register,
    save_bucketed,
    save_table,
)

__all__ = ["load_rules", "load_table", "preview", "register", "save_bucketed", "save_table"]

"""The named analyses: scores of an entity, a cohort, a table; two repair jobs."""

from tidemark.plans.named import (
    cohort_average,
    entity_score,
    repair_coded_file,
    repair_text_file,
    table_average,
)

__all__ = [
    "cohort_average",
    "entity_score",
    "repair_coded_file",
    "repair_text_file",
    "table_average",
]

"""Data currency of versioned tables on Spark: scores, error detection, repair."""

import sys

from pyspark import cloudpickle

from tidemark.functions import average_score, combine_scores, entity_filter
from tidemark.functions.sql import register_scores
from tidemark.operators.determine import cvq, hsq
from tidemark.operators.histogram import (
    latest_values,
    present_edges,
    value_counts,
    value_versions,
)
from tidemark.operators.ordering import (
    dense_topo_rank,
    run_compress,
    static_rank,
    topo_row_number,
)
from tidemark.operators.reach import relation
from tidemark.operators.repair import (
    detect_errors,
    join_back,
    repair,
    repaired_cells,
)
from tidemark.operators.rule_graph import (
    RuleBook,
    rule_closure,
    rule_edges,
    rule_rank,
)
from tidemark.operators.stored import cvq_of, histogram, hsq_of, merge_histograms
from tidemark.sources import load_rules, load_table, preview, register, save_bucketed, save_table

__all__ = [
    "RuleBook",
    "average_score",
    "combine_scores",
    "cvq",
    "cvq_of",
    "dense_topo_rank",
    "detect_errors",
    "entity_filter",
    "histogram",
    "hsq",
    "hsq_of",
    "join_back",
    "latest_values",
    "load_rules",
    "load_table",
    "merge_histograms",
    "present_edges",
    "preview",
    "register",
    "register_scores",
    "relation",
    "repair",
    "repaired_cells",
    "rule_closure",
    "rule_edges",
    "rule_rank",
    "run_compress",
    "save_bucketed",
    "save_table",
    "static_rank",
    "topo_row_number",
    "value_counts",
    "value_versions",
]

# Functions sent to executors carry the library's code with them, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Score combination and entity filters."""

from tidemark.functions.scores import average_score, combine_scores, entity_filter

__all__ = ["average_score", "combine_scores", "entity_filter"]

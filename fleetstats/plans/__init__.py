"""Plan-shape helpers: top-k (global or per group), last-row-per-key, dense numbering."""

from fleetstats.plans.shapes import dense_sequence, last_per_key, top_k

__all__ = ["dense_sequence", "last_per_key", "top_k"]

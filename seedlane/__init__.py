"""Similarity search over long strings as Spark DataFrame plans.

The stages are: cut sequences into k-mers, join the k-mers of queries with those of the
references, count hits per diagonal, keep the diagonals above a threshold, fetch the matching
reference windows and align them.
"""

from seedlane.plans.reference import Reference, append_reference, build_reference, compact_reference, open_reference
from seedlane.plans.search import SearchOptions, find_candidates, search, search_reference

__all__ = [
    "Reference",
    "SearchOptions",
    "append_reference",
    "build_reference",
    "compact_reference",
    "find_candidates",
    "open_reference",
    "search",
    "search_reference",
]

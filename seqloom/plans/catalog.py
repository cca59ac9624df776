"""All registered queries: importing the families fills the registry."""

from seqloom.plans import detail_queries, fact_queries, io_queries, live_queries, match_queries, stream_queries, structure_queries, text_queries  # noqa: F401
from seqloom.plans.registry import ORACLES, QUERIES  # noqa: F401

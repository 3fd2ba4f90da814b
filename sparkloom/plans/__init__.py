"""Query plans over the driver's tables; importing the modules registers them."""

from . import detail_queries, event_queries, fact_queries, index_queries, linked_queries, retrieval_queries, sequence_queries, service_queries, store_queries, text_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401

"""Named queries over the driver tables and their DuckDB oracle statements."""
from .registry import ORACLE, QUERIES, comparable  # noqa: F401


def load_all() -> None:
    """Import every query module so its queries register."""
    from . import (age_queries, link_queries, model_queries, network_queries, panel_queries,  # noqa: F401
                   rate_queries, register_queries, series_queries, time_queries, enrich_queries, shape_queries, source_queries, stream_queries)

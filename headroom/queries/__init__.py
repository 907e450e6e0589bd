"""Importing this package registers every query."""

from headroom.queries import (  # noqa: F401
    contact_queries,
    io_queries,
    region_queries,
    report_queries,
    session_queries,
)

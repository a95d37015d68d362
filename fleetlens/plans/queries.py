"""Every registered query. Importing the modules below registers theirs."""

from . import discovery_queries, findings_queries, history_queries, scanner_queries, stream_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401

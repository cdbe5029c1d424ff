"""All registered queries."""

from leafmill.plans import articles, audit, books, jobs, pages, search, sources, streams, transcripts  # noqa: F401
from leafmill.plans.registry import ORACLES, QUERIES  # noqa: F401

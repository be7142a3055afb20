"""All queries of the library's own operators."""

from __future__ import annotations

from .functions import codecs, wire  # noqa: F401
from .operators import aggregates, cache, compaction, lookups, reads, segments, state  # noqa: F401
from .plans import metadata  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
from .streaming import tail  # noqa: F401

"""The registered queries: each operator over whole tables, with the SQL that it is compared with.

The tables hold no research records, so each query says what stands for what.
"""

from attestor.queries import audit, browsing, catalogue, coverage, exchange, extensions, extraction, governance, history, layout, planning, surface
from attestor.queries.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "audit", "browsing", "catalogue", "coverage", "exchange", "extensions", "extraction", "governance", "history", "layout", "planning", "surface"]

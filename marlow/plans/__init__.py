"""All registered queries."""

from marlow.plans import line_queries, record_queries, source_queries, table_queries, text_queries  # noqa: F401
from marlow.plans.catalog import ORACLES, QUERIES  # noqa: F401

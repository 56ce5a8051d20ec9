"""All registered queries of the document-analytics operators, and their SQL twins."""

from __future__ import annotations

from docmill.plans import q_blocks, q_extract, q_joins, q_runs, q_text  # noqa: F401
from docmill.plans.registry import QUERIES, SQL  # noqa: F401

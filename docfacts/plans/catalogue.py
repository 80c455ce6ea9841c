"""Every registered query of the fact engine, with its DuckDB form.

Queries run over whole tables. Those of the extractor read the documents rendered from orders; their DuckDB forms compute
what must be found from the base tables. Review and learning queries run over a log derived from orders, line items and events.
"""

from __future__ import annotations

from collections.abc import Callable

from docfacts.plans import anchors, audits, catalogues, closing, corpus, display, facts, learning, relational, review, streams, workspace

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (facts, relational, corpus, review, learning, streams, workspace, display, closing, anchors, audits, catalogues):
    QUERIES.update(_module.QUERIES)
    ORACLE_SQL.update(_module.ORACLE_SQL)

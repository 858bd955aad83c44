"""All queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import ann, decontaminate, html_text, line_crf, line_dedup, mixing, sharding, simhash, surrogates, token_counts

MODULES = (token_counts, mixing, html_text, surrogates, decontaminate, sharding, line_crf, simhash, line_dedup, ann)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in getattr(module, "ORACLE_SQL", {}).items()}

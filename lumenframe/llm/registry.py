"""All queries of this subpackage, with their SQL."""

from . import queries_groups, queries_splits, queries_texts

_ALL = (queries_splits, queries_groups, queries_texts)
QUERIES = {k: v for m in _ALL for k, v in m.QUERIES.items()}
SQL = {k: v for m in _ALL for k, v in m.SQL.items()}

"""All queries of the audit engine and their oracle SQL, by name."""

from . import binary_queries, markup_queries, removal_queries, site_queries, text_queries

QUERIES, ORACLE_SQL = {}, {}
for _part in (text_queries, markup_queries, site_queries, removal_queries, binary_queries):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL

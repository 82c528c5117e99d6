"""All registered queries and their SQL checks."""

from . import queries_assembly, queries_edits, queries_ingest, queries_review

QUERIES, ORACLE = {}, {}
for module in (queries_assembly, queries_review, queries_edits, queries_ingest):
    QUERIES.update(module.QUERIES)
    ORACLE.update(module.ORACLE)

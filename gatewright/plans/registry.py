"""All registered queries and their SQL."""

from gatewright.plans import (
    code_queries, detect_queries, issue_queries, metric_queries, report_queries, source_queries, stream_queries,
)

_FAMILIES = [source_queries, metric_queries, detect_queries, report_queries, issue_queries, stream_queries, code_queries]
QUERIES, ORACLES = {}, {}
for _family in _FAMILIES:
    QUERIES.update(_family.QUERIES)
    ORACLES.update(_family.ORACLES)

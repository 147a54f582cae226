"""Every registered query, by survey section."""

from workload import (  # noqa: F401
    q_sources, q_functions, q_browse, q_rules, q_linkage, q_state, q_identity, q_ingest,
)
from workload.registry import QUERIES, checks  # noqa: F401

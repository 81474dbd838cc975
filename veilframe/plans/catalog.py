"""All registered queries."""

from veilframe.plans import detect_queries, stream_queries, traffic_queries, vault_queries  # noqa: F401
from veilframe.plans.registry import ORACLES, QUERIES  # noqa: F401

"""All registered queries."""

from acreledger.testbed import q_activity, q_core, q_io, q_ops, q_star  # noqa: F401
from acreledger.testbed.registry import ORACLES, QUERIES  # noqa: F401

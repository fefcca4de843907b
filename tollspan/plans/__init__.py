"""All registered queries."""

from tollspan.plans import q_flow, q_model, q_plate, q_road, q_scalars, q_stream, q_study  # noqa: F401
from tollspan.plans.registry import QUERIES, oracles

ORACLES = oracles()

__all__ = ["ORACLES", "QUERIES"]

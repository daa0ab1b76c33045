"""All registered queries."""

from . import queries_rollouts, queries_runs, queries_streams  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

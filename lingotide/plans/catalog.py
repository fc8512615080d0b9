"""All registered queries: importing this module fills QUERIES and ORACLES."""

from lingotide.plans import q_frames, q_metrics, q_practice, q_sources, q_streaming, q_syllables, q_text  # noqa: F401
from lingotide.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

"""Registered queries, by chapter; each module adds to the registry what it defines."""

from . import blending, evaluation, indicators, learning, panel, patterns
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "blending", "evaluation", "indicators", "learning", "panel", "patterns"]

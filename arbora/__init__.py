"""Aggregates over many-to-many equi-join graphs, without materialising the join."""

from arbora.engine import Engine
from arbora.plans.ir import Aggregate, Decline, SpecError

__all__ = ["Aggregate", "Decline", "Engine", "SpecError"]

"""The intermediate representation: relations, equalities, aggregates."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

Ref = tuple[str, str]  # (relation, column)


class SpecError(ValueError):
    """A question that is not well formed."""


class Decline(Exception):
    """Why a question is left to Spark's own plan; `reasons` holds every reason found."""

    def __init__(self, *reasons: str):
        super().__init__("; ".join(reasons))
        self.reasons = list(reasons)


@dataclass(frozen=True)
class Aggregate:
    """kind: count, count_col, sum, avg, min, max, bool_and, bool_or, or sum_product (of x and y)."""

    kind: str
    name: str
    x: Ref | None = None
    y: Ref | None = None


@dataclass
class JoinGraph:
    """A bag-semantic inner equi-join: relations by alias, equalities between their columns, at most one inequality."""

    relations: dict[str, DataFrame]
    equal: list[tuple[Ref, Ref]]
    unequal: tuple[Ref, Ref] | None = None
    names: dict[str, str] = field(default_factory=dict)

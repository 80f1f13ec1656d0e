"""The string grammar of questions: tables "t", "t a", "t AS a"; joins "a.x = b.y", and one "a.x <> b.y" for counts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .ir import JoinGraph, Ref, SpecError

_TABLE = re.compile(r"^\s*(?P<table>[^\s]+)(?:\s+(?:as\s+)?(?P<alias>[^\s]+))?\s*$", re.I)
_INEXACT = (T.FloatType, T.DoubleType, T.ArrayType, T.MapType, T.StructType, T.VariantType)


def ref(text: str, relations: dict[str, DataFrame]) -> Ref:
    parts = [p.strip() for p in text.split(".")]
    if len(parts) != 2 or not all(parts):
        raise SpecError(f"operand is not relation.column: {text.strip()!r}")
    if parts[0] not in relations:
        raise SpecError(f"unknown relation: {parts[0]!r}")
    if parts[1] not in relations[parts[0]].columns:
        raise SpecError(f"unknown column: {text.strip()!r}")
    return parts[0], parts[1]


def tables(specs: list[str], resolve) -> tuple[dict[str, DataFrame], dict[str, str]]:
    relations, names = {}, {}
    for spec in specs:
        m = _TABLE.match(spec or "")
        if not m:
            raise SpecError(f"empty or malformed relation: {spec!r}")
        alias = m["alias"] or m["table"]
        if alias in relations:
            raise SpecError(f"duplicate alias: {alias!r}")
        relations[alias], names[alias] = resolve(m["table"]), m["table"]
    if len(relations) < 2:
        raise SpecError("at least two relations are needed")
    return relations, names


def graph(table_specs: list[str], joins: list[str], resolve, allow_unequal: bool = False) -> JoinGraph:
    relations, names = tables(table_specs, resolve)
    equal, unequal = [], []
    for j in joins:
        for op in ("<>", "!="):
            if op in j:
                if not allow_unequal:
                    raise SpecError(f"an inequality is only for counts: {j!r}")
                left, right = (ref(x, relations) for x in j.split(op, 1))
                if left[0] == right[0]:
                    raise SpecError(f"an inequality needs two relations: {j!r}")
                unequal.append((left, right))
                break
        else:
            sides = j.split("=")
            if len(sides) != 2 or any(c in j for c in "<>!"):
                raise SpecError(f"not an equality: {j!r}")
            equal.append((ref(sides[0], relations), ref(sides[1], relations)))
    if len(unequal) > 1:
        raise SpecError("at most one inequality")
    for a, b in equal:
        for r, c in (a, b):
            if isinstance(relations[r].schema[c].dataType, _INEXACT):
                raise SpecError(f"not a join key type: {r}.{c}")
    for r in relations:
        if not any(r in (a[0], b[0]) for a, b in equal):
            raise SpecError(f"relation without a predicate: {r!r}")
    return JoinGraph(relations, equal, unequal[0] if unequal else None, names)

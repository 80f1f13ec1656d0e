"""Semijoin reduction (Yannakakis): extremes, existence and tuples without the join's multiplicities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.operators.messages import leaf
from arbora.plans.ir import JoinGraph, Ref
from arbora.plans.tree import JoinTree, join_tree


def reduced(g: JoinGraph, tree: JoinTree, r: str, extra: set[str]) -> DataFrame:
    """The rows of r that some tuple of its subtree's join holds: semijoins, children first."""
    df = leaf(g, tree, r, extra)
    for c in tree.children(r):
        keys = [f"v{k}" for k in tree.key[c]]
        df = df.join(reduced(g, tree, c, set()).select(*keys).distinct(), keys, "left_semi")
    return df


def extreme(g: JoinGraph, x: Ref, largest: bool, name: str) -> DataFrame:
    df = reduced(g, join_tree(g, x[0]), x[0], {x[1]})
    col = F.col(f"`r{list(g.relations).index(x[0])}_{x[1]}`")
    return df.agg((F.max(col) if largest else F.min(col)).alias(name))


def exists(g: JoinGraph) -> DataFrame:
    """One row: whether the join holds any tuple. Stops at the first row that survives."""
    tree = join_tree(g)
    return reduced(g, tree, tree.root, set()).limit(1).agg((F.count("*") > 0).alias("exists"))


def tuples(g: JoinGraph, limit: int | None = None) -> DataFrame:
    """The join's tuples over its join columns, as <alias>_<column>; each relation is reduced before it is joined."""
    tree = join_tree(g)
    df = reduced(g, tree, tree.root, set())
    for r in reversed(tree.order):
        if r != tree.root:
            df = df.join(reduced(g, tree, r, set()), [f"v{k}" for k in tree.key[r]])
    out = df.select(*[F.col(f"v{k}").alias(f"{r}_{c}") for r in g.relations for k, cols in sorted(tree.of[r].items()) for c in cols])
    return out if limit is None else out.limit(limit)

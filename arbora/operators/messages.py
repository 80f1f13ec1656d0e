"""Aggregates by message passing: every relation is folded per join key and the folds multiply up the join tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.plans.gate import best_root, fold_rate
from arbora.plans.ir import Aggregate, Decline, JoinGraph, Ref
from arbora.plans.tree import JoinTree, join_tree

BIG = T.DecimalType(38, 0)
#: Bytes (as Spark estimates them) from which a relation is profiled before it is folded.
LARGE = 256 << 20


def leaf(g: JoinGraph, tree: JoinTree, r: str, extra: set[str]) -> DataFrame:
    """Relation r with its join classes as v<class> (nulls dropped, columns of one class equal) and `extra` columns as r<i>_<column>.

    Only what is used is selected, so the scan reads no other column; filters on r reach it.
    """
    df, i = g.relations[r], list(g.relations).index(r)
    for cols in tree.of[r].values():
        for c in cols:
            df = df.where(F.col(f"`{c}`").isNotNull())
        for c in cols[1:]:
            df = df.where(F.col(f"`{cols[0]}`") == F.col(f"`{c}`"))
    keys = [F.col(f"`{cols[0]}`").alias(f"v{k}") for k, cols in tree.of[r].items()]
    return df.select(*keys, *[F.col(f"`{c}`").alias(f"r{i}_{c}") for c in sorted(extra)])


def _name(g: JoinGraph, x: Ref) -> str:
    return f"`r{list(g.relations).index(x[0])}_{x[1]}`"


def _bare(g: JoinGraph, x: Ref) -> str:
    return _name(g, x).strip("`")


def _summable(g: JoinGraph, x: Ref) -> tuple[bool, int]:
    kind = g.relations[x[0]].schema[x[1]].dataType
    if isinstance(kind, T.IntegralType):
        return True, 0
    if isinstance(kind, T.DecimalType):
        return True, kind.scale
    return False, 0


def check(g: JoinGraph, aggregates: list[Aggregate]) -> list[str]:
    """Why the aggregates can't be folded exactly: sums of binary fractions depend on their order."""
    out = []
    for a in aggregates:
        for x in (a.x, a.y):
            if x and a.kind in ("sum", "avg", "sum_product") and not _summable(g, x)[0]:
                out.append(f"{a.kind}({x[0]}.{x[1]}): only integers and decimals add up the same in any order")
            if x and a.kind in ("bool_and", "bool_or") and not isinstance(g.relations[x[0]].schema[x[1]].dataType, T.BooleanType):
                out.append(f"{a.kind}({x[0]}.{x[1]}): not a boolean")
    return out


class Fold:
    """The message columns of one question.

    n: rows of the subtree's join. For a measure x in the subtree: nn_x (rows where it isn't null), s_x (its sum),
    lo_x, hi_x. For a product: nn and s of x, y and of their pair. Counts and sums are decimals of 38 digits; each is
    its own relation's value times the n of all other branches.
    """

    def __init__(self, g: JoinGraph, tree: JoinTree, aggregates: list[Aggregate], groups: list[Ref]):
        self.g, self.tree, self.aggregates, self.groups = g, tree, aggregates, groups
        self.sums = {x for a in aggregates if a.kind in ("sum", "avg", "sum_product") for x in (a.x, a.y) if x}
        self.counted = self.sums | {a.x for a in aggregates if a.kind == "count_col"}
        self.ends = {a.x for a in aggregates if a.kind in ("min", "max", "bool_and", "bool_or")}
        self.products = {(a.x, a.y) for a in aggregates if a.kind == "sum_product"}
        self.needs = {r: {x[1] for x in self.counted | self.ends | set(groups) if x[0] == r} for r in g.relations}

    def folded(self, r: str) -> DataFrame:
        """r's own rows, one per join key and group, before it meets any message: a hot key is added up before it is shuffled.

        A large relation whose rows hardly share keys, as its profile shows, goes on row by row instead: folding it would shuffle it twice.
        """
        df, g = leaf(self.g, self.tree, r, self.needs[r]), self.g
        keys = [*[F.col(f"v{k}") for k in self.tree.of[r]], *[F.col(_name(g, x)) for x in self.groups if x[0] == r]]
        no = F.lit(0).cast(BIG)
        parts = [("n", F.lit(1).cast(BIG), F.sum)]
        for x in self.counted:
            if x[0] == r:
                col = F.col(_name(g, x))
                parts.append((f"nn_{_bare(g, x)}", F.when(col.isNotNull(), F.lit(1).cast(BIG)).otherwise(no), F.sum))
                if x in self.sums:
                    parts.append((f"s_{_bare(g, x)}", F.coalesce(self.unscaled(x, col), no), F.sum))
        for x in self.ends:
            if x[0] == r:
                parts += [(f"lo_{_bare(g, x)}", F.col(_name(g, x)), F.min), (f"hi_{_bare(g, x)}", F.col(_name(g, x)), F.max)]
        for x, y in self.products:
            if x[0] == y[0] == r:
                both = (self.unscaled(x, F.col(_name(g, x))) * self.unscaled(y, F.col(_name(g, y)))).cast(BIG)
                parts += [(f"nnp_{self.pair(x, y)}", F.when(both.isNotNull(), F.lit(1).cast(BIG)).otherwise(no), F.sum), (f"sp_{self.pair(x, y)}", F.coalesce(both, no), F.sum)]
        if not self.shares(r):
            return df.select(*keys, *[c.alias(name) for name, c, _ in parts])
        return df.groupBy(*keys).agg(*[(how(c).cast(BIG) if how is F.sum else how(c)).alias(name) for name, c, how in parts])

    def shares(self, r: str) -> bool:
        """Whether r is folded before it is joined: always if one class joins it (the fold's shuffle is the join's), or if it is small."""
        df = self.g.relations[r]
        if len(self.tree.of[r]) == 1 or float(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < LARGE:
            return True
        return fold_rate(self.g, self.tree, r, self.groups) >= 2

    def pair(self, x: Ref, y: Ref) -> str:
        return f"{_bare(self.g, x)}__{_bare(self.g, y)}"

    def message(self, r: str) -> tuple[DataFrame, set[str]]:
        """The fold of r's subtree by its key to the parent (and the groups inside it), and the relations in it.

        r's folded rows and its children's messages are branches alike: a value of one branch is multiplied by the n of all others.
        """
        tree, g = self.tree, self.g
        own = self.folded(r)
        if not tree.children(r) and set(tree.of[r]) == set(tree.key.get(r, [])) and self.shares(r):
            return own, {r}
        held: dict[str, set[str]] = {"n": {r}}  # each branch's n, and its relations
        df = own
        for c in tree.children(r):
            m, names = self.message(c)
            tag = f"c{list(g.relations).index(c)}_n"
            df = df.join(m.withColumnRenamed("n", tag), [f"v{k}" for k in tree.key[c]])
            held[tag] = names
        inside = set().union(*held.values())
        here = lambda x: x[0] in inside
        side = lambda x: next(n for n, names in held.items() if x[0] in names)

        def total(value: Column | None, skip: set[str]) -> Column:
            out = value
            for n in held:
                if n not in skip:
                    out = F.col(n) if out is None else (out * F.col(n)).cast(BIG)
            return F.sum(out).cast(BIG)

        aggs = [total(None, set()).alias("n")]
        for x in filter(here, self.counted):
            for what in ("nn", "s") if x in self.sums else ("nn",):
                aggs.append(total(F.col(f"`{what}_{_bare(g, x)}`"), {side(x)}).alias(f"{what}_{_bare(g, x)}"))
        for x in filter(here, self.ends):
            aggs += [F.min(F.col(f"`lo_{_bare(g, x)}`")).alias(f"lo_{_bare(g, x)}"), F.max(F.col(f"`hi_{_bare(g, x)}`")).alias(f"hi_{_bare(g, x)}")]
        for x, y in self.products:
            if here(x) and here(y):
                for what in ("nn", "s"):
                    name = f"{what}p_{self.pair(x, y)}"
                    value = F.col(f"`{name}`") if side(x) == side(y) else (F.col(f"`{what}_{_bare(g, x)}`") * F.col(f"`{what}_{_bare(g, y)}`")).cast(BIG)
                    aggs.append(total(value, {side(x), side(y)}).alias(name))
        by = [F.col(f"v{k}") for k in tree.key.get(r, [])] + [F.col(_name(g, x)) for x in self.groups if here(x)]
        return df.groupBy(*by).agg(*aggs), inside

    def unscaled(self, x: Ref, col: Column) -> Column:
        scale = _summable(self.g, x)[1]
        return (col * F.lit(10**scale).cast(T.DecimalType(scale + 1, 0))).cast(BIG) if scale else col.cast(BIG)

    def mean(self, x: Ref, s: Column, n: Column) -> Column:
        """The exact mean of a decimal, rounded half up at four digits more than it has, as Spark's avg: by whole parts and remainders of integers."""
        kind = self.g.relations[x[0]].schema[x[1]].dataType
        scale = min(38, kind.scale + 4)
        whole = lambda a: ((a - a % n).cast(BIG) / n).cast(BIG)
        rest = (s % n).cast(BIG)
        more = (rest * F.lit(10 ** (scale - kind.scale)).cast(T.DecimalType(6, 0))).cast(BIG)
        last = (more % n).cast(BIG)
        up = F.when(F.abs(last) * 2 >= n, F.signum(last).cast(BIG)).otherwise(F.lit(0).cast(BIG))
        units = (whole(s) * F.lit(10 ** (scale - kind.scale)).cast(T.DecimalType(6, 0))).cast(BIG) + whole(more) + up
        return F.concat(units.cast(BIG).cast("string"), F.lit(f"E-{scale}")).cast(T.DecimalType(min(38, kind.precision + 4), scale))

    def result(self) -> DataFrame:
        g = self.g
        m, _ = self.message(self.tree.root)
        twice = [x[1] for x in self.groups]
        out = [F.col(_name(g, x)).alias(x[1] if twice.count(x[1]) == 1 else f"{x[0]}_{x[1]}") for x in self.groups]
        for a in self.aggregates:
            name = _name(g, a.x).strip("`") if a.x else ""
            if a.kind == "count":
                c = F.coalesce(F.col("n"), F.lit(0)).cast("long")
            elif a.kind == "count_col":
                c = F.coalesce(F.col(f"`nn_{name}`"), F.lit(0)).cast("long")
            elif a.kind in ("sum", "avg"):
                scale = _summable(g, a.x)[1]
                s = F.when(F.col(f"`nn_{name}`") > 0, F.col(f"`s_{name}`"))
                if a.kind == "avg" and isinstance(g.relations[a.x[0]].schema[a.x[1]].dataType, T.DecimalType):
                    c = self.mean(a.x, s, F.col(f"`nn_{name}`"))
                elif a.kind == "avg":
                    c = s.cast("double") / F.lit(float(10**scale)) / F.col(f"`nn_{name}`").cast("double")
                else:
                    c = (s.cast(T.DecimalType(38, scale)) / F.lit(10**scale).cast(T.DecimalType(scale + 1, 0))).cast(T.DecimalType(38, scale)) if scale else s
            elif a.kind == "sum_product":
                pair = f"{name}__{_name(g, a.y).strip('`')}"
                scale = _summable(g, a.x)[1] + _summable(g, a.y)[1]
                c = F.when(F.col(f"`nnp_{pair}`") > 0, F.col(f"`sp_{pair}`"))
                c = (c / F.lit(10**scale).cast(T.DecimalType(scale + 1, 0))).cast(T.DecimalType(38, scale)) if scale else c
            elif a.kind in ("min", "bool_and"):
                c = F.col(f"`lo_{name}`")
            elif a.kind in ("max", "bool_or"):
                c = F.col(f"`hi_{name}`")
            else:
                raise Decline(f"aggregate {a.kind}")
            out.append(c.alias(a.name))
        return m.select(*out)


def aggregate(g: JoinGraph, aggregates: list[Aggregate], groups: list[Ref] | None = None) -> DataFrame:
    """One row (or one per group) of the aggregates over the join of g, declining what it can't fold exactly."""
    groups = groups or []
    reasons = check(g, aggregates)
    if reasons:
        raise Decline(*reasons)
    apart = len({x[0] for x in groups}) > 1  # where groups lie in one relation, that is the root
    root = (best_root(g, groups) if apart else groups[0][0]) if groups else None
    return Fold(g, join_tree(g, root), aggregates, groups).result()

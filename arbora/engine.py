"""The engine: questions over join graphs, and ordinary SQL with message passing where it pays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.operators import counts, reducer
from arbora.operators.messages import aggregate
from arbora.plans import parse
from arbora.plans.gate import Gate
from arbora.plans.ir import Aggregate, Decline, JoinGraph, SpecError
from arbora.plans.tree import join_tree
from arbora.plans.walker import Walker
from arbora.sources import Catalog


class Engine:
    """mode: `off`, `auto` (the gate decides) or `force`; unknown modes mean off. With fallback, errors of a rewrite leave Spark's plan."""

    def __init__(self, spark: SparkSession, mode: str = "auto", gate: Gate | None = None, fallback: bool = True, reduce_extremes: bool = True):
        self.spark, self.mode, self.gate, self.fallback, self.reduce_extremes = spark, mode, gate or Gate(), fallback, reduce_extremes
        self.catalog, self._stats, self.last = Catalog(spark), {}, []

    def register(self, name: str, df: DataFrame) -> None:
        self.catalog.register(name, df)

    def graph(self, tables: list[str], joins: list[str], allow_unequal: bool = False) -> JoinGraph:
        return parse.graph(tables, joins, self.catalog.resolve, allow_unequal)

    def count(self, tables: list[str], joins: list[str], limit: int | None = None) -> DataFrame:
        g = self.graph(tables, joins, allow_unequal=True)
        return counts.count(g) if limit is None else counts.count_at_most(g, limit)

    def exists(self, tables: list[str], joins: list[str]) -> DataFrame:
        return reducer.exists(self.graph(tables, joins))

    def tuples(self, tables: list[str], joins: list[str], limit: int | None = None) -> DataFrame:
        if limit is not None and limit < 0:
            raise SpecError("a limit can't be negative")
        return reducer.tuples(self.graph(tables, joins), limit)

    def group_count(self, tables: list[str], joins: list[str], keys: str) -> DataFrame:
        g = self.graph(tables, joins)
        groups = [parse.ref(k, g.relations) for k in keys.split(",")]
        return aggregate(g, [Aggregate("count", "count")], groups)

    def aggregate(self, tables: list[str], joins: list[str], aggregates: dict[str, tuple], by: list[str] | None = None) -> DataFrame:
        """aggregates: name -> (kind, "r.x"[, "r.y"])."""
        g = self.graph(tables, joins)
        aggs = [Aggregate(kind, name, *[parse.ref(x, g.relations) for x in xs]) for name, (kind, *xs) in aggregates.items()]
        return aggregate(g, aggs, [parse.ref(k, g.relations) for k in by or []])

    def extreme(self, tables: list[str], joins: list[str], column: str, largest: bool, name: str) -> DataFrame:
        g = self.graph(tables, joins)
        return reducer.extreme(g, parse.ref(column, g.relations), largest, name)

    def stats(self, tables: list[str], joins: list[str]) -> DataFrame:
        """One row: count, records (rows of all messages), bytes (Spark's estimate of the inputs), slices (shuffle partitions)."""
        g = self.graph(tables, joins)
        steps = self._steps(g)
        size = sum(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for df in g.relations.values())
        n = counts.count(g).first()[0]
        return self.spark.createDataFrame([(n, sum(s[2] for s in steps), size, int(self.spark.conf.get("spark.sql.shuffle.partitions")))], "count long, records long, bytes long, slices long")

    def steps(self, tables: list[str], joins: list[str]) -> DataFrame:
        """One row per relation of the join tree, leaves first: its message's rows, its join's tuples, their ratio and fan-out."""
        return self.spark.createDataFrame(self._steps(self.graph(tables, joins)), "step int, relation string, records long, tuples long, compression double, fanout_mean double, fanout_max long")

    def _steps(self, g: JoinGraph) -> list[tuple]:
        from arbora.operators.messages import Fold

        tree, out = join_tree(g), []
        fold = Fold(g, tree, [Aggregate("count", "count")], [])
        for i, r in enumerate(tree.order):
            n, t, mean, most = fold.message(r)[0].agg(F.count("n"), F.coalesce(F.sum("n"), F.lit(0)).cast("long"), F.avg("n").cast("double"), F.coalesce(F.max("n"), F.lit(0)).cast("long")).first()
            out.append((i, r, n, t, float(t) / n if n else 0.0, mean, most))
        return out

    def optimize(self, df: DataFrame, mode: str | None = None) -> DataFrame:
        """df, or an equal DataFrame in which foldable aggregates over joins pass messages."""
        mode = mode or self.mode
        self.last = []
        if mode not in ("auto", "force"):
            return df
        walker = Walker(self.spark, mode, self.gate, self._stats, self.reduce_extremes)
        try:
            out = walker.rewrite(df)
        except Exception as e:  # internal plan classes: whatever goes wrong, Spark's plan answers
            if not self.fallback:
                raise
            out, walker.fired = df, 0
            walker.notes.append(f"fell back: {type(e).__name__}: {str(e)[:200]}")
        self.last = walker.notes
        self.fired = walker.fired
        return out

    def sql(self, query: str, mode: str | None = None) -> DataFrame:
        return self.optimize(self.spark.sql(query), mode)

    def explain(self, query: str, mode: str | None = None) -> list[str]:
        """Why the query was taken over or declined, every reason."""
        self.sql(query, mode)
        return self.last


__all__ = ["Aggregate", "Decline", "Engine", "SpecError"]

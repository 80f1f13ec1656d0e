"""The engine's registered queries and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.engine import Engine
from arbora.operators import counts

TABLES = "region nation customer supplier part orders lineitem events".split()
CHAIN = (["customer", "orders", "lineitem"], ["customer.c_custkey = orders.o_custkey", "orders.o_orderkey = lineitem.l_orderkey"])
TREE = ([*CHAIN[0], "supplier"], [*CHAIN[1], "supplier.s_nationkey = customer.c_nationkey"])
STAR = (["lineitem a", "lineitem b", "lineitem c"], ["a.l_suppkey = b.l_suppkey", "a.l_suppkey = c.l_suppkey"])
_CHAIN = "customer, orders, lineitem WHERE c_custkey = o_custkey AND o_orderkey = l_orderkey"
_TREE = "customer, orders, lineitem, supplier WHERE c_custkey = o_custkey AND o_orderkey = l_orderkey AND s_nationkey = c_nationkey"
BIG = "decimal(38,0)"


def engine(spark: SparkSession, sf_dir: str, **derived) -> Engine:
    """An engine over the tables of sf_dir; derived maps names to functions of (engine)."""
    e = Engine(spark, mode="force", fallback=False)
    for t in TABLES:
        e.register(t, spark.read.parquet(f"{sf_dir}/{t}.parquet"))
    for name, f in derived.items():
        e.register(name, f(e))
    return e


def table(name: str):
    return lambda e: e.catalog.resolve(name)


def _count(tables, joins, **derived):
    return lambda spark, sf: engine(spark, sf, **derived).count(tables, joins).withColumnRenamed("count", "n")


def _agg(tables, joins, aggs, by=None, casts=None, **derived):
    def run(spark, sf):
        df = engine(spark, sf, **derived).aggregate(tables, joins, aggs, by)
        return df.withColumns({c: F.col(c).cast(t) for c, t in (casts or {}).items()})

    return run


def _sql(text: str, mode: str = "force", fires: bool = True):
    def run(spark, sf) -> DataFrame:
        e = engine(spark, sf)
        df = e.sql(text, mode)
        if bool(e.fired) != fires:
            raise AssertionError(f"fired {e.fired}: {e.last}")
        return df

    return run


def _line(e):
    return e.catalog.resolve("lineitem").select("l_orderkey", "l_suppkey", F.when(F.col("l_linenumber") <= 4, F.col("l_linenumber")).alias("few"), F.col("l_quantity").cast("decimal(12,2)").alias("quantity"), (F.col("l_linenumber") > 3).alias("late"), F.col("l_linenumber").cast("long").alias("number"))


_LINE = "(SELECT l_orderkey, l_suppkey, CASE WHEN l_linenumber <= 4 THEN l_linenumber END AS few, CAST(l_quantity AS DECIMAL(12,2)) AS quantity, l_linenumber > 3 AS late, CAST(l_linenumber AS BIGINT) AS number FROM lineitem)"
_L = (["orders", "line"], ["orders.o_orderkey = line.l_orderkey"])
_ON = f"orders, {_LINE} line WHERE o_orderkey = line.l_orderkey"


def _filtered(e):
    return e.catalog.resolve("lineitem").where("l_linenumber > 3 AND l_linenumber IS NOT NULL")


def _band(e):
    return e.catalog.resolve("orders").where("o_totalprice BETWEEN 10000 AND 200000")


def _sides(how, swap=False):
    def run(spark, sf):
        e = engine(spark, sf)
        c, o = e.catalog.resolve("customer"), e.catalog.resolve("orders")
        return counts.side_count(c, o, ["c_custkey"], ["o_custkey"], how).withColumnRenamed("count", "n")

    return run


_SIDES = "SELECT count(*) AS n FROM customer {} JOIN orders ON c_custkey = o_custkey"
_HUB = (["supplier", "lineitem a", "lineitem b"], ["supplier.s_suppkey = a.l_suppkey", "supplier.s_suppkey = b.l_suppkey"])

Q: dict[str, tuple] = {
    "count_star3": (_count(*STAR), "SELECT CAST(sum(c * c * c) AS BIGINT) AS n FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_suppkey)"),
    "count_equality_prop": (_count(STAR[0], ["a.l_suppkey = b.l_suppkey", "b.l_suppkey = c.l_suppkey"]), "SELECT CAST(sum(c * c * c) AS BIGINT) AS n FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_suppkey)"),
    "count_chain": (_count(*CHAIN), f"SELECT count(*) AS n FROM {_CHAIN}"),
    "count_tree": (_count(*TREE), f"SELECT count(*) AS n FROM {_TREE}"),
    "count_selfjoin_events": (_count(["events a", "events b"], ["a.user_id = b.user_id"]), "SELECT count(*) AS n FROM events a, events b WHERE a.user_id = b.user_id"),
    "count_composite": (_count(["lineitem a", "lineitem b"], ["a.l_partkey = b.l_partkey", "a.l_suppkey = b.l_suppkey"]), "SELECT count(*) AS n FROM lineitem a, lineitem b WHERE a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey"),
    "count_filtered": (_count(["customer", "band", "some"], ["customer.c_custkey = band.o_custkey", "band.o_orderkey = some.l_orderkey"], some=_filtered, band=_band), f"SELECT count(*) AS n FROM {_CHAIN} AND l_linenumber > 3 AND o_totalprice BETWEEN 10000 AND 200000"),
    "count_empty": (_agg(["orders", "none"], ["orders.o_orderkey = none.l_orderkey"], {"n": ("count",), "s": ("sum", "none.l_linenumber")}, casts={"s": "bigint"}, none=lambda e: e.catalog.resolve("lineitem").where("l_linenumber < 0")), "SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_linenumber < 0"),
    "count_col": (_agg(*_L, {"n": ("count",), "k": ("count_col", "line.few")}, line=_line), f"SELECT count(*) AS n, count(few) AS k FROM {_ON}"),
    "sum_int": (_agg(*TREE, {"s": ("sum", "lineitem.l_linenumber")}, casts={"s": "bigint"}), f"SELECT CAST(sum(l_linenumber) AS BIGINT) AS s FROM {_TREE}"),
    "sum_decimal": (_agg(*_L, {"s": ("sum", "line.quantity")}, line=_line), f"SELECT CAST(sum(quantity) AS DECIMAL(38,2)) AS s FROM {_ON}"),
    "avg_int": (_agg(*TREE, {"a": ("avg", "lineitem.l_linenumber")}), f"SELECT avg(l_linenumber) AS a FROM {_TREE}"),
    "min_max_reduced": (lambda spark, sf: engine(spark, sf, some=_filtered).extreme(["customer", "orders", "some"], ["customer.c_custkey = orders.o_custkey", "orders.o_orderkey = some.l_orderkey"], "orders.o_orderkey", True, "m"), f"SELECT max(o_orderkey) AS m FROM {_CHAIN} AND l_linenumber > 3"),
    "min_max_grouped": (_agg(*CHAIN, {"lo": ("min", "orders.o_orderkey"), "hi": ("max", "orders.o_orderkey")}, ["customer.c_nationkey"]), f"SELECT c_nationkey, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM {_CHAIN} GROUP BY 1"),
    "bool_and_or": (_agg(*_L, {"every": ("bool_and", "line.late"), "some": ("bool_or", "line.late")}, ["orders.o_custkey"], line=_line), f"SELECT o_custkey, bool_and(late) AS every, bool_or(late) AS some FROM {_ON} GROUP BY 1"),
    "sum_product": (_agg(*_HUB, {"p": ("sum_product", "a.l_linenumber", "b.l_orderkey")}), "SELECT CAST(sum(x * y) AS DECIMAL(38,0)) AS p FROM (SELECT l_suppkey, CAST(sum(l_linenumber) AS HUGEINT) AS x, CAST(sum(l_orderkey) AS HUGEINT) AS y FROM lineitem GROUP BY 1) JOIN supplier ON s_suppkey = l_suppkey"),
    "multi_agg": (_agg(*TREE, {"n": ("count",), "s": ("sum", "lineitem.l_linenumber"), "t": ("sum", "supplier.s_suppkey"), "lo": ("min", "orders.o_orderkey"), "hi": ("max", "lineitem.l_partkey"), "a": ("avg", "supplier.s_suppkey")}, casts={"s": "bigint", "t": "bigint"}), f"SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s, CAST(sum(s_suppkey) AS BIGINT) AS t, min(o_orderkey) AS lo, max(l_partkey) AS hi, avg(s_suppkey) AS a FROM {_TREE}"),
    "group_root": (_agg(*CHAIN, {"n": ("count",)}, ["customer.c_nationkey"]), f"SELECT c_nationkey, count(*) AS n FROM {_CHAIN} GROUP BY 1"),
    "group_deep": (_agg(*TREE, {"n": ("count",)}, ["lineitem.l_linenumber"]), f"SELECT l_linenumber, count(*) AS n FROM {_TREE} GROUP BY 1"),
    "group_siblings": (_agg(*TREE, {"n": ("count",), "s": ("sum", "orders.o_orderkey")}, ["lineitem.l_linenumber", "supplier.s_suppkey"], casts={"s": "bigint"}), f"SELECT l_linenumber, s_suppkey, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s FROM {_TREE} GROUP BY 1, 2"),
    "group_payload": (_agg(*CHAIN, {"n": ("count",)}, ["orders.o_orderstatus"]), f"SELECT o_orderstatus, count(*) AS n FROM {_CHAIN} GROUP BY 1"),
    "group_multi": (_agg(*CHAIN, {"n": ("count",)}, ["customer.c_mktsegment", "orders.o_orderpriority", "lineitem.l_returnflag"]), f"SELECT c_mktsegment, o_orderpriority, l_returnflag, count(*) AS n FROM {_CHAIN} GROUP BY 1, 2, 3"),
    "group_null_key": (_agg(*_L, {"n": ("count",), "s": ("sum", "line.few")}, ["line.few"], casts={"s": "bigint"}, line=_line), f"SELECT few, count(*) AS n, CAST(sum(few) AS BIGINT) AS s FROM {_ON} GROUP BY 1"),
    "exists_true": (lambda spark, sf: engine(spark, sf).exists(*CHAIN), f"SELECT count(*) > 0 AS exists FROM {_CHAIN}"),
    "exists_false": (lambda spark, sf: engine(spark, sf, none=lambda e: e.catalog.resolve("lineitem").where("l_linenumber < 0")).exists(["orders", "none"], ["orders.o_orderkey = none.l_orderkey"]), "SELECT count(*) > 0 AS exists FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_linenumber < 0"),
    "count_at_most": (lambda spark, sf: engine(spark, sf).count(*CHAIN, limit=3).withColumnRenamed("count", "n"), f"SELECT count(*) AS n FROM (SELECT 1 FROM {_CHAIN} LIMIT 3)"),
    "count_at_most_all": (lambda spark, sf: engine(spark, sf).count(*CHAIN, limit=10**12).withColumnRenamed("count", "n"), f"SELECT count(*) AS n FROM {_CHAIN}"),
    "count_at_most_zero": (lambda spark, sf: engine(spark, sf).count(*CHAIN, limit=0).withColumnRenamed("count", "n"), "SELECT CAST(0 AS BIGINT) AS n"),
    "tuples_all": (lambda spark, sf: engine(spark, sf).tuples(["nation n", "customer c", "supplier s"], ["n.n_nationkey = c.c_nationkey", "n.n_nationkey = s.s_nationkey"]), "SELECT n_nationkey AS n_n_nationkey, c_nationkey AS c_c_nationkey, s_nationkey AS s_s_nationkey FROM nation, customer, supplier WHERE n_nationkey = c_nationkey AND n_nationkey = s_nationkey"),
    "tuples_limit": (lambda spark, sf: engine(spark, sf).tuples(*CHAIN, limit=100), None),
    "group_count_fn": (lambda spark, sf: engine(spark, sf).group_count(*CHAIN, "orders.o_custkey, lineitem.l_orderkey").withColumnRenamed("count", "n"), f"SELECT o_custkey, l_orderkey, count(*) AS n FROM {_CHAIN} GROUP BY 1, 2"),
    "not_equal": (_count(["orders a", "orders b"], ["a.o_custkey = b.o_custkey", "a.o_orderkey <> b.o_orderkey"]), "SELECT count(*) AS n FROM orders a, orders b WHERE a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey"),
    "left_outer_count": (_sides("left"), _SIDES.format("LEFT")),
    "right_outer_count": (_sides("right"), _SIDES.format("RIGHT")),
    "full_outer_count": (_sides("full"), _SIDES.format("FULL")),
    "semi_count": (_sides("semi"), _SIDES.format("SEMI")),
    "anti_count": (_sides("anti"), _SIDES.format("ANTI")),
    "outer_last_count": (lambda spark, sf: counts.outer_count(engine(spark, sf).graph(["customer", "orders"], ["customer.c_custkey = orders.o_custkey"]), spark.read.parquet(f"{sf}/supplier.parquet").where("s_nationkey < 12"), ("customer", "c_nationkey"), "s_nationkey", "full").withColumnRenamed("count", "n"), "SELECT count(*) AS n FROM (SELECT c_nationkey FROM customer, orders WHERE c_custkey = o_custkey) FULL JOIN (SELECT * FROM supplier WHERE s_nationkey < 12) ON c_nationkey = s_nationkey"),
    "range_count": (lambda spark, sf: counts.range_count(spark.read.parquet(f"{sf}/lineitem.parquet"), spark.read.parquet(f"{sf}/part.parquet"), "l_linenumber", "p_size").withColumnRenamed("count", "n"), "SELECT CAST(sum(a.n * b.n) AS BIGINT) AS n FROM (SELECT l_linenumber AS v, count(*) AS n FROM lineitem GROUP BY 1) a, (SELECT p_size AS v, count(*) AS n FROM part GROUP BY 1) b WHERE a.v < b.v"),
    "sql_count": (_sql(f"SELECT count(*) AS n FROM {_TREE}"), f"SELECT count(*) AS n FROM {_TREE}"),
    "group_cast": (_sql(f"SELECT CAST(l_quantity / 10 AS INT) AS g, count(*) AS n FROM {_CHAIN} GROUP BY CAST(l_quantity / 10 AS INT)", fires=False), f"SELECT CAST(floor(l_quantity / 10) AS INTEGER) AS g, count(*) AS n FROM {_CHAIN} GROUP BY 1"),
    "group_computed": (_sql(f"SELECT c_nationkey + 1 AS g, sum(l_linenumber + 1) AS s, count(*) AS n FROM {_CHAIN} GROUP BY c_nationkey + 1"), f"SELECT c_nationkey + 1 AS g, CAST(sum(l_linenumber + 1) AS BIGINT) AS s, count(*) AS n FROM {_CHAIN} GROUP BY 1"),
    "sum_computed": (_sql(f"SELECT sum(l_linenumber * 2) AS s, sum(l_orderkey * c_custkey) AS p FROM {_CHAIN}"), f"SELECT CAST(sum(l_linenumber * 2) AS BIGINT) AS s, CAST(sum(l_orderkey * c_custkey) AS BIGINT) AS p FROM {_CHAIN}"),
    "min_cast": (_sql(f"SELECT min(CAST(o_orderkey AS STRING)) AS m, max(CAST(l_linenumber AS BIGINT)) AS b FROM {_CHAIN}"), f"SELECT min(CAST(o_orderkey AS VARCHAR)) AS m, max(CAST(l_linenumber AS BIGINT)) AS b FROM {_CHAIN}"),
    "join_cast": (_sql("SELECT count(*) AS n FROM lineitem, part WHERE CAST(l_quantity AS INT) = p_size"), "SELECT count(*) AS n FROM lineitem, part WHERE CAST(trunc(l_quantity) AS INTEGER) = p_size"),
    "avg_decimal": (_agg(*_L, {"a": ("avg", "line.quantity")}, ["orders.o_orderstatus"], line=_line), f"SELECT o_orderstatus, CAST(sum(quantity) / count(quantity) AS DECIMAL(16,6)) AS a FROM {_ON} GROUP BY 1"),
    "sql_exists": (_sql(f"SELECT EXISTS (SELECT 1 FROM {_CHAIN} AND l_linenumber > 3) AS e"), f"SELECT EXISTS (SELECT 1 FROM {_CHAIN} AND l_linenumber > 3) AS e"),
    "sql_limit": (_sql(f"SELECT count(*) AS n FROM (SELECT 1 FROM {_CHAIN} LIMIT 100)"), f"SELECT count(*) AS n FROM (SELECT 1 FROM {_CHAIN} LIMIT 100)"),
    "sql_limit_large": (_sql(f"SELECT count(*) AS n FROM (SELECT 1 FROM {_CHAIN} LIMIT 100000000)"), f"SELECT count(*) AS n FROM (SELECT 1 FROM {_CHAIN} LIMIT 100000000)"),
    "sql_limit_zero": (_sql(f"SELECT count(*) AS n FROM (SELECT 1 FROM {_CHAIN} LIMIT 0)", fires=False), f"SELECT count(*) AS n FROM (SELECT 1 FROM {_CHAIN} LIMIT 0)"),
    "sql_having_order": (_sql(f"SELECT c_nationkey, count(*) AS n, sum(l_linenumber) AS s, avg(o_orderkey) AS a FROM {_TREE} AND l_linenumber > 2 GROUP BY c_nationkey HAVING count(*) > 10 ORDER BY n DESC, c_nationkey LIMIT 7"), f"SELECT c_nationkey, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s, avg(o_orderkey) AS a FROM {_TREE} AND l_linenumber > 2 GROUP BY c_nationkey HAVING count(*) > 10 ORDER BY n DESC, c_nationkey LIMIT 7"),
    "sql_max": (_sql(f"SELECT max(o_orderkey) AS m FROM {_CHAIN} AND c_nationkey < 5"), f"SELECT max(o_orderkey) AS m FROM {_CHAIN} AND c_nationkey < 5"),
    "sql_or_filter": (_sql(f"SELECT count(*) AS n FROM {_CHAIN} AND (l_linenumber = 1 OR l_quantity > 40)"), f"SELECT count(*) AS n FROM {_CHAIN} AND (l_linenumber = 1 OR l_quantity > 40)"),
    "decline_double_sum": (_sql(f"SELECT round(sum(l_quantity), 2) AS s FROM {_CHAIN}", fires=False), f"SELECT round(sum(l_quantity), 2) AS s FROM {_CHAIN}"),
    "decline_distinct": (_sql(f"SELECT count(DISTINCT o_custkey) AS n FROM {_CHAIN}", fires=False), f"SELECT count(DISTINCT o_custkey) AS n FROM {_CHAIN}"),
    "decline_cyclic": (_sql("SELECT count(*) AS n FROM customer, orders, lineitem, supplier WHERE c_custkey = o_custkey AND o_orderkey = l_orderkey AND l_suppkey = s_suppkey AND s_nationkey = c_nationkey", fires=False), "SELECT count(*) AS n FROM customer, orders, lineitem, supplier WHERE c_custkey = o_custkey AND o_orderkey = l_orderkey AND l_suppkey = s_suppkey AND s_nationkey = c_nationkey"),
    "decline_outer_sql": (_sql("SELECT count(*) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey", fires=False), "SELECT count(*) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey"),
    "decline_rollup": (_sql(f"SELECT c_nationkey, count(*) AS n FROM {_CHAIN} GROUP BY ROLLUP (c_nationkey)", fires=False), f"SELECT c_nationkey, count(*) AS n FROM {_CHAIN} GROUP BY ROLLUP (c_nationkey)"),
    "decline_theta": (_sql("SELECT count(*) AS n FROM orders a, orders b WHERE a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey", fires=False), "SELECT count(*) AS n FROM orders a, orders b WHERE a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey"),
    "auto_gate_fires": (_sql("SELECT count(*) AS n FROM lineitem a, lineitem b WHERE a.l_suppkey = b.l_suppkey", "auto"), "SELECT count(*) AS n FROM lineitem a, lineitem b WHERE a.l_suppkey = b.l_suppkey"),
    "auto_gate_declines": (_sql(f"SELECT count(*) AS n FROM {_CHAIN}", "auto", fires=False), f"SELECT count(*) AS n FROM {_CHAIN}"),
    "stats_fn": (lambda spark, sf: engine(spark, sf).stats(*CHAIN), None),
    "steps_fn": (lambda spark, sf: engine(spark, sf).steps(*TREE), None),
}
QUERIES = {k: v[0] for k, v in Q.items()}
SQL = {k: v[1] for k, v in Q.items() if v[1]}

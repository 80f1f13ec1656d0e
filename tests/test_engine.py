"""Bind errors, the rewrite's fallback and reasons, the gate, files, statistics and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora import Engine
from arbora.functions import census, most_common, spread_sample
from arbora.operators import messages
from arbora.plans import gate
from arbora.plans.ir import SpecError
from arbora.streaming import running_counts


@pytest.fixture
def engine(spark):
    e = Engine(spark, mode="force")
    e.register("a", spark.createDataFrame([(i % 5, i, i * 1.0) for i in range(50)], "k long, x int, d double"))
    e.register("b", spark.createDataFrame([(i % 7, i, None if i % 3 else i) for i in range(40)], "k long, y long, z int"))
    return e


@pytest.mark.parametrize(
    ("tables", "joins"),
    [
        (["a"], []), (["a", "a"], ["a.k = a.k"]), (["a", ""], ["a.k = b.k"]), (["a", "b"], []), (["a", "b"], ["a.k = b.nope"]), (["a", "b"], ["a.k = c.k"]),
        (["a", "b"], ["a.k < b.k"]), (["a", "b"], ["ak = bk"]), (["a", "b"], ["a.d = b.k"]), (["a", "b"], ["a.k = b.k = a.x"]), (["a", "b"], ["a.k = b.k", "a.x <> b.y", "a.x <> b.k"]), (["a", "b"], ["a.k = b.k", "a.x <> a.k"]),
    ],
)
def test_bind_errors(engine, tables, joins):
    with pytest.raises(SpecError):
        engine.count(tables, joins)


def test_negative_limits(engine):
    for f in (engine.count, engine.tuples):
        with pytest.raises(SpecError):
            f(["a", "b"], ["a.k = b.k"], limit=-1)


def test_reasons_and_fallback(engine, monkeypatch):
    def said(q):
        return " ".join(engine.explain(q))

    assert "not a column" in said("SELECT CAST(d AS INT) g, count(*) n FROM a, b WHERE a.k = b.k GROUP BY CAST(d AS INT)")
    both = said("SELECT count(DISTINCT x) n, stddev(y) s FROM a, b WHERE a.k = b.k")
    assert "DISTINCT" in both and "StddevSamp" in both  # every reason, not the first
    assert "tree:" in said("SELECT count(*) n FROM a, b WHERE a.k = b.k")
    assert "expression over aggregates" not in said("SELECT count(*) + 1 n FROM a, b WHERE a.k = b.k HAVING count(*) > 0")
    monkeypatch.setattr(messages.Fold, "result", lambda self: 1 / 0)
    assert engine.sql("SELECT count(*) n FROM a, b WHERE a.k = b.k").first().n == sum((i % 5 == j % 7) for i in range(50) for j in range(40))
    assert "fell back" in " ".join(engine.last)


def test_join_keys_cast_to_fewer_values(spark):
    e = Engine(spark, mode="force")
    e.register("q", spark.createDataFrame([(x, i) for i, x in enumerate([1.0, 1.9, -1.5, -0.5, None, 7.2, 7.7, 50.0])], "d double, i int"))
    e.register("p", spark.createDataFrame([(x,) for x in [1, 1, -1, 0, 7, None, 8]], "s int"))
    for q in (
        "SELECT count(*) n FROM q, p WHERE CAST(d AS INT) = s", "SELECT s, count(*) n, sum(i) t, max(i) m FROM q, p WHERE CAST(d AS INT) = s GROUP BY s", "SELECT count(*) n FROM q x, q y WHERE CAST(x.d AS SMALLINT) = CAST(y.d AS INT)",
        "SELECT count(*) n FROM q, p WHERE CAST(d AS INT) + 1 = s AND i > 2", "SELECT EXISTS (SELECT 1 FROM q, p WHERE CAST(d AS INT) = s) e", "SELECT count(*) n FROM (SELECT 1 FROM q, p WHERE CAST(d AS INT) = s LIMIT 3)", "SELECT max(i) m FROM q, p WHERE CAST(d AS INT) = s",
    ):
        assert sorted(e.sql(q).collect(), key=str) == sorted(e.sql(q, "off").collect(), key=str)
        e.sql(q)
        assert e.fired, q
    e.register("far", spark.createDataFrame([(1.0,), (1e10,)], "d double"))
    for q in ("SELECT count(*) n FROM far, p WHERE CAST(d AS INT) = s AND d < 1e9", "SELECT count(*) n FROM far, p WHERE try_cast(d AS INT) = s"):
        assert e.sql(q).first().n == 2 and e.fired
    for mode in ("off", "force"):  # the plain join raises too
        with pytest.raises(Exception, match="CAST_OVERFLOW"):
            e.sql("SELECT count(*) n FROM far, p WHERE CAST(d AS INT) = s", mode).collect()
    e.register("two", spark.createDataFrame([(1, 5)], "s int, t int"))
    assert e.sql("SELECT count(*) n FROM far, two WHERE CAST(d AS INT) = s AND t > 9").first().n == 0 and e.fired  # the other side is empty: no key is computed
    three = "SELECT count(*) n FROM far, p, p r WHERE CAST(d AS INT) = p.s AND p.s = r.s"  # another join may drop the row first
    assert "not a column" in " ".join(e.explain(three))


def test_wide_values(spark):
    e = Engine(spark, mode="force")
    e.register("w", spark.createDataFrame([(1, "99469559132272.5965"), (1, "-0.0001"), (2, "1.0000"), (2, "2.0001")], "k int, s string").selectExpr("k", "CAST(s AS DECIMAL(20,4)) AS v"))
    e.register("m", spark.createDataFrame([(1,), (1,), (2,)], "k int"))
    for q in ("SELECT k, avg(v) a FROM (SELECT w.k, v FROM w, m WHERE w.k = m.k) GROUP BY k", "SELECT w.k, avg(v) a, sum(v) s FROM w, m WHERE w.k = m.k GROUP BY w.k"):
        assert sorted(e.sql(q).collect()) == sorted(e.sql(q, "off").collect())
        assert e.sql(q).dtypes == e.sql(q, "off").dtypes


def test_limits_and_existence(engine):
    on = "FROM a, b WHERE a.k = b.k"
    n = sum((i % 5 == j % 7) for i in range(50) for j in range(40))
    for k in (1, 3, n, n + 1, 5000):
        assert engine.sql(f"SELECT count(*) n FROM (SELECT 1 {on} LIMIT {k})").first().n == min(k, n) and engine.fired
        assert engine.count(["a", "b"], ["a.k = b.k"], limit=k).first()[0] == min(k, n)
    assert engine.sql(f"SELECT EXISTS (SELECT 1 {on} AND y > 1000) e").first().e is False and engine.fired
    assert "FileScan" not in engine.count(["a", "b"], ["a.k = b.k"], limit=0)._jdf.queryExecution().toString()


def test_gate_sees_skew_and_changed_tables(spark, tmp_path):
    hot = spark.range(30_000).select(F.when(F.col("id") < 3000, 0).otherwise(F.col("id")).alias("k"))
    even = spark.range(30_000).select(F.col("id").alias("k"))
    e = Engine(spark, mode="auto")
    for name, df in (("hot", hot), ("even", even)):
        df.write.parquet(str(tmp_path / name))
        e.register(name, spark.read.parquet(str(tmp_path / name)))
    e.sql("SELECT count(*) n FROM hot x, hot y WHERE x.k = y.k")
    assert e.fired
    e.sql("SELECT count(*) n FROM even x, even y WHERE x.k = y.k")
    assert not e.fired
    hot.write.mode("overwrite").parquet(str(tmp_path / "even"))
    e.register("even", spark.read.parquet(str(tmp_path / "even")))
    e.sql("SELECT count(*) n FROM even x, even y WHERE x.k = y.k")
    assert e.fired
    c = gate.column([1] * 50 + list(range(2, 52)), 1000)
    assert c.common == {1: 0.5} and abs(c.distinct - (51 - 50 + 50 * np.sqrt(10))) < 1e-9


def test_gate_counts_distinct_keys_beyond_the_sample(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(gate, "SAMPLE", 200)
    e = Engine(spark, mode="auto")
    for name, n, k in (("one", 50_000, 50_000), ("four", 200_000, 50_000), ("many", 200_000, 500)):
        spark.range(n).select((F.col("id") % k).alias("k")).write.parquet(str(tmp_path / name))
        e.register(name, spark.read.parquet(str(tmp_path / name)))
    e.sql("SELECT count(*) n FROM one x, four y WHERE x.k = y.k")  # 200,000 tuples of 250,000 rows
    assert not e.fired
    assert e.sql("SELECT count(*) n FROM many x, four y WHERE x.k = y.k").first().n == 500 * 400 * 4 and not e.fired  # 800,000 of 400,000
    e.sql("SELECT count(*) n FROM many x, many y WHERE x.k = y.k")
    assert e.fired


def test_large_relations_go_row_by_row(engine, monkeypatch):
    ask = lambda: sorted(map(tuple, engine.aggregate(["a", "b", "a c"], ["a.k = b.k", "b.y = c.x"], {"n": ("count",), "s": ("sum", "b.y"), "z": ("count_col", "b.z"), "p": ("sum_product", "a.x", "b.y"), "hi": ("max", "c.x")}, ["b.k", "c.k"]).collect()))
    want = ask()
    assert want
    monkeypatch.setattr(messages, "LARGE", 0)
    assert ask() == want


def test_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("k,x\n1,2\n1,\n")
    e = Engine(spark)
    e.catalog.register_files("t", str(tmp_path / "t.csv"), "csv", "k int, x int", header=True)
    assert e.count(["t", "t u"], ["t.k = u.k"]).first()[0] == 4


def test_statistics_of_columns(spark):
    df = spark.createDataFrame([(i % 3,) for i in range(10)], "k int")
    assert census(df, ["k"]).first().asDict() == {"distinct": 3, "rows": 10, "fanout_mean": 10 / 3, "fanout_max": 4}
    assert most_common(df, "k", 2).orderBy(F.desc("freq")).first().asDict() == {"value": 0, "freq": 4}
    assert spread_sample(df, 100).count() == 10 and spread_sample(df, 5).count() <= 10


def test_running_counts(spark, tmp_path):
    spark.createDataFrame([(1,), (1,), (2,), (9,)], "k long").write.parquet(str(tmp_path / "in"))
    static = spark.createDataFrame([(1,), (1,), (2,)], "k long")
    stream = spark.readStream.schema("k long").parquet(str(tmp_path / "in"))
    q = running_counts(stream, "k", static, "k").writeStream.format("memory").queryName("running").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("running").collect())) == [(1, 4), (2, 1)]

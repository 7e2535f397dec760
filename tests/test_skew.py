"""The skew-safe building blocks against brute force, with one key holding a third or more of the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cellframe.config import ALIGN_PHASES
from cellframe.functions import skew
from cellframe.functions.skew import (
    chunked_previous, chunked_running_sum, exact_mad, exact_quantiles, rank_by_hash, running_index, salted_lookup,
)
from cellframe.operators import structure
from cellframe.operators.align import interval_join, phase_offsets, phase_windows


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(1)
    n = 6000
    key = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 60, n))
    value = np.where(rng.random(n) < 0.3, 7.0, np.round(rng.normal(size=n), 3))
    pdf = pd.DataFrame({"k": key, "id": np.arange(n), "v": value})
    pdf.loc[rng.random(n) < 0.05, "v"] = np.nan
    pdf = pd.concat([pdf, pd.DataFrame({"k": [900, 901, 901], "id": [n, n + 1, n + 2], "v": [1.5, 2.0, 4.0]})])
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    return df, pdf


@pytest.mark.parametrize("limit", [1, 20, 10000])
def test_quantiles_are_exact(skewed, limit):
    df, pdf = skewed
    probs = {"a": 0.0, "b": 0.2, "c": 0.5, "d": 0.8, "e": 1.0}
    got = exact_quantiles(df, ["k"], "v", probs, limit).toPandas().set_index("k")
    for name, p in probs.items():
        want = pdf.groupby("k")["v"].quantile(p)
        pd.testing.assert_series_equal(got[name].sort_index(), want.sort_index(), check_names=False)


def test_a_hot_key_is_never_held_by_one_task(spark, skewed, monkeypatch):
    """No window meets more than the allowed values, and the counts of the hot key lie in several partitions."""
    df, pdf = skewed
    seen = []
    plain = skew._at_ranks

    def watched(values, by, ranks):
        seen.append(values.groupBy(*by).count().agg(F.max("count")).first()[0])
        return plain(values, by, ranks)

    def narrowed(counts, ks, brackets, plain=skew._narrowed):
        hot = counts.where("k = 0").groupBy(F.spark_partition_id()).count()
        assert hot.count() > 1 and hot.agg(F.sum("count")).first()[0] > 100
        return plain(counts, ks, brackets)

    monkeypatch.setattr(skew, "_at_ranks", watched)
    monkeypatch.setattr(skew, "_narrowed", narrowed)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions stay apart
    try:
        got = {r.k: (r.a, r.b) for r in exact_quantiles(df, ["k"], "v", {"a": 0.37, "b": 0.9}, 25).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(seen) <= 25
    for k, g in pdf.groupby("k")["v"]:
        assert got[k] == (pytest.approx(g.quantile(0.37)), pytest.approx(g.quantile(0.9)))


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([(1, None)], "k int, v double")
    assert exact_quantiles(empty, ["k"], "v", {"m": 0.5}).count() == 0 and exact_quantiles(empty, [], "v", {"m": 0.5}).count() == 0


def test_global_quantile_and_mad(skewed):
    df, pdf = skewed
    assert exact_quantiles(df, [], "v", {"m": 0.5}).first()["m"] == pytest.approx(pdf["v"].median())
    got = exact_mad(df, ["k"], "v", ["id"]).toPandas().set_index("k")
    for k, g in pdf.dropna().groupby("k"):
        med = g["v"].median()
        assert got.loc[k, "median"] == pytest.approx(med)
        assert got.loc[k, "mad"] == pytest.approx((g["v"] - med).abs().median())


def test_chunked_windows_match_plain_windows(skewed):
    df, _ = skewed
    c = df.withColumn("chunk", F.floor(F.col("id") / 500))
    w = Window.partitionBy("k").orderBy("id")
    want = df.select("id", F.lag("v").over(w).alias("p"), F.sum(F.lit(1)).over(w).alias("s"), F.row_number().over(w).alias("r"))
    prev = chunked_previous(c, ["k"], ["chunk"], [F.col("id")], ["v"]).select("id", F.col("prev_v").alias("p"))
    run = chunked_running_sum(c, ["k"], ["chunk"], [F.col("id")], F.lit(1), "s").select("id", "s")
    idx = running_index(c, ["k"], ["id"], ["chunk"], "r").select("id", "r")
    got = prev.join(run, "id").join(idx, "id").orderBy("id").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want.orderBy("id").collect()]


def test_salted_lookup_is_a_join(skewed):
    df, _ = skewed
    look = df.groupBy("k").agg(F.count("*").alias("n")).where("k < 30")
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = salted_lookup(df, look, ["k"], ["id"], how)
        b = df.join(look, "k", how)
        assert a.count() == b.count()
        assert sorted(map(tuple, a.select(sorted(a.columns)).na.fill(-1.0).collect())) == sorted(map(tuple, b.select(sorted(b.columns)).na.fill(-1.0).collect()))


def test_hash_rank_is_dense_and_independent_of_partitioning(skewed):
    df, _ = skewed
    one = {r["id"]: r["r"] for r in rank_by_hash(df, ["k"], F.col("id").cast("string"), "r").collect()}
    two = {r["id"]: r["r"] for r in rank_by_hash(df.repartition(7), ["k"], F.col("id").cast("string"), "r").collect()}
    assert one == two
    per_key = df.groupBy("k").count().collect()
    assert sum(r["count"] for r in per_key) == len(one)
    hot = [one[r["id"]] for r in df.where("k = 0").collect()]
    assert sorted(hot) == list(range(1, len(hot) + 1))


def test_lookups_of_repeated_rows_are_not_broadcast(spark):
    """Exploded rows look smaller to the planner than they are; neither side may go through the driver."""
    few = spark.range(100).select((F.col("id") % 10).alias("k"), "id", F.timestamp_seconds("id").alias("at"))
    rows = few.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(50))))
    spans = few.groupBy("k").agg(F.min("at").alias("a"), F.max("at").alias("b"))
    many = [salted_lookup(rows, spans, ["k"], ["id", "i"], how) for how in ("inner", "left", "left_semi", "left_anti")]
    many.append(interval_join(rows, spans, ["k"], "at", "a", "b", ["id", "i"]))
    for df in many:
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert many[-1].count() == 5000


def test_class_lookup_is_a_join(skewed):
    df, _ = skewed
    look = df.groupBy("k").agg(F.count("*").alias("n")).where("k < 30")
    for how in ("inner", "left"):
        a, b = skew.class_lookup(df, look, ["k"], how), df.join(look, "k", how)
        assert sorted(map(tuple, a.select(sorted(a.columns)).na.fill(-1.0).collect())) == sorted(map(tuple, b.select(sorted(b.columns)).na.fill(-1.0).collect()))


def test_tables_that_both_grow_are_not_broadcast(spark):
    """Files and filters look small to the planner; the joins of cycles, phases and chunks must not go through the driver."""
    phase = spark.range(60).select(
        F.lit("a").alias("file"), F.floor(F.col("id") / 3).cast("int").alias("Cycle"), F.element_at(F.array(*[F.lit(p) for p in ALIGN_PHASES]), (F.col("id") % 3 + 1).cast("int")).alias("phase"),
        F.timestamp_seconds(F.col("id") * 10).alias("Oneset_Date"), F.timestamp_seconds(F.col("id") * 10 + 5).alias("End_Date"),
    )
    record = spark.range(600).select(F.lit("a").alias("file"), F.floor(F.col("id") / 30).cast("int").alias("Cycle"), F.col("id").alias("rec_no"), F.timestamp_seconds("id").alias("record_date"))
    step = phase.select("file", "Cycle", F.lit("cc_dchg").alias("Step_Type_norm"), F.lit(1).alias("Step_Index"), F.lit(1.0).alias("Step_Number"), F.lit(3.0).alias("V_end"))
    windows = phase_windows(phase)
    chunked = running_index(record.withColumn("chunk", F.floor(F.col("rec_no") / 100)), ["file"], ["rec_no"], ["chunk"], "n")
    offsets = skew.merge_join(windows, phase_offsets(interval_join(record, windows, ["file", "Cycle"], "record_date", "onset", "phase_end", ["rec_no"])), ["file", "Cycle", "ph"])
    for df, rows in ((chunked, 600), (offsets, 60), (structure.phase_steps(step, step.select("file", "Cycle").distinct()), 60)):
        assert df.count() == rows
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan

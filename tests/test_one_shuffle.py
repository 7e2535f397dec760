"""Bounded cycles cross one shuffle from the records to the grid and its features, with the rows of the salted path."""

import datetime as dt
import random

from pyspark.sql import functions as F

from cellframe.config import GridSpec
from cellframe.operators import align, features, step_ends

T0 = dt.datetime(2024, 1, 1)
at = lambda s: None if s is None else T0 + dt.timedelta(seconds=s)


def sheets(spark, twice=False):
    """Cycles with all phases, without records in one phase, with null dates and keys, with records on both boundaries."""
    rnd = random.Random(3)
    names, spans = ["take_off", "hover", "cruise"], [(0, 8), (8, 20), (20, 33)]
    phases, rec = [], []
    for c in range(1, 9):
        for n, (a, b) in zip(names, spans):
            phases.append(("f" if c < 6 else "g", c, n, at(a), None if c == 3 and n == "hover" else at(b)))
        for i in range(20):
            s = rnd.choice([0, 8, 20, 33, rnd.uniform(-3, 40)]) if c != 4 else rnd.uniform(0, 7)
            y = [None if rnd.random() < 0.3 else rnd.uniform(2, 4) for _ in range(3)]
            rec.append(("f" if c < 6 else "g", None if i == 19 else c, c * 100 + i, None if i == 18 else at(s), *y))
    phases.append((None, 1, "hover", at(0), at(5)))
    return (
        spark.createDataFrame(rec * (1 + twice), "file string, Cycle int, rec_no long, record_date timestamp, voltage_v double, current_a double, power_w double"),
        spark.createDataFrame(phases * (1 + twice), "file string, Cycle int, phase string, Oneset_Date timestamp, End_Date timestamp"),
        spark.createDataFrame([("f", True), ("g", False)], "file string, has_power boolean"),
    )


def rows(df):
    return sorted(map(str, df.collect()))


KEEP = ["voltage_v", "current_a", "power_w"]


def test_cycles_align_as_with_salts(spark):
    for twice in (False, True):
        rec, phases, choices = sheets(spark, twice)
        asked = align.align(rec, align.placements(rec, phases, choices=choices), KEEP)
        assert align.bounded(rec) and asked.count() > 100
        assert rows(align.align_cycles(rec, phases, keep=KEEP, choices=choices)) == rows(asked)
        assert rows(align.align_cycles(rec, phases, keep=KEEP)) == rows(align.align(rec, align.placements(rec, phases), KEEP))
        assert rows(align.placements(rec, phases, choices=choices, whole=True)) == rows(align.placements(rec, phases, choices=choices))


def test_records_are_shuffled_once(spark, monkeypatch):
    """One exchange of the records and one of the phases, down to the features; the grid sorts in one direction only."""
    monkeypatch.setattr(align, "FEW_VALUES", 10)
    rec, phases, _ = sheets(spark)
    assert not align.bounded(rec)
    grid = align.full_window(align.resample(align.align_cycles(rec, phases, keep=KEEP), GridSpec(), KEEP), KEEP)
    for df in (grid, features.early_features(grid)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2 and "DESC" not in plan


def test_step_windows_need_no_salt(spark):
    rec, phases, _ = sheets(spark)
    rec = rec.select("file", "Cycle", "rec_no", F.col("record_date").alias("date"), F.col("voltage_v").alias("time_h"), F.col("current_a").alias("voltage_v"))
    picked = phases.select("file", "Cycle", F.col("phase").alias("name"), F.col("Oneset_Date").alias("onset"), F.col("End_Date").alias("end"))
    whole = step_ends.window_ends(picked, rec, True)
    assert rows(whole) == rows(step_ends.window_ends(picked, rec)) and whole.count() > 5
    good = spark.createDataFrame([("f", 1), ("f", 2), ("f", 2), (None, 3)], "file string, Cycle int")
    assert rows(step_ends.restrict(rec, good, True)) == rows(step_ends.restrict(rec, good))
    assert step_ends.window_ends(picked, rec, True)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2

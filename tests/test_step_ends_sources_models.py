"""Segmentation, sources and sinks, model data."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellframe.operators import augment, evaluate, model_data, step_ends
from cellframe.sources import labels, sheets, sinks
from cellframe.streaming import landing

REC = "file string, Cycle int, rec_no long, step_type string, date timestamp, time_h double, voltage_v double"


def test_time_resets(spark):
    base = dt.datetime(2024, 1, 1)
    t = [0, 0.1, 0.5, 0, 0.2, 0.2, 0, 0]
    rows = [("dated", 4, i, "x", base + dt.timedelta(hours=9 * i), float(x), float(i)) for i, x in enumerate(t)]
    rows += [("undated", 4, i, "x", None, float(x), float(i)) for i, x in enumerate(t)]
    seg = step_ends.segment(spark.createDataFrame(rows, REC))
    got = {f: [r["seg"] for r in seg.where(F.col("file") == f).orderBy("rec_no").collect()] for f in ("dated", "undated")}
    assert got["dated"] == [0, 0, 0, 1, 1, 1, 2, 2] and set(got["undated"]) == {0}
    ends = step_ends.segment_ends(seg).where("file = 'dated'").orderBy("seg").collect()
    assert [r["end_voltage"] for r in ends] == [2.0, 5.0, 6.0] and [r["n"] for r in ends] == [3, 3, 2]


def test_header_families_and_required_columns(spark, tmp_path):
    (tmp_path / "a").mkdir(); (tmp_path / "b").mkdir()
    (tmp_path / "a" / "one.csv").write_text("Cycle Index,Step Index,Step Type,Step Time(h),End Voltage(V)\n4,1, CC Chg ,1.5,4.3\nx,2,CC DChg,0.2,4\n")
    (tmp_path / "b" / "two.csv").write_text("END VOLTAGE(V),step_type,Step-Time(h),step index,cycle  index\nbad,CC DChg,nan,2.9,5\n")
    df = sheets.read_csv_families(spark, [str(tmp_path / "a"), str(tmp_path / "b")], sheets.parse_step)
    rows = {r["file"]: r for r in df.collect()}
    assert rows["one.csv"]["Step_Type_norm"] == "cc_chg" and rows["one.csv"]["V_end"] == 4.3
    assert rows["two.csv"]["Step_Index"] == 2 and rows["two.csv"]["V_end"] is None and rows["two.csv"]["Step_Time_h"] is None
    assert df.count() == 2
    with pytest.raises(sheets.MissingColumn):
        sheets.parse_step(spark.createDataFrame([(1,)], "`Cycle Index` int"))
    assert sheets.resolve_header(["Step Type", "step-type"], ["Step Type"]) == "step-type"


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 2, 1), ("b", 1, 2), ("a", 1, 2)], "file string, Cycle int, w int")
    for fmt in ("parquet", "csv"):
        sinks.write_table(df, str(tmp_path / fmt), fmt, by=["w"], sort=["file", "Cycle"])
        back = spark.read.option("header", "true").option("inferSchema", "true").format(fmt).load(str(tmp_path / fmt))
        assert sorted(map(tuple, back.select("file", "Cycle", "w").collect())) == [("a", 1, 2), ("a", 2, 1), ("b", 1, 2)]
    sinks.write_tables({"labels": df, "records": df}, str(tmp_path / "run"), by=["file"])
    assert spark.read.parquet(str(tmp_path / "run" / "labels")).count() == 3
    sinks.write_feature_list(spark, ["b", "a"], str(tmp_path / "names"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "names")).collect()] == ["b", "a"]
    sinks.write_split_info(df.select("file"), str(tmp_path / "split"), 0.3, 42)
    assert spark.read.json(str(tmp_path / "split")).columns == ["file", "random_state", "test_size"]


def test_tables_are_published_together(spark, tmp_path):
    root = str(tmp_path / "out")
    first = spark.createDataFrame([("a", 2, 1.5, None), (None, 1, None, "x,\n\"y\""), ("", 1, -0.25, "")], "file string, Cycle int, `v.x` double, label string")
    second = first.limit(0)
    with pytest.raises(FileNotFoundError):
        sinks.published(spark, root)
    assert sinks.publish(spark, {"cells": first, "none": second}, root, "one", by=["Cycle"]) == 1
    assert sinks.publish(spark, {"cells": second}, root, "one") == 1  # a retried run leaves what is there
    back = sinks.published(spark, root)
    assert back["cells"].schema == first.schema and sorted(back["cells"].collect(), key=str) == sorted(first.collect(), key=str)
    assert back["none"].count() == 0

    sinks.write_table(second, f"{root}/cells/two")  # a run that broke off before its manifest
    assert sinks.published(spark, root)["cells"].count() == 3
    assert sinks.publish(spark, {"cells": first.where("Cycle = 2"), "none": first}, root, "two", fmt={"cells": "json"}) == 2
    assert sinks.published(spark, root)["cells"].collect() == first.where("Cycle = 2").collect()
    assert sinks.published(spark, root, 1)["cells"].count() == 3
    assert sinks.versions(spark, root) == [1, 2]
    assert sorted(sinks.prune(spark, root)) == ["cells/one", "manifest-000000001", "none/one"]
    assert sinks.versions(spark, root) == [2] and sinks.published(spark, root)["none"].count() == 3
    assert sinks.prune(spark, root) == []


def test_csv_tables_come_back_as_written(spark, tmp_path):
    rows = spark.createDataFrame([("a", 2, 1.5, "p"), ("b", None, None, "q"), ("c, \"d\"", 1, -0.25, "p")], "file string, Cycle int, v double, side string")
    sinks.publish(spark, {"t": rows}, str(tmp_path / "csv"), "r", fmt="csv", by=["side"])
    assert sorted(sinks.published(spark, str(tmp_path / "csv"))["t"].collect(), key=str) == sorted(rows.collect(), key=str)


def test_landing_takes_each_file_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "one.csv").write_text("Cycle Index,Step Index,Step Type,Step Time(h)\n4,1,CC Chg,1.5\n")
    schema = "`Cycle Index` string, `Step Index` string, `Step Type` string, `Step Time(h)` string"
    from pyspark.sql.types import _parse_datatype_string

    run = lambda: landing.land(spark, str(src), _parse_datatype_string(schema), sheets.parse_step, str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    run()
    (src / "two.csv").write_text("Cycle Index,Step Index,Step Type,Step Time(h)\n5,1,CC Chg,1.5\n")
    run()
    assert sorted((r["file"], r["Cycle"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("one.csv", 4), ("two.csv", 5)]


def test_label_layouts(spark):
    assert labels.is_label_sheet(["Cycle", "Cycle Label 3Name"]) and not labels.is_label_sheet(["Cycle", "x"])
    t = spark.createDataFrame([("x_good_labeled_3class.xlsx", "4", "1"), ("x_good_labeled_3class.xlsx", "4", "1"), ("x_good_labeled_3class.xlsx", "q", "2")], "file string, cycle string, label string")
    assert [tuple(r) for r in labels.consolidate([t]).collect()] == [("x.xlsx", 4, "good_no_drone")]


def test_clean_labels(spark):
    df = spark.createDataFrame([("f", "4", " Good_Drone "), ("f", "5", "0"), ("f", "6", "good_no_drone"), ("f", "7", None), ("f", "x", "bad")], "file string, Cycle string, cycle_label_3name string")
    rows = lambda **k: sorted((r["Cycle"], r["cycle_label_3name"]) for r in model_data.clean_labels(df, **k).collect())
    assert rows() == [(4, "GOOD_drone"), (5, "BAD")]
    assert rows(aliases={"good_no_drone": "GOOD_not_drone"}) == [(4, "GOOD_drone"), (5, "BAD"), (6, "GOOD_not_drone")]


def test_group_split(spark):
    df = spark.createDataFrame([(f"f{i % 10}", i) for i in range(50)], "file string, Cycle int")
    s = model_data.group_split(df)
    sides = {r["file"]: r["is_test"] for r in s.collect()}
    assert sum(sides.values()) == 3 and len(sides) == 10
    assert sides == {r["file"]: r["is_test"] for r in model_data.group_split(df.repartition(3).where("Cycle >= 10")).collect()}
    a, b = model_data.split_rows(df, s, True), model_data.split_rows(df, s, False)
    assert a.count() + b.count() == 50 and a.join(b, "file").count() == 0


def test_scores_by_hand(spark):
    pairs = [("BAD", "BAD"), ("BAD", "GOOD_drone"), ("GOOD_drone", "GOOD_drone"), ("GOOD_not_drone", "BAD")]
    p = spark.createDataFrame(pairs, "y_true string, y_pred string")
    s = evaluate.scores(p).first()
    assert s["accuracy"] == 0.5 and s["macro_f1"] == pytest.approx((0.5 + 2 / 3 + 0) / 3) and s["weighted_f1"] == pytest.approx((2 * 0.5 + 2 / 3) / 4)
    assert [tuple(r) for r in evaluate.confusion(p).orderBy("position").select("BAD", "GOOD_drone", "GOOD_not_drone").collect()] == [(1, 1, 0), (0, 1, 0), (1, 0, 0)]


def test_synthetic_rows(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"file": [f"f{i}" for i in range(300)], "Cycle": range(300), "cycle_label_3name": ["BAD"] * 200 + ["GOOD_drone"] * 100, "a": rng.normal(size=300), "flag": [0.0, 1.0] * 150})
    df = spark.createDataFrame(pdf)
    syn = augment.synthesise(df, ["a", "flag"], 1.5)
    out = syn.toPandas()
    assert out["cycle_label_3name"].value_counts().to_dict() == {"BAD": 300, "GOOD_drone": 150}
    assert set(out["flag"]) == {0.0, 1.0}
    assert not set(np.round(out["a"], 9)) <= set(np.round(pdf["a"], 9))
    assert abs(out["a"].std() - pdf["a"].std()) < 0.2
    again = augment.synthesise(df.repartition(5), ["a", "flag"], 1.5).toPandas()
    key = ["cycle_label_3name", "draw"]
    pd.testing.assert_frame_equal(out.sort_values(key).reset_index(drop=True), again.sort_values(key).reset_index(drop=True))

"""Alignment, interpolation and early features against NumPy."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellframe.config import LEGACY17, WINDOWS, GridSpec
from cellframe.operators import align, features


def brute(x, y, t):
    ok = ~np.isnan(y)
    x, y = x[ok], y[ok]
    out = np.full(len(t), np.nan)
    if len(x) == 0:
        return out
    order = np.argsort(x, kind="stable")
    ux, first = np.unique(x[order], return_index=True)
    uy = y[order][first]
    if len(ux) == 1:
        out[np.isclose(t, ux[0])] = uy[0]
        return out
    inside = (t >= ux[0]) & (t <= ux[-1])
    out[inside] = np.interp(t[inside], ux, uy)
    return out


@pytest.mark.parametrize("grid", [GridSpec(10, 1), GridSpec(10, 3)])
def test_interpolation_matches_numpy(spark, grid):
    rng = np.random.default_rng(3)
    frames = []
    for c in range(40):
        n = 1 if c < 4 else rng.integers(2, 60)
        x = np.sort(np.round(rng.random(n) * 14, 2 if c % 2 else 0)) + (0 if c % 3 else 1)
        if c == 0:
            x = np.array([3.00001])
        if c == 1:
            x = np.array([3.1])
        y = rng.normal(size=n)
        y[rng.random(n) < 0.2] = np.nan
        frames.append(pd.DataFrame({"file": "f", "Cycle": c, "ph": 1, "rec_no": np.arange(n), "x": x, "v": y}))
    pdf = pd.concat(frames)
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).repartition(5)
    got = align.resample(df, grid, ["v"]).toPandas()
    t = np.arange(0, grid.max_sec + grid.dt_sec, grid.dt_sec).astype(float)
    for c, g in pdf.groupby("Cycle"):
        mine = got[got.Cycle == c].sort_values("t_sec")
        assert list(mine.t_sec) == list(t)
        np.testing.assert_allclose(mine["v"].astype(float).to_numpy(), brute(g.x.to_numpy(), g.v.to_numpy(), t), rtol=1e-12, atol=1e-12)


def test_boundary_record_counts_in_both_phases(spark):
    base = dt.datetime(2024, 1, 1)
    at = lambda s: base + dt.timedelta(seconds=s)
    phases = spark.createDataFrame(
        [("f", 4, "take_off", at(0), at(2)), ("f", 4, "hover", at(2), at(4)), ("f", 4, "cruise", at(4), at(6)), ("f", 5, "take_off", at(0), at(9))],
        "file string, Cycle int, phase string, Oneset_Date timestamp, End_Date timestamp",
    )
    rec = spark.createDataFrame([("f", c, i, at(i), float(i)) for c in (4, 5) for i in range(7)], "file string, Cycle int, rec_no long, record_date timestamp, v double")
    rows = align.align(rec, align.placements(rec, phases), ["v"]).orderBy("ph", "rec_no").collect()
    assert [(r["Cycle"], r["ph"], r["rec_no"], r["x"]) for r in rows] == [
        (4, 1, 0, 0.0), (4, 1, 1, 1.0), (4, 1, 2, 2.0), (4, 2, 2, 2.0), (4, 2, 3, 3.0), (4, 2, 4, 4.0), (4, 3, 4, 4.0), (4, 3, 5, 5.0), (4, 3, 6, 6.0)
    ]


@pytest.fixture(scope="module")
def grid_rows(spark):
    rng = np.random.default_rng(5)
    n = 61
    pdf = pd.concat([
        pd.DataFrame({"file": "f", "Cycle": c, "idx": np.arange(n), "t_sec": np.arange(n), **{s: rng.normal(size=n) for s in ("voltage_v", "current_a", "power_w", "energy_wh", "dchg_cap", "dchg_spec")}})
        for c in (1, 2)
    ])
    pdf.loc[pdf.Cycle == 2, "voltage_v"] = np.nan
    df = spark.createDataFrame(pdf)
    return df.withColumn("voltage_v", F.when(~F.isnan("voltage_v"), F.col("voltage_v"))), pdf


def test_early_features_by_hand(grid_rows):
    df, pdf = grid_rows
    got = features.early_features(df).toPandas().set_index(["Cycle", "w"])
    one = pdf[pdf.Cycle == 1]
    for w in WINDOWS:
        v, i, p = (one[c].to_numpy()[: w + 1] for c in ("voltage_v", "current_a", "power_w"))
        r = got.loc[(1, w)]
        dv = np.diff(v)
        want = {
            "V_mean": v.mean(), "V_std": v.std(), "V_sag": v[0] - v.min(), "dvdt_std": dv.std(), "V_end": v[-1], "V_min_idx": v.argmin(), "I_abs_mean": np.abs(i).mean(),
            "energy_ws": p[:-1].sum(), "IR_early": (v[0] - v[-1]) / (np.abs(i).mean() + 1e-8), "V_drop_2s": v[0] - v[min(2, w)], "V_slope_global": (v[-1] - v[0]) / w,
            "traj_V_rel_area": (v[:-1] - v[0]).sum(), "power_cv": p.std() / (abs(p.mean()) + 1e-8),
        }
        if w >= 2:
            want["d2vdt2_mean"] = np.diff(dv).mean()
            blocks = np.lib.stride_tricks.sliding_window_view(v, 3)
            want["V_roll3_drop_max"] = (blocks[:, 0] - blocks.min(axis=1)).max()
            want["traj_V_roll3_drop_max"] = want["V_roll3_drop_max"]
        else:
            want["traj_V_roll3_drop_max"] = 0.0
        for k, x in want.items():
            assert r[k] == pytest.approx(x, abs=1e-9), (w, k)


def test_all_null_voltage_gives_nulls_zero_flags_and_an_issue(grid_rows):
    df, _ = grid_rows
    f = features.early_features(df, [5])
    r = f.where("Cycle = 2").first()
    assert r["V_mean"] is None and r["voltage_collapse_flag"] == 0 and r["IR_high_flag"] == 0
    assert [x["Cycle"] for x in features.null_voltage_issues(f).collect()] == [2]


def test_window_does_not_depend_on_the_other_windows(grid_rows):
    df, _ = grid_rows
    a = features.early_features(df).where("w = 10").orderBy("Cycle").collect()
    b = features.early_features(df.where("t_sec <= 10"), [10]).orderBy("Cycle").collect()
    assert a == b
    with pytest.raises(ValueError):
        features.early_features(df, [0])


def test_stored_feature_counts(grid_rows):
    df, _ = grid_rows
    wide = features.widen(features.early_features(df), [n for n in LEGACY17 if n != "missing"])
    cols = features.add_growth(wide).columns
    assert [len(features.stored_columns(cols, w)) for w in WINDOWS] == [80, 97, 114, 131, 148, 165, 182, 199]
    assert [len(features.trainer_columns(cols, w)) for w in (1, 5, 10, 60)] == [13, 53, 80, 167]


def test_feature_set_grammar():
    sets = features.feature_sets(["early1_a", "early2_a", "early2_flag", "early1_energy_ws", "base", "early1_bin"], {"early1_bin"})
    assert sets["full"] == ["base", "early1_a", "early2_a"] and sets["early2_only"] == ["early2_a"] and sets["early1_plus_base"] == ["base", "early1_a"]
    names = list(sets)
    assert features.select_feature_sets("all", names)[0] == names
    assert features.select_feature_sets("early:1-2, full", names)[0] == ["full", "early1_only", "early2_only"]
    assert features.select_feature_sets("early:1,2", names) == (["early1_only"], ["2"])
    with pytest.raises(ValueError):
        features.select_feature_sets("nothing", names)


def test_wide_round_trip(grid_rows):
    df, _ = grid_rows
    wide = align.to_wide(df, features=["voltage_v", "power_w"])
    assert len(wide.columns) == 2 + 2 * 61 and wide.columns[2:4] == ["voltage_v_t0", "power_w_t0"]
    back = align.from_wide(wide, ["voltage_v", "power_w"])
    assert back.exceptAll(df.select("file", "Cycle", "idx", "t_sec", "voltage_v", "power_w")).count() == 0

"""Structure checks and rules on hand-made steps."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cellframe.functions import metrics, text
from cellframe.operators import master, rules, structure
from cellframe.plans import fleet as sheet_plans
from cellframe.sources import sheets

STEP = "file string, `Cycle Index` int, `Step Index` int, `Step Type` string, `Step Time(h)` double, `End Voltage(V)` double, `Chg. Cap.(Ah)` double, `DChg. Cap.(Ah)` double, `DChg. Spec. Cap.(mAh/g)` double, `Energy(Wh)` double"


def cycle(file, c, n_dchg=5, n_chg=1):
    rows = [(file, c, i + 1, "CC Chg", 1.5, 4.3, 2.0, None, None, 8.0) for i in range(n_chg)]
    return rows + [(file, c, n_chg + i + 1, "CC DChg", 0.25, 4.0 - 0.2 * i, None, 0.4, 30.0 * (i + 1), 1.5) for i in range(n_dchg)]


@pytest.fixture(scope="module")
def fleet(spark):
    rows = []
    for c in range(3, 8):
        rows += cycle("ok", c)
        rows += cycle("lt5", c, n_dchg=4 if c in (5, 6) else 5)
        rows += cycle("extra", c, n_chg=2 if c == 4 else 1, n_dchg=6 if c == 5 else 5)
        rows += cycle("dup", c)
        rows += cycle("last_short", c, n_dchg=3 if c == 7 else 5)
    rows += cycle("young", 3) + cycle("single", 4)
    step = sheets.parse_step(spark.createDataFrame(rows, STEP))
    sheet = sheets.parse_cycle(spark.createDataFrame(
        [("dup", 4, 2.0, 1.9), ("dup", 4, 2.0, 1.9), ("ok", 5, 2.0, None)], "file string, `Cycle Index` int, `Chg. Cap.(Ah)` double, `DChg. Cap.(Ah)` double"
    ))
    return step, sheet


def test_master_and_issues(fleet):
    m, i = master.build_master(*fleet)
    kept = {(r["file"], r["Cycle"]) for r in m.collect()}
    assert kept == {("ok", 4), ("ok", 5), ("ok", 6), ("extra", 6), ("last_short", 4), ("last_short", 5), ("last_short", 6)}
    issues = {(r["file"], r["Cycle"], r["reason"]) for r in i.collect()}
    assert issues == {
        ("lt5", 5, "skip_file_cycle_has_lt5_dchg:4"), ("extra", 4, "skip_cycle_charge_count_2"), ("extra", 5, "skip_cycle_dchg_count_6"),
        ("dup", None, "read_error:duplicate_cycle"), ("young", None, "no_cycles_after_start"), ("single", None, "all_cycles_removed_after_skip_last"),
    }


def test_cycle_sheet_wins_even_with_nulls(fleet):
    rows = {(r["file"], r["Cycle"]): r for r in master.build_master(*fleet)[0].collect()}
    listed, derived = rows[("ok", 5)], rows[("ok", 4)]
    assert listed["DChg_Cap_Ah"] is None and listed["HF_MISSING"] and listed["Label"] == "BAD" and listed["Missing_Count"] == 4
    assert derived["DChg_Cap_Ah"] == pytest.approx(2.0) and derived["DChg_Spec_mAhg"] == 150.0 and derived["CE"] == pytest.approx(1.0)
    assert derived["standby_t_end_h"] == pytest.approx(1.25) and derived["landing_V_rel_global"] == pytest.approx(3.4 / 4.3)


def test_rule_edges(spark):
    base = dict(Chg_Spec_mAhg=150.0, DChg_Spec_mAhg=150.0, Chg_Cap_Ah=2.0, DChg_Cap_Ah=2.0, Chg_Energy_Wh=8.0, DChg_Energy_Wh=7.0, CE=1.0, IR_proxy=0.1,
                charge_V_end=4.28, standby_V_end=2.73, landing_V_rel_global=0.52)
    cases = {
        "plain": {}, "ce_low_edge": {"CE": 0.95}, "ce_093": {"CE": 0.93}, "ce_108": {"CE": 1.08}, "ir_edge": {"IR_proxy": 0.385}, "ir_over": {"IR_proxy": 0.39},
        "at_70": {"IR_proxy": 0.5, "CE": 0.945}, "below_70": {"IR_proxy": 0.5, "CE": 0.93}, "hard": {"Chg_Spec_mAhg": 190.5}, "spec_edge": {"Chg_Spec_mAhg": 190.0}, "missing": {"DChg_Energy_Wh": None},
        "not_ready": {"standby_V_end": 2.7},
    }
    rows = [(n, *[{**base, **c}[k] for k in base]) for n, c in cases.items()]
    df = spark.createDataFrame(rows, "name string, " + ", ".join(f"{k} double" for k in base))
    got = {r["name"]: r for r in rules.three_class(rules.two_class(df)).collect()}
    score = {n: r["soft_score"] for n, r in got.items()}
    assert score["plain"] == 100 and score["ce_low_edge"] == 100 and score["ir_edge"] == 100 and score["ir_over"] == 80
    assert score["ce_093"] == 88 and score["ce_108"] == 90 - 2 * int((1.08 - 1.05) / 0.01)
    assert score["at_70"] == 70 and got["at_70"]["Label"] == "GOOD" and got["below_70"]["Label"] == "BAD"
    assert got["hard"]["hard_fail"] and not got["spec_edge"]["hard_fail"] and got["missing"]["HF_MISSING"]
    assert got["plain"]["cycle_label_3name"] == "GOOD_drone" and got["plain"]["cycle_label_3class"] == 2
    assert got["not_ready"]["cycle_label_3name"] == "GOOD_not_drone" and got["hard"]["cycle_label_3class"] == 0


def test_text_and_metrics(spark):
    df = spark.createDataFrame([(" CC-Chg  (x)", "a.b_labeled_3class.xlsx"), ("DChg. Cap.(Ah)", ".hidden")], "t string, f string")
    assert [r[0] for r in df.select(text.norm_text(F.col("t"))).collect()] == ["cc_chg_x", "dchg._cap.ah"]
    assert [r[0] for r in df.select(text.file_stem(F.col("f"))).collect()] == ["a.b", ".hidden"]
    z = spark.range(1).select(metrics.ratio(F.lit(1.0), F.lit(0.0)).alias("r"), metrics.total(F.lit(1.0), F.lit(None).cast("double")).alias("t")).first()
    assert z["r"] is None and z["t"] is None


def test_no_rows_leave_unexplained(fleet):
    step, sheet = fleet
    m, i = master.build_master(step, sheet)
    candidates = structure.drop_formation_and_last(structure.step_counts(step).select("file", "Cycle"))
    whole = [r["file"] for r in i.where("reason like 'skip_file%' or reason like 'read_error%'").collect()]
    rest = candidates.where(~F.col("file").isin(whole)).join(i, ["file", "Cycle"], "left_anti").join(m, ["file", "Cycle"], "left_anti")
    assert rest.count() == 0


def test_norm_text_is_that_of_the_patterns(spark):
    rng = random.Random(1)
    letters = "aZ9_. -<>\t\n#\u00e9\u0130\u00df\U0001f600\0$\\AbC__--  "
    rows = [("".join(rng.choice(letters) for _ in range(rng.randrange(14))),) for _ in range(3000)] + [(None,), ("",), ("__-- __",)]
    s = F.col("s")
    kept = F.regexp_replace(F.translate(F.lower(F.trim(s)), "- ", "__"), "[^a-z0-9_.]+", "")
    df = spark.createDataFrame(rows, "s string").select(text.norm_text(s).alias("got"), F.regexp_replace(kept, "_+", "_").alias("want"))
    assert df.where(~F.col("got").eqNullSafe(F.col("want"))).count() == 0


def test_step_scans_are_short_enough_to_be_compiled(spark, tmp_path, capsys):
    """The JVM leaves methods over 8,000 bytes uncompiled, which made the step scan several times slower."""
    orders = spark.range(40).select((F.col("id") % 4).alias("o_custkey"), F.col("id").alias("o_orderkey"), F.to_date(F.lit("2020-01-01")).alias("o_orderdate"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    sheet = sheet_plans.step(spark, str(tmp_path))
    named = structure.phase_steps(sheet, structure.valid_cycles(structure.audit(structure.step_counts(sheet))))
    for df in (named.select("file", "Cycle", "phase", "Oneset_Date", "End_Date"), master.phase_pivot(sheet)):
        spark.conf.set("spark.sql.adaptive.enabled", "false")  # an adaptive plan shows no code before it has run
        try:
            df.explain("codegen")
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
        assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out))) <= 8000

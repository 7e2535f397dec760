"""Raw sheets to one labelled row per valid cycle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.config import PHASES, MasterRules
from cellframe.functions import metrics
from cellframe.functions.skew import merge_join, salted_lookup
from cellframe.operators import rules, structure

PHASE_FIELDS = {  # suffix -> step column
    "step_index": "Step_Index", "t_h": "Step_Time_h", "V_start": "V_start", "V_end": "V_end",
    "DChg_Cap_Ah": "DChg_Cap_Ah", "DChg_Spec_mAhg": "DChg_Spec_mAhg", "Energy_Wh": "Energy_Wh",
}
CHARGE_FIELDS = {
    "charge_step_index": "Step_Index", "charge_t_h": "Step_Time_h", "charge_V_start": "V_start",
    "charge_V_end": "V_end", "Chg_Cap_Ah_step": "Chg_Cap_Ah", "Chg_Spec_mAhg_step": "Chg_Spec_mAhg",
    "Chg_Energy_Wh_step": "Energy_Wh",
}
# Leading columns of the stored master, in order.
PREFERRED = [
    "file", "Cycle", "Chg_Spec_mAhg", "DChg_Spec_mAhg", "Chg_Cap_Ah", "DChg_Cap_Ah", "Chg_Energy_Wh",
    "DChg_Energy_Wh", "CE", "IR_proxy", "HF_CHG_SPEC_HIGH", "HF_DCHG_SPEC_LOW", "HF_MISSING", "hard_fail",
    "soft_score", "SP_IR_OUTLIER", "SP_CE_SOFT", "IR_proxy_threshold", "Label", "charge_V_end",
    "take_off_V_end", "hover_V_end", "cruise_V_end", "landing_V_end", "standby_V_end", "standby_t_end_h",
    "landing_V_rel_global", "cycle_label_3class", "cycle_label_3name", "battery_label_3class",
    "battery_label_3name", "Missing_Count", "CE_dev_abs",
]


def phase_pivot(step: DataFrame, exact: bool = False) -> DataFrame:
    """A2, A3, A4: one row per cycle from its numbered steps.

    Totals ignore nulls and are null when every part is null; the last
    specific capacity is the last non-null one in step order.  ``exact`` takes
    one shuffle, and its rows hold for cycles of the exact structure only.
    """
    numbered = structure.number_exact_steps(step) if exact else structure.number_steps(step)
    dchg = F.col("kind") == "dchg"
    aggs = [F.max(F.when(~dchg & (F.col("n") == 1), F.col(src))).alias(out) for out, src in CHARGE_FIELDS.items()]
    for i, phase in enumerate(PHASES, start=1):
        at = dchg & (F.col("n") == i)
        aggs += [F.max(F.when(at, F.col(src))).alias(f"{phase}_{out}") for out, src in PHASE_FIELDS.items()]
    spec_at = F.when(dchg & F.col("DChg_Spec_mAhg").isNotNull(), F.col("n"))
    aggs += [
        F.sum(F.when(dchg, F.col("DChg_Cap_Ah"))).alias("DChg_Cap_Ah_step_total"),
        F.max_by("DChg_Spec_mAhg", spec_at).alias("DChg_Spec_mAhg_step_last"),
        F.sum(F.when(dchg, F.col("Energy_Wh"))).alias("DChg_Energy_Wh_step_total"),
    ]
    return numbered.groupBy("file", "Cycle").agg(*aggs)


def cycle_totals(rows: DataFrame, cycle_sheet: DataFrame) -> DataFrame:
    """Cycle-sheet totals where the cycle is listed there, step totals elsewhere."""
    sheet = cycle_sheet.withColumn("_listed", F.lit(True))
    j = merge_join(rows, sheet, ["file", "Cycle"], "left")
    listed = F.col("_listed").isNotNull()
    derived = {
        "Chg_Cap_Ah": "Chg_Cap_Ah_step", "Chg_Spec_mAhg": "Chg_Spec_mAhg_step",
        "DChg_Cap_Ah": "DChg_Cap_Ah_step_total", "DChg_Spec_mAhg": "DChg_Spec_mAhg_step_last",
        "Chg_Energy_Wh": "Chg_Energy_Wh_step", "DChg_Energy_Wh": "DChg_Energy_Wh_step_total",
    }
    totals = {k: metrics.sheet_value(listed, F.col(f"{k}_cycle"), F.col(v)) for k, v in derived.items()}
    return j.withColumns(totals).drop("_listed", *[f"{k}_cycle" for k in derived])


def cycle_metrics(rows: DataFrame) -> DataFrame:
    """P11, P13, P16, P17 on the totals and the phase columns."""
    c = F.col
    return rows.withColumns({
        "CE": metrics.ratio(c("DChg_Cap_Ah"), c("Chg_Cap_Ah")),
        "IR_proxy": metrics.ir_proxy(c("Chg_Energy_Wh"), c("Chg_Cap_Ah"), c("DChg_Energy_Wh"), c("DChg_Cap_Ah")),
        "standby_t_end_h": metrics.total(*[c(f"{p}_t_h") for p in PHASES]),
        "landing_V_rel_global": metrics.landing_relative(c("landing_V_end"), c("charge_V_end")),
    })


def ordered(df: DataFrame, preferred: list[str] = PREFERRED) -> DataFrame:
    """Preferred columns first, the others after them."""
    lead = [c for c in preferred if c in df.columns]
    return df.select(*lead, *[c for c in df.columns if c not in lead])


def build_master(step: DataFrame, cycle_sheet: DataFrame, files: DataFrame | None = None, cfg: MasterRules = MasterRules()) -> tuple[DataFrame, DataFrame]:
    """(master, issues) for the whole fleet in one lazy plan each."""
    counts = structure.step_counts(step)
    audited = structure.audit(counts, cfg.start_cycle, cfg.skip_last_cycle)
    unreadable = structure.duplicate_cycle_files(cycle_sheet).withColumn("reason", F.lit("read_error:duplicate_cycle"))
    valid = structure.valid_cycles(audited)
    readable = salted_lookup(valid, unreadable.select("file"), ["file"], ["Cycle"], how="left_anti")
    rows = merge_join(phase_pivot(step, exact=True), readable, ["file", "Cycle"], "left_semi")
    labelled = rules.three_class(rules.two_class(cycle_metrics(cycle_totals(rows, cycle_sheet)), cfg), cfg)
    labelled = labelled.withColumns({
        "battery_label_3class": F.lit(None).cast("int"), "battery_label_3name": F.lit(None).cast("string"),
    })
    known = step.select("file").distinct() if files is None else files
    issues = structure.file_issues(known, unreadable, counts, audited, cfg.start_cycle, cfg.skip_last_cycle).unionByName(
        structure.cycle_issues(audited, unreadable)
    )
    return ordered(labelled), issues

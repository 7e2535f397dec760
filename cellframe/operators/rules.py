"""Cycle labelling rules as column algebra."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellframe.config import CLASS_CODES, CycleSheetRules, MasterRules
from cellframe.functions import metrics


def yes(c: Column) -> Column:
    """A comparison with a missing value does not hold."""
    return F.coalesce(c, F.lit(False))


def two_class(df: DataFrame, cfg: MasterRules = MasterRules()) -> DataFrame:
    """Hard limits, soft score, GOOD or BAD.  The score drops even after a hard failure."""
    ce = F.col("CE")
    low, high = F.lit(cfg.ce_soft_low), F.lit(cfg.ce_soft_high)
    missing = metrics.missing_count(*[F.col(c) for c in ["Chg_Cap_Ah", "DChg_Cap_Ah", "Chg_Energy_Wh", "DChg_Energy_Wh", "CE"]])
    out = df.withColumns({
        "HF_CHG_SPEC_HIGH": yes(F.col("Chg_Spec_mAhg") > cfg.chg_spec_max),
        "HF_DCHG_SPEC_LOW": yes(F.col("DChg_Spec_mAhg") < cfg.dchg_spec_min),
        "HF_MISSING": missing > 0,
        "SP_IR_OUTLIER": yes(F.col("IR_proxy") > cfg.ir_soft_max),
        "SP_CE_SOFT": yes((ce < low) | (ce > high)),
        "IR_proxy_threshold": F.lit(cfg.ir_soft_max),
        "Missing_Count": missing,
        "CE_dev_abs": metrics.ce_deviation(ce),
    })
    excess = F.when(ce < low, low - ce).otherwise(ce - high)
    steps = F.floor(excess / F.lit(cfg.ce_step)).cast("double")
    out = out.withColumn("hard_fail", F.col("HF_CHG_SPEC_HIGH") | F.col("HF_DCHG_SPEC_LOW") | F.col("HF_MISSING"))
    out = out.withColumn(
        "soft_score",
        F.lit(cfg.score_start)
        - F.when(F.col("SP_IR_OUTLIER"), F.lit(cfg.penalty_ir)).otherwise(0.0)
        - F.when(F.col("SP_CE_SOFT"), F.lit(cfg.penalty_ce) + steps * F.lit(cfg.penalty_ce_step)).otherwise(0.0),
    )
    bad = F.col("hard_fail") | (F.col("soft_score") < cfg.score_good)
    return out.withColumn("Label", F.when(bad, F.lit("BAD")).otherwise(F.lit("GOOD")))


def three_class(df: DataFrame, cfg: MasterRules = MasterRules()) -> DataFrame:
    """R2: GOOD splits by mission readiness; BAD stays BAD."""
    ready = yes(
        (F.col("IR_proxy") <= cfg.drone_ir_max)
        & (F.col("DChg_Spec_mAhg") >= cfg.drone_dchg_spec_min)
        & F.col("CE").between(cfg.drone_ce_low, cfg.drone_ce_high)
        & (F.col("charge_V_end") >= cfg.drone_charge_v_end_min)
        & (F.col("standby_V_end") >= cfg.drone_standby_v_end_min)
        & (F.col("landing_V_rel_global") >= cfg.drone_landing_rel_min)
    )
    name = F.when(F.col("Label") == "BAD", F.lit("BAD")).when(ready, F.lit("GOOD_drone")).otherwise(F.lit("GOOD_not_drone"))
    code = reduce(lambda acc, kv: acc.when(F.col("cycle_label_3name") == kv[0], F.lit(kv[1])), list(CLASS_CODES.items()), F)
    return df.withColumn("cycle_label_3name", name).withColumn("cycle_label_3class", code.cast("int"))


def label_cycle_sheet(cycles: DataFrame, cfg: CycleSheetRules = CycleSheetRules()) -> DataFrame:
    """Labels from the cycle sheet alone.

    ``cycles`` has one row per kept (file, Cycle) with the legacy canonical
    columns.  Penalties apply only without a hard failure; the resistance flag
    is set either way.
    """
    c = F.col
    base = cycles.select(
        "file", "Cycle",
        c("chg_spec_mAhg").alias("Chg_Spec_mAhg"), c("dchg_spec_mAhg").alias("DChg_Spec_mAhg"),
        c("chg_cap_ah").alias("Chg_Cap_Ah"), c("dchg_cap_ah").alias("DChg_Cap_Ah"),
        c("chg_energy_wh").alias("Chg_Energy_Wh"), c("dchg_energy_wh").alias("DChg_Energy_Wh"),
    ).withColumns({
        "CE": metrics.ratio(c("DChg_Cap_Ah"), c("Chg_Cap_Ah")),
        "IR_proxy": metrics.ir_proxy(c("Chg_Energy_Wh"), c("Chg_Cap_Ah"), c("DChg_Energy_Wh"), c("DChg_Cap_Ah")),
    })
    missing = metrics.missing_count(c("Chg_Cap_Ah"), c("DChg_Cap_Ah"), c("Chg_Energy_Wh"), c("DChg_Energy_Wh"), c("CE"))
    out = base.withColumns({
        "HF_CHG_SPEC_HIGH": yes(c("Chg_Spec_mAhg") > cfg.chg_spec_max),
        "HF_DCHG_SPEC_LOW": yes(c("DChg_Spec_mAhg") < cfg.dchg_spec_min),
        "HF_MISSING": missing > 0,
        "SP_IR_OUTLIER": yes(c("IR_proxy") > cfg.ir_max),
        "IR_proxy_threshold": F.lit(cfg.ir_max),
    }).withColumn("hard_fail", c("HF_CHG_SPEC_HIGH") | c("HF_DCHG_SPEC_LOW") | c("HF_MISSING"))
    soft = ~c("hard_fail")
    out = out.withColumn("SP_CE_SOFT", soft & yes((c("CE") < cfg.ce_soft_low) | (c("CE") > cfg.ce_soft_high)))
    out = out.withColumn(
        "soft_score",
        F.lit(cfg.score_start)
        - F.when(c("SP_IR_OUTLIER") & soft, F.lit(cfg.penalty_ir)).otherwise(0.0)
        - F.when(c("SP_CE_SOFT"), F.lit(cfg.penalty_ce)).otherwise(0.0),
    )
    bad = c("hard_fail") | (c("soft_score") < cfg.score_good)
    return out.withColumn("Label", F.when(bad, F.lit("BAD")).otherwise(F.lit("GOOD")))


def first_per_cycle(cycles: DataFrame, order: str = "src_ord") -> DataFrame:
    """Duplicate cycle rows: the first in source order wins (one aggregate, combined map-side)."""
    values = [c for c in cycles.columns if c not in ("file", "cycle_index", order)]
    return cycles.groupBy("file", F.col("cycle_index").alias("Cycle")).agg(
        F.min_by(F.struct(*values), F.col(order)).alias("_r")
    ).select("file", "Cycle", "_r.*")

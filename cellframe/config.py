"""Rule thresholds and fixed vocabularies.

Every threshold is a field of a frozen dataclass; override with
``dataclasses.replace(MasterRules(), ir_soft_max=0.4)``.  The values become
literals in the plan.
"""

from __future__ import annotations

from dataclasses import dataclass

# Names and grids that the stored tables depend on.
PHASES = ["take_off", "hover", "cruise", "landing", "standby"]
ALIGN_PHASES = ["take_off", "hover", "cruise"]
WINDOWS = [1, 2, 5, 10, 20, 30, 50, 60]
SERIES = [
    "voltage_v", "current_a", "power_w", "capacity_ah", "spec_cap",
    "chg_cap", "chg_spec", "dchg_cap", "dchg_spec", "energy_wh",
]
META = ["file", "Cycle", "Label", "cycle_label_3class", "cycle_label_3name"]
CLASSES = ["BAD", "GOOD_drone", "GOOD_not_drone"]  # alphabetical = trainer code order
CLASS_CODES = {"BAD": 0, "GOOD_not_drone": 1, "GOOD_drone": 2}  # stored label codes
GROWTH_PAIRS = [(1, 2), (2, 5), (5, 10), (10, 20), (20, 30), (30, 50), (50, 60), (1, 10), (1, 30)]
GROWTH_FEATURES = ["IR_early", "V_sag", "V_sag_ratio", "dvdt_std", "power_std", "energy_ws", "energy_per_I"]
LEGACY17 = [
    "IR_early", "IR_high_flag", "I_mean", "I_std", "V_mean", "V_min", "V_sag", "V_sag_ratio",
    "dvdt_fluct_flag", "dvdt_mean", "dvdt_std", "energy_per_I", "energy_ws", "missing",
    "power_mean", "power_std", "voltage_collapse_flag",
]


@dataclass(frozen=True)
class MasterRules:
    """Two-class and three-class rules of the cycle master."""

    start_cycle: int = 4
    skip_last_cycle: bool = True
    chg_spec_max: float = 190.0
    dchg_spec_min: float = 120.0
    ce_soft_low: float = 0.95
    ce_soft_high: float = 1.05
    ir_soft_max: float = 0.385
    score_start: float = 100.0
    score_good: float = 70.0
    penalty_ce: float = 10.0
    penalty_ir: float = 20.0
    penalty_ce_step: float = 2.0
    ce_step: float = 0.01
    drone_ir_max: float = 0.442
    drone_dchg_spec_min: float = 140.0
    drone_ce_low: float = 0.97
    drone_ce_high: float = 1.03
    drone_charge_v_end_min: float = 4.28
    drone_standby_v_end_min: float = 2.73
    drone_landing_rel_min: float = 0.52


@dataclass(frozen=True)
class CycleSheetRules:
    """Fixed-threshold rules on the cycle sheet alone."""

    start_cycle: int = 4
    skip_last_cycle: bool = True
    chg_spec_max: float = 190.0
    dchg_spec_min: float = 120.0
    ce_soft_low: float = 0.95
    ce_soft_high: float = 1.05
    ir_max: float = 0.422
    score_start: float = 100.0
    score_good: float = 70.0
    penalty_ce: float = 10.0
    penalty_ir: float = 20.0


@dataclass(frozen=True)
class RecordRules:
    """Record-level rules with robust outlier scoring."""

    start_cycle: int = 4
    skip_last_cycle: bool = True
    v_end_chg_min: float = 4.25
    v_max_chg_max: float = 4.35
    v_min_dchg_min: float = 2.70
    v_end_dchg_max: float = 2.90
    discharge_h_min: float = 1.20
    discharge_h_target: float = 1.50
    ce_abs_low: float = 0.93
    ce_abs_high: float = 1.05
    charge_r2_min: float = 0.93
    ir_abs_max: float = 0.30
    min_points_chg: int = 20
    min_points_dchg: int = 20
    score_start: float = 100.0
    score_good: float = 70.0
    mad_k: float = 5.0
    penalty_ah_chg: float = 15.0
    penalty_ah_dchg: float = 20.0
    penalty_wh_dchg: float = 15.0
    penalty_time: float = 10.0
    penalty_ce: float = 10.0
    penalty_ir: float = 10.0
    penalty_slope: float = 10.0
    ce_marginal_low: float = 0.96
    ce_marginal_high: float = 1.02
    ce_well_low: float = 0.95
    ce_well_high: float = 1.03


@dataclass(frozen=True)
class EarlyRules:
    """Flag thresholds of the early-window features."""

    sag_ratio_max: float = 0.12
    ir_max: float = 0.35
    dvdt_std_max: float = 0.02


@dataclass(frozen=True)
class GridSpec:
    """Resampling grid: 0, dt, 2 dt, ... up to the first point >= max_sec."""

    max_sec: int = 60
    dt_sec: int = 1

    @property
    def last(self) -> int:
        """Index of the last grid point of ``arange(0, max + dt, dt)``."""
        return (self.max_sec + self.dt_sec - 1) // self.dt_sec

"""Cycle metric expressions (null in, null out)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """A / b, null on a null or zero denominator."""
    return F.try_divide(a, F.nullif(b, F.lit(0.0)))


def ir_proxy(wh_chg: Column, ah_chg: Column, wh_dchg: Column, ah_dchg: Column) -> Column:
    """Energy per charge in minus energy per charge out."""
    return ratio(wh_chg, ah_chg) - ratio(wh_dchg, ah_dchg)


def missing_count(*cols: Column) -> Column:
    """How many of the columns are null."""
    return reduce(lambda a, b: a + b, [c.isNull().cast("int") for c in cols])


def ce_deviation(ce: Column) -> Column:
    """Distance of the coulombic efficiency from one."""
    return F.abs(ce - F.lit(1.0))


def flag_count(columns: list[str], prefix: str) -> Column:
    """Number of true flags among the columns that carry the prefix."""
    flags = [F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in columns if c.startswith(prefix)]
    return reduce(lambda a, b: a + b, flags) if flags else F.lit(0)


def landing_relative(landing_v: Column, charge_v: Column, mode: str = "ratio") -> Column:
    """Landing end voltage relative to the charge end voltage."""
    if mode == "ratio":
        return F.try_divide(landing_v, charge_v)
    if mode == "difference":
        return landing_v - charge_v
    raise ValueError(f"mode must be 'ratio' or 'difference', not {mode!r}")


def total(*cols: Column) -> Column:
    """Sum that is null as soon as one part is null."""
    return reduce(lambda a, b: a + b, cols)


def sheet_value(matched: Column, sheet: Column, derived: Column) -> Column:
    """The cycle sheet wins whenever it has the cycle, even with a null."""
    return F.when(matched, sheet).otherwise(derived)


def sheet_or_record(sheet: Column, n_samples: Column, record_max: Column) -> Column:
    """Sheet value unless null or zero, then the record maximum if there are samples."""
    unusable = sheet.isNull() | (sheet == 0)
    return F.when(unusable & (n_samples > 0), record_max).otherwise(sheet)


def reason_text(hard: dict[str, Column], soft: dict[str, Column], end_reason: Column) -> Column:
    """Triggered flag names and the end reason, comma separated."""
    parts = [F.when(c, F.lit(n.removeprefix("HF_"))) for n, c in hard.items()]
    parts += [F.when(c, F.lit(n)) for n, c in soft.items()]
    parts.append(F.concat(F.lit("end:"), end_reason))
    return F.concat_ws(", ", *parts)

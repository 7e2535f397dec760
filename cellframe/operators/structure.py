"""Which cycles count: selection, structural checks, issue log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellframe.config import PHASES
from cellframe.functions.skew import merge_join, salted_lookup
from cellframe.functions.text import is_charge, is_discharge


def step_counts(step: DataFrame, keys: list[str] = ("file", "Cycle"), charge: Column | None = None, discharge: Column | None = None) -> DataFrame:
    """Charge and discharge steps per cycle; one row per distinct cycle.

    Both counts are the halves of one sum.  Readers of either then have the same
    shuffle under them, which Spark runs once, instead of a scan of the steps each.
    """
    n = F.col("Step_Type_norm")
    chg = is_charge(n) if charge is None else charge
    dch = is_discharge(n) if discharge is None else discharge
    one = lambda c, v: F.when(c, F.lit(v)).otherwise(F.lit(0)).cast("bigint")
    both = step.groupBy(*keys).agg(F.sum(one(chg, 1 << 32) + one(dch, 1)).alias("_both"))
    return both.select(*keys, F.shiftright("_both", 32).alias("n_chg"), F.col("_both").bitwiseAND(F.lit((1 << 32) - 1)).alias("n_dchg"))


def drop_formation_and_last(
    cycles: DataFrame, start: int = 4, skip_last: bool = True, keep_single: bool = False,
    file: str = "file", cycle: str = "Cycle",
) -> DataFrame:
    """Cycles from ``start`` on, without the last one of each file.

    ``cycles`` has one row per (file, cycle).  ``keep_single`` keeps a file's
    only remaining cycle (the label scripts), otherwise it goes too.
    """
    kept = cycles.where(F.col(cycle) >= start)
    if not skip_last:
        return kept
    last = kept.groupBy(file).agg(F.max(cycle).alias("_last"), F.count(F.lit(1)).alias("_n"))
    rule = F.col(cycle) < F.col("_last")
    if keep_single:
        rule = rule | (F.col("_n") == 1)
    return salted_lookup(kept, last, [file], [cycle], how="inner").where(rule).drop("_last", "_n")


def file_facts(counts: DataFrame, start: int, skip_last: bool) -> DataFrame:
    """One row per file: last cycle, number of candidate cycles, first cycle with too few discharge steps.

    A short cycle that is the file's last one is not a candidate, and no other
    short cycle can then exist before it, so one aggregate answers both F3 and F4.
    """
    from_start = F.col("Cycle") >= start
    facts = counts.groupBy("file").agg(
        F.count_if(from_start).alias("n_from_start"),
        F.max(F.when(from_start, F.col("Cycle"))).alias("last_cycle"),
        F.min(F.when(from_start & (F.col("n_dchg") < 5), F.col("Cycle"))).alias("_short"),
        F.min_by("n_dchg", F.when(from_start & (F.col("n_dchg") < 5), F.col("Cycle"))).alias("_short_n"),
    )
    drop = 1 if skip_last else 0
    is_candidate = (F.col("_short") < F.col("last_cycle")) if skip_last else F.col("_short").isNotNull()
    return facts.select(
        "file", "n_from_start", "last_cycle",
        (F.col("n_from_start") - drop).alias("n_candidates"),
        F.when(is_candidate, F.col("_short")).alias("short_cycle"),
        F.when(is_candidate, F.col("_short_n")).alias("short_count"),
    )


def audit(counts: DataFrame, start: int = 4, skip_last: bool = True) -> DataFrame:
    """Candidate cycles with the verdict of the structure check.

    ``rejected_file`` marks cycles of files that hold a candidate cycle with
    fewer than five discharge steps; ``reason`` is null for a valid cycle.
    """
    # Files without such a cycle have no row here, so that facts and rows can read the same counts.
    counted = counts.where(F.col("Cycle") >= start)
    facts = file_facts(counted, start, skip_last)
    rows = salted_lookup(counted, facts, ["file"], ["Cycle"], how="inner")
    if skip_last:
        rows = rows.where(F.col("Cycle") < F.col("last_cycle"))
    reason = F.when(
        F.col("n_chg") != 1, F.concat(F.lit("skip_cycle_charge_count_"), F.col("n_chg").cast("string"))
    ).when(F.col("n_dchg") != 5, F.concat(F.lit("skip_cycle_dchg_count_"), F.col("n_dchg").cast("string")))
    return rows.select(
        "file", "Cycle", "n_chg", "n_dchg", F.col("short_cycle").isNotNull().alias("rejected_file"), reason.alias("reason")
    )


def valid_cycles(audited: DataFrame) -> DataFrame:
    """(file, Cycle) that pass both checks."""
    return audited.where(~F.col("rejected_file") & F.col("reason").isNull()).select("file", "Cycle")


def duplicate_cycle_files(cycle_sheet: DataFrame) -> DataFrame:
    """Q5: a repeated cycle in the cycle sheet makes the whole file unreadable."""
    return cycle_sheet.groupBy("file", "Cycle").count().where(F.col("count") > 1).select("file").distinct()


def file_issues(files: DataFrame, unreadable: DataFrame, counts: DataFrame, audited: DataFrame, start: int = 4, skip_last: bool = True) -> DataFrame:
    """at most one file-level issue per file; the first reason that applies wins.

    ``unreadable`` has (file, reason).
    """
    facts = file_facts(counts, start, skip_last)
    valid = audited.groupBy("file").agg(F.count_if(~F.col("rejected_file") & F.col("reason").isNull()).alias("_valid"))
    j = files.select("file").distinct()
    for more in (unreadable.select("file", F.col("reason").alias("_read")), facts, valid):
        j = merge_join(j, more, ["file"], "left")
    short = F.concat(F.lit("skip_file_cycle_has_lt5_dchg:"), F.col("short_count").cast("string"))
    reason = (
        F.when(F.col("_read").isNotNull(), F.col("_read"))
        .when(F.col("n_from_start").isNull(), F.lit("empty_step_sheet"))
        .when(F.col("n_from_start") == 0, F.lit("no_cycles_after_start"))
        .when(F.col("n_candidates") <= 0, F.lit("all_cycles_removed_after_skip_last"))
        .when(F.col("short_cycle").isNotNull(), short)
        .when(F.coalesce("_valid", F.lit(0)) == 0, F.lit("no_valid_cycles_after_exact_structure_filter"))
    )
    cycle = F.when(F.col("_read").isNull() & (F.col("n_candidates") > 0), F.col("short_cycle"))
    return j.select("file", cycle.cast("int").alias("Cycle"), reason.alias("reason")).where(F.col("reason").isNotNull())


def cycle_issues(audited: DataFrame, unreadable: DataFrame) -> DataFrame:
    """one issue per cycle of a readable, not rejected file that fails the exact structure check."""
    bad = audited.where(~F.col("rejected_file") & F.col("reason").isNotNull())
    return salted_lookup(
        bad, unreadable.select("file").distinct(), ["file"], ["Cycle"], how="left_anti"
    ).select("file", "Cycle", "reason")


def _step_order() -> list[Column]:
    return [F.col("Step_Index").asc(), F.col("Step_Number").asc_nulls_last(), F.col("V_end").asc_nulls_last()]


def _with_kind(step: DataFrame) -> DataFrame:
    """Charge and discharge steps with their ``kind``."""
    n = F.col("Step_Type_norm")
    # Every charge or discharge text has "chg" in it: the short filter keeps the scan's generated code small enough to be compiled.
    return step.where(n.contains("chg")).withColumn("kind", F.when(is_discharge(n), F.lit("dchg")).otherwise(F.lit("chg")))


def number_steps(step: DataFrame, limit: int = 5) -> DataFrame:
    """First ``limit`` charge and discharge steps of each cycle, numbered by step index.

    The ``row_number <= limit`` filter becomes a group limit ahead of the
    shuffle, so a cycle with very many steps sends only a few rows per task.
    """
    w = Window.partitionBy("file", "Cycle", "kind").orderBy(*_step_order())
    return _with_kind(step).withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit)


def number_exact_steps(step: DataFrame) -> DataFrame:
    """:func:`number_steps` for cycles of the exact structure, one charge and five discharge steps.

    Discharge steps come first, so a cycle's six steps are its first six rows
    and one window by cycle numbers both kinds.  What follows by cycle needs no
    further shuffle.  Rows of other cycles mean nothing: join with the valid ones.
    """
    w = Window.partitionBy("file", "Cycle").orderBy(F.col("kind").desc(), *_step_order())
    first = _with_kind(step).withColumn("n", F.row_number().over(w)).where(F.col("n") <= len(PHASES) + 1)
    return first.withColumn("n", F.when(F.col("kind") == "dchg", F.col("n")).otherwise(F.col("n") - len(PHASES)))


def phase_steps(step: DataFrame, valid: DataFrame) -> DataFrame:
    """The five discharge steps of each valid cycle with their phase names.

    They are numbered by cycle, so that the join with the valid cycles does not shuffle them again.
    """
    w = Window.partitionBy("file", "Cycle").orderBy(*_step_order())
    named = _with_kind(step).where(F.col("kind") == "dchg").withColumn("n", F.row_number().over(w)).where(F.col("n") <= len(PHASES))
    phase = F.element_at(F.array(*[F.lit(p) for p in PHASES]), F.col("n"))
    return merge_join(named, valid, ["file", "Cycle"], "left_semi").withColumn("phase", phase).withColumn("phase_no", F.col("n"))

"""Phase alignment, resampling to the grid, wide and prefix exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellframe.config import ALIGN_PHASES, META, SERIES, WINDOWS, GridSpec
from cellframe.functions.coerce import seconds
from cellframe.functions.lineage import materialise
from cellframe.functions.skew import FEW_VALUES, SALT, merge_join, salt_of, salted_lookup, with_all_salts
from cellframe.functions.text import file_stem
from cellframe.sources.sheets import chosen_power

CYCLE = ["file", "Cycle"]


def interval_join(rows: DataFrame, intervals: DataFrame, on: list[str], at: str, start: str, end: str, salt_from: list[str] | None) -> DataFrame:
    """Rows whose ``at`` lies in [start, end] of an interval with the same keys, both ends included.

    Merge join on the keys with the range as residual predicate, never a
    broadcast (see :func:`salted_lookup`); the rows of a hot key are spread by salt.
    Without ``salt_from`` the rows of a key stay together, for keys that are bounded.
    """
    if salt_from is None:
        return merge_join(rows, intervals, on).where(F.col(at).between(F.col(start), F.col(end)))
    r = rows.withColumn(SALT, salt_of(salt_from))
    j = r.join(with_all_salts(intervals).hint("merge"), [*on, SALT])
    return j.where(F.col(at).between(F.col(start), F.col(end))).drop(SALT)


def phase_windows(phases: DataFrame, names: list[str] = ALIGN_PHASES) -> DataFrame:
    """Phases to align with their order, onset and end."""
    order = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("phase"))
    return (
        phases.where(F.col("phase").isin(names))
        .select(*CYCLE, "phase", order.cast("int").alias("ph"), F.col("Oneset_Date").alias("onset"), F.col("End_Date").alias("phase_end"))
        .where(F.col("onset").isNotNull() & F.col("phase_end").isNotNull())
    )


def phase_offsets(inside: DataFrame, n_phases: int = len(ALIGN_PHASES)) -> DataFrame:
    """First record time of each phase and the running sum of the earlier record spans.

    Cycles that miss records in any phase are left out.  The window only sees
    the one row per phase that the aggregate leaves.
    """
    spans = inside.groupBy(*CYCLE, "ph").agg(
        F.min("record_date").alias("t0"), (seconds(F.max("record_date")) - seconds(F.min("record_date"))).alias("span")
    )
    w = Window.partitionBy(*CYCLE).orderBy("ph")
    return (
        spans.withColumn("offset", F.coalesce(F.sum("span").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*CYCLE)))
        .where(F.col("_n") == n_phases)
        .select(*CYCLE, "ph", "t0", "offset")
    )


def placements(record: DataFrame, phases: DataFrame, names: list[str] = ALIGN_PHASES, choices: DataFrame | None = None, whole: bool = False) -> DataFrame:
    """Where each phase of a cycle lies on the common axis; one row per phase, written once.

    Reads only the keys and dates of the records.  ``choices`` holds the
    per-file decisions of P9, which travel with these few rows so that the
    records need no join by file.  ``whole`` cycles, which are :func:`bounded`,
    are joined without a salt, so that their spans need no other shuffle.
    """
    windows = phase_windows(phases, names)
    inside = interval_join(
        record.select(*CYCLE, "rec_no", "record_date"), windows, CYCLE, "record_date", "onset", "phase_end", None if whole else ["rec_no"]
    )
    out = merge_join(windows, phase_offsets(inside, len(names)), [*CYCLE, "ph"])
    if choices is not None:
        out = salted_lookup(out, choices.select("file", "has_power"), ["file"], ["Cycle"])
    return materialise(out)


def align(record: DataFrame, placed: DataFrame, keep: list[str] = SERIES) -> DataFrame:
    """take_off, hover and cruise records of each cycle on one time axis ``x`` (seconds).

    ``placed`` comes from :func:`placements`.  A record on a shared boundary
    appears in both phases.
    """
    rows = record.select(*CYCLE, "rec_no", "record_date", *keep)
    out = interval_join(rows, placed, CYCLE, "record_date", "onset", "phase_end", ["rec_no"])
    if "has_power" in placed.columns and "power_w" in keep:
        out = out.withColumn("power_w", chosen_power())
    x = seconds(F.col("record_date")) - seconds(F.col("t0")) + F.col("offset")
    return out.withColumn("x", x).select(*CYCLE, "phase", "ph", "rec_no", "record_date", "x", *keep)


def bounded(record: DataFrame) -> bool:
    """No cycle has more records than a window may sort (one aggregate, combined map-side)."""
    largest = record.groupBy(*CYCLE).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0]
    return largest is None or largest <= FEW_VALUES


def align_cycles(record: DataFrame, phases: DataFrame, names: list[str] = ALIGN_PHASES, keep: list[str] = SERIES, choices: DataFrame | None = None) -> DataFrame:
    """W8, W9, T1 in one pass over the records, for cycles that are :func:`bounded`: the rows of :func:`align` on :func:`placements`.

    Records and phases meet by cycle, without a salt.  The phases' first and
    last records come from windows over the joined rows, which lie in the order
    of the join already; and whatever groups by cycle afterwards needs no other
    shuffle.
    """
    windows = phase_windows(phases, names)
    if choices is not None:
        windows = salted_lookup(windows, choices.select("file", "has_power"), ["file"], ["Cycle"])
    rows = record.select(*CYCLE, "rec_no", "record_date", *keep)
    out = interval_join(rows, windows, CYCLE, "record_date", "onset", "phase_end", None)
    cycle, date = Window.partitionBy(*CYCLE), F.col("record_date")
    at = {n: F.when(F.col("ph") == n, date) for n in range(1, len(names) + 1)}
    out = out.withColumns({f"_{side}{n}": f(c).over(cycle) for n, c in at.items() for side, f in (("t", F.min), ("e", F.max))})
    complete, x, before = F.lit(True), F.lit(None).cast("double"), F.lit(0.0)
    for n in at:
        complete = complete & F.col(f"_t{n}").isNotNull()
        x = F.when(F.col("ph") == n, seconds(date) - seconds(F.col(f"_t{n}")) + before).otherwise(x)
        before = before + (seconds(F.col(f"_e{n}")) - seconds(F.col(f"_t{n}")))
    out = out.where(complete)
    if choices is not None and "power_w" in keep:
        out = out.withColumn("power_w", chosen_power())
    return out.withColumn("x", x).select(*CYCLE, "phase", "ph", "rec_no", "record_date", "x", *keep)


def resample(aligned: DataFrame, grid: GridSpec = GridSpec(), features: list[str] = SERIES) -> DataFrame:
    """Linear interpolation of every feature at 0, dt, 2 dt, ... per cycle.

    Grid point g needs only the last support at or before g*dt and the first
    one after it.  So each record falls in bin ceil(x / dt) and every bin keeps
    its first and last support per feature: one map-side combined aggregate
    that leaves at most ``last + 2`` rows per cycle, whatever its length.  The
    windows run over those rows, and each row then yields the grid points up to
    the next one.  No extrapolation; of equal times the earliest (phase,
    record) counts; a single support is used only where the grid meets it.
    """
    last, dt = grid.last, float(grid.dt_sec)
    bins = F.greatest(F.lit(0), F.least(F.lit(last + 1), F.ceil(F.col("x") / F.lit(dt)))).cast("int")
    filled = aligned.select(*CYCLE, bins.alias("bin"), "x", "ph", "rec_no", *features)
    ends = []
    for f in features:
        has, y = F.col(f).isNotNull(), F.col(f).alias("y")
        first = F.struct(F.col("x"), F.col("ph"), F.col("rec_no"), y)
        final = F.struct(F.col("x"), -F.col("ph"), -F.col("rec_no"), y)
        ends += [F.min(F.when(has, first)).alias(f"{f}_first"), F.max(F.when(has, final)).alias(f"{f}_last")]
    flat = []
    for f in features:
        flat += [F.col(f"{f}_{side}")[c].alias(f"{f}_{c}{n}") for n, side in enumerate(("first", "last")) for c in "xy"]
    per_bin = filled.groupBy(*CYCLE, "bin").agg(*ends).select(*CYCLE, "bin", *flat)
    # One order serves all: what lies behind is a frame that grows by a row at a time, the next support a lead that skips nulls.
    up = Window.partitionBy(*CYCLE).orderBy("bin")
    upto, all_ = up.rowsBetween(Window.unboundedPreceding, 0), up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = lambda c: F.expr(f"lead(`{c}`, 1) IGNORE NULLS OVER (PARTITION BY {', '.join(f'`{k}`' for k in CYCLE)} ORDER BY bin)")
    picks = {"_next": F.lead("bin").over(up), "_lead_in": F.lag("bin").over(up).isNull()}
    for f in features:
        picks[f"{f}_ax"] = F.last(f"{f}_x1", ignorenulls=True).over(upto)
        picks[f"{f}_ay"] = F.last(f"{f}_y1", ignorenulls=True).over(upto)
        picks[f"{f}_bx"], picks[f"{f}_by"] = following(f"{f}_x0"), following(f"{f}_y0")
        picks[f"{f}_min"], picks[f"{f}_max"] = F.min(f"{f}_x0").over(all_), F.max(f"{f}_x1").over(all_)
    start = F.when(F.col("_lead_in"), F.lit(0)).otherwise(F.col("bin"))
    stop = F.coalesce(F.col("_next") - 1, F.lit(last))
    placed = per_bin.withColumns(picks).where(start <= F.least(stop, F.lit(last)))
    points = placed.withColumn("idx", F.explode(F.sequence(start, F.least(stop, F.lit(last)))))
    t = F.col("idx").cast("double") * F.lit(dt)
    values = [_interpolated(f, t).alias(f) for f in features]
    return points.select(*CYCLE, "idx", (F.col("idx") * F.lit(grid.dt_sec)).cast("int").alias("t_sec"), *values)


def _interpolated(f: str, t: Column) -> Column:
    """Value at ``t`` from the support at or before it (a) and the first one after it (b).

    Points ahead of the first bin have only that bin and later ones to look at.
    Where one side has no support, the extremes of the cycle, all on the other
    side, tell whether it is a single support, which is used only where the grid
    meets it.
    """
    c = lambda s: F.col(f"{f}_{s}")
    ahead = F.col("idx") < F.col("bin")
    ax, ay = F.when(~ahead, c("ax")), c("ay")
    bx = F.when(ahead, F.coalesce(c("x0"), c("bx"))).otherwise(c("bx"))
    by = F.when(ahead, F.when(c("x0").isNotNull(), c("y0")).otherwise(c("by"))).otherwise(c("by"))
    near = lambda x: F.abs(t - x) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(x)
    return (
        F.when(ax == t, ay)
        .when(ax.isNotNull() & bx.isNotNull(), (by - ay) / (bx - ax) * (t - ax) + ay)
        .when(bx.isNull() & (ax == c("min")) & near(ax), ay)
        .when(ax.isNull() & (bx == c("max")) & near(bx), by)
    )


def full_window(grid_rows: DataFrame, features: list[str] = SERIES) -> DataFrame:
    """F8: grid rows of cycles where no feature is missing at any grid point."""
    ok = F.lit(True)
    for f in features:
        ok = ok & F.col(f).isNotNull()
    w = Window.partitionBy(*CYCLE).orderBy("t_sec").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # the order that the features need
    return grid_rows.withColumn("_ok", F.min(ok).over(w)).where("_ok").drop("_ok")


def with_meta(grid_rows: DataFrame, master: DataFrame) -> DataFrame:
    """Label columns of the master on every grid row."""
    return merge_join(grid_rows, master.select(*META), CYCLE)


def to_wide(grid_rows: DataFrame, grid: GridSpec = GridSpec(), features: list[str] = SERIES, keys: list[str] = CYCLE) -> DataFrame:
    """One ``{feature}_t{t}`` column per feature and grid point, by time then feature."""
    ts = [i * grid.dt_sec for i in range(grid.last + 1)]
    p = grid_rows.groupBy(*keys).pivot("t_sec", ts).agg(*[F.first(f).alias(f) for f in features])
    if len(features) == 1:
        return p.select(*keys, *[F.col(str(t)).alias(f"{features[0]}_t{t}") for t in ts])
    return p.select(*keys, *[F.col(f"{t}_{f}").alias(f"{f}_t{t}") for t in ts for f in features])


def from_wide(wide: DataFrame, features: list[str] = SERIES, keys: list[str] = CYCLE) -> DataFrame:
    """Stored wide table back to grid rows; time points are read from the column names."""
    import re

    found: dict[int, set[str]] = {}
    for c in wide.columns:
        m = re.fullmatch(r"(.+)_t(\d+)", c)
        if m:
            found.setdefault(int(m.group(2)), set()).add(m.group(1))
    have = [f for f in features if all(f in names for names in found.values())]
    rows = F.array(*[
        F.struct(F.lit(i).alias("idx"), F.lit(t).alias("t_sec"), *[F.col(f"{f}_t{t}").cast("double").alias(f) for f in have])
        for i, t in enumerate(sorted(found))
    ])
    return wide.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*")


def prefixes(grid_rows: DataFrame, windows: list[int] = WINDOWS) -> DataFrame:
    """Each grid row once per window that contains it, as column ``w``."""
    inside = F.filter(F.array(*[F.lit(w) for w in windows]), lambda w: F.col("t_sec") <= w)
    return grid_rows.withColumn("w", F.explode(inside))


def series_issues(
    master: DataFrame, known_files: DataFrame, valid: DataFrame, aligned: DataFrame, full: DataFrame | None,
    unreadable: DataFrame | None = None, failed: DataFrame | None = None,
) -> DataFrame:
    """why a master cycle has no series; the first failing stage names the reason.

    ``unreadable`` (file, error) holds files that could not be read, ``failed``
    (file, Cycle, error) cycles whose computation broke off; the error follows
    the reason.
    """
    m = master.select("file", "Cycle", file_stem(F.col("file")).alias("file_key"))
    files = known_files.select(file_stem(F.col("file")).alias("file_key")).distinct().withColumn("_file", F.lit(True))
    j = salted_lookup(m, files, ["file_key"], ["Cycle"])
    for name, stage in (("_valid", valid), ("_aligned", aligned), ("_full", full)):
        if stage is None:
            j = j.withColumn(name, F.lit(True))
        else:
            j = merge_join(j, stage.groupBy(*CYCLE).agg(F.lit(True).alias(name)), CYCLE, "left")
    said = F.min(F.coalesce(F.col("error"), F.lit("")))
    if unreadable is not None:
        broken = unreadable.groupBy(file_stem(F.col("file")).alias("file_key")).agg(said.alias("_read_error"))
        j = salted_lookup(j, broken, ["file_key"], ["Cycle"])
    if failed is not None:
        j = merge_join(j, failed.groupBy(*CYCLE).agg(said.alias("_cycle_error")), CYCLE, "left")
    read_error = F.lit(None) if unreadable is None else F.col("_read_error")
    cycle_error = F.lit(None) if failed is None else F.col("_cycle_error")
    reason = (
        F.when(F.col("_file").isNull(), F.lit("raw_excel_not_found"))
        .when(read_error.isNotNull(), F.concat(F.lit("file_read_error:"), read_error))
        .when(cycle_error.isNotNull(), F.concat(F.lit("cycle_error:"), cycle_error))
        .when(F.col("_valid").isNull(), F.lit("invalid_step_structure"))
        .when(F.col("_aligned").isNull(), F.lit("empty_aligned_cycle"))
        .when(F.col("_full").isNull(), F.lit("missing_values_in_full_window"))
    )
    return j.withColumn("reason", reason).where(F.col("reason").isNotNull()).select("file", "Cycle", "reason")


def match_raw_files(master: DataFrame, raw_files: DataFrame) -> DataFrame:
    """Master rows with the raw file of the same stem; of several, the last in sorted order.

    ``raw_file`` is null where none exists.
    """
    best = raw_files.groupBy(file_stem(F.col("file")).alias("file_key")).agg(F.max("file").alias("raw_file"))
    rows = master.withColumn("file_key", file_stem(F.col("file")))
    return salted_lookup(rows, best, ["file_key"], ["Cycle"])

"""Label tables: sheet choice, GOOD lists, defaults, consolidation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellframe.functions.coerce import number, whole
from cellframe.functions.skew import salted_lookup
from cellframe.functions.text import class_name, norm_key_str

# Columns that a label table is expected to carry.
METRIC_COLUMNS = [
    "Chg_Spec_mAhg", "DChg_Spec_mAhg", "IR_proxy", "CE",
    "Chg_Cap_Ah", "DChg_Cap_Ah", "Chg_Energy_Wh", "DChg_Energy_Wh",
]
HARD_FLAGS = ["HF_CHG_SPEC_HIGH", "HF_DCHG_SPEC_LOW", "HF_MISSING"]
SHEET_PRIORITY = ["cycle_labels", "labels", "cycle_label", "cyclelabels"]


def choose_label_sheet(rows: DataFrame, sheet: str = "sheet", priority: list[str] = SHEET_PRIORITY[:2]) -> DataFrame:
    """S3: keep, per file, the rows of the first sheet in ``priority`` that the file has.

    ``rows`` holds all label sheets united, with the sheet name as a column.
    """
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col(sheet))
    ranked = rows.withColumn("_rank", rank).where(F.col("_rank") > 0)
    best = ranked.groupBy("file").agg(F.min("_rank").alias("_best"))
    value_cols = [c for c in rows.columns if c != "file"]
    return (
        salted_lookup(ranked, best, ["file"], value_cols, how="inner")
        .where(F.col("_rank") == F.col("_best"))
        .drop("_rank", "_best")
    )


def label_columns(columns: list[str]) -> tuple[str | None, str | None, str | None]:
    """(cycle column, name column, class column) found by normalised header."""
    known = {norm_key_str(c): c for c in columns}
    pick = lambda *names: next((known[n] for n in names if n in known), None)
    return pick("cycle", "cycleindex"), pick("cyclelabel3name"), pick("cyclelabel3class", "label")


def is_label_sheet(columns: list[str]) -> bool:
    """S3: a cycle column together with something that looks like a label."""
    known = {norm_key_str(c) for c in columns}
    return "cycle" in known and bool(known & {"cyclelabel3name", "cyclelabel3class", "label"})


def good_cycles(labels: DataFrame, cycle: str = "Cycle", label: str = "Label") -> DataFrame:
    """Distinct (file, Cycle) whose label is GOOD in any case."""
    return (
        labels.where(F.upper(F.col(label)) == "GOOD")
        .select("file", whole(F.col(cycle)).alias("Cycle"))
        .dropna(subset=["Cycle"])
        .distinct()
    )


def cycle_labels(labels: DataFrame, cycle: str = "Cycle", label: str = "Label") -> DataFrame:
    """Distinct (file, Cycle, upper-case label)."""
    return (
        labels.select("file", whole(F.col(cycle)).alias("Cycle"), F.upper(F.coalesce(F.col(label), F.lit("nan"))).alias("label"))
        .dropna(subset=["Cycle"])
        .distinct()
    )


def with_defaults(labels: DataFrame) -> DataFrame:
    """Absent metrics become null, absent hard flags become false."""
    out = labels
    for c in METRIC_COLUMNS:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("double"))
    for c in HARD_FLAGS:
        out = out.withColumn(c, F.coalesce(F.col(c).cast("boolean"), F.lit(False)) if c in out.columns else F.lit(False))
    return out


def unite_labels(parts: list[DataFrame]) -> DataFrame:
    """U1 + S11: union of label tables with differing columns, then the defaults."""
    return with_defaults(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))


def original_name(c: Column, suffix: str = "_good_labeled_3class") -> Column:
    """File name of the labelled workbook back to the original one."""
    return F.replace(c, F.lit(f"{suffix}.xlsx"), F.lit(".xlsx"))


def consolidate(tables: list[DataFrame]) -> DataFrame:
    """Distinct (file, Cycle, cycle_label_3name) over label tables of any accepted layout."""
    parts = []
    for t in tables:
        cycle, name, klass = label_columns(t.columns)
        if cycle is None or (name is None and klass is None):
            continue
        label = F.col(name) if name else class_name(F.col(klass))
        parts.append(
            t.select(
                original_name(F.col("file")).alias("file"),
                number(F.col(cycle)).cast("int").alias("Cycle"),
                label.alias("cycle_label_3name"),
            ).dropna(subset=["Cycle"])
        )
    if not parts:
        raise ValueError("no table with cycle and label columns")
    return reduce(DataFrame.unionByName, parts).distinct()

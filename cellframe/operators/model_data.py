"""Model tables: assembly, grouped split, encoding, imputation, scaling, weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellframe.config import CLASSES, META
from cellframe.functions.coerce import number, whole
from cellframe.functions.skew import exact_quantiles, one_row, rank_by_hash, salted_lookup
from cellframe.functions.text import canonical_label
from cellframe.operators.features import add_growth, stored_columns

LABEL_CHOICES = ["cycle_label_3name", "battery_label_3name", "Label"]  # fixed values, in priority order


def detect_label_column(columns: list[str]) -> str:
    """P21."""
    found = next((c for c in LABEL_CHOICES if c in columns), None)
    if found is None:
        raise ValueError(f"none of {LABEL_CHOICES} in the table")
    return found


def clean_labels(df: DataFrame, label: str | None = None, aliases: dict[str, str] | None = None) -> DataFrame:
    """Keys coerced, rows without key or label dropped, labels canonical and whitelisted.

    ``aliases`` accepts further spellings, e.g. ``{"good_no_drone": "GOOD_not_drone"}``.
    """
    label = label or detect_label_column(df.columns)
    name = canonical_label(F.col(label).cast("string"))
    for k, v in (aliases or {}).items():
        name = F.when(F.lower(F.trim(F.col(label).cast("string"))) == k, F.lit(v)).otherwise(name)
    return (
        df.withColumn("Cycle", whole(F.col("Cycle"))).dropna(subset=["Cycle", "file", label])
        .withColumn("cycle_label_3name", name).where(F.col("cycle_label_3name").isin(CLASSES))
    )


def final_table(wide: DataFrame, window: int, label: str | None = None) -> DataFrame:
    """M1: cleaned labels, growth features, metadata and the stored feature columns of the window."""
    df = add_growth(clean_labels(wide, label))
    meta = [c for c in META if c in df.columns]
    return df.select(*meta, *stored_columns(df.columns, window))


def group_split(df: DataFrame, group: str = "file", test_size: float = 0.3, seed: int = 42) -> DataFrame:
    """M2: (group, is_test); the first ceil(test_size * G) groups by md5 of name and seed are the test side.

    Ranking goes through hash-prefix chunks, so no task sorts all groups.  The
    result depends on the names and the seed only, and is the same for every
    window of the same cohort.
    """
    groups = df.select(F.col(group).cast("string").alias(group)).where(F.col(group).isNotNull()).distinct()
    token = F.concat_ws("#", F.col(group), F.lit(str(seed)))
    ranked = rank_by_hash(groups, [], token, "rank")
    n = groups.agg(F.count(F.lit(1)).alias("_g"))
    test = F.col("rank") <= F.ceil(F.col("_g") * F.lit(float(test_size)))
    return one_row(ranked, n).select(group, "rank", test.alias("is_test"))


def split_rows(df: DataFrame, split: DataFrame, test: bool, group: str = "file", spread: str = "Cycle") -> DataFrame:
    """Rows whose group is on the asked side."""
    side = split.where(F.col("is_test") == test).select(group)
    return salted_lookup(df, side, [group], [spread], how="left_semi")


def encode(c: Column, classes: list[str] = CLASSES) -> Column:
    """M3: alphabetical class code, null for an unknown class."""
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in sorted(classes)]), c), F.lit(0)).cast("int") - 1


def decode(c: Column, classes: list[str] = CLASSES) -> Column:
    """M3: class name of a code."""
    return F.get(F.array(*[F.lit(x) for x in sorted(classes)]), c.cast("int"))


def feature_medians(train: DataFrame, columns: list[str]) -> DataFrame:
    """Exact median per feature as rows (feature, median)."""
    long = train.select(*[number(F.col(f"`{c}`")).alias(c) for c in columns]).unpivot([], columns, "feature", "value")
    return exact_quantiles(long, ["feature"], "value", {"median": 0.5})


def collect_parameters(df: DataFrame, key: str = "feature") -> dict[str, dict]:
    """Fitted parameters of a preparation step: one row per feature column, so bounded by the schema."""
    return {r[key]: r.asDict() for r in df.collect()}


def impute(df: DataFrame, medians: dict[str, float | None]) -> DataFrame:
    """M4: training medians in place of missing values; a feature without any value becomes 0."""
    return df.withColumns({c: F.coalesce(number(F.col(f"`{c}`")), F.lit(float(m) if m is not None else 0.0)) for c, m in medians.items()})


def feature_moments(train: DataFrame, columns: list[str]) -> DataFrame:
    """M5: mean and population deviation per feature as rows."""
    aggs = []
    for n, c in enumerate(columns):
        aggs += [F.avg(f"`{c}`").alias(f"m{n}"), F.stddev_pop(f"`{c}`").alias(f"s{n}")]
    one = train.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m{n}").alias("mean"), F.col(f"s{n}").alias("std")) for n, c in enumerate(columns)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def standardise(df: DataFrame, moments: dict[str, dict]) -> DataFrame:
    """M5: (x - mean) / population deviation; a constant feature is only centred."""
    out = {}
    for c, m in moments.items():
        s = m["std"] if m["std"] else 1.0
        out[c] = (F.col(f"`{c}`") - F.lit(float(m["mean"] or 0.0))) / F.lit(float(s))
    return df.withColumns(out)


def class_weights(df: DataFrame, label: str = "cycle_label_3name") -> DataFrame:
    """M6: n / (k * n_c) per class; one row per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    total = counts.agg(F.sum("n_class").alias("_n"), F.count(F.lit(1)).alias("_k"))
    return one_row(counts, total).select(label, "n_class", (F.col("_n") / (F.col("_k") * F.col("n_class"))).alias("weight"))


def with_class_weight(df: DataFrame, label: str = "cycle_label_3name", classes: list[str] = CLASSES) -> DataFrame:
    """M6: weight on every row; the table has as many rows as there are classes, which bounds the broadcast."""
    w = class_weights(df.where(F.col(label).isin(classes)), label).select(label, "weight")
    return df.join(F.broadcast(w), label, "left")

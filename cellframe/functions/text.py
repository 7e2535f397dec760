"""Text normalisation and label vocabulary as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

KEPT = "abcdefghijklmnopqrstuvwxyz0123456789_."  # fixed value: characters of a normalised text
# Label spellings accepted in stored tables.
LABEL_ALIASES = {
    "0": "BAD", "1": "GOOD_not_drone", "2": "GOOD_drone",
    "bad": "BAD", "good_not_drone": "GOOD_not_drone", "good_drone": "GOOD_drone",
}
CLASS_NAMES = {0: "bad", 1: "good_no_drone", 2: "good_drone"}


def norm_text(c: Column) -> Column:
    """Trim, lower, dash/space to underscore, keep [a-z0-9_.], collapse underscores."""
    x = lambda s, a, b: F.replace(s, F.lit(a), F.lit(b))
    plain = x(x(F.lower(F.trim(c)), "-", "_"), " ", "_")
    # Every sheet row comes through here, and patterns cost more than the rest of the scan.
    kept = F.call_function("translate", plain, F.translate(plain, KEPT, ""), F.lit(""))
    return x(x(x(kept, "_", "<>"), "><", ""), "<>", "_")


def norm_key(c: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def norm_text_str(s: str) -> str:
    """P1 for a header name at plan time."""
    kept = re.sub(r"[^a-z0-9_.]+", "", s.strip().lower().translate(str.maketrans("- ", "__")))
    return re.sub(r"_+", "_", kept)


def norm_key_str(s: str) -> str:
    """P2 for a header name at plan time."""
    return re.sub(r"[^a-z0-9]+", "", s.lower())


def file_stem(c: Column) -> Column:
    """P5: file name without its last extension and without the label suffixes."""
    stem = F.regexp_replace(c, r"(?<=.)\.[^.]*$", "")
    return F.replace(F.replace(stem, F.lit("_labeled_3class"), F.lit("")), F.lit("_labeled"), F.lit(""))


def label_stem(c: Column) -> Column:
    """Stem used to pair a file with its labelled twin: one trailing ``_labeled`` removed."""
    return F.regexp_replace(F.regexp_replace(c, r"(?<=.)\.[^.]*$", ""), "_labeled$", "")


def is_charge(norm: Column) -> Column:
    """P7 on normalised step text."""
    return norm.contains("chg") & ~norm.contains("dchg")


def is_discharge(norm: Column) -> Column:
    """P7 on normalised step text."""
    return norm.contains("dchg")


def is_charge_row(capacity: Column, step_type: Column, has_capacity: Column | bool = True) -> Column:
    """Capacity > 0 where the sheet has a capacity column, else the text rule."""
    t = F.lower(F.coalesce(step_type, F.lit("")))
    text = t.contains("chg") & ~t.contains("dchg") & ~t.contains("discharge")
    return _choose(has_capacity, F.coalesce(capacity, F.lit(0.0)) > 0, text)


def is_discharge_row(capacity: Column, step_type: Column, has_capacity: Column | bool = True) -> Column:
    """Discharge counterpart."""
    t = F.lower(F.coalesce(step_type, F.lit("")))
    text = t.contains("dchg") | t.contains("discharge")
    return _choose(has_capacity, F.coalesce(capacity, F.lit(0.0)) > 0, text)


def _choose(flag: Column | bool, a: Column, b: Column) -> Column:
    if isinstance(flag, bool):
        return a if flag else b
    return F.when(flag, a).otherwise(b)


def canonical_label(c: Column) -> Column:
    """P20: known spellings mapped, unknown ones lower-cased and trimmed."""
    low = F.lower(F.trim(c))
    table = F.create_map(*[F.lit(x) for kv in LABEL_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, low), low)


def class_name(c: Column) -> Column:
    """Numeric class to the label name of the consolidated label table."""
    table = F.create_map(*[F.lit(x) for kv in CLASS_NAMES.items() for x in kv])
    return F.try_element_at(table, c.try_cast("double").try_cast("int"))


def window_from_name(c: Column) -> Column:
    """``..._10s.csv`` -> 10."""
    return F.nullif(F.regexp_extract(c, r"_(\d+)s\.[^.]*$", 1), F.lit("")).try_cast("int")

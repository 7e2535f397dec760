"""Reasons of cycles without a series."""

from cellframe.operators import align


def test_read_failures_and_broken_cycles_are_named(spark):
    keys = lambda rows: spark.createDataFrame(rows, "file string, Cycle int")
    master = keys([("a.xlsx", 1), ("a.xlsx", 2), ("a.xlsx", 3), ("b.xlsx", 1), ("c.xlsx", 1)])
    known = spark.createDataFrame([("a.xlsx",), ("b.xlsx",)], "file string")
    good = keys([("a.xlsx", 1)])
    unreadable = spark.createDataFrame([("b.xlsx", "ValueError:bad zip")], "file string, error string")
    failed = spark.createDataFrame([("a.xlsx", 2, None)], "file string, Cycle int, error string")
    got = align.series_issues(master, known, good, good, good, unreadable, failed).collect()
    assert sorted(tuple(r) for r in got) == [
        ("a.xlsx", 2, "cycle_error:"), ("a.xlsx", 3, "invalid_step_structure"), ("b.xlsx", 1, "file_read_error:ValueError:bad zip"), ("c.xlsx", 1, "raw_excel_not_found"),
    ]
    assert {r.reason for r in align.series_issues(master, known, good, good, good).collect()} == {"invalid_step_structure", "raw_excel_not_found"}

"""One SQL statement per registered query, written independently of the Spark code."""

from __future__ import annotations

import random

from oracles.common import ESS, MISSING, NAMES, PHASES, PIVOT_COLS, SERIES, block, r6, sql

STATEMENTS: dict[str, str] = {}
W = [1, 2, 5, 10, 20, 30, 50, 60]
K = 'file, "Cycle"'


def add(name: str, needs: list[str], select: str) -> None:
    STATEMENTS[name] = sql(needs, select)


def rq(*cols: str) -> str:
    return ", ".join(r6(f'"{c}"', c) for c in cols)


def digest(source: str, keys: str, order: str, doubles: list[str], wholes: list[str] = ()) -> str:
    """Rows and MD5 of all values per key: columns by name, doubles as whole millionths, rows by ``order``."""
    cells = {c: f'CAST(round("{c}" * 1e6) AS BIGINT)' for c in doubles} | {c: f'"{c}"' for c in wholes}
    row = " || ',' || ".join(f"coalesce(CAST({cells[c]} AS VARCHAR), 'n')" for c in sorted(cells))
    return f"SELECT {keys}, count(*) AS rows, md5(string_agg({order} || ':' || {row}, ';' ORDER BY {order})) AS digest FROM {source} GROUP BY {keys}"


# --- sources -----------------------------------------------------------------

add("S01_file_listing", [], "SELECT 'orders.parquet' AS file, count(*) AS rows FROM orders")
add("S02_absent_sheets", ["step", "cycle_sheet"], """
SELECT file, CAST(NULL AS INTEGER) AS "Cycle", CASE WHEN c % 13 = 4 OR file NOT IN (SELECT file FROM step) THEN 'read_error:sheet_step_missing' ELSE 'read_error:sheet_cycle_missing' END AS reason
FROM (SELECT 'cell_' || c_custkey || '.xlsx' AS file, c_custkey AS c FROM customer)
WHERE c % 13 = 4 OR c % 17 = 3 OR file NOT IN (SELECT file FROM step) OR file NOT IN (SELECT file FROM cycle_sheet)""")
block("labelsheets", ["cyc"], """
SELECT file, sheet, "Cycle", CASE k % 4 WHEN 0 THEN 'good' WHEN 1 THEN 'BAD' WHEN 2 THEN 'GOOD' END AS "Label" FROM cyc
CROSS JOIN (VALUES ('labels'), ('cycle_labels'), ('notes')) AS t(sheet)
WHERE (sheet = 'labels' AND c % 3 <> 0) OR (sheet = 'cycle_labels' AND c % 2 = 0) OR sheet = 'notes'""")
add("S03_label_sheet_choice", ["labelsheets"], """
SELECT file, sheet, "Cycle", "Label" FROM labelsheets l
WHERE sheet = 'cycle_labels' OR (sheet = 'labels' AND file NOT IN (SELECT file FROM labelsheets WHERE sheet = 'cycle_labels'))""")
add("S04_step_scan", ["step"], f"""
SELECT file, "Cycle", "Step_Index", "Step_Type", CASE "Step_Type" WHEN 'CC Chg' THEN 'cc_chg' WHEN 'CC DChg' THEN 'cc_dchg' ELSE 'rest' END AS "Step_Type_norm",
  {r6('CASE WHEN src_ord % 29 <> 0 THEN "Step_Time_h" END', "Step_Time_h")}, {r6('epoch_us("Oneset_Date") / 1e6', "Oneset_Date")}, {r6('epoch_us("End_Date") / 1e6', "End_Date")},
  {rq("Energy_Wh", "V_end")}, CAST(NULL AS DOUBLE) AS "Capacity_Ah"
FROM step WHERE src_ord % 31 <> 0""")
add("S05_cycle_scan", ["cycle_sheet"], f"""SELECT {K}, {rq(*[f"{c}_cycle" for c in ("Chg_Cap_Ah", "Chg_Spec_mAhg", "DChg_Cap_Ah", "DChg_Spec_mAhg", "Chg_Energy_Wh", "DChg_Energy_Wh")])} FROM cycle_sheet""")
add("S06_P09_P10_record_scan", ["record"], f"""
SELECT {K}, count(*) AS rows, {", ".join(r6(f"sum({c})", f"sum_{c}") for c in [*SERIES, "time_sec_raw"])}, {r6("sum(epoch_us(record_date) / 1e6)", "sum_date")}
FROM record GROUP BY {K}""")
add("S07_P06_U01_header_families", ["step"], f"""
SELECT file, src_ord, "Cycle" AS cycle_index, "Step_Type" AS step_type,
  CASE WHEN CAST(regexp_extract(file, '_(\\d+)\\.', 1) AS BIGINT) % 2 = 0 THEN "Step_Number" ELSE CAST(src_ord AS DOUBLE) END AS step_number,
  {r6('"Step_Time_h"', "step_time_h")}, {r6('"Chg_Cap_Ah"', "chg_cap_ah")}, {r6('epoch_us("Oneset_Date") / 1e6', "onset")}, {r6('"V_end"', "end_voltage_v")}
FROM step""")
add("S08_F10_good_cycles", ["labelsheets"], f"""SELECT DISTINCT {K} FROM labelsheets WHERE upper("Label") = 'GOOD'""")
add("S08_U02_cycle_labels", ["labelsheets"], f"""SELECT DISTINCT {K}, upper(coalesce("Label", 'nan')) AS label FROM labelsheets""")
add("S09_master_scan", ["master"], f"""SELECT {K}, "Label", cycle_label_3class, cycle_label_3name, replace(file, '.xlsx', '') AS file_key FROM master""")
add("S10_window_from_name", [], """SELECT w, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_custkey AS INTEGER) END AS w FROM orders) GROUP BY w""")

block("lcycle", ["cycle_sheet"], f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY src_ord) AS rn FROM cycle_sheet) WHERE rn = 1""")
block("lkept", ["lcycle"], f"""
SELECT * FROM (SELECT *, max("Cycle") OVER (PARTITION BY file) AS mx, count(*) OVER (PARTITION BY file) AS nc FROM lcycle WHERE "Cycle" >= 4) WHERE "Cycle" < mx OR nc = 1""")
block("labels4", ["lkept"], f"""
SELECT *, CASE WHEN hard_fail OR soft_score < 70e0 THEN 'BAD' ELSE 'GOOD' END AS "Label" FROM (
SELECT *, 100e0 - CASE WHEN "SP_IR_OUTLIER" AND NOT hard_fail THEN 20e0 ELSE 0e0 END - CASE WHEN "SP_CE_SOFT" THEN 10e0 ELSE 0e0 END AS soft_score FROM (
SELECT *, NOT hard_fail AND coalesce("CE" < 0.95e0 OR "CE" > 1.05e0, false) AS "SP_CE_SOFT" FROM (
SELECT *, "HF_CHG_SPEC_HIGH" OR "HF_DCHG_SPEC_LOW" OR "HF_MISSING" AS hard_fail FROM (
SELECT *, coalesce("Chg_Spec_mAhg" > 190e0, false) AS "HF_CHG_SPEC_HIGH", coalesce("DChg_Spec_mAhg" < 120e0, false) AS "HF_DCHG_SPEC_LOW", {MISSING} > 0 AS "HF_MISSING",
  coalesce("IR_proxy" > 0.422e0, false) AS "SP_IR_OUTLIER", 0.422e0 AS "IR_proxy_threshold" FROM (
SELECT *, "DChg_Cap_Ah" / nullif("Chg_Cap_Ah", 0) AS "CE", "Chg_Energy_Wh" / nullif("Chg_Cap_Ah", 0) - "DChg_Energy_Wh" / nullif("DChg_Cap_Ah", 0) AS "IR_proxy" FROM (
SELECT {K}, "Chg_Spec_mAhg_cycle" AS "Chg_Spec_mAhg", "DChg_Spec_mAhg_cycle" AS "DChg_Spec_mAhg", "Chg_Cap_Ah_cycle" AS "Chg_Cap_Ah", "DChg_Cap_Ah_cycle" AS "DChg_Cap_Ah",
  "Chg_Energy_Wh_cycle" AS "Chg_Energy_Wh", "DChg_Energy_Wh_cycle" AS "DChg_Energy_Wh" FROM lkept))))))""")
add("R04_cycle_sheet_labels", ["labels4"], f"""
SELECT {K}, {rq("Chg_Spec_mAhg", "DChg_Spec_mAhg", "Chg_Cap_Ah", "DChg_Cap_Ah", "Chg_Energy_Wh", "DChg_Energy_Wh", "CE", "IR_proxy", "soft_score", "IR_proxy_threshold")},
  "HF_CHG_SPEC_HIGH", "HF_DCHG_SPEC_LOW", "HF_MISSING", hard_fail, "SP_IR_OUTLIER", "SP_CE_SOFT", "Label" FROM labels4""")
add("S11_P14_P15_label_defaults", ["labels4"], f"""
SELECT 'full' AS src, {K}, "Label", "HF_MISSING", {rq("IR_proxy")}, {MISSING} AS "Missing_Count", {r6('abs("CE" - 1e0)', "CE_dev_abs")},
  CAST("HF_CHG_SPEC_HIGH" AS INTEGER) + CAST("HF_DCHG_SPEC_LOW" AS INTEGER) + CAST("HF_MISSING" AS INTEGER) AS "Hard_Count",
  CAST("SP_IR_OUTLIER" AS INTEGER) + CAST("SP_CE_SOFT" AS INTEGER) AS "Soft_Count" FROM labels4
UNION ALL
SELECT 'plain', {K}, "Label", false, CAST(NULL AS DOUBLE), 3 + CAST("Chg_Cap_Ah" IS NULL AS INTEGER) + CAST("CE" IS NULL AS INTEGER), {r6('abs("CE" - 1e0)')}, 0, CAST("SP_IR_OUTLIER" AS INTEGER) FROM labels4""")
add("S15_P22_label_union", ["cyc"], """
SELECT file, "Cycle", 'L' || (k % 5) AS cycle_label_3name FROM cyc WHERE c % 2 = 0
UNION SELECT file, "Cycle", CASE k % 5 WHEN 0 THEN 'bad' WHEN 1 THEN 'good_no_drone' WHEN 2 THEN 'good_drone' END FROM cyc WHERE c % 2 = 1 AND k % 7 <> 0""")

# --- scalar functions --------------------------------------------------------

add("P01_P02_normalise_text", [], """
SELECT p_partkey, regexp_replace(regexp_replace(replace(replace(lower(trim(t)), '-', '_'), ' ', '_'), '[^a-z0-9_.]+', '', 'g'), '_+', '_', 'g') AS norm_text,
  regexp_replace(lower(t), '[^a-z0-9]+', '', 'g') AS norm_key
FROM (SELECT p_partkey, p_name || ' - ' || p_type || ' - ' || p_brand AS t FROM part)""")
add("P03_P31_number_coercion", [], f"""
SELECT k, {r6("CASE WHEN NOT isinf(v) THEN v END", "value")}, isinf(v) AS infinite, {r6("CASE WHEN v IS NULL OR isinf(v) THEN 0e0 ELSE v END", "filled")} FROM (
SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 2 THEN CAST('Infinity' AS DOUBLE) WHEN o_orderkey % 7 > 3 THEN o_totalprice END AS v FROM orders)""")
add("P04_timestamp_coercion", [], f"""
SELECT o_orderkey AS k, {r6("CASE WHEN o_orderkey % 6 > 1 THEN epoch_us(date_trunc('day', CAST(o_orderdate AS TIMESTAMP))) / 1e6 + 3723.25e0 END", "at")} FROM orders""")
add("P05_file_stem", [], """
SELECT c_custkey, CASE c_custkey % 5 WHEN 2 THEN c_name || '.v2' ELSE c_name END AS stem FROM customer""")
add("P07_P08_step_kinds", ["step"], """
SELECT t, count(*) FILTER (n LIKE '%chg%' AND n NOT LIKE '%dchg%') AS charge, count(*) FILTER (n LIKE '%dchg%') AS discharge,
  count(*) FILTER (CASE WHEN src_ord % 3 = 0 THEN coalesce("Chg_Cap_Ah", 0) > 0 ELSE n LIKE '%chg%' AND n NOT LIKE '%dchg%' AND n NOT LIKE '%discharge%' END) AS charge_row,
  count(*) FILTER (CASE WHEN src_ord % 3 = 0 THEN coalesce("DChg_Cap_Ah", 0) > 0 ELSE n LIKE '%dchg%' OR n LIKE '%discharge%' END) AS discharge_row
FROM (SELECT *, lower(t) AS n FROM (SELECT *, CASE src_ord % 4 WHEN 0 THEN lower("Step_Type") WHEN 1 THEN 'Discharge CHG' ELSE "Step_Type" END AS t FROM step)) GROUP BY t""")
add("P11_P17_cycle_metrics", [], f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {r6("a / nullif(b, 0)", "ratio")}, {r6("d / nullif(c, 0) - a / nullif(b, 0)", "ir_proxy")}, {r6("a / nullif(c, 0)", "landing_ratio")},
  {r6("a - c", "landing_difference")}, {r6("a + b + c", "total")}, CAST(a IS NULL AS INTEGER) + CAST(b IS NULL AS INTEGER) AS missing, {r6("abs(a - 1e0)", "ce_dev")},
  {r6("CASE WHEN l_returnflag = 'A' THEN a ELSE b END", "sheet_value")}, {r6("CASE WHEN (b IS NULL OR b = 0) AND l_linenumber > 1 THEN c ELSE b END", "sheet_or_record")}
FROM (SELECT *, nullif(l_discount, 0.05e0) AS a, l_tax AS b, l_quantity AS c, l_extendedprice * 1.00001371934562e0 AS d FROM lineitem)""")
add("P20_P21_canonical_label", [], """
SELECT raw, label, count(*) AS n FROM (SELECT CASE o_orderkey % 8 WHEN 0 THEN ' Good_Drone ' WHEN 1 THEN '0' WHEN 2 THEN 'good_no_drone' WHEN 3 THEN '1' WHEN 4 THEN 'BAD' WHEN 5 THEN '2' WHEN 6 THEN 'GOOD_not_drone' ELSE 'Other' END AS raw,
 CASE o_orderkey % 8 WHEN 0 THEN 'GOOD_drone' WHEN 1 THEN 'BAD' WHEN 2 THEN 'good_no_drone' WHEN 3 THEN 'GOOD_not_drone' WHEN 4 THEN 'BAD' WHEN 5 THEN 'GOOD_drone' WHEN 6 THEN 'GOOD_not_drone' ELSE 'other' END AS label FROM orders) GROUP BY raw, label""")

# --- structure ---------------------------------------------------------------

add("A01_A23_step_counts", ["counts"], f"SELECT {K}, n_chg, n_dchg FROM counts")
add("F02_F03_W13_cycle_selection", ["counts"], """
SELECT file, "Cycle", rule FROM (SELECT file, "Cycle", max("Cycle") OVER (PARTITION BY file) AS mx, count(*) OVER (PARTITION BY file) AS nc FROM counts WHERE "Cycle" >= 4)
CROSS JOIN (VALUES ('master'), ('keep_single')) AS t(rule) WHERE "Cycle" < mx OR (rule = 'keep_single' AND nc = 1)""")
add("F04_F05_structure_audit", ["audited"], f"SELECT {K}, n_chg, n_dchg, rejected_file, reason FROM audited")
add("F06_issue_log", ["audited", "dupfile", "shortfile", "counts", "valid"], """
SELECT file, CAST(NULL AS INTEGER) AS "Cycle", 'read_error:duplicate_cycle' AS reason FROM dupfile
UNION ALL SELECT file, CASE WHEN cyc_ok THEN short_cycle END, reason FROM (
  SELECT f.file, s.short_cycle, s.file IS NOT NULL AS cyc_ok,
    CASE WHEN f.nf = 0 THEN 'no_cycles_after_start' WHEN f.nf = 1 THEN 'all_cycles_removed_after_skip_last'
         WHEN s.file IS NOT NULL THEN 'skip_file_cycle_has_lt5_dchg:' || s.short_count
         WHEN f.file NOT IN (SELECT file FROM valid) THEN 'no_valid_cycles_after_exact_structure_filter' END AS reason
  FROM (SELECT file, count(*) FILTER ("Cycle" >= 4) AS nf FROM counts GROUP BY file) f LEFT JOIN shortfile s ON f.file = s.file
  WHERE f.file NOT IN (SELECT file FROM dupfile)) WHERE reason IS NOT NULL
UNION ALL SELECT file, "Cycle", reason FROM audited WHERE NOT rejected_file AND reason IS NOT NULL AND file NOT IN (SELECT file FROM dupfile)""")
PHASE_OF = "CASE n.n " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PHASES, 1)) + " END"
add("W01_phase_names", ["numbered", "valid"], f"""
SELECT n.file, n."Cycle", {PHASE_OF} AS phase, n."Step_Index", {r6('n."V_end"', "V_end")} FROM numbered n JOIN valid v ON n.file = v.file AND n."Cycle" = v."Cycle" WHERE n.is_dchg""")
INTS = {c for c in PIVOT_COLS if c.endswith("step_index")}
PIV = ", ".join(f'"{c}"' if c in INTS else r6(f'"{c}"', c) for c in PIVOT_COLS)
add("A02_A03_A04_phase_pivot", ["pivoted"], f"SELECT {K}, {PIV} FROM pivoted")
add("J02_P18_cycle_totals", ["totals"], f"""SELECT {K}, {rq("Chg_Cap_Ah", "Chg_Spec_mAhg", "DChg_Cap_Ah", "DChg_Spec_mAhg", "Chg_Energy_Wh", "DChg_Energy_Wh")} FROM totals""")
add("R01_R02_R03_P24_cycle_master", ["master"], f"""
SELECT {K}, {PIV}, {rq("Chg_Cap_Ah", "Chg_Spec_mAhg", "DChg_Cap_Ah", "DChg_Spec_mAhg", "Chg_Energy_Wh", "DChg_Energy_Wh", "CE", "IR_proxy", "standby_t_end_h", "landing_V_rel_global", "soft_score", "IR_proxy_threshold", "CE_dev_abs")},
  "HF_CHG_SPEC_HIGH", "HF_DCHG_SPEC_LOW", "HF_MISSING", hard_fail, "SP_IR_OUTLIER", "SP_CE_SOFT", "Label", "Missing_Count", cycle_label_3class, cycle_label_3name FROM master""")
add("A16_label_counts", ["master"], "SELECT cycle_label_3name, count(*) AS n FROM master GROUP BY cycle_label_3name")
add("A17_kept_summary", ["master"], "SELECT count(*) AS rows, count(DISTINCT file) AS files FROM master")
add("A18_batch_summary", ["labels4"], """
SELECT c.file, coalesce(a.cycles, 0) AS cycles, coalesce(a.good, 0) AS good, coalesce(a.bad, 0) AS bad, CASE WHEN a.file IS NULL THEN 'no_labelled_cycles' END AS error
FROM (SELECT 'cell_' || c_custkey || '.xlsx' AS file FROM customer) c
LEFT JOIN (SELECT file, count(*) AS cycles, count(*) FILTER ("Label" = 'GOOD') AS good, count(*) FILTER ("Label" = 'BAD') AS bad FROM labels4 GROUP BY file) a ON c.file = a.file""")

# --- alignment ---------------------------------------------------------------

add("J01_raw_file_match", ["master"], """
SELECT m.file, m."Cycle", replace(m.file, '.xlsx', '') AS file_key, CASE WHEN c.c_custkey IS NOT NULL THEN 'cell_' || c.c_custkey || '_labeled.xlsx' END AS raw_file
FROM master m LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 11 <> 0) c ON m.file = 'cell_' || c.c_custkey || '.xlsx'""")
add("J03_event_intervals", [], """SELECT o.user_id, o.event_id AS opener, e.event_id, epoch_us(e.ts) - epoch_us(o.ts) AS after_us FROM events o JOIN events e ON e.user_id = o.user_id
AND epoch_us(e.ts) BETWEEN epoch_us(o.ts) AND epoch_us(o.ts) + CAST(floor(o.value * 3600) AS BIGINT) * 1000000 WHERE o.event_type = 'error'""")
add("J03_interval_join", ["inside"], f"SELECT {K}, ph, rec_no FROM inside")
add("W08_W09_phase_offsets", ["offsets"], f"""SELECT {K}, ph, {r6("epoch_us(t0) / 1e6", "t0")}, {r6("off", "offset")} FROM offsets""")
add("T01_aligned_series", ["aligned"], f"SELECT {K}, ph, rec_no, {rq('x', 'voltage_v', 'current_a', 'power_w')} FROM aligned")
add("T02_T03_W10_resampled_grid", ["grid"], f"SELECT {K}, t_sec, {rq(*SERIES)} FROM grid")
add("F08_full_window", ["fullgrid"], digest("fullgrid", K, "t_sec", SERIES))
add("T04_P24_wide_series", ["fullgrid"], f"SELECT {K}, " + ", ".join(r6(f"max({f}) FILTER (t_sec = {t})", f"{f}_t{t}") for t in range(61) for f in SERIES) + f" FROM fullgrid GROUP BY {K}")
WIN = "(VALUES " + ", ".join(f"({w})" for w in W) + ") AS win(w)"
add("T05_F11_prefixes", ["fullgrid"], digest(f"fullgrid JOIN {WIN} ON t_sec <= w", f"{K}, w", "t_sec", SERIES))
add("T06_wide_to_long", ["fullgrid"], f"SELECT {K}, t_sec, {rq('voltage_v', 'current_a')} FROM fullgrid")
add("F07_series_issues", ["cand", "valid", "aligned", "fullgrid"], """
SELECT file, "Cycle", reason FROM (SELECT c.file, c."Cycle",
  CASE WHEN CAST(regexp_extract(c.file, '_(\\d+)\\.', 1) AS BIGINT) % 11 = 0 THEN 'raw_excel_not_found'
       WHEN CAST(regexp_extract(c.file, '_(\\d+)\\.', 1) AS BIGINT) % 13 = 5 THEN 'file_read_error:OSError' WHEN c."Cycle" % 9 = 4 THEN 'cycle_error:ValueError ' || c."Cycle"
       WHEN v.file IS NULL THEN 'invalid_step_structure'
       WHEN a.file IS NULL THEN 'empty_aligned_cycle' WHEN f.file IS NULL THEN 'missing_values_in_full_window' END AS reason
FROM cand c LEFT JOIN valid v ON c.file = v.file AND c."Cycle" = v."Cycle"
LEFT JOIN (SELECT DISTINCT file, "Cycle" FROM aligned) a ON c.file = a.file AND c."Cycle" = a."Cycle"
LEFT JOIN (SELECT DISTINCT file, "Cycle" FROM fullgrid) f ON c.file = f.file AND c."Cycle" = f."Cycle") WHERE reason IS NOT NULL""")

# --- features ----------------------------------------------------------------

block("diffs", ["fullgrid"], """
SELECT *, v - lag(v) OVER o AS dv, i - lag(i) OVER o AS di, p - lag(p) OVER o AS dp FROM (SELECT file, "Cycle", t_sec AS t, voltage_v AS v, current_a AS i, power_w AS p, energy_wh AS en, dchg_cap AS dc, dchg_spec AS ds FROM fullgrid)
WINDOW o AS (PARTITION BY file, "Cycle" ORDER BY t)""")
_roll = ", ".join(
    f"CASE WHEN t >= {k - 1} THEN lag(v, {k - 1}) OVER o - min(v) OVER f{k} END AS vd{k}, CASE WHEN t >= {k - 1} THEN max(v) OVER f{k} - min(v) OVER f{k} END AS vr{k}, CASE WHEN t >= {k - 1} THEN max(p) OVER f{k} - min(p) OVER f{k} END AS pr{k}"
    for k in (3, 5))
block("seq", ["diffs"], f"""
SELECT *, dv - lag(dv) OVER o AS d2v, {_roll} FROM diffs
WINDOW o AS (PARTITION BY file, "Cycle" ORDER BY t), f3 AS (PARTITION BY file, "Cycle" ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), f5 AS (PARTITION BY file, "Cycle" ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")


def four(name: str, c: str) -> list[tuple[str, str]]:
    return [(f"{name}_mean", f"avg({c})"), (f"{name}_std", f"stddev_pop({c})"), (f"{name}_min", f"min({c})"), (f"{name}_max", f"max({c})")]


AGG = [("v0", "max(v) FILTER (t = 0)"), ("V_end", "max(v) FILTER (t = w)"), ("v1", "max(v) FILTER (t = least(1, w))"), ("v2", "max(v) FILTER (t = least(2, w))"), ("n", "count(*)"),
       ("V_mean", "avg(v)"), ("V_min", "min(v)"), ("V_max", "max(v)"), ("V_std", "stddev_pop(v)"), *four("dvdt", "dv"), *four("d2vdt2", "d2v"), *four("I", "i"),
       ("I_abs_mean", "avg(abs(i))"), ("I_abs_std", "stddev_pop(abs(i))"), *four("didt", "di"), *four("power", "p"), ("power_abs_mean", "avg(abs(p))"), ("power_abs_std", "stddev_pop(abs(p))"), *four("dpdt", "dp"),
       ("energy_ws", "coalesce(sum(p) FILTER (t < w), 0e0)"), ("V_min_idx", "CAST(arg_min(t, v * 1e0) AS DOUBLE)")]
for k in (3, 5):
    AGG += [(f"V_roll{k}_drop_max", f"max(vd{k})"), (f"V_roll{k}_range_max", f"max(vr{k})"), (f"power_roll{k}_range_max", f"max(pr{k})")]
for n, c in (("energy", "en"), ("dchg_cap", "dc"), ("dchg_spec", "ds")):
    AGG += [(f"{n}0", f"max({c}) FILTER (t = 0)"), (f"{n}_end", f"max({c}) FILTER (t = w)"), (f"{n}_mean", f"avg({c})"), (f"{n}_std", f"stddev_pop({c})")]
# first position of the minimum: smallest t among the rows at the minimum
block("feat0", ["seq"], f"""SELECT {K}, w, """ + ", ".join(f'{e} AS "{a}"' for a, e in AGG if a != "V_min_idx") + f" FROM seq JOIN {WIN} ON t <= w GROUP BY {K}, w")
block("featpos", ["seq", "feat0"], """
SELECT s.file, s."Cycle", f.w, CAST(min(s.t) AS DOUBLE) AS "V_min_idx"
FROM seq s JOIN feat0 f ON s.file = f.file AND s."Cycle" = f."Cycle" AND s.t <= f.w AND s.v = f."V_min" GROUP BY s.file, s."Cycle", f.w""")
block("featarea", ["seq", "feat0"], """
SELECT s.file, s."Cycle", f.w, coalesce(sum(s.v - f.v0) FILTER (s.t < f.w), 0e0) AS "traj_V_rel_area"
FROM seq s JOIN feat0 f ON s.file = f.file AND s."Cycle" = f."Cycle" AND s.t <= f.w GROUP BY s.file, s."Cycle", f.w""")
DER = {
    "V_drop_end": 'v0 - "V_end"', "V_sag": 'v0 - "V_min"', "V_sag_ratio": '(v0 - "V_min") / (abs(v0) + 1e-8)', "energy_per_I": 'energy_ws / ("I_abs_mean" + 1e-8)',
    "IR_early": '(v0 - "V_end") / ("I_abs_mean" + 1e-8)', "V_drop_1s": "v0 - v1", "V_drop_2s": "v0 - v2", "V_slope_global": '("V_end" - v0) / f.w', "V_sag_norm": '(v0 - "V_min") / ("I_abs_mean" + 1e-8)',
    "voltage_recovery": '"V_end" - "V_min"', "power_cv": "power_std / (abs(power_mean) + 1e-8)", "traj_V_roll3_drop_max": 'CASE WHEN n < 3 THEN 0e0 ELSE "V_roll3_drop_max" END',
    "energy_slope_global": "(energy_end - energy0) / f.w", "dchg_cap_slope_global": "(dchg_cap_end - dchg_cap0) / f.w", "dchg_spec_slope_global": "(dchg_spec_end - dchg_spec0) / f.w",
}
ALIASES = {"traj_V_drop_1": "V_drop_1s", "traj_V_drop_2": "V_drop_2s", "traj_V_slope_global": "V_slope_global", "traj_V_sag_norm": "V_sag_norm", "traj_V_recovery": "voltage_recovery", "traj_power_cv": "power_cv"}
block("feat", ["feat0", "featpos", "featarea"], "SELECT *, " + ", ".join(f'"{s}" AS "{a}"' for a, s in ALIASES.items()) + """,
  CAST(coalesce("V_sag_ratio" > 0.12e0, false) AS INTEGER) AS voltage_collapse_flag, CAST(coalesce("IR_early" > 0.35e0, false) AS INTEGER) AS "IR_high_flag", CAST(coalesce(dvdt_std > 0.02e0, false) AS INTEGER) AS dvdt_fluct_flag
FROM (SELECT f.*, p."V_min_idx", a."traj_V_rel_area", """ + ", ".join(f'{e} AS "{a}"' for a, e in DER.items()) + """
FROM feat0 f LEFT JOIN featpos p ON f.file = p.file AND f."Cycle" = p."Cycle" AND f.w = p.w LEFT JOIN featarea a ON f.file = a.file AND f."Cycle" = a."Cycle" AND f.w = a.w)""")
FLAGS = ["voltage_collapse_flag", "IR_high_flag", "dvdt_fluct_flag"]
INTERNAL = {"v0", "v1", "v2", "n", "energy0", "dchg_cap0", "dchg_spec0"}
FEATURES = [a for a, _ in AGG if a not in INTERNAL] + list(DER) + list(ALIASES) + ["traj_V_rel_area"]
add("E01_E26_W11_W12_early_features", ["feat"], f"SELECT {K}, w, {rq(*FEATURES)}, " + ", ".join(f'"{f}"' for f in FLAGS) + " FROM feat")
add("E27_A19_window_counts", ["feat"], "SELECT w, count(*) AS rows, CASE WHEN w < 2 THEN 65 WHEN w < 4 THEN 72 ELSE 75 END AS n_features FROM feat GROUP BY w")

L16 = ["IR_early", "IR_high_flag", "I_mean", "I_std", "V_mean", "V_min", "V_sag", "V_sag_ratio", "dvdt_fluct_flag", "dvdt_mean", "dvdt_std", "energy_per_I", "energy_ws", "power_mean", "power_std", "voltage_collapse_flag"]
block("wide", ["feat", "master"], 'SELECT m.file, m."Cycle", m."Label", m.cycle_label_3class, m.cycle_label_3name, ' + ", ".join(
    [f'max(f."{n}") FILTER (f.w = {w}) AS "early{w}_{n}"' for w in W for n in L16] + [f'CASE WHEN count(*) FILTER (f.w = {w}) = 0 THEN 1 ELSE 0 END AS early{w}_missing' for w in W]
) + ' FROM master m LEFT JOIN feat f ON m.file = f.file AND m."Cycle" = f."Cycle" GROUP BY m.file, m."Cycle", m."Label", m.cycle_label_3class, m.cycle_label_3name')
EARLY_COLS = ", ".join([f'"early{w}_{n}"' if n in FLAGS else r6(f'"early{w}_{n}"', f"early{w}_{n}") for w in W for n in L16] + [f"early{w}_missing" for w in W])
META = 'file, "Cycle", "Label", cycle_label_3class, cycle_label_3name'
add("J09_P29_widened_windows", ["wide"], f"SELECT {META}, {EARLY_COLS} FROM wide")
PAIRS = [(1, 2), (2, 5), (5, 10), (10, 20), (20, 30), (30, 50), (50, 60), (1, 10), (1, 30)]
GF = ["IR_early", "V_sag", "V_sag_ratio", "dvdt_std", "power_std", "energy_ws", "energy_per_I"]
GROWTH = {f"{n}_growth_{a}_to_{b}": f'"early{b}_{n}" - "early{a}_{n}"' for a, b in PAIRS for n in GF}
add("P23_M01_final_table", ["wide"], f"SELECT {META}, {EARLY_COLS}, " + ", ".join(r6(e, a) for a, e in GROWTH.items()) + " FROM wide")
STORED = [80, 97, 114, 131, 148, 165, 182, 199]
TRAINER = [13 * (i + 1) + 7 * sum(1 for a, b in PAIRS if b <= w) for i, w in enumerate(W)]
add("P25_P26_A19_feature_counts", ["master"], """
SELECT window_sec, n_stored, n_trainer, rows, files FROM (SELECT count(*) AS rows, count(DISTINCT file) AS files FROM master) CROSS JOIN (VALUES """
    + ", ".join(f"({w}, {s}, {t})" for w, s, t in zip(W, STORED, TRAINER)) + ") AS t(window_sec, n_stored, n_trainer)")
BIN = [(f"early{w}_{n}", f'"early{w}_{n}"') for w in W for n in [*L16, "missing"]] + list(GROWTH.items())
block("binsummary", ["wide"], "SELECT " + ", ".join(f"count({e}) > 0 AND count(*) FILTER ({e} NOT IN (0, 1)) = 0 AS b{i}" for i, (_, e) in enumerate(BIN)) + " FROM wide")
add("A22_P27_binary_columns", ["binsummary"], " UNION ALL ".join(f"SELECT '{a}' AS feature, b{i} AS is_binary FROM binsummary" for i, (a, _) in enumerate(BIN)))

# --- record labels -----------------------------------------------------------

block("rstats", ["record0"], """
SELECT file, "Cycle", count(*) FILTER (is_chg) AS n_chg, count(*) FILTER (is_dchg) AS n_dchg, max(voltage_v) FILTER (is_chg AND rec_no % 60 = 23) AS "V_end_chg", max(voltage_v) FILTER (is_chg) AS "V_max_chg",
  min(voltage_v) FILTER (is_dchg) AS "V_min_dchg", max(voltage_v) FILTER (is_dchg AND rec_no % 60 = 59) AS "V_end_dchg",
  min(time_h) FILTER (is_chg) AS t_min_chg, max(time_h) FILTER (is_chg) AS t_max_chg, min(time_h) FILTER (is_dchg) AS t_min_dchg, max(time_h) FILTER (is_dchg) AS t_max_dchg,
  max(chg_cap) FILTER (is_chg) AS "rec_Ah_chg", max(dchg_cap) FILTER (is_dchg) AS "rec_Ah_dchg", max(energy_wh) FILTER (is_chg) AS "rec_Wh_chg", max(energy_wh) FILTER (is_dchg) AS "rec_Wh_dchg"
FROM record0 GROUP BY file, "Cycle" """)
RS = ["V_end_chg", "V_max_chg", "V_min_dchg", "V_end_dchg", "t_min_chg", "t_max_chg", "t_min_dchg", "t_max_dchg", "rec_Ah_chg", "rec_Ah_dchg", "rec_Wh_chg", "rec_Wh_dchg"]
add("A05_A06_record_stats", ["rstats"], f"SELECT {K}, n_chg, n_dchg, {rq(*RS)} FROM rstats")
block("middle", ["record0"], """
SELECT r.* FROM record0 r JOIN (SELECT file, "Cycle", quantile_cont(time_h, 0.2) AS lo, quantile_cont(time_h, 0.8) AS hi FROM record0 WHERE is_chg AND time_h IS NOT NULL GROUP BY file, "Cycle") q
ON r.file = q.file AND r."Cycle" = q."Cycle" WHERE r.is_chg AND r.time_h BETWEEN q.lo AND q.hi""")
add("F12_middle_window", ["middle"], f"""SELECT {K}, count(*) AS n, {r6("min(time_h)", "t0")}, {r6("max(time_h)", "t1")}, CAST(sum(rec_no) AS BIGINT) AS rows FROM middle GROUP BY {K}""")
block("lin", ["middle"], """
SELECT file, "Cycle", CASE WHEN count(DISTINCT time_h) >= 3 AND max(voltage_v) > min(voltage_v) THEN regr_r2(voltage_v, time_h) END AS charge_r2, count(*) AS n_middle FROM middle GROUP BY file, "Cycle" """)
add("A07_linearity", ["lin"], f"SELECT {K}, {rq('charge_r2')}, n_middle FROM lin")
block("slopes", ["middle"], """
SELECT file, "Cycle", (voltage_v - lag(voltage_v) OVER o) / nullif(time_h - lag(time_h) OVER o, 0) AS s FROM middle WINDOW o AS (PARTITION BY file, "Cycle" ORDER BY rec_no)""")
block("smad", ["slopes"], """
SELECT s.file, s."Cycle", median(abs(s.s - m.md)) AS slope_mad FROM slopes s JOIN (SELECT file, "Cycle", median(s) AS md FROM slopes GROUP BY file, "Cycle") m ON s.file = m.file AND s."Cycle" = m."Cycle" GROUP BY s.file, s."Cycle" """)
add("A10_slope_variability", ["smad"], f"SELECT {K}, {rq('slope_mad')} FROM smad")
block("res", ["record0", "rstats"], """
SELECT file, "Cycle", CASE WHEN abs(i2 - i1) > 1e-6 THEN (v1 - v2) / (i2 - i1) END AS "IR_est" FROM (
SELECT r.file, r."Cycle", avg(r.voltage_v) FILTER (r.is_chg AND r.time_h >= s.t_max_chg - 10e0 / 3600e0) AS v1, avg(r.current_a) FILTER (r.is_chg AND r.time_h >= s.t_max_chg - 10e0 / 3600e0) AS i1,
  avg(r.voltage_v) FILTER (r.is_dchg AND r.time_h <= s.t_min_dchg + 10e0 / 3600e0) AS v2, avg(r.current_a) FILTER (r.is_dchg AND r.time_h <= s.t_min_dchg + 10e0 / 3600e0) AS i2
FROM record0 r JOIN rstats s ON r.file = s.file AND r."Cycle" = s."Cycle" GROUP BY r.file, r."Cycle")""")
add("A11_resistance", ["res"], f"SELECT {K}, {rq('IR_est')} FROM res")


def bounds(src: str, metric: str) -> str:
    return f"""SELECT m.file, m.md - 5e0 * d.mad AS lo, m.md + 5e0 * d.mad AS hi FROM (SELECT file, median("{metric}") AS md FROM {src} GROUP BY file) m
JOIN (SELECT s.file, median(abs(s."{metric}" - q.md)) AS mad FROM {src} s JOIN (SELECT file, median("{metric}") AS md FROM {src} GROUP BY file) q ON s.file = q.file GROUP BY s.file) d ON m.file = d.file"""


for c in ("CE", "IR_proxy", "DChg_Cap_Ah"):
    block(f"b4_{c}", ["labels4"], bounds("labels4", c))
add("A08_A09_robust_bounds", ["labels4"] + [f"b4_{c}" for c in ("CE", "IR_proxy", "DChg_Cap_Ah")], """
SELECT f.file, """ + ", ".join(f'{r6(f"{c}.lo", f"{c}_low")}, {r6(f"{c}.hi", f"{c}_high")}' for c in ("CE", "IR_proxy", "DChg_Cap_Ah")) + " FROM (SELECT DISTINCT file FROM labels4) f "
    + " ".join(f'LEFT JOIN b4_{c} {c} ON f.file = {c}.file' for c in ("CE", "IR_proxy", "DChg_Cap_Ah")))

HARD = ["MISSING_DATA", "UNDERCHARGE", "OVERSHOOT", "EARLY_STOP_NO_CUTOFF", "UNDERVOLTAGE", "LOW_LINEARITY", "CE_ABS", "IR_ABS"]
block("rkept", ["rstats"], """
SELECT * FROM (SELECT *, max("Cycle") OVER (PARTITION BY file) AS mx, count(*) OVER (PARTITION BY file) AS nc FROM rstats WHERE "Cycle" >= 4) WHERE "Cycle" < mx OR nc = 1""")


def choose(sheet: str, n: str, rec: str) -> str:
    return f'CASE WHEN (s."{sheet}" IS NULL OR s."{sheet}" = 0) AND r.{n} > 0 THEN r."{rec}" ELSE s."{sheet}" END'


block("rmet0", ["rkept", "lcycle", "lin", "smad", "res"], f"""
SELECT r.*, t_max_chg - t_min_chg AS t_charge_h, CASE WHEN n_dchg > 0 THEN t_max_dchg - t_min_dchg ELSE 0e0 END AS t_discharge_h,
  {choose("Chg_Cap_Ah_cycle", "n_chg", "rec_Ah_chg")} AS "Ah_chg", {choose("DChg_Cap_Ah_cycle", "n_dchg", "rec_Ah_dchg")} AS "Ah_dchg",
  {choose("Chg_Energy_Wh_cycle", "n_chg", "rec_Wh_chg")} AS "Wh_chg", {choose("DChg_Energy_Wh_cycle", "n_dchg", "rec_Wh_dchg")} AS "Wh_dchg", l.charge_r2, d.slope_mad, e."IR_est"
FROM rkept r LEFT JOIN lcycle s ON r.file = s.file AND r."Cycle" = s."Cycle" LEFT JOIN lin l ON r.file = l.file AND r."Cycle" = l."Cycle"
LEFT JOIN smad d ON r.file = d.file AND r."Cycle" = d."Cycle" LEFT JOIN res e ON r.file = e.file AND r."Cycle" = e."Cycle" """)
block("rmet", ["rmet0"], """
SELECT *, "HF_MISSING_DATA" OR "HF_UNDERCHARGE" OR "HF_OVERSHOOT" OR "HF_EARLY_STOP_NO_CUTOFF" OR "HF_UNDERVOLTAGE" OR "HF_LOW_LINEARITY" OR "HF_CE_ABS" OR "HF_IR_ABS" AS hard_fail FROM (
SELECT *, n_chg < 20 OR n_dchg < 20 AS "HF_MISSING_DATA", coalesce("V_end_chg" < 4.25e0, false) AS "HF_UNDERCHARGE", coalesce("V_max_chg" > 4.35e0, false) AS "HF_OVERSHOOT",
  coalesce(t_discharge_h < 1.2e0 AND "V_end_dchg" > 2.9e0, false) AS "HF_EARLY_STOP_NO_CUTOFF", coalesce("V_min_dchg" < 2.7e0, false) AS "HF_UNDERVOLTAGE", coalesce(charge_r2 < 0.93e0, false) AS "HF_LOW_LINEARITY",
  coalesce("CE" < 0.93e0 OR "CE" > 1.05e0, false) AS "HF_CE_ABS", coalesce("IR_est" > 0.3e0, false) AS "HF_IR_ABS",
  CASE WHEN "V_end_dchg" <= (2.9e0 - 0.1e0) + 0.15e0 THEN 'voltage_cutoff' WHEN t_discharge_h >= 1.5e0 - 0.05e0 THEN 'time_cutoff' ELSE 'unknown' END AS end_reason
FROM (SELECT *, "Ah_dchg" / nullif("Ah_chg", 0) AS "CE", "Wh_dchg" / nullif("Wh_chg", 0) AS "EE" FROM rmet0))""")
add("R05_R06_P12_P19_record_metrics", ["rmet"], f"""
SELECT {K}, {rq("V_end_chg", "V_max_chg", "t_charge_h", "Ah_chg", "V_min_dchg", "V_end_dchg", "t_discharge_h", "Ah_dchg", "Wh_chg", "Wh_dchg", "CE", "EE", "charge_r2", "slope_mad", "IR_est")},
  end_reason, hard_fail, {", ".join(f'"HF_{h}"' for h in HARD)} FROM rmet""")
WATCH = {"Ah_chg": "Ah_chg", "Ah_dchg": "Ah_dchg", "Wh_dchg": "Wh_dchg", "IR_est": "IR_est", "slope_mad": "slope_mad"}
for c in WATCH:
    block(f"rb_{c}", ["rmet"], bounds("rmet", c))
SOFT = ["Ah_chg_outlier", "Ah_dchg_outlier", "Wh_dchg_outlier", "time_dev", "CE_marginal", "IR_marginal", "slope_var"]
PEN = [15, 20, 15, 10, 10, 10, 10]


def out(c: str) -> str:
    return f'coalesce(r."{c}" < rb_{c}.lo OR r."{c}" > rb_{c}.hi, false)'


block("rlab", ["rmet"] + [f"rb_{c}" for c in WATCH], f"""
SELECT *, CASE WHEN hard_fail OR soft_score < 70e0 THEN 'BAD' ELSE 'GOOD' END AS "Label",
  concat_ws(', ', {", ".join(f"CASE WHEN \"HF_{h}\" THEN '{h}' END" for h in HARD)}, {", ".join(f"CASE WHEN \"SP_{s}\" THEN 'SP_{s}' END" for s in SOFT)}, 'end:' || end_reason) AS "Reasons"
FROM (SELECT *, 100e0 - {" - ".join(f'CASE WHEN "SP_{s}" THEN {p}e0 ELSE 0e0 END' for s, p in zip(SOFT, PEN))} AS soft_score FROM (
SELECT r.*, act AND ok AND {out("Ah_chg")} AS "SP_Ah_chg_outlier", act AND ok AND {out("Ah_dchg")} AS "SP_Ah_dchg_outlier", act AND ok AND {out("Wh_dchg")} AS "SP_Wh_dchg_outlier",
  act AND coalesce(abs(t_discharge_h - 1.5e0) > 0.10e0 * 1.5e0, false) AND NOT coalesce("V_end_dchg" <= 2.9e0 + 0.02e0, false) AS "SP_time_dev",
  act AND ok AND coalesce("CE" BETWEEN 0.93e0 AND 1.05e0, false) AND NOT coalesce("CE" BETWEEN 0.96e0 AND 1.02e0, false) AS "SP_CE_marginal",
  act AND ok AND {out("IR_est")} AND coalesce("IR_est" < 0.3e0, false) AS "SP_IR_marginal", act AND ok AND {out("slope_mad")} AS "SP_slope_var"
FROM (SELECT *, NOT hard_fail AND count(*) OVER (PARTITION BY file) > 5 AS act, NOT (coalesce("V_end_dchg" <= 2.9e0 + 0.03e0, false) AND coalesce("CE" BETWEEN 0.95e0 AND 1.03e0, false)) AS ok FROM rmet) r
{" ".join(f"LEFT JOIN rb_{c} ON r.file = rb_{c}.file" for c in WATCH)}))""")
add("R07_R08_P30_record_labels", ["rlab"], f"""SELECT {K}, {rq("soft_score")}, {", ".join(f'"SP_{s}"' for s in SOFT)}, "Label", "Reasons" FROM rlab""")
add("J04_R08_augmented_records", ["rlab", "record0"], """
SELECT r."Cycle", l."Label" AS "Cycle Label", l."Reasons" AS "Cycle Reasons", count(*) AS records, CAST(sum(r.rec_no) AS BIGINT) AS rec_sum
FROM record0 r LEFT JOIN rlab l ON r.file = l.file AND r."Cycle" = l."Cycle" GROUP BY ALL""")

# --- step ends ---------------------------------------------------------------

NAME_OF = "CASE n " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(NAMES)) + " END"


def picked(order: str) -> str:
    return f"""
SELECT *, {NAME_OF} AS name FROM (SELECT *, count(*) OVER (PARTITION BY {K}) AS total FROM (
  SELECT *, CASE WHEN ord = c_ord THEN 0 ELSE row_number() OVER (PARTITION BY {K}, is_dchg ORDER BY ord) END AS n FROM (
    SELECT *, min(ord) FILTER (is_chg) OVER (PARTITION BY {K}) AS c_ord FROM (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY {order}) AS ord FROM step))
  WHERE ord = c_ord OR (is_dchg AND ord > c_ord)) WHERE n <= 5) WHERE total = 6"""


ENDS = ", ".join(f'max(v) FILTER (name = \'{n}\') AS "{n}_V_end"' for n in NAMES) + ", max(t) FILTER (name = 'standby') AS standby_t_end_h"
END_COLS = [f"{n}_V_end" for n in NAMES] + ["standby_t_end_h"]
block("picked", ["step"], picked('"Oneset_Date" NULLS LAST, "End_Date" NULLS LAST, "Step_Number", src_ord'))
block("ends", ["picked"], f'SELECT {K}, {ENDS} FROM (SELECT *, "V_end" AS v, "Step_Time_h" AS t FROM picked) GROUP BY {K}')
block("good", ["labels4"], f"""SELECT {K} FROM labels4 WHERE "Label" = 'GOOD'""")
add("W02_L03_picked_steps", ["picked"], f"""SELECT {K}, CAST(n AS INTEGER) AS n, name, src_ord, {r6('"V_end"', "end_voltage_v")} FROM picked""")
add("W14_J07_good_step_ends_from_step", ["ends", "good"], f"SELECT e.file, e.\"Cycle\", {rq(*END_COLS)} FROM ends e SEMI JOIN good g ON e.file = g.file AND e.\"Cycle\" = g.\"Cycle\"")
add("W14_J05_all_step_ends_labelled", ["ends", "cyc"], f"""
SELECT e.file, e."Cycle", {rq(*END_COLS)}, {r6('"landing_V_end" - "charge_V_end"', "landing_V_rel_global")}, CASE WHEN k % 4 <> 0 THEN 'L' || (k % 3 + 1) END AS cycle_label_3name
FROM ends e JOIN cyc c ON e.file = c.file AND e."Cycle" = c."Cycle" WHERE e."Cycle" >= 4""")
block("picked2", ["step"], picked('"Step_Number" NULLS LAST, src_ord'))
block("ends2", ["picked2"], f'SELECT {K}, {ENDS} FROM (SELECT *, "V_end" AS v, "Step_Time_h" AS t FROM picked2) GROUP BY {K}')
add("W14_J07_label_audit", ["labels4", "ends2"], f"""
SELECT l.file, l."Cycle", upper(l."Label") AS label, e.file IS NOT NULL AS pattern_ok, {rq(*END_COLS)} FROM labels4 l LEFT JOIN ends2 e ON l.file = e.file AND l."Cycle" = e."Cycle" WHERE l."Cycle" >= 4""")

block("flight", ["step"], r"""
SELECT file, "Cycle", src_ord * 6 + s AS rec_no, CASE WHEN k % 3 = 0 THEN 'Step' ELSE "Step_Type" END AS step_type,
  CASE WHEN c % 9 <> 2 THEN make_timestamp(epoch_us("Oneset_Date") + CAST(floor(CAST((epoch_us("End_Date") - epoch_us("Oneset_Date")) * s AS DOUBLE) / 6e0) AS BIGINT)) END AS date,
  CASE WHEN "Step_Index" = 6 AND k % 31 = 0 THEN 0e0 ELSE coalesce("Step_Time_h", 0.3e0) * CAST(s AS DOUBLE) / 5e0 END AS time_h,
  coalesce("V_start", 3e0) + (coalesce("V_end", 3e0) - coalesce("V_start", 3e0)) * CAST(s AS DOUBLE) / 5e0 AS voltage_v
FROM (SELECT *, src_ord // 16 AS k, CAST(regexp_extract(file, '_(\d+)\.', 1) AS BIGINT) AS c FROM step) CROSS JOIN (SELECT unnest(range(6)) AS s)""")
block("segm", ["flight"], """
SELECT *, CAST(sum(reset) OVER (PARTITION BY file, "Cycle" ORDER BY pos) AS BIGINT) AS seg FROM (
SELECT *, CASE WHEN time_h + 1e-9 < lag(time_h) OVER (PARTITION BY file, "Cycle" ORDER BY pos) - 1e-9 THEN 1 ELSE 0 END AS reset FROM (
SELECT *, row_number() OVER (PARTITION BY file, "Cycle" ORDER BY date NULLS LAST, time_h, voltage_v, rec_no) AS pos FROM flight))""")
block("segpos", ["segm"], """
SELECT *, row_number() OVER (PARTITION BY file, "Cycle", seg ORDER BY pos) AS up, row_number() OVER (PARTITION BY file, "Cycle", seg ORDER BY pos DESC) AS down,
  CASE WHEN last_value(time_h) OVER (PARTITION BY file, "Cycle", seg ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) = 0
       THEN min(pos) FILTER (time_h = 0) OVER (PARTITION BY file, "Cycle", seg) ELSE max(pos) OVER (PARTITION BY file, "Cycle", seg) END AS endpos,
  contains(lower(step_type), 'cc chg') OR contains(lower(step_type), 'charge') AS is_c, contains(lower(step_type), 'cc dchg') OR contains(lower(step_type), 'discharge') AS is_d FROM segm""")
block("segends", ["segpos"], """
SELECT file, "Cycle", seg, n, end_voltage, end_time_h, CASE WHEN ca > da THEN 'charge' WHEN da > ca THEN 'discharge' WHEN rows_to_end >= 3 AND n = rows_to_end AND ve - vs > 0.02e0 AND vmax >= 4.25e0 THEN 'charge' ELSE 'discharge' END AS kind FROM (
SELECT file, "Cycle", seg, count(*) AS n, max(voltage_v) FILTER (pos = endpos) AS end_voltage, max(time_h) FILTER (pos = endpos) AS end_time_h,
  count(*) FILTER (pos <= endpos AND is_c) AS ca, count(*) FILTER (pos <= endpos AND is_d) AS da, count(*) FILTER (pos <= endpos) AS rows_to_end,
  median(voltage_v) FILTER (up <= 3) AS vs, median(voltage_v) FILTER (down <= 3) AS ve, max(voltage_v) AS vmax FROM segpos GROUP BY file, "Cycle", seg)""")
add("W03_W04_W05_segments", ["segends"], f"SELECT {K}, seg, n, kind, {rq('end_voltage', 'end_time_h')} FROM segends")
block("segchoice", ["segends"], f"""
SELECT s.*, s.seg - c.ci AS n0 FROM segends s JOIN (
  SELECT {K}, coalesce(min(seg) FILTER (kind = 'charge'), CASE WHEN max(end_voltage) >= 4.25e0 THEN min(seg) FILTER (end_voltage = mv) ELSE 0 END) AS ci, max(seg) AS ms
  FROM (SELECT *, max(end_voltage) OVER (PARTITION BY {K}) AS mv FROM segends) GROUP BY {K}) c ON s.file = c.file AND s."Cycle" = c."Cycle" WHERE s.seg BETWEEN c.ci AND c.ci + 5 AND c.ms >= c.ci + 5""")
block("recends", ["segchoice"], f"SELECT {K}, {ENDS} FROM (SELECT *, end_voltage AS v, end_time_h AS t, {NAME_OF.replace('CASE n ', 'CASE n0 ')} AS name FROM segchoice) GROUP BY {K}")
add("W06_L04_picked_segments", ["recends"], f"SELECT {K}, {rq(*END_COLS)} FROM recends")
block("winrows", ["picked", "good", "flight"], """
SELECT p.file, p."Cycle", p.name, f.time_h, f.voltage_v, row_number() OVER (PARTITION BY p.file, p."Cycle", p.name ORDER BY f.date DESC, f.time_h DESC, f.rec_no DESC) AS r
FROM picked p JOIN good g ON p.file = g.file AND p."Cycle" = g."Cycle" JOIN flight f ON p.file = f.file AND p."Cycle" = f."Cycle" AND f.date BETWEEN p."Oneset_Date" AND p."End_Date" """)
block("winends", ["winrows"], """
SELECT file, "Cycle", name, CASE WHEN t1 = 0 AND t2 = 0 THEN v2 ELSE v1 END AS v, CASE WHEN t1 = 0 AND t2 = 0 THEN t2 ELSE t1 END AS t FROM (
SELECT file, "Cycle", name, max(time_h) FILTER (r = 1) AS t1, max(time_h) FILTER (r = 2) AS t2, max(voltage_v) FILTER (r = 1) AS v1, max(voltage_v) FILTER (r = 2) AS v2 FROM winrows WHERE r <= 2 GROUP BY file, "Cycle", name)""")
block("stepwin", ["picked", "good", "winends", "recends"], f"""
SELECT {K}, {ENDS} FROM (SELECT p.file, p."Cycle", p.name, CASE WHEN w.file IS NOT NULL THEN w.v ELSE {"CASE p.name " + " ".join(f"WHEN '{n}' THEN r.\"{n}_V_end\"" for n in NAMES) + " END"} END AS v,
  CASE WHEN w.file IS NOT NULL THEN w.t WHEN p.name = 'standby' THEN r.standby_t_end_h END AS t
FROM picked p JOIN good g ON p.file = g.file AND p."Cycle" = g."Cycle" LEFT JOIN winends w ON p.file = w.file AND p."Cycle" = w."Cycle" AND p.name = w.name
LEFT JOIN recends r ON p.file = r.file AND p."Cycle" = r."Cycle") GROUP BY {K}""")
block("recgood", ["recends", "good"], """SELECT r.* FROM recends r SEMI JOIN good g ON r.file = g.file AND r."Cycle" = g."Cycle" """)
for name, a, b in (("W07_good_step_ends_from_record", "recgood", "stepwin"), ("W07_good_step_ends_from_step_dates", "stepwin", "recgood")):
    tag = {"recgood": "record", "stepwin": "step"}
    add(name, ["recgood", "stepwin"], f"""
SELECT {K}, '{tag[a]}' AS source, {rq(*END_COLS)} FROM {a}
UNION ALL SELECT {K}, '{tag[b]}', {", ".join(r6(f'"{c}"') for c in END_COLS)} FROM {b} b WHERE NOT EXISTS (SELECT 1 FROM {a} a WHERE a.file = b.file AND a."Cycle" = b."Cycle")""")
add("J06_labelled_file_match", [], """
SELECT 'Cell-' || c_custkey || '.xlsx' AS file, CASE c_custkey % 4 WHEN 0 THEN 'Cell-' || c_custkey || '_labeled.xlsx' WHEN 1 THEN 'cell_' || c_custkey || '_labeled.xlsx' WHEN 2 THEN 'CELL ' || c_custkey || '_labeled.xlsx' END AS labelled_file FROM customer""")
add("A12_step_end_summary", ["ends"], " UNION ALL ".join(
    f"""SELECT file, '{c}' AS metric, {r6(f'avg("{c}")', "mean")}, {r6(f'median("{c}")', "median")} FROM ends GROUP BY file UNION ALL SELECT '(all)', '{c}', {r6(f'avg("{c}")')}, {r6(f'median("{c}")')} FROM ends""" for c in END_COLS))

# --- fleet statistics --------------------------------------------------------

block("quant", ["labels4"], f"""
SELECT *, {MISSING} AS "Missing_Count", abs("CE" - 1e0) AS "CE_dev_abs", "HF_CHG_SPEC_HIGH" OR "HF_DCHG_SPEC_LOW" OR "HF_MISSING" AS hf, "SP_IR_OUTLIER" OR "SP_CE_SOFT" AS sf FROM labels4""")
add("A13_J11_failures_by_cycle", ["quant"], f"""
SELECT "Cycle", cycles, hard_fail_cnt, soft_fail_cnt, both_fail_cnt, {", ".join(f"round(100e0 * {k}_fail_cnt / cycles, 2) + 0e0 AS pct_{k}_fail" for k in ("hard", "soft", "both"))} FROM (
SELECT "Cycle", count(*) AS cycles, count(*) FILTER (hf) AS hard_fail_cnt, count(*) FILTER (sf) AS soft_fail_cnt, count(*) FILTER (hf AND sf) AS both_fail_cnt FROM quant GROUP BY "Cycle")""")
GM = ["Chg_Spec_mAhg", "DChg_Spec_mAhg", "Missing_Count", "IR_proxy", "CE_dev_abs"]
block("goodq", ["quant"], "SELECT * FROM quant WHERE \"Label\" = 'GOOD'")
add("A14_good_summary", ["goodq"], " UNION ALL ".join(f"""SELECT '{c}' AS metric, {r6(f'avg("{c}")', "mean_GOOD")}, {r6(f'median(CAST("{c}" AS DOUBLE))', "median_GOOD")} FROM goodq""" for c in GM))
block("checked", ["quant", "goodq"], """
SELECT *, "Q_pass_ChgSpec" AND "Q_pass_DChgSpec" AND "Q_pass_IRproxy" AND "Q_pass_CEdev" AS "Quantified_AllPass" FROM (
SELECT q.*, coalesce(q."Chg_Spec_mAhg" <= m.a, false) AS "Q_pass_ChgSpec", coalesce(q."DChg_Spec_mAhg" >= m.b, false) AS "Q_pass_DChgSpec", coalesce(q."IR_proxy" <= m.c, false) AS "Q_pass_IRproxy", coalesce(q."CE_dev_abs" <= m.d, false) AS "Q_pass_CEdev"
FROM quant q CROSS JOIN (SELECT median("Chg_Spec_mAhg") AS a, median("DChg_Spec_mAhg") AS b, median("IR_proxy") AS c, median("CE_dev_abs") AS d FROM goodq) m)""")
add("R09_J10_quantified_checks", ["checked"], f"""SELECT {K}, "Label", {rq("CE_dev_abs")}, "Q_pass_ChgSpec", "Q_pass_DChgSpec", "Q_pass_IRproxy", "Q_pass_CEdev", "Quantified_AllPass" FROM checked""")
PASS = {"pass_ChgSpec": "Q_pass_ChgSpec", "pass_DChgSpec": "Q_pass_DChgSpec", "pass_IRproxy": "Q_pass_IRproxy", "pass_CEdev": "Q_pass_CEdev", "pass_All": "Quantified_AllPass"}
add("A15_passes_by_file", ["checked"], f"""
SELECT file, cycles, {", ".join(f'"{p}", round(100e0 * "{p}" / cycles, 2) + 0e0 AS "pct_{p}"' for p in PASS)} FROM (
SELECT file, count(*) AS cycles, {", ".join(f'count(*) FILTER ("{c}") AS "{p}"' for p, c in PASS.items())} FROM checked GROUP BY file)""")

# --- model data --------------------------------------------------------------

PREP = ["CE", "IR_proxy", "DChg_Spec_mAhg", "Chg_Energy_Wh", "standby_V_end", "standby_t_end_h"]
block("split", ["master"], """
SELECT file, rank, rank <= ceil(g * 0.3e0) AS is_test FROM (SELECT file, row_number() OVER (ORDER BY md5(file || '#42')) AS rank, count(*) OVER () AS g FROM (SELECT DISTINCT file FROM master))""")
add("S12_S13_S14_L01_published", ["master", "split"], " UNION ALL ".join(
    f"SELECT '{name}' AS published, {n} AS rows, CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS added"
    for name, n in {"cycle_master": "(SELECT count(*) FROM master)", "labels": "(SELECT count(*) FROM master)", "split": "(SELECT count(*) FROM split)", "features": f"CAST({len(PREP)} AS BIGINT)"}.items()
))
add("M02_group_split", ["split"], "SELECT file, rank, is_test FROM split")
add("M02_J12_split_rows", ["split", "master"], """
SELECT m.cycle_label_3name, count(*) AS rows, count(DISTINCT m.file) AS files, CASE WHEN s.is_test THEN 'test' ELSE 'train' END AS side FROM master m JOIN split s ON m.file = s.file GROUP BY m.cycle_label_3name, s.is_test""")
add("M03_label_codes", ["master"], """
SELECT cycle_label_3name, CASE cycle_label_3name WHEN 'BAD' THEN 0 WHEN 'GOOD_drone' THEN 1 ELSE 2 END AS code, cycle_label_3name AS back, count(*) AS n FROM master GROUP BY cycle_label_3name""")
block("trainrows", ["master", "split"], "SELECT m.* FROM master m JOIN split s ON m.file = s.file WHERE NOT s.is_test")
add("A21_train_medians", ["trainrows"], " UNION ALL ".join(f"""SELECT '{c}' AS feature, {r6(f'median("{c}")', "median")} FROM trainrows""" for c in PREP))
block("imputed", ["master", "split", "trainrows"], "SELECT m.file, m.\"Cycle\", m.cycle_label_3name, s.is_test, " + ", ".join(f'coalesce(m."{c}", t."{c}") AS "{c}"' for c in PREP)
      + " FROM master m JOIN split s ON m.file = s.file CROSS JOIN (SELECT " + ", ".join(f'median("{c}") AS "{c}"' for c in PREP) + " FROM trainrows) t")
add("M04_M05_imputed_scaled", ["imputed"], "SELECT i.file, i.\"Cycle\", i.cycle_label_3name, CASE WHEN i.is_test THEN 'test' ELSE 'train' END AS side, "
    + ", ".join(r6(f'(i."{c}" - p."m_{c}") / p."s_{c}"', c) for c in PREP) + " FROM imputed i CROSS JOIN (SELECT "
    + ", ".join(f'avg("{c}") AS "m_{c}", stddev_pop("{c}") AS "s_{c}"' for c in PREP) + " FROM imputed WHERE NOT is_test) p")
add("M06_class_weights", ["master"], f"""
SELECT cycle_label_3name, n_class, {r6("CAST(sum(n_class) OVER () AS DOUBLE) / (count(*) OVER () * n_class)", "weight")} FROM (SELECT cycle_label_3name, count(*) AS n_class FROM master GROUP BY cycle_label_3name)""")
add("M18_score_band", ["master"], f"""
SELECT m.file, m."Cycle", m.cycle_label_3name, {r6('m."IR_proxy"', "IR_proxy")} FROM master m JOIN (SELECT cycle_label_3name, quantile_cont("IR_proxy", 0.1) AS lo, quantile_cont("IR_proxy", 0.9) AS hi FROM master WHERE "IR_proxy" IS NOT NULL GROUP BY 1) q
ON m.cycle_label_3name = q.cycle_label_3name WHERE m."IR_proxy" BETWEEN q.lo AND q.hi""")
# The experiment's grid: features per window by the training rule, and the sides of every seed's split.
POINTS = {1: 13, 2: 33, 5: 53, 10: 80, 20: 100, 30: 127, 50: 147, 60: 167}
SEEDS = (42, 43)


def sides(rows: str, seed: str) -> str:
    """Files of ``rows`` with the side that ``seed`` puts them on."""
    return f"""SELECT file, r <= ceil(g * 0.3e0) AS is_test FROM (SELECT file, row_number() OVER (ORDER BY md5(file || '#{seed}')) AS r, count(*) OVER () AS g FROM (SELECT DISTINCT file FROM {rows}))"""


for seed in SEEDS:
    block(f"side{seed}", ["master"], sides("master", seed))
    block(f"outer{seed}", ["master", f"side{seed}"], f"SELECT m.* FROM master m JOIN side{seed} s ON m.file = s.file WHERE NOT s.is_test")
    block(f"inner{seed}", [f"outer{seed}"], f"SELECT m.* FROM outer{seed} m JOIN ({sides(f'outer{seed}', seed)}) s ON m.file = s.file WHERE NOT s.is_test")
add("M10_experiment_points", ["master", *(f"side{s}" for s in SEEDS)], "SELECT w.window_sec, m.model, s.*, w.n_features FROM (" + " UNION ALL ".join(
    f"""SELECT {s} AS random_state, count(*) FILTER (NOT is_test) AS n_train, count(*) FILTER (is_test) AS n_test,
  count(DISTINCT m.file) FILTER (NOT is_test) AS train_files, count(DISTINCT m.file) FILTER (is_test) AS test_files FROM master m JOIN side{s} s ON m.file = s.file"""
    for s in SEEDS) + f""") s CROSS JOIN (VALUES ('RF'), ('GBT'), ('MLP')) AS m(model) CROSS JOIN (VALUES {", ".join(map(str, POINTS.items()))}) AS w(window_sec, n_features)""")
# The sweep's candidates: a fixed list that follows from its seed.
DRAW = random.Random(42)
TRIALS = [(n, round(DRAW.randrange(51) / 100, 2), round(0.75 + DRAW.randrange(26) / 100, 2), round(1.5 + DRAW.randrange(36) / 10, 1)) for n in range(100)]
add("M19_trial_sizes", [f"inner{s}" for s in SEEDS], """
SELECT random_state, trial, "inner", "outer", factor, cycle_label_3name, n_class, CAST(floor(n_class * factor) AS BIGINT) AS n_synthetic FROM (""" + " UNION ALL ".join(
    f"SELECT {s} AS random_state, cycle_label_3name, count(*) AS n_class FROM inner{s} GROUP BY cycle_label_3name" for s in SEEDS
) + ") CROSS JOIN (VALUES " + ", ".join(f"({t}, {i}e0, {o}e0, {f}e0)" for t, i, o, f in TRIALS) + """) AS t(trial, "inner", "outer", factor)""")
block("pred", ["master"], """
SELECT "Cycle" % 3 AS seed, CASE WHEN "Cycle" % 2 = 0 THEN 'a' ELSE 'b' END AS model, cycle_label_3name AS y_true,
  CASE WHEN "IR_proxy" > 0.5e0 THEN 'BAD' WHEN "DChg_Spec_mAhg" >= 150e0 THEN 'GOOD_drone' ELSE 'GOOD_not_drone' END AS y_pred FROM master""")
CL = "(VALUES ('BAD'), ('GOOD_drone'), ('GOOD_not_drone')) AS t(class)"


def report(by: str) -> str:
    lead = f"{by}, " if by else ""
    return f"""SELECT *, CASE WHEN prec + rec = 0 THEN 0e0 ELSE 2e0 * prec * rec / (prec + rec) END AS f1 FROM (
SELECT *, CASE WHEN predicted = 0 THEN 0e0 ELSE CAST(tp AS DOUBLE) / predicted END AS prec, CASE WHEN support = 0 THEN 0e0 ELSE CAST(tp AS DOUBLE) / support END AS rec FROM (
SELECT {lead}class, count(*) AS n, count(*) FILTER (y_true = y_pred) AS hits, count(*) FILTER (y_true = class AND y_pred = class) AS tp, count(*) FILTER (y_true = class) AS support, count(*) FILTER (y_pred = class) AS predicted
FROM pred CROSS JOIN {CL} GROUP BY {lead}class))"""


block("rep", ["pred"], report(""))
block("repby", ["pred"], report("model, seed"))
block("scored", ["repby"], """
SELECT model, seed, CAST(max(hits) AS DOUBLE) / max(n) AS accuracy, avg(f1) FILTER (support > 0 OR predicted > 0) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1 FROM repby GROUP BY model, seed""")
add("M11_scores", ["scored"], f"SELECT model, seed, {rq('accuracy', 'macro_f1', 'weighted_f1')} FROM scored")
add("M12_class_report", ["rep"], f"""SELECT class, {r6("prec", "precision")}, {r6("rec", "recall")}, {rq("f1")}, support FROM rep""")
add("M13_confusion_matrix", ["pred"], """
SELECT class AS y_true, count(*) FILTER (y_true = class AND y_pred = 'BAD') AS "BAD", count(*) FILTER (y_true = class AND y_pred = 'GOOD_drone') AS "GOOD_drone", count(*) FILTER (y_true = class AND y_pred = 'GOOD_not_drone') AS "GOOD_not_drone"
FROM pred CROSS JOIN """ + CL + " GROUP BY class")
add("M15_A20_mean_over_seeds", ["scored"], f"""SELECT model, {r6("avg(accuracy)", "accuracy")}, {r6("avg(macro_f1)", "macro_f1")}, {r6("avg(weighted_f1)", "weighted_f1")} FROM scored GROUP BY model""")
assert ESS

"""SQL building blocks: the cycler sheets and the stages as common table expressions.

Each block lists the blocks it reads; :func:`sql` emits them in order.  Double
literals are written with an exponent because plain decimals are exact types.
"""

from __future__ import annotations

BLOCKS: dict[str, tuple[list[str], str]] = {}


def block(name: str, needs: list[str], body: str) -> None:
    BLOCKS[name] = (needs, body)


def sql(needs: list[str], select: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for m in BLOCKS[n][0]:
            visit(m)
        order.append(n)

    for n in needs:
        visit(n)
    if not order:
        return select
    return "WITH " + ",\n".join(f"{n} AS ({BLOCKS[n][1]})" for n in order) + "\n" + select


def r6(expr: str, alias: str | None = None) -> str:
    out = f"round({expr}, 6) + 0e0"
    return f'{out} AS "{alias}"' if alias else out


block("cyc", [], """
SELECT 'cell_' || CAST(o_custkey AS VARCHAR) || '.xlsx' AS file,
       CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS "Cycle",
       o_orderkey AS k, o_custkey AS c, CAST(o_orderdate AS TIMESTAMP) AS d0
FROM orders""")


def m(n: int) -> str:
    return f"CAST(k % {n} AS DOUBLE)"


block("step", ["cyc"], f"""
SELECT file, k * 16 + i AS src_ord, "Cycle", CAST(i AS INTEGER) AS "Step_Index", CAST(i AS DOUBLE) AS "Step_Number",
  CASE WHEN i IN (1, 8) THEN 'CC Chg' WHEN i BETWEEN 2 AND 7 THEN 'CC DChg' ELSE 'Rest' END AS "Step_Type",
  i IN (1, 8) AS is_chg, i BETWEEN 2 AND 7 AS is_dchg,
  CASE WHEN i = 4 AND k % 37 = 0 THEN NULL WHEN i IN (1, 8) THEN 1.5e0
       WHEN i BETWEEN 2 AND 7 THEN 0.25e0 + {m(5)} * 0.01e0 ELSE 0.1e0 END AS "Step_Time_h",
  CASE WHEN NOT (i = 3 AND k % 53 = 0) THEN d0 + onset_s * INTERVAL 1 SECOND END AS "Oneset_Date",
  d0 + (onset_s + len_s) * INTERVAL 1 SECOND AS "End_Date",
  CASE WHEN i IN (1, 8) THEN 2e0 END AS "Chg_Cap_Ah",
  CASE WHEN i IN (1, 8) THEN 150e0 + {m(50)} END AS "Chg_Spec_mAhg",
  CASE WHEN i BETWEEN 2 AND 7 THEN 0.36e0 + {m(13)} * 0.005e0 END AS "DChg_Cap_Ah",
  CASE WHEN i BETWEEN 2 AND 7 THEN (110e0 + {m(60)}) * (CAST(i AS DOUBLE) - 1e0) / 5e0 END AS "DChg_Spec_mAhg",
  CASE WHEN k % 41 = 0 THEN NULL WHEN i IN (1, 8) THEN 8e0 + {m(17)} * 0.03e0
       WHEN i BETWEEN 2 AND 7 THEN 1.4e0 + {m(19)} * 0.01e0 END AS "Energy_Wh",
  CASE WHEN i IN (1, 8) THEN 3.2e0 + {m(7)} * 0.01e0 WHEN i BETWEEN 2 AND 7 THEN 4.2e0 - 0.2e0 * (CAST(i AS DOUBLE) - 1e0) END AS "V_start",
  CASE WHEN i IN (1, 8) THEN 4.26e0 + {m(7)} * 0.01e0
       WHEN i BETWEEN 2 AND 7 THEN 4.1e0 - 0.2e0 * CAST(i AS DOUBLE) - {m(11)} * 0.02e0 - CASE WHEN i = 5 AND k % 13 = 0 THEN 1e0 ELSE 0e0 END END AS "V_end"
FROM (
  SELECT *, CASE i WHEN 1 THEN -5400 WHEN 2 THEN 0 WHEN 3 THEN 20 WHEN 4 THEN 40 WHEN 5 THEN 70 WHEN 6 THEN 90 WHEN 7 THEN 110 WHEN 8 THEN 200 ELSE 130 END AS onset_s,
    CASE WHEN i = 1 THEN 5400 WHEN i = 4 THEN CASE WHEN k % 7 = 0 THEN 10 ELSE 30 END WHEN i = 8 THEN 100 WHEN i = 9 THEN 10 ELSE 20 END AS len_s
  FROM cyc CROSS JOIN (VALUES (1),(2),(3),(4),(5),(6),(7),(8),(9)) AS t(i)
  WHERE (i <= 6 AND NOT (c % 10 = 3 AND "Cycle" = 5 AND i = 6)) OR (i = 7 AND k % 59 = 0) OR (i = 8 AND k % 83 = 0) OR (i = 9 AND k % 5 = 0)
)""")

block("cycle_sheet", ["cyc"], f"""
SELECT file, k * 2 + copy AS src_ord, "Cycle",
  2e0 + {m(3)} * 0.01e0 AS "Chg_Cap_Ah_cycle", 150e0 + {m(50)} AS "Chg_Spec_mAhg_cycle",
  1.8e0 + {m(23)} * 0.02e0 AS "DChg_Cap_Ah_cycle", 110e0 + {m(60)} AS "DChg_Spec_mAhg_cycle",
  8e0 + {m(17)} * 0.03e0 AS "Chg_Energy_Wh_cycle",
  CASE WHEN k % 41 <> 0 THEN 7e0 + {m(19)} * 0.05e0 END AS "DChg_Energy_Wh_cycle"
FROM cyc CROSS JOIN (VALUES (1),(2)) AS t(copy)
WHERE k % 6 <> 0 AND (copy = 1 OR (c % 97 = 5 AND "Cycle" = 4))""")

block("record0", ["cyc"], f"""
SELECT file, c, k, k * 60 + i AS rec_no, "Cycle", CASE WHEN i < 24 THEN 'CC Chg' ELSE 'CC DChg' END AS step_type,
  i < 24 AS is_chg, i >= 24 AS is_dchg,
  d0 + (CASE WHEN i < 24 THEN i * 220 - 5400 ELSE (i - 24) * (2 + k % 3) END) * INTERVAL 1 SECOND AS record_date,
  CASE WHEN c % 8 <> 1 THEN CASE WHEN i < 24 THEN CAST(i AS DOUBLE) * 0.06e0
       ELSE CAST(i - 24 AS DOUBLE) * 0.042e0 * CASE WHEN k % 9 = 0 THEN 0.8e0 ELSE 1e0 END END END AS time_h,
  CAST(i AS DOUBLE) * 0.05e0 AS total_time_h,
  CASE WHEN i < 24 THEN 1e0 + {m(3)} * 0.1e0 ELSE -(2e0 + {m(4)} * 0.25e0 + 0.01e0 * CAST(i - 24 AS DOUBLE)) END * 1.00001371934562e0 AS current_a,
  CASE WHEN i < 24 THEN CASE WHEN k % 17 = 0 THEN 4.27e0 WHEN k % 19 = 0 THEN 4.3e0 - 0.1e0 * CAST((i * 7) % 5 AS DOUBLE)
         ELSE 3.6e0 + 0.03e0 * CAST(i AS DOUBLE) + 0.004e0 * CAST((i * k) % 3 AS DOUBLE) + {m(7)} * 0.01e0 END
       WHEN (k + i - 24) % 23 <> 0 THEN 4.2e0 - (0.01e0 + 0.009e0 * {m(4)}) * CAST(i - 24 AS DOUBLE) - {m(5)} * 0.003e0 * CAST((i - 24) % 4 AS DOUBLE) END AS voltage_v,
  CASE WHEN i < 24 THEN 0.08e0 * i ELSE 0.05e0 * (i - 24) END AS capacity_ah,
  CASE WHEN i < 24 THEN 6.5e0 * i ELSE 3.9e0 * (i - 24) END AS spec_cap,
  CASE WHEN i < 24 THEN 0.08e0 * i ELSE 0e0 END AS chg_cap, CASE WHEN i < 24 THEN 6.5e0 * i ELSE 0e0 END AS chg_spec,
  CASE WHEN i < 24 THEN 0e0 ELSE 0.05e0 * (i - 24) + {m(6)} * 0.005e0 END AS dchg_cap, CASE WHEN i < 24 THEN 0e0 ELSE 3.9e0 * (i - 24) END AS dchg_spec,
  CASE WHEN i < 24 THEN 0.33e0 * i ELSE 0.19e0 * (i - 24) END AS energy_wh,
  CASE WHEN c % 6 <> 0 THEN (CASE WHEN i < 24 THEN 1e0 + {m(3)} * 0.1e0 ELSE -(2e0 + {m(4)} * 0.25e0 + 0.01e0 * CAST(i - 24 AS DOUBLE)) END * 1.00001371934562e0) * 3.7e0 END AS power_raw
FROM cyc CROSS JOIN (SELECT unnest(range(60)) AS i)""")

block("record", ["record0"], """
SELECT *, CASE WHEN count(power_raw) OVER (PARTITION BY file) > 0 THEN power_raw ELSE voltage_v * current_a END AS power_w,
  CASE WHEN count(time_h) OVER (PARTITION BY file) > 0 THEN time_h * 3600e0
       WHEN count(total_time_h) OVER (PARTITION BY file) > 0 THEN total_time_h * 3600e0 END AS time_sec_raw
FROM record0""")

# --- structure ---------------------------------------------------------------

block("counts", ["step"], """
SELECT file, "Cycle", count(*) FILTER (is_chg) AS n_chg, count(*) FILTER (is_dchg) AS n_dchg FROM step GROUP BY file, "Cycle" """)
block("cand", ["counts"], """
SELECT * FROM (SELECT *, max("Cycle") OVER (PARTITION BY file) AS last_cycle FROM counts WHERE "Cycle" >= 4) WHERE "Cycle" < last_cycle""")
block("shortfile", ["cand"], """
SELECT file, min("Cycle") AS short_cycle, arg_min(n_dchg, "Cycle") AS short_count FROM cand WHERE n_dchg < 5 GROUP BY file""")
block("audited", ["cand", "shortfile"], """
SELECT c.file, c."Cycle", c.n_chg, c.n_dchg, s.file IS NOT NULL AS rejected_file,
  CASE WHEN n_chg <> 1 THEN 'skip_cycle_charge_count_' || n_chg WHEN n_dchg <> 5 THEN 'skip_cycle_dchg_count_' || n_dchg END AS reason
FROM cand c LEFT JOIN shortfile s ON c.file = s.file""")
block("valid", ["audited"], """SELECT file, "Cycle" FROM audited WHERE NOT rejected_file AND reason IS NULL""")
block("dupfile", ["cycle_sheet"], """
SELECT DISTINCT file FROM (SELECT file, "Cycle" FROM cycle_sheet GROUP BY file, "Cycle" HAVING count(*) > 1)""")
block("numbered", ["step"], """
SELECT *, row_number() OVER (PARTITION BY file, "Cycle", is_dchg ORDER BY "Step_Index") AS n FROM step WHERE is_chg OR is_dchg""")

PHASES = ["take_off", "hover", "cruise", "landing", "standby"]
NAMES = ["charge", *PHASES]
_PH = {"step_index": "Step_Index", "t_h": "Step_Time_h", "V_start": "V_start", "V_end": "V_end", "DChg_Cap_Ah": "DChg_Cap_Ah", "DChg_Spec_mAhg": "DChg_Spec_mAhg", "Energy_Wh": "Energy_Wh"}
_CH = {"charge_step_index": "Step_Index", "charge_t_h": "Step_Time_h", "charge_V_start": "V_start", "charge_V_end": "V_end", "Chg_Cap_Ah_step": "Chg_Cap_Ah", "Chg_Spec_mAhg_step": "Chg_Spec_mAhg", "Chg_Energy_Wh_step": "Energy_Wh"}
PIVOT_COLS = list(_CH) + [f"{p}_{s}" for p in PHASES for s in _PH]
_sel = [f'max("{src}") FILTER (is_chg AND n = 1) AS "{out}"' for out, src in _CH.items()]
_sel += [f'max("{src}") FILTER (is_dchg AND n = {i}) AS "{p}_{s}"' for i, p in enumerate(PHASES, 1) for s, src in _PH.items()]
_sel += [
    'sum("DChg_Cap_Ah") FILTER (is_dchg) AS "DChg_Cap_Ah_step_total"',
    'arg_max("DChg_Spec_mAhg", n) FILTER (is_dchg AND "DChg_Spec_mAhg" IS NOT NULL) AS "DChg_Spec_mAhg_step_last"',
    'sum("Energy_Wh") FILTER (is_dchg) AS "DChg_Energy_Wh_step_total"',
]
PIVOT_COLS += ["DChg_Cap_Ah_step_total", "DChg_Spec_mAhg_step_last", "DChg_Energy_Wh_step_total"]
block("pivoted", ["numbered"], 'SELECT file, "Cycle", ' + ",\n  ".join(_sel) + ' FROM numbered WHERE n <= 5 GROUP BY file, "Cycle"')

_T = {"Chg_Cap_Ah": "Chg_Cap_Ah_step", "Chg_Spec_mAhg": "Chg_Spec_mAhg_step", "DChg_Cap_Ah": "DChg_Cap_Ah_step_total", "DChg_Spec_mAhg": "DChg_Spec_mAhg_step_last", "Chg_Energy_Wh": "Chg_Energy_Wh_step", "DChg_Energy_Wh": "DChg_Energy_Wh_step_total"}
block("totals", ["pivoted", "valid", "dupfile", "cycle_sheet"], 'SELECT p.*, ' + ", ".join(
    f'CASE WHEN s.file IS NOT NULL THEN s."{k}_cycle" ELSE p."{v}" END AS "{k}"' for k, v in _T.items()
) + """ FROM pivoted p JOIN valid v ON p.file = v.file AND p."Cycle" = v."Cycle"
LEFT JOIN cycle_sheet s ON p.file = s.file AND p."Cycle" = s."Cycle"
WHERE p.file NOT IN (SELECT file FROM dupfile)""")
block("metrics", ["totals"], """
SELECT *, "DChg_Cap_Ah" / nullif("Chg_Cap_Ah", 0) AS "CE",
  "Chg_Energy_Wh" / nullif("Chg_Cap_Ah", 0) - "DChg_Energy_Wh" / nullif("DChg_Cap_Ah", 0) AS "IR_proxy",
  "take_off_t_h" + "hover_t_h" + "cruise_t_h" + "landing_t_h" + "standby_t_h" AS "standby_t_end_h",
  "landing_V_end" / nullif("charge_V_end", 0) AS "landing_V_rel_global"
FROM totals""")
ESS = ["Chg_Cap_Ah", "DChg_Cap_Ah", "Chg_Energy_Wh", "DChg_Energy_Wh", "CE"]
MISSING = " + ".join(f'CAST("{c}" IS NULL AS INTEGER)' for c in ESS)
block("master", ["metrics"], f"""
SELECT *, CASE cycle_label_3name WHEN 'BAD' THEN 0 WHEN 'GOOD_not_drone' THEN 1 ELSE 2 END AS cycle_label_3class FROM (
SELECT *, CASE WHEN "Label" = 'BAD' THEN 'BAD'
  WHEN coalesce("IR_proxy" <= 0.442e0 AND "DChg_Spec_mAhg" >= 140e0 AND "CE" BETWEEN 0.97e0 AND 1.03e0 AND "charge_V_end" >= 4.28e0
    AND "standby_V_end" >= 2.73e0 AND "landing_V_rel_global" >= 0.52e0, false) THEN 'GOOD_drone' ELSE 'GOOD_not_drone' END AS cycle_label_3name
FROM (SELECT *, CASE WHEN hard_fail OR soft_score < 70e0 THEN 'BAD' ELSE 'GOOD' END AS "Label" FROM (
SELECT *, 100e0 - CASE WHEN "SP_IR_OUTLIER" THEN 20e0 ELSE 0e0 END
  - CASE WHEN "SP_CE_SOFT" THEN 10e0 + 2e0 * floor((CASE WHEN "CE" < 0.95e0 THEN 0.95e0 - "CE" ELSE "CE" - 1.05e0 END) / 0.01e0) ELSE 0e0 END AS soft_score,
  "HF_CHG_SPEC_HIGH" OR "HF_DCHG_SPEC_LOW" OR "HF_MISSING" AS hard_fail
FROM (SELECT *, coalesce("Chg_Spec_mAhg" > 190e0, false) AS "HF_CHG_SPEC_HIGH", coalesce("DChg_Spec_mAhg" < 120e0, false) AS "HF_DCHG_SPEC_LOW",
  {MISSING} > 0 AS "HF_MISSING", {MISSING} AS "Missing_Count", coalesce("IR_proxy" > 0.385e0, false) AS "SP_IR_OUTLIER",
  coalesce("CE" < 0.95e0 OR "CE" > 1.05e0, false) AS "SP_CE_SOFT", 0.385e0 AS "IR_proxy_threshold", abs("CE" - 1e0) AS "CE_dev_abs"
FROM metrics))))""")

# --- alignment and grid ------------------------------------------------------

SERIES = ["voltage_v", "current_a", "power_w", "capacity_ah", "spec_cap", "chg_cap", "chg_spec", "dchg_cap", "dchg_spec", "energy_wh"]
block("phasewin", ["numbered", "valid"], """
SELECT n.file, n."Cycle", CAST(n.n AS INTEGER) AS ph, n."Oneset_Date" AS onset, n."End_Date" AS phase_end
FROM numbered n JOIN valid v ON n.file = v.file AND n."Cycle" = v."Cycle"
WHERE n.is_dchg AND n.n <= 3 AND n."Oneset_Date" IS NOT NULL AND n."End_Date" IS NOT NULL""")
block("inside", ["record", "phasewin"], """
SELECT r.*, p.ph, p.onset, p.phase_end FROM record r JOIN phasewin p ON r.file = p.file AND r."Cycle" = p."Cycle" AND r.record_date BETWEEN p.onset AND p.phase_end""")
block("offsets", ["inside"], """
SELECT * FROM (SELECT file, "Cycle", ph, t0, coalesce(sum(span) OVER (PARTITION BY file, "Cycle" ORDER BY ph ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS off,
  count(*) OVER (PARTITION BY file, "Cycle") AS np
FROM (SELECT file, "Cycle", ph, min(record_date) AS t0, CAST(epoch_us(max(record_date)) - epoch_us(min(record_date)) AS DOUBLE) / 1e6 AS span FROM inside GROUP BY file, "Cycle", ph)) WHERE np = 3""")
block("aligned", ["inside", "offsets"], """
SELECT i.*, CAST(epoch_us(i.record_date) - epoch_us(o.t0) AS DOUBLE) / 1e6 + o.off AS x FROM inside i JOIN offsets o ON i.file = o.file AND i."Cycle" = o."Cycle" AND i.ph = o.ph""")
block("points", ["aligned"], """
SELECT file, "Cycle", CAST(g AS DOUBLE) AS t, CAST(g AS INTEGER) AS t_sec FROM (SELECT DISTINCT file, "Cycle" FROM aligned) CROSS JOIN (SELECT unnest(range(61)) AS g)""")
for f in SERIES:
    block(f"sup_{f}", ["aligned"], f"""
SELECT file, "Cycle", x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1, count(*) OVER (PARTITION BY file, "Cycle") AS n
FROM (SELECT file, "Cycle", x, {f} AS y, row_number() OVER (PARTITION BY file, "Cycle", x ORDER BY ph, record_date, rec_no) AS rn FROM aligned WHERE {f} IS NOT NULL)
WHERE rn = 1 WINDOW w AS (PARTITION BY file, "Cycle" ORDER BY x)""")
    block(f"val_{f}", [f"sup_{f}", "points"], f"""
SELECT p.file, p."Cycle", p.t_sec, CASE WHEN s.n = 1 OR p.t = s.x0 THEN s.y0 ELSE (s.y1 - s.y0) / (s.x1 - s.x0) * (p.t - s.x0) + s.y0 END AS v
FROM points p JOIN sup_{f} s ON p.file = s.file AND p."Cycle" = s."Cycle"
AND ((s.n > 1 AND p.t >= s.x0 AND (p.t < s.x1 OR (s.x1 IS NULL AND p.t = s.x0))) OR (s.n = 1 AND abs(p.t - s.x0) <= 1e-8 + 1e-5 * abs(s.x0)))""")
block("grid", ["points"] + [f"val_{f}" for f in SERIES], 'SELECT p.file, p."Cycle", p.t_sec, ' + ", ".join(f"{f}.v AS {f}" for f in SERIES) + " FROM points p " + " ".join(
    f'LEFT JOIN val_{f} {f} ON p.file = {f}.file AND p."Cycle" = {f}."Cycle" AND p.t_sec = {f}.t_sec' for f in SERIES))
block("fullgrid", ["grid"], 'SELECT * EXCLUDE (okc) FROM (SELECT *, count(*) FILTER (' + " AND ".join(f"{f} IS NOT NULL" for f in SERIES) + ') OVER (PARTITION BY file, "Cycle") AS okc FROM grid) WHERE okc = 61')

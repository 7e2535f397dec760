"""Cycler sheets derived from the order tables.

The driver tables hold no telemetry, so every order becomes one cycle and every
customer one cell.  All orders are used, and sheet sizes grow with them.  The
sheets carry the source headers, so that the scans are exercised too.  A share
of the cycles is given structural defects, gaps and odd values on purpose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellframe.functions.lineage import materialise
from cellframe.functions.skew import running_index
from cellframe.sources import sheets

CHUNK = 4096  # order keys per numbering chunk
N_CHARGE, N_DISCHARGE = 24, 36  # records per cycle
_numbered: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, Cycle, k, c, d0): position of each order within its customer.

    Numbered once per application into a stage table that all sheets read.  The
    narrow rows are spread before they are written, so that the sheets' expansion
    runs on every core even when the order table is a single split.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _numbered:
        _numbered[key] = materialise(_number(spark, sf_dir))
    return _numbered[key]


def _number(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("timestamp").alias("d0"),
        F.floor(F.col("o_orderkey") / F.lit(CHUNK)).alias("chunk"),
    )
    numbered = running_index(o, ["c"], ["k"], ["chunk"], "n")
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return numbered.repartition(spread, "k").select(
        F.concat(F.lit("cell_"), F.col("c").cast("string"), F.lit(".xlsx")).alias("file"),
        F.col("n").cast("int").alias("Cycle"), "k", "c", "d0",
    )


def _every(n: int) -> Column:
    return F.pmod(F.col("k"), F.lit(n)) == 0


def _mod(n: int) -> Column:
    return F.pmod(F.col("k"), F.lit(n)).cast("double")


def _shift(ts: Column, secs: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + secs.cast("bigint") * F.lit(1000000))


def raw_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step sheet: 1 charge, 2-6 discharge, 7 extra discharge, 8 extra charge, 9 rest.

    What depends on the step alone is looked up in arrays.  Chains of cases made
    the generated method of the scan so long that the JVM left it uncompiled.
    """
    i = F.col("i")
    x = cycles(spark, sf_dir).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(9))))
    x = x.where(
        ((i <= 6) & ~((F.pmod("c", F.lit(10)) == 3) & (F.col("Cycle") == 5) & (i == 6)))
        | ((i == 7) & _every(59)) | ((i == 8) & _every(83)) | ((i == 9) & _every(5))
    )
    chg, dch = i.isin(1, 8), i.between(2, 7)
    d = i.cast("double")
    by_step = lambda *values: F.get(F.array(*[F.lit(v) for v in values]), i - 1)
    onset = by_step(-5400, 0, 20, 40, 70, 90, 110, 200, 130)
    length = by_step(5400, 20, 20, 30, 20, 20, 20, 100, 10) - F.when((i == 4) & _every(7), 20).otherwise(0)
    num = lambda v: F.lit(float(v))
    chg_cap = F.when(chg, num(2.0))
    chg_spec = F.when(chg, num(150) + _mod(50))
    dchg_cap = F.when(dch, num(0.36) + _mod(13) * num(0.005))
    dchg_spec = F.when(dch, (num(110) + _mod(60)) * (d - num(1)) / num(5))
    return x.select(
        "file", (F.col("k") * 16 + i).alias("src_ord"),
        F.col("Cycle").alias("Cycle Index"), i.alias("Step Index"), i.cast("double").alias("Step Number"),
        by_step(" CC Chg ", *["CC DChg"] * 6, " CC Chg ", "Rest").alias("Step Type"),
        F.when((i == 4) & _every(37), F.lit(None).cast("double")).when(chg, num(1.5)).when(dch, num(0.25) + _mod(5) * num(0.01)).otherwise(num(0.1)).alias("Step Time(h)"),
        F.when(~((i == 3) & _every(53)), _shift(F.col("d0"), onset)).alias("Oneset Date"),
        _shift(F.col("d0"), onset + length).alias("End Date"),
        F.coalesce(chg_cap, dchg_cap).alias("Capacity(Ah)"), F.coalesce(chg_spec, dchg_spec).alias("Spec. Cap.(mAh/g)"),
        chg_cap.alias("Chg. Cap.(Ah)"), chg_spec.alias("Chg. Spec. Cap.(mAh/g)"),
        dchg_cap.alias("DChg. Cap.(Ah)"), dchg_spec.alias("DChg. Spec. Cap.(mAh/g)"),
        F.when(~_every(41), F.when(chg, num(8.0) + _mod(17) * num(0.03)).when(dch, num(1.4) + _mod(19) * num(0.01))).alias("Energy(Wh)"),
        F.when(chg, num(3.2) + _mod(7) * num(0.01)).when(dch, num(4.2) - num(0.2) * (d - num(1))).alias("Oneset Volt.(V)"),
        F.when(chg, num(4.26) + _mod(7) * num(0.01)).when(
            dch, num(4.1) - num(0.2) * d - _mod(11) * num(0.02) - F.when((i == 5) & _every(13), num(1.0)).otherwise(num(0.0))
        ).alias("End Voltage(V)"),
    )


def raw_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycle sheet: five of six cycles are listed; some files list one cycle twice."""
    x = cycles(spark, sf_dir).where(~_every(6))
    twice = F.when((F.pmod("c", F.lit(97)) == 5) & (F.col("Cycle") == 4), F.sequence(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    x = x.withColumn("copy", F.explode(twice))
    num = lambda v: F.lit(float(v))
    return x.select(
        "file", (F.col("k") * 2 + F.col("copy")).alias("src_ord"), F.col("Cycle").alias("Cycle Index"),
        (num(2.0) + _mod(3) * num(0.01)).alias("Chg. Cap.(Ah)"), (num(150) + _mod(50)).alias("Chg. Spec. Cap.(mAh/g)"),
        (num(1.8) + _mod(23) * num(0.02)).alias("DChg. Cap.(Ah)"), (num(110) + _mod(60)).alias("DChg. Spec. Cap.(mAh/g)"),
        (num(8.0) + _mod(17) * num(0.03)).alias("Chg. Energy(Wh)"),
        F.when(~_every(41), num(7.0) + _mod(19) * num(0.05)).alias("DChg. Energy(Wh)"),
    )


def raw_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record sheet: 24 charge and 36 discharge samples per cycle."""
    n = N_CHARGE + N_DISCHARGE
    x = cycles(spark, sf_dir).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    i = F.col("i")
    chg = i < N_CHARGE
    ci = i.cast("double")
    j = (i - N_CHARGE).cast("double")
    num = lambda v: F.lit(float(v))
    slow = F.when(_every(9), num(0.8)).otherwise(num(1.0))
    v_chg = (
        F.when(_every(17), num(4.27))
        .when(_every(19), num(4.3) - num(0.1) * F.pmod(i * 7, F.lit(5)).cast("double"))
        .otherwise(num(3.6) + num(0.03) * ci + num(0.004) * F.pmod(ci.cast("bigint") * F.col("k"), F.lit(3)).cast("double") + _mod(7) * num(0.01))
    )
    v_dch = num(4.2) - (num(0.01) + num(0.009) * _mod(4)) * j - _mod(5) * num(0.003) * F.pmod(i - N_CHARGE, F.lit(4)).cast("double")
    v = F.when(chg, v_chg).when(F.pmod(F.col("k") + i - N_CHARGE, F.lit(23)) != 0, v_dch)
    # the factor keeps products with the voltage away from short decimals, whose rounding engines break differently
    cur = F.when(chg, num(1.0) + _mod(3) * num(0.1)).otherwise(-(num(2.0) + _mod(4) * num(0.25) + num(0.01) * j)) * num(1.00001371934562)
    secs = F.when(chg, i * 220 - 5400).otherwise((i - N_CHARGE) * (F.lit(2) + F.pmod("k", F.lit(3))))
    zero = num(0.0)
    return x.select(
        "file", (F.col("k") * n + i).alias("rec_no"), F.col("Cycle").alias("Cycle Index"),
        F.when(chg, F.lit("CC Chg")).otherwise(F.lit("CC DChg")).alias("Step Type"),
        _shift(F.col("d0"), secs).alias("Date"),
        F.when(F.pmod("c", F.lit(8)) != 1, F.when(chg, ci * num(0.06)).otherwise(j * num(0.042) * slow)).alias("Time(h)"),
        (ci * num(0.05)).alias("Total Time(h)"),
        cur.alias("Current(A)"), v.alias("Voltage(V)"),
        F.when(chg, num(0.08) * ci).otherwise(num(0.05) * j).alias("Capacity(Ah)"),
        F.when(chg, num(6.5) * ci).otherwise(num(3.9) * j).alias("Spec. Cap.(mAh/g)"),
        F.when(chg, num(0.08) * ci).otherwise(zero).alias("Chg. Cap.(Ah)"), F.when(chg, num(6.5) * ci).otherwise(zero).alias("Chg. Spec. Cap.(mAh/g)"),
        F.when(chg, zero).otherwise(num(0.05) * j + _mod(6) * num(0.005)).alias("DChg. Cap.(Ah)"), F.when(chg, zero).otherwise(num(3.9) * j).alias("DChg. Spec. Cap.(mAh/g)"),
        F.when(chg, num(0.33) * ci).otherwise(num(0.19) * j).alias("Energy(Wh)"),
        F.when(F.pmod("c", F.lit(6)) != 0, cur * num(3.7)).alias("Power(W)"),
    )


def step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.parse_step(raw_step(spark, sf_dir))


def cycle_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.parse_cycle(raw_cycle(spark, sf_dir))


def record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.parse_record(raw_record(spark, sf_dir))


def raw_flight_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record sheet with six samples per step and a step time that starts again at every step.

    A third of the cycles carry no telling step text, one file in nine has no
    dates, and some standby steps never advance their clock.
    """
    samples = 6
    x = raw_step(spark, sf_dir).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    k = F.floor(F.col("src_ord") / F.lit(16)).cast("bigint")
    s = F.col("s").cast("double")
    step_no = F.col("Step Index")
    onset, end = F.col("Oneset Date"), F.col("End Date")
    span = F.unix_micros(end) - F.unix_micros(onset)
    cell = F.regexp_extract("file", r"_(\d+)\.", 1).cast("bigint")
    date = F.when(F.pmod(cell, F.lit(9)) != 2, F.timestamp_micros(F.unix_micros(onset) + F.floor(span * F.col("s") / F.lit(samples)).cast("bigint")))
    still = (step_no == 6) & (F.pmod(k, F.lit(31)) == 0)
    time_h = F.when(still, F.lit(0.0)).otherwise(F.coalesce(F.col("Step Time(h)"), F.lit(0.3)) * s / F.lit(5.0))
    v0 = F.coalesce(F.col("`Oneset Volt.(V)`"), F.lit(3.0))
    v = v0 + (F.coalesce(F.col("End Voltage(V)"), F.lit(3.0)) - v0) * s / F.lit(5.0)
    kind = F.trim(F.col("Step Type"))
    return x.select(
        "file", (F.col("src_ord") * samples + F.col("s")).alias("rec_no"), "Cycle Index",
        F.when(F.pmod(k, F.lit(3)) == 0, F.lit("Step")).otherwise(kind).alias("Step Type"), date.alias("Date"), time_h.alias("Time(h)"),
        v.alias("Voltage(V)"), F.lit(1.0).alias("Current(A)"),
        F.lit(None).cast("double").alias("Chg. Cap.(Ah)"), F.lit(None).cast("double").alias("DChg. Cap.(Ah)"), F.lit(None).cast("double").alias("Energy(Wh)"),
    )


def legacy_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.parse_legacy_step(raw_step(spark, sf_dir)).withColumnRenamed("cycle_index", "Cycle")


def legacy_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellframe.operators.rules import first_per_cycle

    return first_per_cycle(sheets.parse_legacy_cycle(raw_cycle(spark, sf_dir)))


def legacy_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.parse_legacy_record(raw_record(spark, sf_dir)).withColumnRenamed("cycle_index", "Cycle")


def flight_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.parse_legacy_record(raw_flight_record(spark, sf_dir)).withColumnRenamed("cycle_index", "Cycle")

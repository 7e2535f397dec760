"""Building blocks that stay balanced when one key holds most of the rows.

The rule used throughout: only *bounded* groups go through a window or a
collected list.  Unbounded groups are reduced by aggregates that combine on
the map side, or are cut into ordered chunks first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellframe.functions.lineage import materialise

SALTS = 8
SALT = "_salt"
#: Distinct values of a key that one window may sort, cells a bracket is cut into, and brackets that may be broadcast.
FEW_VALUES = 50_000
CELLS = 64
FEW_BRACKETS = 10_000


def salt_of(columns: list[str], salts: int = SALTS) -> Column:
    """Reproducible salt: a hash of row content, so a retried task agrees with the first.

    It is never null, and says so: else a join would filter for it down to the
    scan, and a shuffle that the other side has as well would be run twice.
    """
    return F.coalesce(F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int"), F.lit(0))


def with_all_salts(lookup: DataFrame, salts: int = SALTS) -> DataFrame:
    return lookup.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def salted_lookup(
    rows: DataFrame,
    lookup: DataFrame,
    on: list[str],
    salt_from: list[str],
    how: str = "left",
    salts: int = SALTS,
) -> DataFrame:
    """Equi-join of ``rows`` (any skew on ``on``) with ``lookup`` (few rows per key).

    Rows of a hot key spread over ``salts`` reducers and the lookup row is
    repeated for each salt.  The salt also leaves an exchange in front of a
    later aggregate on ``on``, which therefore combines map-side, and which
    lets AQE split a partition that is still too large.  The planner's size
    estimates leave out what ``explode`` adds, so that it would broadcast the
    repeated lookup, or the rows, through the driver: a merge join is asked for.
    """
    return rows.withColumn(SALT, salt_of(salt_from, salts)).join(with_all_salts(lookup, salts).hint("merge"), [*on, SALT], how).drop(SALT)


def merge_join(rows: DataFrame, other: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join of two tables that both grow with the data.

    The planner takes a written table for as large as its compressed file, and
    a filtered or exploded one for no larger than its source, so that it would
    collect millions of rows in the driver to broadcast them.
    """
    return rows.join(other.hint("merge"), on, how)


def class_lookup(rows: DataFrame, lookup: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Equi-join with a lookup of one row per class or feature; that number bounds its broadcast."""
    return rows.join(F.broadcast(lookup), on, how)


def one_row(rows: DataFrame, single: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate; its broadcast size is one row by construction."""
    a = rows.withColumn("_one", F.lit(1))
    b = single.withColumn("_one", F.lit(1))
    return a.join(F.broadcast(b), "_one", "left").drop("_one")


def running_index(df: DataFrame, keys: list[str], order: list[str], chunk: list[str], name: str) -> DataFrame:
    """1-based position within ``keys`` by ``order`` without one task per key.

    ``chunk`` columns must not decrease along ``order``.  Each (key, chunk) is
    numbered on its own, and an offset table with one row per chunk shifts it.
    """
    per_chunk = df.groupBy(*keys, *chunk).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy(*chunk) if not keys else Window.partitionBy(*keys).orderBy(*chunk)
    offsets = per_chunk.select(
        *keys, *chunk,
        F.coalesce(F.sum("_n").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    within = Window.partitionBy(*keys, *chunk).orderBy(*order)
    return (
        merge_join(df.withColumn("_rn", F.row_number().over(within)), offsets, [*keys, *chunk])
        .withColumn(name, (F.col("_rn") + F.col("_before")).cast("bigint"))
        .drop("_rn", "_before")
    )


def rank_by_hash(df: DataFrame, keys: list[str], token: Column, name: str, digits: int = 3) -> DataFrame:
    """Dense 1-based rank by an md5 token (unique per row).

    The leading hex digits cut the rows into 16**digits equally likely chunks,
    so no task sorts more than its share even with a single key.
    """
    tagged = df.withColumn("_tok", F.md5(token)).withColumn("_head", F.substring("_tok", 1, digits))
    return running_index(tagged, keys, ["_tok"], ["_head"], name).drop("_tok", "_head")


def chunked_previous(
    df: DataFrame, keys: list[str], chunk: list[str], order: list[Column], carry: list[str], prefix: str = "prev_"
) -> DataFrame:
    """``lag`` of the ``carry`` columns over ``keys`` by ``order``, one chunk per task.

    The first row of a chunk takes the last row of the chunk before it, from a
    table with one row per (key, chunk).
    """
    w = Window.partitionBy(*keys, *chunk).orderBy(*[o.asc_nulls_last() for o in order])
    packed = F.struct(*[F.col(c) for c in carry])
    inside = df.withColumn("_prev", F.lag(packed).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    tails = (
        df.withColumn("_last", F.row_number().over(Window.partitionBy(*keys, *chunk).orderBy(*[o.desc_nulls_first() for o in order])))
        .where(F.col("_last") == 1)
        .select(*keys, *chunk, packed.alias("_tail"))
    )
    before = tails.select(
        *keys, *chunk, F.lag("_tail").over(Window.partitionBy(*keys).orderBy(*chunk)).alias("_carried")
    )
    prev = F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_prev"))
    out = merge_join(inside, before, [*keys, *chunk], "left").withColumn("_p", prev)
    for c in carry:
        out = out.withColumn(prefix + c, F.col(f"_p.{c}"))
    return out.drop("_prev", "_first", "_carried", "_p")


def chunked_running_sum(
    df: DataFrame, keys: list[str], chunk: list[str], order: list[Column], value: Column, name: str
) -> DataFrame:
    """Inclusive running sum over ``keys`` by ``order``, one chunk per task."""
    w = Window.partitionBy(*keys, *chunk).orderBy(*[o.asc_nulls_last() for o in order])
    local = df.withColumn("_local", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    totals = df.groupBy(*keys, *chunk).agg(F.sum(value).alias("_t"))
    shifted = totals.select(
        *keys, *chunk,
        F.coalesce(
            F.sum("_t").over(Window.partitionBy(*keys).orderBy(*chunk).rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_before"),
    )
    return (
        merge_join(local, shifted, [*keys, *chunk])
        .withColumn(name, F.col("_local") + F.col("_before"))
        .drop("_local", "_before")
    )


def _at_ranks(values: DataFrame, by: list[str], ranks: DataFrame) -> DataFrame:
    """Value at each 0-based rank: ``values`` (by, _v, _c) of bounded groups, ``ranks`` (by, _t, _rank) -> (by, _t, _x)."""
    upto = Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    cum = values.withColumn("_cum", F.sum("_c").over(upto)).withColumn("_start", F.col("_cum") - F.col("_c"))
    wanted = ranks.groupBy(*by).agg(F.collect_list(F.struct(F.col("_t").alias("t"), F.col("_rank").alias("rank"))).alias("_w"))  # two per probability
    here = lambda w: (w["rank"] >= F.col("_start")) & (w["rank"] < F.col("_cum"))
    hits = merge_join(cum, wanted, by).select(*by, "_v", F.explode(F.filter("_w", here)).alias("_hit"))
    return hits.select(*[c for c in by if c != "_t"], F.col("_hit.t").alias("_t"), F.col("_v").alias("_x"))


def _bracketed(counts: DataFrame, brackets: DataFrame, ks: list[str], few: bool) -> DataFrame:
    """Counts beside the brackets of their key that hold them; ``few`` brackets are broadcast."""
    j = class_lookup(counts, brackets, ks, "inner") if few else salted_lookup(counts, brackets, ks, ["_v"], how="inner")
    return j.where(F.col("_v").between(F.col("_lo"), F.col("_hi")))


def _narrowed(counts: DataFrame, ks: list[str], brackets: DataFrame) -> DataFrame:
    """One pass of the rank search: every bracket (ks, _t, _rank, _lo, _hi) shrinks to the cell that holds its rank.

    Cells are cut at approximate quantiles of the distinct values in the bracket,
    then counted exactly; ``_rank`` goes on counting from the cell's first value.
    """
    here = [*ks, "_t"]
    few = brackets.count() <= FEW_BRACKETS
    inside = _bracketed(counts, brackets, ks, few)
    cuts = inside.groupBy(*here).agg(F.percentile_approx("_v", F.array(*[F.lit(k / CELLS) for k in range(1, CELLS)]), F.lit(100 * CELLS)).alias("_cuts"))
    celled = (class_lookup(inside, cuts, here, "inner") if few else salted_lookup(inside, cuts, here, ["_v"], how="inner")).withColumn("_cell", F.size(F.filter("_cuts", lambda x: x < F.col("_v"))))
    cells = celled.groupBy(*here, "_rank", "_cell").agg(
        F.sum("_c").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_distinct"),
    )
    start = F.coalesce(F.sum("_c").over(Window.partitionBy(*here).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumn("_start", start).where((F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_start") + F.col("_c")))
    return cells.select(*here, (F.col("_rank") - F.col("_start")).alias("_rank"), "_lo", "_hi", "_distinct")


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], limit: int = FEW_VALUES
) -> DataFrame:
    """Exact linearly interpolated quantiles per key, for all keys and probabilities at once.

    Rows are reduced to (key, value, count) first, a table spread by key and
    value.  A rank is read off a sorted window only where that holds at most
    ``limit`` distinct values.  Larger keys are searched: repeated distributed
    counts narrow each rank's bracket to one of ``CELLS`` cells a pass, until
    ``limit`` values are left in it, so no task ever holds a key.  ``probs`` maps
    output column to probability.  Nulls are ignored.
    """
    const = "_all"
    ks = keys or [const]
    rows = df.where(F.col(value).isNotNull()).select(*(keys or [F.lit(0).alias(const)]), F.col(value).cast("double").alias("_v"))
    counts = materialise(rows.groupBy(*ks, "_v").agg(F.count(F.lit(1)).alias("_c")))
    sizes = counts.groupBy(*ks).agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_distinct"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    h = {n: (F.col("_n") - 1) * F.lit(float(p)) for n, p in probs.items()}
    targets = F.array(*[F.struct(F.lit(2 * i + j).alias("_t"), (F.ceil(x) if j else F.floor(x)).cast("long").alias("_rank")) for i, x in enumerate(h.values()) for j in (0, 1)])
    largest = sizes.agg(F.max("_distinct")).first()[0]
    if largest is None or largest <= limit:
        ranks = sizes.select(*ks, F.explode(targets).alias("_w")).select(*ks, "_w.*")
        found = _at_ranks(counts, ks, ranks)
    else:
        brackets = materialise(sizes.select(*ks, "_lo", "_hi", "_distinct", F.explode(targets).alias("_w")).select(*ks, "_w.*", "_lo", "_hi", "_distinct"))
        while True:
            brackets = materialise(_narrowed(counts, ks, brackets.drop("_distinct")))
            if brackets.agg(F.max("_distinct")).first()[0] <= limit:
                break
        inside = _bracketed(counts, brackets, ks, brackets.count() <= FEW_BRACKETS)
        found = _at_ranks(inside.select(*ks, "_t", "_v", "_c"), [*ks, "_t"], brackets.select(*ks, "_t", "_rank"))
    picked = found.groupBy(*ks).agg(*[F.max(F.when(F.col("_t") == t, F.col("_x"))).alias(f"_x{t}") for t in range(2 * len(probs))])
    both = merge_join(picked, sizes.select(*ks, "_n"), ks)
    out = both.select(*ks, *[
        (F.col(f"_x{2 * i}") + (F.col(f"_x{2 * i + 1}") - F.col(f"_x{2 * i}")) * (x - F.floor(x))).alias(n) for i, (n, x) in enumerate(h.items())
    ])
    return out if keys else out.drop(const)


def exact_mad(
    df: DataFrame, keys: list[str], value: str, salt_from: list[str], median: str = "median", mad: str = "mad"
) -> DataFrame:
    """Median and unscaled median absolute deviation per key.

    ``salt_from`` names columns that tell the rows of one key apart.
    """
    rows = df.where(F.col(value).isNotNull())
    if not keys:
        rows = rows.withColumn("_all_rows", F.lit(0))
    ks = keys or ["_all_rows"]
    med = exact_quantiles(rows, ks, value, {median: 0.5})
    dev = salted_lookup(rows.select(*dict.fromkeys([*ks, *salt_from, value])), med, ks, salt_from, how="inner")
    spread = exact_quantiles(dev.withColumn("_dev", F.abs(F.col(value) - F.col(median))), ks, "_dev", {mad: 0.5})
    out = merge_join(med, spread, ks, "left")
    return out if keys else out.drop("_all_rows")

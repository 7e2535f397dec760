"""Shards of near equal size by best-fit-decreasing bin packing of indivisible groups.

Rows with equal texts form a group and stay together.  Groups that weigh more
than one part in ``fineness`` of a shard are items of their own, all smaller
ones are bundled by hash, so that the number of items is bounded by the number
of shards and not by the data.  A group that no shard can hold is split.  Items
then enter, largest first, the bin with the tightest remaining capacity that
takes them; a balanced tree keeps the capacities in order.  Many shards are
packed as independent ranges of items, one task each.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellframe.functions.lineage import materialise
from cellframe.functions.skew import running_index

FINENESS = 512
SHARDS_PER_RANGE = 64
ROWS_PER_CHUNK = 100_000
PIECES = 32  # that a shard's worth of a group too large for one is cut into


class CapacityTree:
    """Sorted (remaining, bin) pairs in leaves of bounded size: a balanced search tree of two levels."""

    LEAF = 64

    def __init__(self) -> None:
        self.leaves: list[list[tuple[int, int]]] = []
        self.tops: list[tuple[int, int]] = []

    def add(self, pair: tuple[int, int]) -> None:
        if not self.leaves:
            self.leaves, self.tops = [[pair]], [pair]
            return
        k = min(bisect_left(self.tops, pair), len(self.leaves) - 1)
        leaf = self.leaves[k]
        insort(leaf, pair)
        self.tops[k] = leaf[-1]
        if len(leaf) > self.LEAF:
            half = len(leaf) // 2
            self.leaves[k : k + 1] = [leaf[:half], leaf[half:]]
            self.tops[k : k + 1] = [leaf[half - 1], leaf[-1]]

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least remaining capacity that is at least ``size``."""
        k = bisect_left(self.tops, (size, -1))
        if k == len(self.leaves):
            return None
        leaf = self.leaves[k]
        pair = leaf.pop(bisect_left(leaf, (size, -1)))
        if leaf:
            self.tops[k] = leaf[-1]
        else:
            del self.leaves[k], self.tops[k]
        return pair


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """Bin of each item, for items in decreasing size; a new bin opens only when none has room."""
    tree, bins, out = CapacityTree(), 0, []
    for size in sizes:
        found = tree.take_tightest(size)
        if found is None:
            found, bins = (max(capacity, size), bins), bins + 1
        tree.add((found[0] - size, found[1]))
        out.append(found[1])
    return out


def tightest(sizes: list[int], bins: int) -> list[int]:
    """Best-fit-decreasing with the least capacity tried that needs no more than ``bins`` bins."""
    even, spare = -(-sum(sizes) // bins), 0
    while True:
        out = best_fit(sizes, max(even + spare, sizes[0]))
        if max(out) < bins:
            return out
        spare = max(spare * 2, even >> 14, 1)


def assign(docs: DataFrame, shards: int | None = None, capacity: int | None = None, text: str = "text", fineness: int = FINENESS, carry: list[str] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, shard and slot, without the text.

    Give the number of ``shards``, which then get near equal bytes, or the
    ``capacity`` in bytes of each.  The size of a row is its text's UTF-8 bytes
    (null: none) plus 1; a null text groups with empty ones.  ``slot`` counts
    the rows of a shard from 0.  Repeated rows and null doc_ids are rows like
    any other; an empty table gives no rows.  A group that no shard can hold is
    split by row, whatever its ids.  ``carry`` names columns to pass through.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = materialise(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(body.cast("binary"), 256)).alias("key"),
        F.monotonically_increasing_id().alias("row"), *[F.col(c).alias(f"_{c}") for c in carry],
    ))
    n_rows, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    if shards:
        ranges, room = 1, -(-total // shards)
    else:
        ranges, room = total // (capacity * SHARDS_PER_RANGE) + 1, capacity
    room = max(room, 1)
    bundles = fineness * max(1, -(-total // room))
    heavy = rows.groupBy("key").agg(F.sum("size").alias("bytes")).where(F.col("bytes") * bundles > total)
    pieces = F.when(F.col("bytes") > room, F.ceil(F.col("bytes") * PIECES / room)).otherwise(1).cast("long")
    heavy = heavy.select("key", pieces.alias("pieces"))  # fewer rows than there are bundles
    if bundles <= 100_000:
        heavy = F.broadcast(heavy)
    item = F.when(
        F.col("pieces").isNull(), F.concat(F.lit("b"), F.pmod(F.xxhash64("key"), F.lit(bundles))),
    ).otherwise(F.concat(F.hex("key"), F.lit("-"), F.pmod(F.xxhash64("row"), F.col("pieces"))))
    placed = rows.join(heavy, "key", "left").select("doc_id", "size", "text_crc32", "key", "row", item.alias("item"), *[f"_{c}" for c in carry])
    items = placed.groupBy("item").agg(F.sum("size").alias("bytes")).withColumn("part", F.pmod(F.xxhash64("item"), F.lit(ranges)))

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "item"], ascending=[False, True])
        sizes = [int(x) for x in pdf["bytes"]]
        return pdf[["part", "item"]].assign(bin=tightest(sizes, shards) if shards else best_fit(sizes, capacity))

    bins = materialise(items.groupBy("part").applyInPandas(packed, "part long, item string, bin long"))
    used = bins.groupBy("part").agg((F.max("bin") + 1).alias("n"))  # one row per range
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = bins.join(used.select("part", before.alias("before")), "part").select("item", (F.col("bin") + F.col("before")).cast("int").alias("shard"))
    if bundles <= 100_000:
        bins = F.broadcast(bins)
    chunks = n_rows // ROWS_PER_CHUNK + 1
    out = placed.join(bins, "item").withColumn("_chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)))
    out = running_index(out, ["shard"], ["doc_id", "key", "row"], ["_chunk"], "slot")
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("slot") - 1).alias("slot"), *[F.col(f"_{c}").alias(c) for c in carry])


def write_shards(docs: DataFrame, path: str, shards: int | None = None, capacity: int | None = None) -> None:
    """The rows of ``docs`` as Parquet, one folder per shard, with their slot; other columns of ``docs`` stay out but for the text."""
    placed = assign(docs, shards, capacity, carry=["text"])
    placed.select("doc_id", "text", "shard", "slot").repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

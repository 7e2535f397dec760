"""Merkle manifest of a document table: a leaf per row, a tree per language, a tree over the languages.

Leaves get their places without being sorted.  Per language and range of 32,768
ids a bitmap holds the ids that occur; a directory holds the popcounts of all
bitmaps before it, and each bitmap the popcounts at every 256th byte.  The rank
of an id, a directory entry and a popcount within at most 256 bytes, is its
leaf's place.  An id that occurs on several rows stands in further bitmaps, one
per binary digit of its count (a bit-sliced index), which weigh 2, 4, 8 and so on.

Nodes are then dealt to blocks by place: 1,024 slots are filled by place and
reduced by ten levels in a task; their tops are the nodes of the next tier.
Proofs go the other way: each block's path to the root is handed to its slots.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellframe.functions.lineage import materialise
from cellframe.functions.skew import chunked_running_sum, salted_lookup
from cellframe.llm.common import rows_of

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")  # fixed value: what a leaf covers, in this order
LEVELS = 10
ID_BITS = 15
NO_ID = -(1 << 48) - 1  # below every range of 2**15 signed 64-bit ids
ROWS_PER_READ = 8

RANK = """aggregate(slices, 0L, (n, s) -> n + shiftleft(
  s.counts[cast(id_pos div 2048 as int)]
  + bitmap_count(substring(s.bits, cast(id_pos div 2048 as int) * 256 + 1, cast(id_pos div 8 as int) - cast(id_pos div 2048 as int) * 256))
  + bit_count(cast(conv(hex(substring(s.bits, cast(id_pos div 8 as int) + 1, 1)), 16, 10) as int) & (shiftleft(1, cast(id_pos % 8 as int)) - 1)),
  s.slice))"""


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode("ascii")).hexdigest()


def leaf(fields: dict[str, Column]) -> Column:
    """SHA-256 of the fields: ``-`` for a null, else UTF-8 byte count, colon and value."""

    def part(c: Column) -> Column:
        c = c.cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))

    return F.unhex(F.sha2(F.concat(*[part(fields[n]) for n in FIELDS]).cast("binary"), 256))


def levels_of(n: int, most: int) -> int:
    """Levels, at ``most`` so many, that a block of a tree with ``n`` nodes in this tier is reduced by."""
    return min(most, (n - 1).bit_length())


def tiers(hashes: list[str], levels: int) -> list[list[str]]:
    """The nodes of each level, from the given ones up; a last node without a partner is hashed alone."""
    out = [hashes]
    for _ in range(levels):
        below = out[-1]
        out.append([digest(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return out


def path_of(levels: list[list[str]], slot: int) -> list[str]:
    """Steps from a slot to the top of its block: L or R with the sibling on that side, or - for none."""
    steps = []
    for nodes in levels[:-1]:
        beside = slot ^ 1
        steps.append("-" if beside >= len(nodes) else ("L" if beside < slot else "R") + nodes[beside])
        slot >>= 1
    return steps


def fold(node: str, path: list[str]) -> str:
    """The root that follows from a node and the steps above it."""
    for step in path:
        node = digest(step[1:], node) if step[0] == "L" else digest(node, step[1:]) if step[0] == "R" else digest(node)
    return node


def _filled(slots: list[dict]) -> list[str]:
    out: list[str | None] = [None] * sum(s["count"] for s in slots)
    for s in slots:
        out[s["at"] : s["at"] + s["count"]] = [s["hash"].hex()] * s["count"]
    return out


def ordered_totals(df: DataFrame, group: list[str], order: list[str], weight: str) -> DataFrame:
    """``df`` with before (weight of the rows of its group ahead of it) and total (of the group).

    Rows are dealt to ranges, ranges are summed, and only rows of one range meet in a window.
    """
    part = materialise(df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()))
    ahead = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = part.groupBy(*group, "_part").agg(F.sum(weight).alias("_sum"))
    sums = sums.select(*group, "_part", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"), F.sum("_sum").over(Window.partitionBy(*group)).alias("total"))
    within = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = part.select(*group, *order, "_part", F.coalesce(F.sum(weight).over(within), F.lit(0)).alias("_inside"))
    places = inside.join(sums, [*group, "_part"]).select(*group, *order, (F.col("_ahead") + F.col("_inside")).cast("long").alias("before"), F.col("total").cast("long").alias("total"))
    return part.drop("_part").join(places, [*group, *order])


def rank_index(ids: DataFrame) -> DataFrame:
    """The bitmaps of ids (tree, bucket, id_pos, rows) with their directories: tree, bucket, slices, before, total."""
    digits = F.when(F.col("rows") == 1, F.array(F.lit(0))).otherwise(F.expr("filter(sequence(0, 62), b -> getbit(rows, b) = 1)"))
    bits = ids.select("tree", "bucket", "id_pos", F.explode(digits).alias("slice")).groupBy("tree", "bucket", "slice").agg(F.bitmap_construct_agg("id_pos").alias("bits"))
    counts = F.expr("transform(sequence(0, 15), i -> bitmap_count(substring(bits, 1, i * 256)))")
    index = bits.groupBy("tree", "bucket").agg(
        F.collect_list(F.struct("slice", "bits", counts.alias("counts"))).alias("slices"), F.sum(F.expr("shiftleft(bitmap_count(bits), slice)")).alias("rows"),
    )
    return ordered_totals(index, ["tree"], ["bucket"], "rows")


def leaf_places(rows: DataFrame) -> DataFrame:
    """Places of leaves (tree, bucket, id_pos, leaf, tampered, copies): start, the place of its first copy, and n, the tree's leaves."""
    ids = materialise(rows.groupBy("tree", "bucket", "id_pos").agg(
        F.sum("copies").alias("rows"), F.count(F.lit(1)).alias("leaves"), F.min("leaf").alias("leaf"), F.min("tampered").alias("tampered"),
    ))
    index = materialise(rank_index(ids))
    rank = F.expr(RANK)
    placed = ids.join(index.drop("rows"), ["tree", "bucket"]).select(*ids.columns, (F.col("before") + rank).alias("start"), F.col("total").alias("n"))
    placed = materialise(placed)
    one = placed.where("leaves = 1").select("tree", "bucket", "id_pos", "leaf", "tampered", F.col("rows").alias("copies"), "start", "n")
    # Different rows of one id follow each other by hash; cut by its first digits, so that no task sorts a hot id.
    shared = placed.where("leaves > 1").select("tree", "bucket", "id_pos", "start", "n")
    several = salted_lookup(rows, shared, ["tree", "bucket", "id_pos"], ["leaf"], how="inner").withColumn("_head", F.substring(F.hex("leaf"), 1, 3))
    several = chunked_running_sum(several, ["tree", "bucket", "id_pos"], ["_head"], [F.col("leaf"), F.col("tampered")], F.col("copies"), "_upto")
    several = several.withColumn("start", F.col("start") + F.col("_upto") - F.col("copies"))
    return one.unionByName(several.select(*one.columns))


def blocks_of(runs: DataFrame, levels: int, extra: list[str] = ()) -> DataFrame:
    """Slot arrays: runs (tree, start, copies, n, hash) dealt to blocks of 2**levels places."""
    size = 1 << levels
    first, last = F.expr(f"start div {size}"), F.expr(f"(start + copies - 1) div {size}")
    cut = runs.withColumn("block", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("start"), F.col("block") * size)
    high = F.least(F.col("start") + F.col("copies"), (F.col("block") + 1) * size)
    slot = F.struct((low - F.col("block") * size).cast("int").alias("at"), (high - low).cast("int").alias("count"), "hash", *extra)
    return cut.groupBy("tree", "block").agg(F.max("n").alias("n"), F.collect_list(slot).alias("slots"))


def _tops(batches: Iterator[pa.RecordBatch], levels: int) -> Iterator[pa.RecordBatch]:
    for rows in rows_of(batches, ROWS_PER_READ):
        top = [bytes.fromhex(tiers(_filled(s), levels_of(n, levels))[-1][0]) for s, n in zip(rows["slots"], rows["n"])]
        yield pa.RecordBatch.from_pydict({
            "tree": pa.array(rows["tree"], pa.string()), "start": pa.array(rows["block"], pa.int64()), "hash": pa.array(top, pa.binary()),
            "n": pa.array([-(-n >> levels) for n in rows["n"]], pa.int64()),
        })


def climb(lowest: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """Block tables of all tiers, the given one first, and the top of each tree (tree, hash)."""
    stack, tops = [lowest], []
    while True:
        slots = F.transform("slots", lambda s: F.struct(s["at"].alias("at"), s["count"].alias("count"), s["hash"].alias("hash")))
        bare = stack[-1].select("tree", "block", "n", slots.alias("slots"))
        nodes = materialise(bare.mapInArrow(partial(_tops, levels=levels), "tree string, start long, hash binary, n long"))
        tops.append(nodes.where("n = 1").select("tree", "hash"))
        more = nodes.where("n > 1")
        if more.isEmpty():
            return stack, reduce(DataFrame.unionByName, tops)
        stack.append(materialise(blocks_of(more.withColumn("copies", F.lit(1)), levels)))


def _handed(tier: DataFrame, above: DataFrame | None, ends: DataFrame, levels: int) -> DataFrame:
    """Blocks with the path above their top: a whole tree's from ``ends`` (tree, path, ...), others' from the tier above."""
    whole = tier.where(F.col("n") <= 1 << levels).join(ends, "tree")
    if above is None:
        return whole
    part = tier.where(F.col("n") > 1 << levels).join(above.withColumnRenamed("start", "block"), ["tree", "block"])
    return whole.unionByName(part)


def _steps(batches: Iterator[pa.RecordBatch], levels: int) -> Iterator[pa.RecordBatch]:
    for rows in rows_of(batches, ROWS_PER_READ):
        for tree, block, n, slots, path in zip(rows["tree"], rows["block"], rows["n"], rows["slots"], rows["path"]):
            nodes = tiers(_filled(slots), levels_of(n, levels))
            size = len(nodes[0])
            yield pa.RecordBatch.from_pydict({
                "tree": pa.array([tree] * size, pa.string()), "start": pa.array(range(block << levels, (block << levels) + size), pa.int64()),
                "path": pa.array([path_of(nodes, i) + path for i in range(size)], pa.list_(pa.string())),
            })


def descend(stack: list[DataFrame], ends: DataFrame, levels: int) -> DataFrame:
    """The lowest tier's blocks, each with the path from its top to the root and the further columns of ``ends``."""
    above = None
    for tier in reversed(stack[1:]):
        steps = _handed(tier, above, ends.select("tree", "path"), levels).mapInArrow(partial(_steps, levels=levels), "tree string, start long, path array<string>")
        above = materialise(steps)
    if above is not None:
        above = above.join(ends.drop("path"), "tree")
    return _handed(stack[0], above, ends, levels)


def _verified(batches: Iterator[pa.RecordBatch], levels: int) -> Iterator[pa.RecordBatch]:
    for rows in rows_of(batches, ROWS_PER_READ):
        for n, slots, path, subroot, root in zip(rows["n"], rows["slots"], rows["path"], rows["subroot"], rows["root"]):
            nodes = tiers(_filled(slots), levels_of(n, levels))
            folded: dict[str, str] = {}
            out: dict[str, list] = {c: [] for c in ("doc_id", "leaf", "proof_sha256", "folded_root")}
            for s in slots:
                for at in range(s["at"], s["at"] + s["count"]):
                    own = path_of(nodes, at)
                    top = fold((s["tampered"] or s["hash"]).hex(), own)
                    if top not in folded:
                        folded[top] = fold(top, path)
                    out["doc_id"].append(None if s["bucket"] == NO_ID else (s["bucket"] << ID_BITS) + s["id_pos"])
                    out["leaf"].append(s["hash"].hex())
                    out["proof_sha256"].append(digest(*[step[1:] for step in own], *[step[1:] for step in path]))
                    out["folded_root"].append(folded[top])
            size = len(out["leaf"])
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(out["doc_id"], pa.int64()), "leaf": pa.array(out["leaf"], pa.string()),
                "subroot": pa.array([subroot] * size, pa.string()), "root": pa.array([root] * size, pa.string()),
                "proof_sha256": pa.array(out["proof_sha256"], pa.string()), "folded_root": pa.array(out["folded_root"], pa.string()),
                "verified": pa.array([f == root for f in out["folded_root"]], pa.bool_()),
            })


def manifest(docs: DataFrame, tampered: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """Blocks of leaves with their path to the root: tree, block, n, slots, path, subroot, root.

    ``tampered`` replaces fields for a second leaf that is kept beside the true one.
    """
    fields = {n: F.col(n) for n in FIELDS}
    other = leaf(fields | (tampered or {}))
    doc = F.col("doc_id").cast("long")
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-")).alias("tree"),  # orders as the language does, null first
        F.coalesce(F.shiftright(doc, ID_BITS), F.lit(NO_ID)).alias("bucket"), F.coalesce(doc.bitwiseAND((1 << ID_BITS) - 1), F.lit(0)).cast("long").alias("id_pos"),
        leaf(fields).alias("leaf"), other.alias("tampered"),
    )
    rows = rows.withColumn("tampered", F.when(F.col("tampered") != F.col("leaf"), F.col("tampered")))
    rows = materialise(rows.groupBy("tree", "bucket", "id_pos", "leaf", "tampered").agg(F.count(F.lit(1)).alias("copies")))
    runs = leaf_places(rows).withColumnRenamed("leaf", "hash")
    stack, subroots = climb(materialise(blocks_of(runs, levels, ["bucket", "id_pos", "tampered"])), levels)

    # The languages' tops are the nodes of one more tree.
    one = subroots.select(F.lit("").alias("all"), F.col("tree").alias("lang_tree"), "hash", F.lit(1).alias("copies"))
    nodes = materialise(ordered_totals(one, ["all"], ["lang_tree"], "copies"))
    upper, roots = climb(materialise(blocks_of(
        nodes.select(F.col("all").alias("tree"), F.col("before").alias("start"), "copies", F.col("total").alias("n"), "hash"), levels,
    )), levels)
    ends = roots.select("tree", F.array().cast("array<string>").alias("path"), F.hex("hash").alias("root"))
    held = descend(upper, ends, levels).drop("root").mapInArrow(partial(_steps, levels=levels), "tree string, start long, path array<string>")
    langs = nodes.select(F.col("lang_tree"), F.col("before").alias("start"), F.lower(F.hex("hash")).alias("subroot")).join(held, "start")
    langs = langs.join(roots.select(F.lower(F.hex("hash")).alias("root"), F.col("tree")), "tree").select(F.col("lang_tree").alias("tree"), "path", "subroot", "root")
    return descend(stack, materialise(langs), levels)


def proofs(docs: DataFrame, tampered: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """Leaf, roots, proof and the outcome of its check for every row of ``docs``.

    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root and verified.
    With ``tampered``, a dictionary of field and expression, the check folds the
    leaf of the changed row with the true row's siblings.  Blocks have 2**levels slots.

    Rows without a doc_id come first in their language, rows without a language
    form the first language.  Rows of one doc_id follow each other by leaf, and
    repeated rows are leaves of their own.  Null fields and empty texts are told
    apart by the leaf.  Columns other than the five fields have no effect; an
    empty table gives no rows.  Ids that lie far apart cost a bitmap each, which
    is mostly zeros and is stored compressed.
    """
    out = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    blocks = manifest(docs, tampered, levels).select("n", "slots", "path", "subroot", "root")
    return blocks.mapInArrow(partial(_verified, levels=levels), out)


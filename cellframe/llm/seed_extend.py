"""Repeated word sequences across documents by seed and extend.

Seeds are winnowed anchors: of the k-word hashes inside every window of the
least repeat length, the smallest.  Equal windows have equal anchors, so only
windows whose anchor occurs more than once can be repeats.  Extending both ways
from a shared anchor gives the run of windows around it.  Runs with equal hashes
repeat each other as a whole, and all but the first are later ones.  Where an
anchor stands in runs of different content, the first run of each content is
opened into its windows, whose hashes are joined on.  Overlapping later windows
merge into maximal repeats.

Exact copies of whole documents are set aside first.  Anchors, runs and windows
are combined before they are shuffled, and the joins that mark later occurrences
have one small row per key on one side, so that a passage shared by a large part
of the documents is split over tasks.  No pairs are formed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.functions.lineage import materialise
from cellframe.llm.common import WordHashes, likely, mixed, rows_of, runs_of, words

LEAST = 20
SEED = 6
NULL_ID = -(1 << 63)
_hashes = WordHashes()


def window_minima(h: np.ndarray, least: int, seed: int) -> np.ndarray:
    """Anchor of every window of ``least`` words: the smallest of its seed hashes."""
    m, have, need = runs_of(h, seed), 1, least - seed + 1
    while have * 2 <= need:
        m, have = np.minimum(m[:-have], m[have:]), have * 2
    rest = need - have
    return np.minimum(m[:-rest], m[rest:]) if rest else m


def anchors(h: np.ndarray, least: int, seed: int) -> np.ndarray:
    """Distinct anchors of a document; those at more than one place twice."""
    if len(h) < least:
        return h[:0]
    chosen, s = np.unique(window_minima(h, least, seed)), np.sort(runs_of(h, seed))
    twice = np.searchsorted(s, chosen, side="right") - np.searchsorted(s, chosen, side="left") > 1
    return np.concatenate([chosen, chosen[twice]])


def spans_of(starts: list[int], least: int) -> list[tuple[int, int]]:
    """Union of the windows at ``starts``, as maximal (start, end) spans of words."""
    out: list[list[int]] = []
    for s in sorted(starts):
        if out and s <= out[-1][1]:
            out[-1][1] = s + least
        else:
            out.append([s, s + least])
    return [(a, b) for a, b in out]


def digest(ws: list[str]) -> str:
    return hashlib.sha256(" ".join(ws).encode()).hexdigest()


def without(ws: list[str], spans: list[tuple[int, int]]) -> list[str]:
    kept, at = [], 0
    for a, b in spans:
        kept += ws[at:a]
        at = b
    return kept + ws[at:]


def runs_of_windows(h: np.ndarray, some: np.ndarray, least: int, seed: int) -> tuple[list[dict], list[int]]:
    """Runs of windows around one shared anchor each, and the starts of windows that begin earlier in the document too.

    A run's hash stands for all its windows in their order.
    """
    m, w = window_minima(h, least, seed), runs_of(h, least)
    starts = np.flatnonzero(some[np.minimum(np.searchsorted(some, m), len(some) - 1)] == m)
    if len(starts) == 0:
        return [], []
    head = np.concatenate([[True], (np.diff(starts) > 1) | (m[starts[1:]] != m[starts[:-1]])])
    first = np.flatnonzero(head)
    size = np.diff(np.append(first, len(starts)))
    step = (np.arange(len(starts)) - np.repeat(first, size)).astype(np.uint64)
    total = mixed(np.add.reduceat(mixed(w[starts] ^ mixed(step + np.uint64(1))), first) + size.astype(np.uint64))
    known, at = np.unique(w[starts], return_index=True)
    own = np.ones(len(starts), dtype=bool)
    own[at] = False
    runs = [
        {"anchor": a, "run": r, "start": s, "windows": x}
        for a, r, s, x in zip(
            m[starts[first]].view(np.int64).tolist(), total.view(np.int64).tolist(), starts[first].tolist(),
            np.split(w[starts].view(np.int64), first[1:]), strict=True,
        )
    ]
    return runs, starts[own].tolist()


WINDOWS = "anchor long, run long, start int, windows array<long>"


def kept_words(docs: DataFrame, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """What is left of each document without repeats of ``least`` words or more.

    Returns doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by
    one space) and spans, the removed maximal runs of words as (start, end).  A
    word goes if a window of ``least`` words over it also starts earlier, in a
    document with a smaller doc_id or in the same one.  A null text has no words;
    a null doc_id counts as smallest; rows with one doc_id count as one document
    in this comparison, so that a repeated row does not remove its twin, but
    each of its texts loses its own words only.  An
    empty table gives no rows.
    """
    digest_of_text = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), digest_of_text.alias("key"),
    )
    sketch = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("n_words", pa.int64()), ("kept", pa.binary()), ("anchors", pa.list_(pa.int64()))])

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in rows_of(batches):
            out = {c: [] for c in sketch.names}
            out["doc_id"], out["key"] = cols["doc_id"], cols["key"]
            for text in cols["text"]:
                ws = words(text)
                out["n_words"].append(len(ws))
                out["kept"].append(bytes.fromhex(digest(ws)))
                out["anchors"].append(anchors(_hashes.of(ws), least, seed).view(np.int64))
            yield pa.RecordBatch.from_pydict(out, schema=sketch)

    sketched = materialise(rows.mapInArrow(seeds, "doc_id long, key binary, n_words long, kept binary, anchors array<long>"))
    first = sketched.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("key", "first")
    short = F.xxhash64("key").alias("row")  # with doc_id, names a text well enough
    copies = materialise(sketched.select("doc_id", "key").join(first, "key").where("doc_id > first").select("doc_id", short).distinct())
    originals = sketched.withColumn("row", short).join(copies, ["doc_id", "row"], "left_anti")
    occurrences = originals.select("doc_id", "row", F.explode("anchors").alias("anchor"))
    shared = materialise(occurrences.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"))
    seeded = materialise(occurrences.join(shared, "anchor").groupBy("doc_id", "row").agg(F.collect_set("anchor").alias("anchors")))

    around = pa.schema([
        ("doc_id", pa.int64()), ("key", pa.binary()), ("text", pa.string()), ("own", pa.list_(pa.int32())),
        ("runs", pa.list_(pa.struct([("anchor", pa.int64()), ("run", pa.int64()), ("start", pa.int32()), ("windows", pa.list_(pa.int64()))]))),
    ])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in rows_of(batches, 100):
            own, runs = [], []
            for text, some in zip(cols["text"], cols["anchors"], strict=True):
                h = _hashes.of(words(text))
                found = runs_of_windows(h, np.sort(np.array(some, dtype=np.int64).view(np.uint64)), least, seed) if len(h) >= least else ([], [])
                runs.append(found[0])
                own.append(found[1])
            yield pa.RecordBatch.from_pydict({"doc_id": cols["doc_id"], "key": cols["key"], "text": cols["text"], "own": own, "runs": runs}, schema=around)

    extended = materialise(likely(rows, seeded).withColumn("row", short).join(seeded, ["doc_id", "row"]).drop("row").mapInArrow(extend, f"doc_id long, key binary, text string, own array<int>, runs array<struct<{WINDOWS}>>"))
    extended = extended.withColumn("row", short).join(copies, ["doc_id", "row"], "left_anti")
    at = extended.select("doc_id", "row", F.inline("runs"))
    contents = at.groupBy("run").agg(F.min("doc_id").alias("first"), F.max("anchor").alias("anchor"))
    several = contents.groupBy("anchor").agg((F.count(F.lit(1)) > 1).alias("several"))
    contents = contents.join(several, "anchor").select("run", "first", "several")
    placed = materialise(
        at.join(contents, "run").where((F.col("doc_id") > F.col("first")) | F.col("several"))
        .select("doc_id", "row", "start", F.size("windows").alias("n"), F.when(F.col("doc_id") == F.col("first"), F.col("windows")).alias("windows"))
    )
    later = placed.where("windows is null").select("doc_id", "row", "start", "n")
    opened = placed.where("windows is not null").select("doc_id", "row", "start", F.posexplode("windows").alias("k", "hash")).select("doc_id", "row", (F.col("start") + F.col("k")).alias("start"), "hash")
    earliest = opened.groupBy("hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("hash", "first")
    later = later.unionByName(opened.join(earliest, "hash").where("doc_id > first").select("doc_id", "row", "start", F.lit(1).alias("n")))
    own = extended.select("doc_id", "row", F.explode("own").alias("start")).withColumn("n", F.lit(1))
    gone = later.unionByName(own).groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "n")).alias("gone"))

    cut = pa.schema([
        ("doc_id", pa.int64()), ("key", pa.binary()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    ])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in rows_of(batches):
            out = {c: [] for c in cut.names}
            out["doc_id"], out["key"] = cols["doc_id"], cols["key"]
            for text, some in zip(cols["text"], cols["gone"], strict=True):
                ws = words(text)
                spans = spans_of([s for g in some for s in range(g["start"], g["start"] + g["n"]) if s + least <= len(ws)], least)
                kept = without(ws, spans)
                out["n_removed"].append(len(ws) - len(kept))
                out["kept_sha256"].append(digest(kept))
                out["spans"].append([{"start": a, "end": b} for a, b in spans])
            yield pa.RecordBatch.from_pydict(out, schema=cut)

    spans = "array<struct<start: int, end: int>>"
    removed = extended.select("doc_id", "row", "key", "text").join(gone, ["doc_id", "row"]).drop("row").mapInArrow(remove, f"doc_id long, key binary, n_removed long, kept_sha256 string, spans {spans}")
    copied = copies.select("doc_id", "row", F.lit(True).alias("copied"))
    all_rows = sketched.select("doc_id", "key", "n_words", "kept", short).join(copied, ["doc_id", "row"], "left").join(removed.dropDuplicates(["doc_id", "key"]), ["doc_id", "key"], "left")
    whole = F.coalesce(F.col("copied"), F.lit(False)) & (F.col("n_words") >= least)
    everything = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    return all_rows.select(
        F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(digest([]))).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("kept")))).alias("kept_sha256"),
        F.when(whole, everything).otherwise(F.coalesce("spans", F.array())).cast(spans).alias("spans"),
    )

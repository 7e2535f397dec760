"""Document fingerprints by spot signatures.

Every occurrence of a common word (an anchor) gives a signature: the anchor and
the chain of content words that follow it, common words skipped.  A text's
beginning counts as an anchor.  Where fewer than one word in ``FEW`` is common
(tables, lists, other languages), every word is an anchor, so that the whole
text counts.  The fingerprint is the sorted set of 32-bit
signature hashes, its gaps Rice-coded.  Two fingerprints are compared by Jaccard similarity.

``similar`` finds all pairs of a corpus over a threshold.  Sets are partitioned
by length, so that a pair lies in one partition or in two neighbouring ones.
Each set is indexed by its rarest signatures only, as many as no similar pair
can miss.  Pairs whose lengths or remaining signatures rule the threshold out
are pruned, the others are verified exactly.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellframe.functions.lineage import materialise
from cellframe.functions.skew import salted_lookup
from cellframe.llm.common import WordHashes, mixed, rows_of

# Common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "das der die ein im ist mit und von zu "
    "au de du est et le les que sur un une "
    "con del el en la las los por su y"
).split()
CHAIN = 2
FEW = 16
CHARS_PER_TASK = 8_000_000
LEAST_PERCENT = 75
LONGEST = 1 << 32  # signatures of 32 bits in a set
_WORD = re.compile(r"\w+")
_hashes = WordHashes()
_anchors = np.sort(WordHashes().of(ANCHORS))


def signatures(text: str, chain: int = CHAIN) -> np.ndarray:
    """Sorted distinct signature hashes of a whole text."""
    h = _hashes.of(_WORD.findall(text.lower()))
    if len(h) == 0:
        return np.zeros(0, dtype=np.uint32)
    at = np.searchsorted(_anchors, h)
    common = _anchors[np.minimum(at, len(_anchors) - 1)] == h
    content = np.flatnonzero(~common)
    few = FEW * np.count_nonzero(common) < len(h)
    spots = np.concatenate([[-1], np.arange(len(h)) if few else np.flatnonzero(common)])
    first = np.searchsorted(content, spots, side="right")
    words = np.concatenate([h[content], np.zeros(chain, dtype=np.uint64)])  # a chain may end with the text
    out = np.concatenate([np.zeros(1, dtype=np.uint64), h[spots[1:]]])
    for k in range(chain):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[np.minimum(first + k, len(words) - 1)])
    return np.unique((out >> np.uint64(32)).astype(np.uint32))


def _rest_bits(n: int) -> int:
    """Bits of a gap that are written as they are: those of the mean gap of ``n`` signatures."""
    return (LONGEST // n).bit_length() - 1


def fingerprint(sigs: np.ndarray) -> str:
    """The count in four bytes, the gaps' upper parts in unary, their lower parts in bits; as base64.  No signatures, an empty one."""
    n = len(sigs)
    if n == 0:
        return ""
    k = _rest_bits(n)
    gaps = np.diff(sigs.astype(np.int64), prepend=-1) - 1
    ones = np.cumsum(gaps >> k) + np.arange(n)
    unary = np.zeros(int(ones[-1]) + 1, dtype=np.uint8)
    unary[ones] = 1
    rest = (gaps[:, None] >> np.arange(k - 1, -1, -1) & 1).astype(np.uint8)
    return base64.b64encode(n.to_bytes(4, "big") + np.packbits(unary).tobytes() + np.packbits(rest).tobytes()).decode()


def from_fingerprint(value: str) -> np.ndarray:
    raw = base64.b64decode(value)
    if not raw:
        return np.zeros(0, dtype=np.uint32)
    n = int.from_bytes(raw[:4], "big")
    k, body = _rest_bits(n), np.frombuffer(raw, dtype=np.uint8, offset=4)
    ones = np.flatnonzero(np.unpackbits(body))[:n]
    rest = np.unpackbits(body[int(ones[-1]) // 8 + 1 :], count=n * k).reshape(n, k).astype(np.int64)
    gaps = np.diff(ones, prepend=-1) - 1 << k | rest @ (1 << np.arange(k - 1, -1, -1, dtype=np.int64))
    return (np.cumsum(gaps + 1) - 1).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two signature sets; 0 if pruned as under ``least``; 1 for two empty sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if len(large) == 0:
        return 1.0
    if len(small) == 0 or len(small) < least * len(large):  # the lengths alone rule it out
        return 0.0
    at = np.searchsorted(large, small)
    shared = int(np.count_nonzero(large[np.minimum(at, len(large) - 1)] == small))
    value = shared / (len(a) + len(b) - shared)
    return value if value >= least else 0.0


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as many code points from the start of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


DIGEST = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()),
])
FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared(doc_id: int | None, text: str, sigs: np.ndarray, following: str, next_sigs: np.ndarray) -> dict:
    other = edited(text, following)
    other_sigs = sigs if other == text else signatures(other)
    return {
        "doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(other.encode()).hexdigest(), "fingerprint": fingerprint(sigs),
        "edited_fingerprint": fingerprint(other_sigs), "near_edited": likeness(sigs, other_sigs), "near_next": likeness(sigs, next_sigs),
    }


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of each whole text (null: empty text, empty fingerprint)."""
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: fingerprint(signatures(t)))

    return docs.withColumn(name, F.pandas_udf(run, "string")(F.coalesce(F.col(text), F.lit(""))))


def _ranged(rows: DataFrame, chars_per_task: int) -> tuple[DataFrame, int]:
    """``rows`` (doc_id, text) with the range ``part`` of doc_id they fall in, about ``chars_per_task`` characters each."""
    total, some = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.count("doc_id")).first()
    ranges = total // chars_per_task + 1
    if ranges == 1 or not some:
        return rows.withColumn("part", F.lit(0)), 1
    shares = [k / ranges for k in range(1, ranges)]
    bounds = sorted(set(rows.agg(F.percentile_approx("doc_id", shares, 100 * ranges)).first()[0]))  # one number per range
    part = F.aggregate(F.array(*[F.lit(x) for x in bounds]), F.lit(0), lambda n, x: n + (F.col("doc_id") > x).cast("int"))
    return rows.withColumn("part", F.when(F.col("doc_id").isNull(), 0).otherwise(part)), len(bounds) + 1


def against_next(docs: DataFrame, chars_per_task: int = CHARS_PER_TASK) -> DataFrame:
    """Each document (doc_id, text) against its half-edited text and the next document by doc_id.

    The last document is followed by the first; a single one by itself.  A null
    text counts as empty, a null doc_id comes first, and rows with equal doc_id
    are ordered by text.  An empty table gives no rows.

    Documents are dealt out by ranges of doc_id.  A task compares neighbours as
    they pass; behind a range's last document stands a copy of the next range's
    first, one row per range.  Texts cross one shuffle and results are not staged.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows, ranges = _ranged(rows, chars_per_task)
    order = Window.orderBy("part")  # one row per range
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    least = rows.groupBy("part").agg(F.min(F.struct("doc_id")).alias("least")).select(F.col("part").alias("of"), F.col("least.doc_id").alias("least"))
    at_edge = rows.join(F.broadcast(least), (F.col("part") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("least")), "left_semi")
    firsts = at_edge.groupBy("part", "doc_id").agg(F.min("text").alias("text"))
    closing = firsts.select(
        F.coalesce(F.lag("part").over(order), F.max("part").over(whole)).alias("part"), "doc_id", "text", F.lit(1).alias("closing"),
    )
    dealt = rows.select("part", "doc_id", "text", F.lit(0).alias("closing")).unionByName(closing)
    ordered = dealt.repartitionByRange(ranges, "part").sortWithinPartitions("part", "closing", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for cols in rows_of(batches):
            out = []
            for doc_id, text, closing in zip(cols["doc_id"], cols["text"], cols["closing"], strict=True):
                sigs = signatures(text)
                if before is not None:
                    out.append(compared(*before, text, sigs))
                before = None if closing else (doc_id, text, sigs)
            yield pa.RecordBatch.from_pylist(out, schema=DIGEST)

    return ordered.select("doc_id", "text", "closing").mapInArrow(run, FIELDS)


def partitions_of_lengths(percent: int) -> np.ndarray:
    """Least length of each partition; sets that agree to ``percent`` lie in one partition or in neighbouring ones.

    The next partition starts behind the longest set that can agree with a set of this one's least length, and at least
    1/64 further on, so that a high ``percent`` gives few partitions too.
    """
    starts = [1]
    while starts[-1] <= LONGEST:
        starts.append(max(100 * starts[-1] // percent, starts[-1] + starts[-1] // 64) + 1)
    return np.array(starts, dtype=np.int64)


def indexed_length(n: Column, percent: int) -> Column:
    """How many of a set's rarest signatures are indexed: two sets that agree to ``percent`` share one of theirs."""
    return n - F.ceil(n * percent / F.lit(100)) + 1


def signature_sets(docs: DataFrame, percent: int) -> DataFrame:
    """(doc_id, row, set_id, part, n, sigs) of every distinct row; equal sets have equal ids, empty ones no part."""
    starts = partitions_of_lengths(percent)
    text, doc_id = F.coalesce(F.col("text"), F.lit("")), F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, text).alias("row"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in rows_of(batches):
            sets = [signatures(t) for t in cols["text"]]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(cols["doc_id"], pa.int64()), "row": pa.array(cols["row"], pa.int64()),
                "set_id": [hashlib.sha256(s.tobytes()).hexdigest() for s in sets], "n": pa.array([len(s) for s in sets], pa.int32()),
                "part": pa.array([int(np.searchsorted(starts, len(s), side="right")) - 1 for s in sets], pa.int32()),
                "sigs": pa.array([s.astype(np.int32) for s in sets], pa.list_(pa.int32())),
            })

    return rows.mapInArrow(run, "doc_id long, row long, set_id string, n int, part int, sigs array<int>").dropDuplicates(["doc_id", "row"])


def similar(docs: DataFrame, percent: int = LEAST_PERCENT) -> DataFrame:
    """All near-duplicates (doc_id, text) of a corpus: doc_id_a, row_a, doc_id_b, row_b, likeness of at least ``percent`` / 100.

    ``row`` hashes doc_id and text; rows equal in both count once.  Documents
    with equal sets are compared as one: each of them is paired with the first
    of its set (smallest doc_id, null first, then row), and every two similar
    sets are paired by their firsts, so exact copies give no more rows than there
    are copies.  Two empty sets are equal.
    """
    if not 0 < percent <= 100:
        raise ValueError(f"percent must lie in 1..100, not {percent}")
    rows = materialise(signature_sets(docs, percent))
    sets = materialise(rows.groupBy("set_id").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.first("n").alias("n"), F.first("part").alias("part"), F.first("sigs").alias("sigs")))
    copies = salted_lookup(rows.select("set_id", "doc_id", "row"), sets.select("set_id", "first"), ["set_id"], ["row"])
    copies = copies.where(~F.struct("doc_id", "row").eqNullSafe(F.col("first"))).select(
        F.col("first.doc_id").alias("doc_id_a"), F.col("first.row").alias("row_a"), F.col("doc_id").alias("doc_id_b"), F.col("row").alias("row_b"), F.lit(1.0).alias("likeness"),
    )
    spread = sets.where("n > 0").select("set_id", "part", "n", F.explode("sigs").alias("sig"))
    shared = spread.groupBy("sig").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    held = salted_lookup(spread, shared, ["sig"], ["set_id"]).withColumn("held", F.coalesce("held", F.lit(1)))
    ranked = held.groupBy("set_id", "part", "n").agg(F.sort_array(F.collect_list(F.struct("held", "sig"))).alias("sorted"))
    kept = ranked.select("set_id", "part", "n", F.posexplode(F.slice("sorted", F.lit(1), indexed_length(F.col("n"), percent).cast("int"))).alias("place", "s"))
    index = materialise(kept.where("s.held > 1").select("set_id", "part", "n", "place", F.col("s.sig").alias("sig")))
    a = index.select(*[F.col(c).alias(f"{c}_a") for c in ("set_id", "part", "n", "place")], "sig")
    a = a.withColumn("part", F.explode(F.array(F.col("part_a"), F.col("part_a") + 1)))
    b = index.select(*[F.col(c).alias(f"{c}_b") for c in ("set_id", "n", "place")], "part", "sig")
    met = a.join(b, ["part", "sig"]).where((F.col("part_a") < F.col("part")) | (F.col("set_id_a") < F.col("set_id_b")))
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    rest = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))  # this one and what may follow it in both
    met = met.where((100 * small >= percent * large) & (100 * rest >= percent * (F.col("n_a") + F.col("n_b") - rest)))
    pairs = met.select("set_id_a", "set_id_b").distinct()
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("set_id").alias(f"set_id_{side}"), F.col("first").alias(f"first_{side}"), F.col("sigs").alias(f"sigs_{side}")), f"set_id_{side}")
    both = F.size(F.array_intersect("sigs_a", "sigs_b"))
    either = F.size("sigs_a") + F.size("sigs_b") - both
    found = pairs.withColumn("both", both).withColumn("either", either).where(100 * F.col("both") >= percent * F.col("either"))
    low, high = F.least("first_a", "first_b"), F.greatest("first_a", "first_b")
    found = found.select(low["doc_id"].alias("doc_id_a"), low["row"].alias("row_a"), high["doc_id"].alias("doc_id_b"), high["row"].alias("row_b"), (F.col("both") / F.col("either")).alias("likeness"))
    return copies.unionByName(found)

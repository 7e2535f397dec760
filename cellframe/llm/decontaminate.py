"""Benchmark decontamination: containment search with size-partitioned MinHash.

A short item and a long document have next to no Jaccard similarity, so
documents are compared in segments of an item's size.  Items are partitioned by
shingle count into bands.  For each band a document is cut into segments as long
as the band's largest item; a segment and an item then share MinHash minima with
near certainty when the document contains the item.  Each shingle is hashed
once: low bits choose one of ``BINS`` bins, the rest competes for the bin's
minimum.

An item of q shingles with at least 0.75 q of them in the document shares a
minimum with some segment but for a chance under 1e-8 for 20 shingles, less for
more.  Items under ``WHOLE`` shingles compare all shingles, so none is missed.

The document side is filtered in place by Bloom filters of fixed size over the
items' minima and shingles; what passes is joined, and containment is computed
from the exact shingle sets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellframe.functions.lineage import materialise
from cellframe.llm.common import SHINGLE, WordHashes, bloom, passing, rows_of, runs_of, shingle_set

BINS = 64
WHOLE = 24
CONTAINMENT = 0.75
_WORD = re.compile(r"\w+")
_hashes = WordHashes()


def hashes(text: str) -> np.ndarray:
    """Word hashes of a text: runs of letters, digits and underscores, in lower case."""
    return _hashes.of(_WORD.findall(text.lower()))


def band_of(n: int) -> int:
    """Band 0 holds the smallest items, under ``WHOLE`` shingles; band k > 0 those up to WHOLE * 2**k."""
    k = 0
    while n >= WHOLE << k:
        k += 1
    return k


def minima(shingles: np.ndarray, band: int) -> np.ndarray:
    """Keys of the bins' minima, for each segment of the band's size; they may repeat."""
    tag = np.uint64((band + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    if band == 0 or len(shingles) == 0:
        return shingles ^ tag
    segment = np.arange(len(shingles)) // (WHOLE << band)
    least = np.full((int(segment[-1]) + 1) * BINS, np.iinfo(np.uint64).max)
    np.minimum.at(least, segment * BINS + (shingles & np.uint64(BINS - 1)).astype(np.int64), shingles)
    return least[least != np.iinfo(np.uint64).max] ^ tag


def signed(values: np.ndarray) -> list[int]:
    return values.view(np.int64).tolist()


def leaks(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, item_id: str = "item_id", copies: bool = False) -> DataFrame:
    """Pairs (doc_id, item_id, n_shingles, n_shared, containment) where a document contains an item.

    ``n_shingles`` counts the item's distinct five-word shingles, ``n_shared``
    those that the whole document has too; a pair is returned if their ratio
    reaches ``containment``.  A text of fewer words has one shingle, all of it,
    and is contained only in an equal one; null and wordless texts contain
    nothing and are contained in nothing.  Repeated rows give one pair, the one
    with most shared; rows with a null id are no part of the search.  ``copies``
    says that rows of one doc_id have one text, of which one is compared.
    """
    shingled = pa.schema([("item_id", pa.int64()), ("band", pa.int32()), ("keys", pa.list_(pa.int64())), ("shingles", pa.list_(pa.int64()))])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in rows_of(batches):
            h = [hashes(t) for t in cols["text"]]
            sets = [shingle_set(x) for x in h]
            bands = [band_of(len(s)) for s in sets]
            keys = [signed(minima(s, b)) if b == 0 else signed(item_minima(s, b)) for s, b in zip(sets, bands, strict=True)]
            yield pa.RecordBatch.from_pydict({"item_id": cols["item_id"], "band": bands, "keys": keys, "shingles": [signed(s) for s in sets]}, schema=shingled)

    own = items.where(F.col(item_id).isNotNull() & F.col("text").isNotNull()).select(F.col(item_id).cast("long").alias("item_id"), "text")
    indexed = materialise(own.mapInArrow(index, "item_id long, band int, keys array<long>, shingles array<long>").where(F.size("shingles") > 0))
    bands = sorted(r.band for r in indexed.select("band").distinct().collect())  # a few, they double in size
    key_bits = bloom(indexed.select(F.explode("keys").alias("k")), "k")
    shingle_bits = bloom(indexed.select(F.explode("shingles").alias("s")), "s")
    found = pa.schema([("doc_id", pa.int64()), ("keys", pa.list_(pa.int64())), ("shingles", pa.list_(pa.int64()))])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in rows_of(batches):
            out = {"doc_id": [], "keys": [], "shingles": []}
            for doc_id, text in zip(cols["doc_id"], cols["text"], strict=True):
                h = hashes(text)
                s = runs_of(h, min(SHINGLE, len(h))) if len(h) else h
                keys = np.concatenate([passing(minima(s, b), key_bits) for b in bands]) if bands else s[:0]
                if len(keys):
                    out["doc_id"].append(doc_id)
                    out["keys"].append(signed(np.unique(keys)))
                    out["shingles"].append(signed(np.unique(passing(s, shingle_bits))))
            if out["doc_id"]:
                yield pa.RecordBatch.from_pydict(out, schema=found)

    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hits = texts.mapInArrow(search, "doc_id long, keys array<long>, shingles array<long>")
    hits = materialise(hits.dropDuplicates(["doc_id"]) if copies else hits)
    by_key = indexed.select(F.explode("keys").alias("key"), "item_id")
    pairs = hits.select("doc_id", F.explode("keys").alias("key")).join(by_key, "key").select("doc_id", "item_id").distinct()
    exact = pairs.join(indexed.select("item_id", F.col("shingles").alias("asked")), "item_id").join(hits.select("doc_id", "shingles"), "doc_id")
    shared: Column = F.size(F.array_intersect("asked", "shingles")).cast("long")
    exact = exact.select("doc_id", "item_id", F.size("asked").cast("long").alias("n_shingles"), shared.alias("n_shared"))
    exact = exact.withColumn("containment", F.col("n_shared") / F.col("n_shingles")).where(F.col("containment") >= containment)
    best = exact.groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "n_shared", "n_shingles")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_shingles", "b.n_shared", "b.containment")


def item_minima(shingles: np.ndarray, band: int) -> np.ndarray:
    """Keys of the bins' minima over a whole item."""
    tag = np.uint64((band + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    least = np.full(BINS, np.iinfo(np.uint64).max)
    np.minimum.at(least, (shingles & np.uint64(BINS - 1)).astype(np.int64), shingles)
    return least[least != np.iinfo(np.uint64).max] ^ tag


def without_leaks(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """``docs`` without the texts that contain an item.

    Whether a text goes depends on it alone, so texts and items are named by
    their hash here: rows without an id are judged like any other, and so are
    different texts under one id.
    """
    name = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    asked = items.where(F.col("text").isNotNull()).select(name.alias("item_id"), "text").dropDuplicates(["item_id"])
    found = leaks(docs.where(F.col("text").isNotNull()).select(name.alias("doc_id"), "text"), asked, containment, copies=True)
    gone = found.select(F.col("doc_id").alias("_name")).distinct()
    return docs.withColumn("_name", name).join(gone, "_name", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])

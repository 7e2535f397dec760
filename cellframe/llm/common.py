"""Small helpers shared by the text operators: words, hashes, shared files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_ODD_SPACE = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SHINGLE = 5
CACHE_LIMIT = 400_000
BLOOM_BITS = 1 << 24


def words(text: str | None) -> list[str]:
    """Maximal runs of characters other than space and U+0009 to U+000D.

    ``str.split`` gives the same unless one of the other Unicode spaces occurs.
    """
    if not text:
        return []
    return _WORDS.findall(text) if _ODD_SPACE.search(text) else text.split()


class WordHashes(dict):
    """Word to 64-bit hash; forgets all when full, so that memory stays bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def of(self, ws: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), dtype=np.uint64, count=len(ws))


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalising mix of 64-bit values, so that any of their bits can be used."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def runs_of(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive values; none if there are fewer than ``k``."""
    n = len(h) - k + 1
    if n <= 0:
        return h[:0]
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
        out ^= out >> np.uint64(29)
    return mixed(out)


def shingle_set(h: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles.

    With fewer words the whole sequence is the one shingle; no words, no shingle.
    """
    if len(h) == 0:
        return h
    return np.unique(runs_of(h, min(k, len(h))))


def rows_of(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[dict[str, list]]:
    """Columns of each batch as lists, a bounded number of rows at a time; nulls stay None."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows).to_pydict()


def bloom(values: DataFrame, column: str) -> np.ndarray:
    """Bits of a Bloom filter of fixed size over 64-bit values, built by a distributed aggregate.

    The bitmap functions count positions from 1.
    """
    places = F.array(*[F.shiftrightunsigned(F.col(column), s).bitwiseAND(BLOOM_BITS - 1) + 1 for s in (0, 20, 40)])
    bits = values.select(F.explode(places).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket"))
    rows = bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()  # BLOOM_BITS / 32768 rows at most
    out = np.zeros(BLOOM_BITS // 8, dtype=np.uint8)
    for r in rows:
        raw = np.frombuffer(bytes(r.bits), dtype=np.uint8)
        at = (r.bucket - 1) * 4096
        out[at : at + len(raw)] = raw
    return out


def passing(values: np.ndarray, bits: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
    """Those values that may be in the filter, or their ``rows``; each test looks at what the one before left."""
    out = values if rows is None else rows
    for s in (0, 20, 40):
        p = ((values >> np.uint64(s)) & np.uint64(BLOOM_BITS - 1)).astype(np.int64)
        ok = bits[p >> 3] >> (p & 7).astype(np.uint8) & 1 > 0
        values, out = values[ok], out[ok]
    return out


def likely(rows: DataFrame, wanted: DataFrame, column: str = "doc_id") -> DataFrame:
    """``rows`` without most of those whose id is not in ``wanted``, to spare a shuffle of their texts.

    The filter has a fixed size.  It lets every wanted id pass, and more of the
    others the more ids are wanted, so a join must follow.
    """
    hashed = wanted.select(F.xxhash64(F.col(column)).alias("h"))
    bits = bloom(hashed, "h")
    tagged = rows.withColumn("_h", F.xxhash64(F.col(column)))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("_h")
            h = batch.column(at).to_numpy(zero_copy_only=False).view(np.uint64)
            rows = passing(h, bits, np.arange(len(h)))
            if len(rows):
                yield batch.take(pa.array(rows)).select([n for n in batch.schema.names if n != "_h"])

    return tagged.mapInArrow(keep, rows.schema)


def open_store(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and path of a shared folder, from within any task."""
    if uri.startswith("file:"):
        return arrow_fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return arrow_fs.FileSystem.from_uri(uri)


def put_file(uri: str, name: str, parts: list[bytes], attempt: str) -> None:
    """Write a file under a temporary name and rename it.

    A retried or doubled task writes the same content under the same final name,
    so that readers never meet half a file.
    """
    store, root = open_store(uri)
    store.create_dir(root, recursive=True)
    temporary = f"{root}/.{name}.{attempt}"
    with store.open_output_stream(temporary) as out:
        for p in parts:
            out.write(p)
    store.move(temporary, f"{root}/{name}")

"""Token ids in directly addressable codes: binary shards with random access to any token.

An id is cut into chunks of fixed width, lowest first.  Level 0 holds the first
chunk of every token; a bit per chunk says whether the id goes on at the next
level, and a rank directory over those bits gives the place there.  So token i
is found with one chunk, one bit and one rank per level and nothing else is
decoded.

A shard file: magic, length of a JSON header, header, sections.  Sections are
the doc ids, the docs' end positions, and per level its chunks, its continuation
bits and their rank directory.  Byte order is little-endian.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellframe.functions.lineage import materialise, stage_path
from cellframe.llm.common import CACHE_LIMIT, open_store, put_file, rows_of

MAGIC = b"DACODES1"
RANK_BITS = 512
WIDTHS = (8, 8)
CHARS_PER_SHARD = 24_000_000
NULL_ID = np.iinfo(np.int64).min


def pack(values: np.ndarray, width: int) -> bytes:
    """Unsigned values of 4, 8 or 16 bits each."""
    if width == 4:
        v = np.zeros(len(values) + len(values) % 2, dtype=np.uint8)
        v[: len(values)] = values
        return (v[0::2] | v[1::2] << 4).tobytes()
    return values.astype({8: "<u1", 16: "<u2"}[width]).tobytes()


def unpack(raw: bytes, width: int, skip: int, n: int) -> np.ndarray:
    if width == 4:
        b = np.frombuffer(raw, dtype=np.uint8)
        return np.stack([b & 15, b >> 4], axis=1).ravel()[skip : skip + n].astype(np.uint64)
    return np.frombuffer(raw, dtype={8: "<u1", 16: "<u2"}[width])[skip : skip + n].astype(np.uint64)


def rank_directory(bits: np.ndarray) -> np.ndarray:
    """Ones before each block of ``RANK_BITS`` bits, and in all."""
    padded = np.zeros(-(-len(bits) // RANK_BITS) * RANK_BITS, dtype=np.uint8)
    padded[: len(bits)] = bits
    return np.concatenate([[0], np.cumsum(padded.reshape(-1, RANK_BITS).sum(axis=1, dtype=np.int64))]).astype("<i8")


def shard_bytes(doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> list[bytes]:
    """A shard file's content."""
    sections: dict[str, bytes] = {
        "doc_ids": np.array([NULL_ID if d is None else d for d in doc_ids], dtype="<i8").tobytes(),
        "ends": np.asarray(ends, dtype="<i8").tobytes(),
    }
    rest, levels = np.asarray(ids, dtype=np.uint64), []
    while not levels or len(rest):
        width = widths[min(len(levels), len(widths) - 1)]
        k = len(levels)
        more = rest >> np.uint64(width) > 0
        sections[f"chunks{k}"] = pack(rest & np.uint64((1 << width) - 1), width)
        sections[f"more{k}"] = np.packbits(more, bitorder="little").tobytes()
        sections[f"ranks{k}"] = rank_directory(more).tobytes()
        levels.append({"width": width, "n": len(rest)})
        rest = rest[more] >> np.uint64(width)
    places, at = {}, 0
    for name, raw in sections.items():
        places[name] = [at, len(raw)]
        at += len(raw)
    head = json.dumps({"docs": len(doc_ids), "tokens": len(ids), "levels": levels, "places": places}).encode()
    return [MAGIC, len(head).to_bytes(8, "little"), head, *sections.values()]


class Shard:
    """Reads a shard file by ranges; single tokens and slices without decoding what lies before them."""

    def __init__(self, uri: str, name: str):
        store, root = open_store(uri)
        self.file = store.open_input_file(f"{root}/{name}")
        assert self.file.read_at(8, 0) == MAGIC
        n = int.from_bytes(self.file.read_at(8, 8), "little")
        self.head = json.loads(self.file.read_at(n, 16))
        self.base = 16 + n
        self.levels = self.head["levels"]

    def _read(self, section: str, start: int, n: int) -> bytes:
        return self.file.read_at(n, self.base + self.head["places"][section][0] + start) if n > 0 else b""

    def _ints(self, section: str, start: int, n: int) -> np.ndarray:
        return np.frombuffer(self._read(section, 8 * start, 8 * n), dtype="<i8")

    def doc_ids(self) -> list[int | None]:
        return [None if d == NULL_ID else int(d) for d in self._ints("doc_ids", 0, self.head["docs"])]

    def ends(self) -> np.ndarray:
        return self._ints("ends", 0, self.head["docs"])

    def _bits(self, level: int, start: int, n: int) -> np.ndarray:
        first = start // 8
        raw = np.frombuffer(self._read(f"more{level}", first, (start + n + 7) // 8 - first), dtype=np.uint8)
        return np.unpackbits(raw, bitorder="little")[start - 8 * first :][:n]

    def rank(self, level: int, i: int) -> int:
        """Ones before position i of a level's continuation bits."""
        block = i // RANK_BITS
        return int(self._ints(f"ranks{level}", block, 1)[0]) + int(self._bits(level, block * RANK_BITS, i - block * RANK_BITS).sum())

    def tokens(self, start: int, n: int) -> np.ndarray:
        """The ids at positions start to start + n - 1."""
        out = np.zeros(n, dtype=np.uint64)
        where, shift = np.arange(n), 0
        for k, level in enumerate(self.levels):
            if n == 0:
                break
            width = level["width"]
            first = start * width // 8
            raw = self._read(f"chunks{k}", first, ((start + n) * width + 7) // 8 - first)
            out[where] |= unpack(raw, width, start - first * 8 // width, n) << np.uint64(shift)
            more = self._bits(k, start, n).astype(bool)
            shift += width
            where = where[more]
            if len(where):
                start = self.rank(k, start)
            n = len(where)
        return out.astype(np.uint32)

    def token(self, i: int) -> int:
        return int(self.tokens(i, 1)[0])

    def close(self) -> None:
        self.file.close()


class WordCoder:
    """Whole texts to ids by the tokenizers library, each word encoded once while it is remembered.

    Only for tokenizers that drop white space and let no token reach over it, so
    that a text's ids are those of its words.  Words are remembered for two
    generations; one that is met again moves into the younger, so that common
    words stay when the older is forgotten.
    """

    _made: dict[str, WordCoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> WordCoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        parts = [library_words(t) for t in texts]
        if len(self.known) >= CACHE_LIMIT // 2:
            self.known, self.older = {}, self.known
        missing = {w for p in parts for w in p if w not in self.known}
        new = [w for w in missing if w not in self.older]
        self.known.update((w, self.older[w]) for w in missing if w in self.older)
        for w, e in zip(new, self.library.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.known[w] = np.array(e.ids, dtype="<u4").tobytes()
        return [b"".join(map(self.known.__getitem__, p)) for p in parts]


def library_words(text: str) -> list[str]:
    """Words between Unicode white space, which U+001C to U+001F are not."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        for n, c in enumerate("\x1c\x1d\x1e\x1f"):
            text = text.replace(c, chr(0xF0000 + n))  # private characters stand in while splitting
        back = str.maketrans({chr(0xF0000 + n): c for n, c in enumerate("\x1c\x1d\x1e\x1f")})
        return [w.translate(back) for w in text.split()]
    return text.split()


MANIFEST = "part int, shard int, folder string, name string, n_docs long, n_tokens long"
SHARDS = pa.schema([
    ("part", pa.int32()), ("shard", pa.int32()), ("folder", pa.string()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()),
])


def write(
    docs: DataFrame, path: str, end_id: int | None = 1, widths: tuple[int, ...] = WIDTHS, chars_per_shard: int = CHARS_PER_SHARD,
) -> DataFrame:
    """Encode every whole text (doc_id, text) and write shards in ascending doc_id order; return their manifest.

    Texts are shuffled once, by ranges of doc_id of about ``chars_per_shard``
    characters, and encoded where they arrive; a range with more is cut into
    several shards, so that no task holds more than one.  A null text counts as
    empty and has the end id only, a null doc_id comes first, rows with the same
    doc_id stand side by side in the order of their texts' hashes, so that
    ranges may part them, and no documents give no shards.  The manifest, a
    written table, has one row per shard.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    ranges = (rows.agg(F.sum(F.length("text"))).first()[0] or 0) // chars_per_shard + 1
    folder = stage_path(spark, "token-shards")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, coder = TaskContext.get().partitionId(), WordCoder.of(path)
        end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()
        doc_ids, raw, held, shard = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            parts = shard_bytes(doc_ids, np.cumsum([len(x) // 4 for x in raw]), np.frombuffer(b"".join(raw), dtype="<u4"), widths)
            name = f"{part:06d}-{shard:04d}.dac"
            put_file(folder, name, parts, uuid.uuid4().hex)
            row = {"part": [part], "shard": [shard], "folder": [folder], "name": [name], "n_docs": [len(raw)], "n_tokens": [held // 4]}
            return pa.RecordBatch.from_pydict(row, schema=SHARDS)

        for cols in rows_of(batches, 200):
            for doc_id, coded in zip(cols["doc_id"], coder.encode(cols["text"]), strict=True):
                ids = coded + end
                if raw and held + len(ids) > 4 * chars_per_shard:
                    yield flush()
                    doc_ids, raw, held, shard = [], [], 0, shard + 1
                doc_ids.append(doc_id)
                raw.append(ids)
                held += len(ids)
        if raw:
            yield flush()

    placed = rows.repartitionByRange(ranges, "doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text")
    return materialise(placed.mapInArrow(save, MANIFEST))


def read(manifest: DataFrame) -> DataFrame:
    """Per document, from the shard files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    starts = manifest.withColumn(  # one row per shard
        "first", F.coalesce(F.sum("n_tokens").over(Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    )
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in rows_of(batches, 1):
            shard = Shard(cols["folder"][0], cols["name"][0])
            doc_ids, ends = shard.doc_ids(), shard.ends()
            for at in range(0, len(doc_ids), 1000):
                some = ends[at : at + 1000]
                begins = np.concatenate([ends[at - 1 : at] if at else [0], some[:-1]]).astype(np.int64)
                ids = shard.tokens(int(begins[0]), int(some[-1] - begins[0])).astype("<u4")
                cut = np.split(ids, (some[:-1] - begins[0]).astype(np.int64))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": doc_ids[at : at + 1000], "start": begins + cols["first"][0], "n_tokens": some - begins,
                    "ids_crc32": [zlib.crc32(x.tobytes()) for x in cut],
                }, schema=out)
            shard.close()

    spread = starts.repartition(max(2, manifest.sparkSession.sparkContext.defaultParallelism), "part", "shard")
    return spread.mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")

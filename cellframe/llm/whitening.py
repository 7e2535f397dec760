"""Whitening of embeddings through distributed block matrices.

Entries are put on an integer grid.  The distinct vectors are the rows of a
matrix; they are dealt to blocks of a fixed number of bytes, centred by the exact
mean and handed to MLlib's ``BlockMatrix``.  Its transpose times itself is the
scatter matrix, of the size of one vector squared, whose eigenvectors are
computed locally.  The block matrix times the whitening matrix projects all
distinct vectors; rows get theirs by a 128-bit hash.

For the scatter every few row blocks stand in a block column of their own, so
that the product has a block for each such group and many tasks share the work;
the blocks are then summed pairwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellframe.functions.lineage import materialise, stage_path
from cellframe.functions.skew import one_row

BLOCK_BYTES = 1 << 21
BLOCKS_PER_GROUP = 8
#: A vector on at least this share of the rows is joined by a broadcast; there are fewer than 1 / share of them.
HOT_SHARE = 0.001
#: Eigenvalues below this share of the largest are rounding errors of zero.
LEAST_SHARE = 1e-13
_WIDTHS = ("<i1", "<i2", "<i4", "<i8")


def _grid(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    """(vec_id, dim, hash, x) of every vector without a null or non-finite entry; x is packed in its narrowest integers."""
    for batch in batches:
        ids, dims, hashes, packed = [], [], [], []
        lists = batch.column(1)
        values = lists.values if hasattr(lists, "values") else lists.flatten()
        flat = values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
        ends = lists.offsets.to_numpy(zero_copy_only=False)
        there = lists.is_valid().to_numpy(zero_copy_only=False)
        for i, vec_id in enumerate(batch.column(0).to_pylist()):
            c = flat[ends[i] : ends[i + 1]]
            if not there[i] or len(c) == 0 or not np.isfinite(c).all():
                continue
            x = np.clip(np.floor(c * scale), -(2.0**63), np.nextafter(2.0**63, 0)).astype(np.int64)
            body = _packed(x)
            ids.append(vec_id)
            dims.append(len(x))
            hashes.append(xxhash.xxh3_128_digest(body, seed=len(x)))
            packed.append(body)
        yield pa.RecordBatch.from_pydict({
            "vec_id": pa.array(ids, pa.int64()), "dim": pa.array(dims, pa.int32()), "hash": pa.array(hashes, pa.binary()), "x": pa.array(packed, pa.binary()),
        })


def _packed(x: np.ndarray) -> bytes:
    """Integers, row by row, in the narrowest width that holds them all."""
    most = int(max(x.max(), -(x.min() + 1)))
    return x.astype(next(w for w in _WIDTHS if most <= np.iinfo(w).max)).tobytes()


def _unpacked(body: bytes, count: int) -> np.ndarray:
    return np.frombuffer(body, dtype=_WIDTHS[(len(body) // count).bit_length() - 1]).astype(np.int64)


def _exact_sum(x: np.ndarray, axis: int) -> list[int]:
    """Sums of 64-bit integers as Python integers, in two halves that cannot overflow."""
    return [(int(h) << 32) + int(low) for h, low in zip((x >> 32).sum(axis), (x & 0xFFFFFFFF).sum(axis))]


def _blocks(batches: Iterator[pa.RecordBatch], dim: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Rows (hash, copies, x) of a partition as blocks: part, seq, hashes, copies, the rows' integers and their sums."""
    part, seq = TaskContext.get().partitionId(), 0
    held: list[tuple] = []

    def block(members: list[tuple]) -> pa.RecordBatch:
        x = np.stack([_unpacked(m[2], dim) for m in members])
        sums = [str(s) for s in _exact_sum(x, 0)]
        return pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "hashes": pa.array([[m[0] for m in members]], pa.list_(pa.binary())),
            "copies": pa.array([[m[1] for m in members]], pa.list_(pa.int64())), "x": pa.array([_packed(x.T)], pa.binary()),
            "sums": pa.array([sums], pa.list_(pa.string())),
        })

    for batch in batches:
        held += zip(*(batch.column(i).to_pylist() for i in range(3)))
        while len(held) >= rows:
            yield block(held[:rows])
            held, seq = held[rows:], seq + 1
    if held:
        yield block(held)


_BLOCK = "part int, seq int, hashes array<binary>, copies array<long>, x binary, sums array<string>"


@dataclass
class Fit:
    """Distinct vectors in blocks, their number and sums, and the whitening found from them."""

    blocks: DataFrame
    rows: int
    dim: int
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def whitening(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list[int | None]]:
    """x - S/n, rounded once, and the exact sum over a row of (n x - S) squared (None beyond 64 bits)."""
    most = n * max(int(x.max()), -int(x.min())) + max(map(abs, sums))
    if most * most * len(sums) < 1 << 62:
        d = x * n - np.array(sums, dtype=np.int64)
        return d / n, (d * d).sum(axis=1).tolist()
    d = x.astype(object) * n - np.array(sums, dtype=object)
    far = [int(s) for s in (d * d).sum(axis=1)]
    return (d / n).astype(np.float64), [s if s < 1 << 63 else None for s in far]


def _matrices(blocks: DataFrame, rows: int, dim: int, n: int, sums: list[int]) -> DataFrame:
    """Centred blocks as stored dense matrices: block, group, subMatrix, column by column and padded with zero rows."""
    fields = {f.name: f for f in MatrixUDT.sqlType()}

    def centred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = _unpacked(batch.column(1)[i].as_py(), dim * batch.column(2)[i].as_py()).reshape(dim, -1).T
                whole = np.zeros((rows, dim))
                whole[: len(x)] = _centred(x, n, sums)[0]
                matrix = {"type": 1, "numRows": rows, "numCols": dim, "colPtrs": None, "rowIndices": None, "values": whole.T.ravel(), "isTransposed": False}
                kinds = pa.struct([("type", pa.int8()), ("numRows", pa.int32()), ("numCols", pa.int32()), ("colPtrs", pa.list_(pa.int32())),
                                   ("rowIndices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64())), ("isTransposed", pa.bool_())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([matrix], kinds)], ["block", "subMatrix"])

    plain = T.StructType([T.StructField("block", T.LongType()), T.StructField("subMatrix", T.StructType([fields[k] for k in fields]))])
    path = stage_path(blocks.sparkSession)
    blocks.select("block", "x", F.size("hashes").alias("rows")).mapInArrow(centred, plain).write.option("compression", "zstd").parquet(path)
    typed = T.StructType([T.StructField("block", T.LongType()), T.StructField("subMatrix", MatrixUDT())])
    return blocks.sparkSession.read.schema(typed).parquet(path)


def _block_matrix(matrices: DataFrame, column, rows: int, dim: int) -> BlockMatrix:
    index = F.struct(F.col("block").alias("blockRowIndex"), column.cast("long").alias("blockColIndex"))
    return BlockMatrix(callMLlibFunc("createBlockMatrix", matrices.select(index.alias("blockIndex"), "subMatrix"), rows, dim, 0, 0), rows, dim)


def fit(vectors: DataFrame, dim: int) -> Fit | None:
    """The whitening of the distinct vectors of (hash, x); None if there are none."""
    rows = max(64, BLOCK_BYTES // (8 * dim))
    distinct = vectors.groupBy("hash", "x").agg(F.count(F.lit(1)).alias("copies")).select("hash", "copies", "x")
    cut = materialise(distinct.mapInArrow(lambda batches: _blocks(batches, dim, rows), _BLOCK))
    # Block numbers follow the parts: one row per task here.
    ahead, start = 0, {}
    for r in cut.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        start[r.part], ahead = ahead, ahead + r.n
    if not start:
        return None
    starts = vectors.sparkSession.createDataFrame(list(start.items()), "part int, start long")
    blocks = cut.join(F.broadcast(starts), "part").withColumn("block", F.col("start") + F.col("seq"))
    totals = cut.select(F.size("hashes").alias("n"), F.posexplode("sums").alias("d", "s")).groupBy("d").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found = sorted(totals.collect())  # one row per dimension
    n, sums = found[0].n, [int(r.s) for r in found]
    matrices = _matrices(blocks, rows, dim, n, sums)
    groups = -(-ahead // BLOCKS_PER_GROUP)
    tall = _block_matrix(matrices, F.lit(0), rows, dim)
    apart = _block_matrix(matrices, F.col("block") % groups, rows, dim)
    parts = apart.transpose().multiply(tall).blocks.map(lambda b: b[1].toArray())
    scatter = parts.treeReduce(np.add)
    covariance = (scatter + scatter.T) / (2 * n)
    values, found_vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")
    values, found_vectors = values[order], found_vectors[:, order]
    found_vectors = found_vectors * np.where(found_vectors[np.abs(found_vectors).argmax(axis=0), np.arange(dim)] < 0, -1.0, 1.0)
    keep = values > max(values[0], 0.0) * LEAST_SHARE
    out = Fit(blocks, rows, dim, n, sums, values[keep], found_vectors[:, keep], float(np.trace(covariance)))
    out.matrix = tall
    return out


def project(found: Fit, components: int) -> DataFrame:
    """(hash, copies, deviation, white) of every distinct vector, ``white`` with the first ``components`` coordinates."""
    w = found.whitening[:, :components]
    sc = found.blocks.sparkSession.sparkContext
    right = BlockMatrix(sc.parallelize([((0, 0), DenseMatrix(w.shape[0], w.shape[1], w.T.ravel().tolist()))], 1), found.dim, w.shape[1])
    product = found.matrix.multiply(right)
    white = product.blocks.map(lambda b: (int(b[0][0]), bytearray(np.ascontiguousarray(b[1].toArray()).tobytes()))).toDF("block long, white binary")
    n, dim, sums, k = found.n, found.dim, found.sums, w.shape[1]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                hashes, copies = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                x = _unpacked(batch.column(2)[i].as_py(), dim * len(hashes)).reshape(dim, -1).T
                y = np.frombuffer(batch.column(3)[i].as_py(), dtype=np.float64).reshape(-1, k)[: len(hashes)]
                yield pa.RecordBatch.from_pydict({
                    "hash": pa.array(hashes, pa.binary()), "copies": pa.array(copies, pa.int64()), "deviation": pa.array(_centred(x, n, sums)[1], pa.int64()),
                    "white": pa.array(list(y), pa.list_(pa.float64())),
                })

    joined = found.blocks.select("block", "hashes", "copies", "x").join(white, "block").select("hashes", "copies", "x", "white")
    return joined.mapInArrow(rows, "hash binary, copies long, deviation long, white array<double>")


def identity_error(white: DataFrame, components: int) -> float:
    """Largest absolute entry of the covariance of ``white`` minus the identity, centred by its mean."""
    at = range(components)
    means = white.agg(*[F.avg(F.col("white")[i]).alias(f"m{i}") for i in at])
    centred = one_row(white.select("white"), means)
    d = [F.col("white")[i] - F.col(f"m{i}") for i in at]
    entries = centred.agg(*[F.abs(F.avg(d[i] * d[j]) - (1.0 if i == j else 0.0)).alias(f"e{i}_{j}") for i in at for j in at if j >= i]).first()
    return float(max(entries))


def whiten(vectors: DataFrame, components: int = 4, scale: float = 256.0, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Whitened coordinates of every vector along the first ``components`` eigenvectors.

    Returns ``key``, component (from 1), n, deviation, whitened, explained and
    identity_error.  Rows whose vector is null, empty or holds a null or
    non-finite entry are left out, and so are vectors of another length than the
    most frequent one (of equally frequent ones the longest).  Repeated rows and
    rows without a key stay; equal vectors count once in the fit.  Entries
    beyond 64 bits take the nearest 64-bit integer; a deviation beyond 64 bits
    is null.  Directions without any variance are no components, so a table with
    one distinct vector, like an empty one, gives no rows.  Each component's
    largest entry is positive.  Further columns have no effect.
    """
    out = f"`{key}` long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = vectors.sparkSession
    grid = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("c"))
    grid = materialise(grid.mapInArrow(lambda b: _grid(b, scale), "vec_id long, dim int, hash binary, x binary"))
    first = grid.groupBy("dim").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("dim")).first()
    if first is None:
        return spark.createDataFrame([], out)
    grid = grid.where(F.col("dim") == first.dim)
    found = fit(grid.select("hash", "x"), first.dim)
    k = min(components, len(found.values))
    if k == 0:
        return spark.createDataFrame([], out)
    white = materialise(project(found, k))
    error = identity_error(white, k)
    hot = white.where(F.col("copies") >= max(2.0, first.rows * HOT_SHARE)).select("hash", F.col("deviation").alias("hot_deviation"), F.col("white").alias("hot_white"))
    marked = grid.select("vec_id", "hash").join(F.broadcast(hot), "hash", "left")
    common = marked.where("hot_white IS NOT NULL").select("vec_id", F.col("hot_deviation").alias("deviation"), F.col("hot_white").alias("white"))
    rare = marked.where("hot_white IS NULL").select("vec_id", "hash").join(white.select("hash", "deviation", "white"), "hash").select("vec_id", "deviation", "white")
    explained = F.element_at(F.array(*[F.lit(float(v) / found.trace) for v in found.values[:k]]), F.col("component"))
    rows = common.unionByName(rare).select("vec_id", "deviation", F.posexplode("white").alias("at", "whitened")).withColumn("component", (F.col("at") + 1).cast("int"))
    return rows.select(
        F.col("vec_id").alias(key), "component", F.lit(found.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"),
        F.lit(error).alias("identity_error"),
    )

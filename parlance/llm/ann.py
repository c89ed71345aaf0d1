"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector is centred, rotated by a random orthogonal matrix and kept as its signs with two scalars: the length of the
centred vector and the cosine between it and its code. Inner products are estimated from the packed bits; the error
bound of the estimate says which vectors can still be among the nearest, and only those are scored exactly.

The index is a stored table in the order of coarse cells, so that vectors read together lie together: where a whole run of them is
too far from a query, by its centre and radius, none of them is estimated for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

INDEX_SCHEMA = "cell int, vec_id long, code binary, length float, cosine float, vector array<double>"
FOUND_SCHEMA = "query_id long, vec_id long, score double"


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are whole, finite, not zero and of the right dimension, as doubles, and their places."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.asarray(column.offsets)
    sizes = np.diff(offsets)
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    good = np.flatnonzero((sizes == dim) & np.asarray(column.is_valid()))
    rows = values[(offsets[good][:, None] + np.arange(dim)[None, :])] if len(good) else np.zeros((0, dim))
    with np.errstate(all="ignore"):
        fine = np.isfinite(rows).all(axis=1) & (rows != 0).any(axis=1)
    return rows[fine], good[fine]


#: Coarse cells, and rounds of their choice.
CELLS, ROUNDS = 256, 5


class Coder:
    """The rotation, the centre and the cells' centres; all come from a seed and a bounded sample."""

    def __init__(self, dim: int, sample: np.ndarray, seed: int = 7):
        q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
        self.dim, self.centre, self.rotation = dim, sample.mean(axis=0), q * np.sign(np.diag(r))
        self.cells = sample[:: max(1, len(sample) // CELLS)][:CELLS].copy()
        for _ in range(ROUNDS):
            own = self.cell(sample)
            many = np.bincount(own, minlength=len(self.cells))
            sums = np.zeros_like(self.cells)
            np.add.at(sums, own, sample)
            self.cells[many > 0] = sums[many > 0] / many[many > 0, None]

    def cell(self, x: np.ndarray) -> np.ndarray:
        """The nearest cell of each vector."""
        return np.argmin((self.cells**2).sum(axis=1)[None, :] - 2 * x @ self.cells.T, axis=1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r = x - self.centre
        length = np.linalg.norm(r, axis=1)
        o = (r / np.where(length > 0, length, 1)[:, None]) @ self.rotation
        return np.packbits(o > 0, axis=1), length, np.abs(o).sum(axis=1) / np.sqrt(self.dim)

    def bounds(self, code: np.ndarray, length: np.ndarray, cosine: np.ndarray, q: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products of coded vectors (columns) with queries (rows), and the half-width of their interval."""
        signs = np.unpackbits(code, axis=1, count=self.dim).astype(np.float32) * 2 - 1
        c = np.maximum(cosine, 1e-6)
        dots = (q @ self.rotation).astype(np.float32) @ signs.T / np.float32(np.sqrt(self.dim))
        estimate = dots * (length / c)[None, :] + (q @ self.centre)[:, None]
        if np.isinf(width):
            return estimate, np.full(estimate.shape, np.inf)
        spread = np.sqrt(np.maximum(1 - c * c, 0)) / c * length * width / np.sqrt(max(1, self.dim - 1))
        return estimate, np.linalg.norm(q, axis=1)[:, None] * spread[None, :] + 1e-5 * (1 + np.abs(estimate))


def exact_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row by row inner products, summed in the order of the components."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += x[:, j] * q[:, j]
    return out


def _nearest(rows: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row's candidates: larger score, then smaller id."""
    order = np.lexsort((ids, -score, rows))
    r = rows[order]
    first = np.flatnonzero(np.append(True, r[1:] != r[:-1])) if len(r) else np.zeros(0, np.int64)
    rank = np.arange(len(r)) - np.repeat(first, np.diff(np.append(first, len(r))))
    return order[rank < k]


def build_index(vectors: DataFrame, coder: Coder, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Cells and codes of all rows that take part, with the vectors for reranking."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, at = _matrix(b.column(1), coder.dim)
            code, length, cosine = coder.encode(x)
            vector = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * coder.dim, x.ravel())
            columns = [pa.array(coder.cell(x).astype(np.int32)), b.column(0).take(pa.array(at)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(length.astype(np.float32)), pa.array(cosine.astype(np.float32)), vector]
            yield pa.RecordBatch.from_arrays(columns, ["cell", "vec_id", "code", "length", "cosine", "vector"])

    return vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>")).mapInArrow(encode, INDEX_SCHEMA)


def _scan(coder: Coder, shared, k: int, width: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, q, floor = shared.value
        floor, reach = floor.copy(), np.linalg.norm(q, axis=1)
        best: tuple[np.ndarray, np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                s = b.slice(lo, 2048)
                ids = s.column(1).to_numpy()
                code = np.frombuffer(b"".join(s.column(2).to_pylist()), np.uint8).reshape(len(ids), -1)
                x = s.column(5).flatten().to_numpy().reshape(len(ids), coder.dim)
                length, cosine = (s.column(j).to_numpy().astype(np.float64) for j in (3, 4))
                middle = x.mean(axis=0)
                most = q @ middle + reach * np.linalg.norm(x - middle, axis=1).max()
                live = np.flatnonzero(most + 1e-9 * (1 + np.abs(most)) >= floor)
                rows, cols = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for at in range(0, len(live), 1024):
                    own = live[at : at + 1024]
                    estimate, half = coder.bounds(code, length, cosine, q[own], width)
                    r, c = np.nonzero(estimate + half >= floor[own, None])
                    rows.append(own[r])
                    cols.append(c)
                row, col = np.concatenate(rows), np.concatenate(cols)
                keep = query_ids[row] != ids[col]
                row, col = row[keep], col[keep]
                near = np.concatenate([np.einsum("ij,ij->i", x[col[i : i + 4096]], q[row[i : i + 4096]]) for i in range(0, len(row), 4096)] or [np.zeros(0)])
                good = near >= floor[row] - 1e-9 * (1 + np.abs(near))
                row, col = row[good], col[good]
                score = exact_scores(x[col], q[row])
                row, vec, score = (np.concatenate(p) for p in zip(best, (row, ids[col], score), strict=True))
                at = _nearest(row, vec, score, k)
                best = row[at], vec[at], score[at]
                full = np.flatnonzero(np.bincount(best[0], minlength=len(q)) >= k)
                worst = np.full(len(q), np.inf)
                np.minimum.at(worst, best[0], best[2])
                floor[full] = np.maximum(floor[full], worst[full])
        yield pa.RecordBatch.from_arrays([pa.array(query_ids[best[0]], pa.int64()), pa.array(best[1], pa.int64()), pa.array(best[2])], ["query_id", "vec_id", "score"])

    return scan


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", pilot: int = 4096, query_block: int = 65536, width: float = 3.0) -> DataFrame:
    """The k rows of `vectors` with the largest inner product with each row of `queries`, the row with the query's own id aside.

    Returns query_id, rank (from 1), vec_id, score (double, from the original vectors); ties go to the smaller vec_id.
    The codes are computed once and stored, in the order of coarse cells. Queries come to the workers in blocks of at most
    query_block rows, one pass over the stored codes for each block, which skips runs of vectors that are too far as a whole. The
    centre, the cells, and a floor under each query's k-th best score, come from at most `pilot` rows; every row is indexed. `width`
    is the error bound in standard deviations of the estimate: at 3 about one true neighbour in 2,000 is passed over, and with
    an infinite width none, as then every vector is scored exactly.

    Defined cases: rows with a null id, and vectors that are null, zero, of another dimension than most of the pilot's,
    or hold null or non-finite components take no part; with fewer than k candidates all are returned; repeated ids are
    candidates each; an empty table gives an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    usable = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
    sample = usable.select(F.col(id_col).cast("long").alias("i"), F.col(vector_col).cast("array<double>").alias("v")).orderBy(F.xxhash64("i"), "i").limit(pilot).toArrow()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = np.diff(np.asarray(sample["v"].combine_chunks().offsets)) if sample.num_rows else np.zeros(0, int)
    if not (sizes > 0).any():
        return empty
    dim = int(np.bincount(sizes[sizes > 0]).argmax())
    x, at = _matrix(sample["v"], dim)
    if not len(x):
        return empty
    pilot_ids = sample["i"].to_numpy()[at]
    coder = Coder(dim, x)
    # one cell, however many rows it has, is split by id
    index = cut(build_index(vectors, coder, id_col, vector_col).repartitionByRange("cell", "vec_id").sortWithinPartitions("cell"))
    asked = queries.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(vector_col).cast("array<double>").alias("v"))
    found = None
    for ids, q in _query_blocks(asked, dim, query_block):
        floor = np.full(len(q), -np.inf)
        for lo in range(0, len(q), 1024):
            s = q[lo : lo + 1024] @ x.T
            s[ids[lo : lo + 1024, None] == pilot_ids[None, :]] = -np.inf
            if s.shape[1] > k:
                floor[lo : lo + 1024] = np.partition(s, -k, axis=1)[:, -k]
        floor -= 1e-9 * (1 + np.abs(np.where(np.isfinite(floor), floor, 0)))
        part = index.mapInArrow(_scan(coder, spark.sparkContext.broadcast((ids, q, floor)), k, width), FOUND_SCHEMA)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return empty
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _query_blocks(asked: DataFrame, dim: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of queries, read partition by partition; workers clean and pack them, so that the driver takes whole batches."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, at = _matrix(b.column(1), dim)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0).to_numpy()[at].tobytes()]), pa.array([x.tobytes()])], ["i", "v"])

    held, count = [], 0
    joined = lambda: tuple(np.concatenate(x) for x in zip(*held, strict=True))
    for r in asked.mapInArrow(pack, "i binary, v binary").toLocalIterator(prefetchPartitions=True):
        held.append((np.frombuffer(r["i"], np.int64), np.frombuffer(r["v"]).reshape(-1, dim)))
        count += len(held[-1][0])
        if count >= size:
            ids, rows = joined()
            for lo in range(0, count - size + 1, size):
                yield ids[lo : lo + size], rows[lo : lo + size]
            held = [(ids[count - count % size :], rows[count - count % size :])]
            count %= size
    if count:
        yield joined()

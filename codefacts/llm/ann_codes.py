"""Approximate nearest neighbours by randomly rotated one-bit codes.

Index: a vector's offset from the mean is turned by one random rotation; the signs of its axes are
packed to bits, with two correction scalars, the offset's length and the inner product between the
unit offset and its unit code. Search: the inner product of a query with the code, divided by the
second scalar, estimates the inner product with the vector, and an error bound of `spread` standard
deviations comes with it. Only vectors whose upper estimate reaches the k-th best lower estimate of
the block are scored on the original vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, matrix, moments, ship, usable
from .exact_topk import one_row_per_id, paired_blocks, ranked

FOUND = "query_id long, vec_id long, score double"


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix, the same for a dimension and seed everywhere."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, offset length and code correlation of each row."""
    turned = (x - mean) @ turn
    length = np.sqrt((turned * turned).sum(1))
    fit = np.abs(turned).sum(1) / (np.sqrt(x.shape[1]) * np.where(length > 0, length, 1))
    return np.packbits(turned > 0, axis=1), length, np.where(length > 0, fit, 1.0)


def search_block(ids, vectors, bits, length, fit, query_ids, queries, mean, turn, k: int, spread: float, step: int = 256):
    """The k nearest found of one block for each query: (query_id, vec_id, score) as flat arrays."""
    d = vectors.shape[1]
    signs = (np.unpackbits(bits, axis=1, count=d).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(d))
    gain = (length / np.maximum(fit, 1e-12)).astype(np.float32)
    loose = (spread * length * np.sqrt(np.maximum(1 - fit * fit, 0)) / np.maximum(fit, 1e-12) / np.sqrt(max(d - 1, 1))).astype(np.float32)
    out: list[tuple] = []
    n, most = len(ids), 1 << 16

    def exact(r, c):
        """Scores of pairs on the original vectors, a bounded number of pairs at a time."""
        return np.concatenate([np.einsum("ij,ij->i", q[r[i : i + most]], vectors[c[i : i + most]]) for i in range(0, max(len(r), 1), most)])

    for at in range(0, len(queries), step):
        q, qid = queries[at : at + step], query_ids[at : at + step]
        own = qid[:, None] == ids[None]
        estimate = ((q @ turn).astype(np.float32) @ signs.T) * gain + (q @ mean).astype(np.float32)[:, None]
        estimate[own] = -np.inf
        q_len = np.sqrt((q * q).sum(1)).astype(np.float32)
        upper = estimate + q_len[:, None] * (loose[None] + np.float32(1e-5) * (length.max(initial=0) + np.abs(mean).sum()).astype(np.float32))
        m = min(n, 4 * k)
        likely = np.argpartition(estimate, n - m, axis=1)[:, n - m :]
        rows = np.repeat(np.arange(len(q)), m)
        first = np.where(np.take_along_axis(own, likely, 1), -np.inf, exact(rows, likely.ravel()).reshape(len(q), m))
        kth = np.partition(first, m - k, axis=1)[:, m - k] if m >= k else np.full(len(q), -np.inf)
        reached = (upper >= kth[:, None].astype(np.float32)) & ~own
        np.put_along_axis(reached, likely, ~np.take_along_axis(own, likely, 1), 1)
        r, c = np.nonzero(reached)
        score = exact(r, c)
        order = np.lexsort((ids[c], -score, r))
        r, c, score = r[order], c[order], score[order]
        kept = np.arange(len(r)) - np.searchsorted(r, np.arange(len(q)))[r] < k
        out.append((qid[r[kept]], ids[c[kept]], score[kept]))
    return tuple(np.concatenate([o[j] for o in out]) for j in range(3)) if out else ([], [], [])


def build_index(vectors: DataFrame) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """(id, vector, bits, length, fit) for every usable row, and the mean of each dimension, taken over all rows."""
    ship(vectors.sparkSession)
    rows = one_row_per_id(columns(vectors, "id", "vector").where(usable(F.col("vector"), zero_too=False)).withColumn("vector", F.col("vector").cast("array<double>")))
    means = {d: s / n for d, (n, s, _) in moments(rows).items()}

    def run(batches):
        for b in batches:
            sizes = pa.compute.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
            for d in np.unique(sizes):
                part = b.filter(pa.array(sizes == d))
                bits, length, fit = encode(matrix(part.column(1), np.float64), means[int(d)], rotation(int(d)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x.tobytes() for x in bits], pa.binary()), pa.array(length), pa.array(fit)], names=["id", "vector", "bits", "length", "fit"])

    import pyarrow.compute  # noqa: F401

    return rows.mapInArrow(run, "id long, vector array<double>, bits binary, length double, fit double"), means


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, *, spread: float = 2.0, most_candidates: int = 16_384, most_queries: int = 4_096) -> DataFrame:
    """The k nearest found by inner product for each query: query_id, rank, vec_id, score (double, on the original vectors).

    Both tables: id long, vector array of numbers. A query never finds rows of its own id; ties go to the
    smaller id; repeated ids count once (smallest vector). Vectors that are null, empty or zero or hold
    null or non-finite components, and rows without id, take no part; vectors meet only their own
    dimension; a query with fewer than k candidates gets all of them.
    """
    index, means = build_index(vectors)
    asked = one_row_per_id(columns(queries, "id", "vector").where(usable(F.col("vector"), zero_too=False)).withColumn("vector", F.col("vector").cast("array<double>")))
    packed = index.select("id", F.col("vector"), F.struct("bits", "length", "fit").alias("code"))

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = ([], [], [])
        d = key[0].as_py()
        if len(left) and len(right):
            code = left.column("code").combine_chunks()
            bits = np.frombuffer(b"".join(code.field("bits").to_pylist()), np.uint8).reshape(len(left), -1)
            out = search_block(
                left.column("id").to_numpy(), matrix(left.column("vector"), np.float64), bits, code.field("length").to_numpy(), code.field("fit").to_numpy(),
                right.column("id").to_numpy(), matrix(right.column("vector"), np.float64), means[d], rotation(d), k, spread,
            )
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    return ranked(paired_blocks(packed, asked, most_candidates, most_queries).applyInArrow(run, FOUND), k)


def op6(spark, sf_dir: str) -> DataFrame:
    """Twenty nearest vectors for every vec_id divisible by 20; see nearest."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector"))
    return nearest(vectors, vectors.where("id % 20 = 0"), 20)

"""Exact top-k search by inner product over norm-sorted vectors.

Candidates are dealt by ranges of length. All queries meet the longest range first, which gives each
a k-th score; |q| times the greatest length of a range bounds every score in it, so a query goes on
only to ranges that may reach its k-th score. Inside a block, candidates are taken by descending
length and the same bound stops a query early. For the others a partial sum over the leading axes of
an SVD rotation plus the Cauchy-Schwarz bound of the two residuals decides which candidates are
scored exactly, the likeliest first. The bounds carry a slack for rounding, and a bound equal to the
k-th score is never pruned, so ties are whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, columns, cut, matrix, moments, ship, usable

FOUND = "query_id long, vec_id long, score long"
EXACT_IN_DOUBLE = 2.0**53


def best_of(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest scores of each row, ties to the smaller id, in the order of rows."""
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[kept], ids[kept], scores[kept]


def search_block(cand_ids, cand, query_ids, query, rotation, head: int, k: int, step: int = 2048, floor=None, counts: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact k best of one block for each query: (query_id, vec_id, score) as flat arrays.

    floor: a score for each query that k candidates of other blocks reach; what is lower may be left out.
    counts: "pairs" and "scored" are added up in it.
    """
    c, q = cand.astype(np.float64), query.astype(np.float64)
    lengths = np.sqrt((c * c).sum(1))
    order = np.lexsort((cand_ids, -lengths))
    cand_ids, cand, c, lengths = cand_ids[order], cand[order], c[order], lengths[order]
    q_len = np.sqrt((q * q).sum(1))
    if (np.abs(c).max(initial=0) * np.abs(q).max(initial=0) * c.shape[1]) < EXACT_IN_DOUBLE:
        cand, query = c, q
    c_rot, q_rot = c @ rotation, q @ rotation
    c_head, q_head = np.ascontiguousarray(c_rot[:, :head]), np.ascontiguousarray(q_rot[:, :head])
    c_rest, q_rest = np.sqrt((c_rot[:, head:] ** 2).sum(1)), np.sqrt((q_rot[:, head:] ** 2).sum(1))
    floor = np.full(len(q), -np.inf) if floor is None else floor
    found, scored, most = [], 0, 1 << 16

    def exact(r, j):
        """Scores of pairs, a bounded number of pairs at a time."""
        parts = [np.einsum("ij,ij->i", query[r[i : i + most]], cand[j[i : i + most]]) for i in range(0, len(r), most)]
        return np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64)

    for first in range(0, len(q), 256):
        some = np.arange(first, min(first + 256, len(q)))
        top = (np.empty(0, np.int64),) * 3
        kth = floor[some].astype(np.float64)

        def add(r, j):
            """Scores the pairs (row among some, candidate) and raises the k-th scores."""
            nonlocal top, scored
            scored += len(r)
            top = best_of(*(np.concatenate(x) for x in zip(top, (r, cand_ids[j], exact(some[r], j)))), k)
            n = np.bincount(top[0], minlength=len(some))
            full = n >= k
            kth[full] = np.maximum(kth[full], top[2][np.cumsum(n)[full] - 1])

        for at in range(0, len(c), step):
            to = min(at + step, len(c))
            active = np.flatnonzero(q_len[some] * lengths[at] * (1 + 1e-9) + 1e-6 >= kth)
            if not len(active):
                break
            a = some[active]
            bound = q_head[a] @ c_head[at:to].T + q_rest[a, None] * c_rest[None, at:to]
            bound += 1e-9 * q_len[a, None] * lengths[None, at:to] + 1e-6
            alive = (bound >= kth[active, None]) & (query_ids[a, None] != cand_ids[None, at:to])
            m = min(k, to - at)
            likely = np.zeros_like(alive)
            np.put_along_axis(likely, np.argpartition(np.where(alive, bound, -np.inf), to - at - m, axis=1)[:, to - at - m :], True, 1)
            likely &= alive
            r, j = np.nonzero(likely)
            add(active[r], at + j)
            r, j = np.nonzero(alive & ~likely & (bound >= kth[active, None]))
            add(active[r], at + j)
        found.append((query_ids[some[top[0]]], top[1], top[2]))
    if counts is not None:
        counts["pairs"] = counts.get("pairs", 0) + len(c) * len(q)
        counts["scored"] = counts.get("scored", 0) + scored
    return tuple(np.concatenate([f[n] for f in found]) for n in range(3)) if found else ([], [], [])


def one_row_per_id(vectors: DataFrame) -> DataFrame:
    """Repeated ids count once, with their smallest vector; rows without id take no part."""
    return vectors.where("id is not null").groupBy("id").agg(F.min("vector").alias("vector"))


def paired_blocks(candidates: DataFrame, queries: DataFrame, most_candidates: int, most_queries: int):
    """Candidates and queries, each row once for every block of the other side, grouped by (dim, block of candidates, block of queries)."""
    spark = candidates.sparkSession
    nc, nq = blocks(candidates.count(), most_candidates, spark), max(1, -(-queries.count() // most_queries))
    at = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    key = ["dim", "cb", "qb"]
    dim = F.size("vector").alias("dim")
    left = candidates.select("*", dim, at(nc).alias("cb")).withColumn("qb", every(nq))
    right = queries.select("*", dim, at(nq).alias("qb")).withColumn("cb", every(nc))
    return left.groupBy(*key).cogroup(right.groupBy(*key))


def ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def length_ranges(lengths: DataFrame, n: int, seed: int) -> list[float]:
    """Descending lower ends of ranges of length: the first holds about `seed` of the n rows, each next one twice as many; at most 9 ranges."""
    share, ends = max(seed / max(n, 1), 1 / 256), []
    at = share
    while at < 1:
        ends.append(1 - at)
        share *= 2
        at += share
    return sorted(set(lengths.approxQuantile("length", ends, 1 / 2048)), reverse=True) if ends else []


def exact_top_k(
    candidates: DataFrame, queries: DataFrame, k: int = 10, *, energy: float = 0.9, most_candidates: int = 16_384, most_queries: int = 4_096
) -> DataFrame:
    """The k candidates of highest inner product for each query, exactly: query_id, rank, vec_id, score.

    Both tables: id long, vector array<long>. A query never finds rows of its own id. Ties go to the
    smaller id. Repeated ids count once (smallest vector); rows with a null id, a null or empty vector
    or null components take no part; vectors meet only vectors of their own dimension; a query with
    fewer than k candidates gets all of them. Scores must fit 64 bits.
    """
    spark = candidates.sparkSession
    ship(spark)
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("length")
    whole = lambda df: cut(one_row_per_id(columns(df, "id", "vector").where(usable(F.col("vector"), zero_too=True))).select("id", "vector", F.size("vector").alias("dim"), length))
    candidates, queries = whole(candidates), whole(queries)
    rotations = {}
    for d, (_, _, gram) in moments(candidates.select(F.col("vector").cast("array<double>").alias("vector"))).items():
        values, axes = np.linalg.eigh(gram)
        values, axes = np.maximum(values[::-1], 0), np.ascontiguousarray(axes[:, ::-1])
        share = np.cumsum(values) / max(values.sum(), 1e-300)
        rotations[d] = (axes, int(np.searchsorted(share, energy) + 1))
    n, nq = candidates.count(), max(1, -(-queries.count() // most_queries))
    seed = min(most_candidates, max(512, n // 16))
    ends = length_ranges(candidates, n, seed)
    at = sum((F.when(F.col("length") < e, 1).otherwise(0) for e in ends), F.lit(0))
    candidates = candidates.withColumn("range", at)
    sizes = {r["range"]: (r.n, r.longest) for r in candidates.groupBy("range").agg(F.count("*").alias("n"), F.max("length").alias("longest")).collect()}
    parts = {r: blocks(size, most_candidates, spark) for r, (size, _) in sizes.items()}
    key = ["dim", "range", "part", "qb"]

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = ([], [], [])
        d = key[0].as_py()
        if len(left) and len(right):
            out = search_block(
                left.column("id").to_numpy(), matrix(left.column("vector"), np.int64), right.column("id").to_numpy(), matrix(right.column("vector"), np.int64), *rotations.get(d, (np.eye(d), d)), k,
                floor=right.column("floor").to_numpy(),
            )
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("query_id", "vec_id", "score"), out)})

    def search(ranges: list[int], asked: DataFrame) -> DataFrame:
        """Found rows of the queries of `asked` (with floor) in these ranges, each query only where its length may reach its floor."""
        deal = F.create_map(*[F.lit(x) for r in ranges for x in (r, parts[r])])
        left = candidates.where(F.col("range").isin(ranges)).withColumn("part", F.pmod(F.xxhash64("id"), deal[F.col("range")]).cast("int"))
        left = left.select("id", "vector", "dim", "range", "part", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"))
        reach = F.array(*[F.struct(F.lit(r).alias("range"), F.lit(parts[r]).alias("parts"), F.lit(float(sizes[r][1])).alias("longest")) for r in ranges])
        right = asked.withColumn("r", F.explode(reach)).where(F.col("length") * F.col("r.longest") * (1 + 1e-9) + 1e-6 >= F.col("floor"))
        own = [F.col(c).alias(c) for c in ("id", "vector", "dim", "qb")]  # candidates and queries may be one table
        right = right.select(*own, "floor", "r.range", F.explode(F.sequence(F.lit(0), F.col("r.parts") - 1)).alias("part"))
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, FOUND)

    asked = queries.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(nq)).cast("int"))
    order = sorted(sizes)
    if not order:
        return ranked(spark.createDataFrame([], FOUND), k)
    longest = ranked(search(order[:1], asked.withColumn("floor", F.lit(float("-inf")))), k)
    if len(order) == 1:
        return longest
    longest = cut(longest)
    floors = longest.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("floor"))
    rest = asked.join(floors, "id", "left").fillna(float("-inf"), ["floor"])
    return ranked(longest.drop("rank").unionByName(search(order[1:], rest)), k)


def op4(spark, sf_dir: str) -> DataFrame:
    """Ten best integer inner products for every vec_id divisible by 100; see exact_top_k."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(usable(F.col("embedding"), zero_too=True))
    scaled = vectors.select(F.col("vec_id").cast("long").alias("id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 1024).cast("long")).alias("vector"))
    return exact_top_k(scaled, scaled.where("id % 100 = 0"), 10)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

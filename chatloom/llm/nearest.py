"""Approximate nearest neighbours: multi-index hashing over learned rotated binary codes.

Vectors are scaled to length one, centred, projected on their principal axes and rotated so that the
signs lose least (iterative quantisation); the signs are the code, of at most 64 bits. Mean, axes,
rotation and search radius are fitted on a sample of at most FIT_ROWS rows; every row is indexed.

A code's bytes are its substrings. Within a block of rows each substring has its own bucket index.
For a radius R the substrings get radii r_i with sum(r_i + 1) = R + 1, so by the pigeonhole principle
every code within R is within r_i in some substring i: probing the buckets within r_i retrieves all
of them, a bit count drops the others, and the rest are ranked by cosine in double precision. R holds
RADIUS_SHARE of the sample's own nearest neighbours; where a block has fewer than k codes within R,
the search there widens until it has k. So every query gets k neighbours, or all candidates.

Rows are dealt to blocks by a hash of their id, and queries meet the blocks in blocks of their own, so
floats are reranked where they lie and only k rows of a query leave a block. An index over the whole
table, with candidates sent to their floats, would move less only where few codes are within R; where
neighbours differ by noise in every dimension, as in the tables at hand, R holds a twentieth of all
codes (README). A substring is a byte: all 256 buckets of a block are compared with a query's at once.
Equal vectors of a block are searched as one; its k + 1 smallest ids stand for the rest, which no
answer of k can hold.

Vectors that are null, of a length other than the most frequent one (the larger of ties), all zeros,
or that hold null or non-finite components take no part, nor do rows without an id. Rows with equal
ids count once, by their best score; of query rows with equal ids the smallest vector asks. An empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .workspace import Workspace

FIT_ROWS = 10_000
BITS = 64
RADIUS_SHARE = 0.985
ROUNDS = 30
BLOCK_ROWS = 8192
QUERY_ROWS = 32768
_APART = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])


class Code:
    """mean, axes and rotation in one matrix; code(x) gives 64-bit numbers."""

    def __init__(self, sample: np.ndarray, k: int = 5):
        x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.mean = x.mean(0)
        bits = min(BITS, max(8, x.shape[1] // 8 * 8))
        _, axes = np.linalg.eigh(np.cov((x - self.mean).T).reshape(x.shape[1], -1)) if len(x) > 1 else (None, np.eye(x.shape[1]))
        axes = axes[:, ::-1][:, :bits]
        if axes.shape[1] < bits:  # fewer axes than a byte has bits
            axes = np.hstack([axes, np.random.default_rng(1).standard_normal((len(axes), bits - axes.shape[1]))])
        z = (x - self.mean) @ axes
        rotation = np.linalg.qr(np.random.default_rng(0).standard_normal((bits, bits)))[0]
        for _ in range(ROUNDS):
            u, _, v = np.linalg.svd(np.where(z @ rotation >= 0, 1.0, -1.0).T @ z)
            rotation = (u @ v).T
        self.matrix, self.bits = axes @ rotation, bits
        self.radius = self._radius(x, k)

    def code(self, x: np.ndarray) -> np.ndarray:
        """Codes of vectors, as rows of bytes."""
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        return np.packbits((unit - self.mean) @ self.matrix >= 0, axis=1)

    def _radius(self, x: np.ndarray, k: int) -> int:
        if len(x) < 2:
            return self.bits
        codes = self.code(x)
        asked = np.linspace(0, len(x) - 1, min(len(x), 400)).astype(int)
        near = x[asked] @ x.T
        near[np.arange(len(asked)), asked] = -np.inf
        best = np.argpartition(-near, min(k, len(x) - 1) - 1, axis=1)[:, : min(k, len(x) - 1)]
        apart = np.bitwise_count(codes[best] ^ codes[asked][:, None, :]).sum(2)
        return int(np.quantile(apart, RADIUS_SHARE, method="higher"))


class Index:
    """Bucket indexes of a block's codes, one per byte."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.orders = [np.argsort(c, kind="stable") for c in codes.T]
        self.counts = [np.bincount(c, minlength=256) for c in codes.T]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose codes are at most radius bits from code, all of them."""
        parts = len(code)
        base, more = divmod(radius + 1, parts)
        hit = np.zeros(len(self.codes), bool)
        for i in range(parts):
            reach = base + (i < more) - 1  # sum of (reach + 1) is radius + 1
            if reach >= 0:
                hit[self.orders[i][np.repeat(_APART[code[i]] <= reach, self.counts[i])]] = True
        rows = np.flatnonzero(hit)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(1) <= radius]


def search_block(code: Code, ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, cosine) of each query's k nearest found among the rows."""
    order = np.lexsort((ids, *x.T[::-1]))
    ids, x = ids[order], x[order]
    fresh = np.r_[True, (x[1:] != x[:-1]).any(1)]
    group = np.cumsum(fresh) - 1
    again = np.r_[False, ~fresh[1:] & (ids[1:] == ids[:-1])]
    ids, group = ids[~again], group[~again]
    begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ends = np.r_[begins[1:], len(ids)]
    x = x[fresh]
    index, norms = Index(code.code(x)), np.sqrt((x * x).sum(1))
    codes = code.code(q)
    out = []
    for n, (own, v) in enumerate(zip(query_ids.tolist(), q, strict=True)):
        radius = code.radius
        while True:
            rows = index.within(codes[n], radius)
            total = int((ends[rows] - begins[rows]).sum())
            if total > k or radius >= code.bits:
                break
            radius = min(code.bits, radius + 4)
        score = (x[rows] * v).sum(1) / (norms[rows] * np.sqrt((v * v).sum()))
        if len(rows) > 2 * k + 2:
            floor = np.partition(score, -(k + 1))[-(k + 1)]
            keep = score >= floor
            rows, score = rows[keep], score[keep]
        found = [(-s, i) for r, s in zip(rows.tolist(), score.tolist(), strict=True) for i in ids[begins[r] : min(ends[r], begins[r] + k + 1)].tolist() if i != own]
        seen: set[int] = set()
        for s, i in sorted(found):
            if i not in seen:
                seen.add(i)
                out.append((own, i, -s))
            if len(seen) == k:
                break
    a, b, c = zip(*out, strict=True) if out else ((), (), ())
    return np.array(a, np.int64), np.array(b, np.int64), np.array(c, np.float64)


def _matrix(column: pa.ChunkedArray, d: int) -> np.ndarray:
    """Rows in double precision, each scaled by a power of two, which changes no cosine, so that no square overflows or vanishes."""
    one = column.combine_chunks()
    one = one.chunk(0) if isinstance(one, pa.ChunkedArray) else one
    x = one.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1]) if x.size else x


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, work: Workspace | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of vectors (vec_id, embedding) found for each of queries (the same columns)."""
    spark = vectors.sparkSession
    work = work or Workspace(spark, "nearest")

    kinds = {x.schema["embedding"].dataType.simpleString() for x in (vectors, queries)}
    kind = "array<float>" if kinds == {"array<float>"} else "array<double>"  # as narrow as it comes, until it is searched

    def usable(x: DataFrame) -> DataFrame:
        x = x.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
        bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        return x.where("vec_id is not null and embedding is not null").where(~bad & F.exists("embedding", lambda v: v != 0))

    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = usable(vectors)
    common = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return empty
    d, n = common.d, common["count"]
    rows = rows.where(F.size("embedding") == d)
    asks = usable(queries).where(F.size("embedding") == d).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    draw = F.xxhash64("vec_id", F.lit("fit"))
    sample = rows.where(F.pmod(draw, F.lit(1 << 30)) < F.lit(int(min(1.0, 1.2 * FIT_ROWS / n) * (1 << 30)))).orderBy(draw, "vec_id").limit(FIT_ROWS).select("embedding").toArrow()
    if not sample.num_rows:
        sample = rows.orderBy(draw, "vec_id").limit(FIT_ROWS).select("embedding").toArrow()
    code = Code(_matrix(sample.column("embedding"), d), k)
    asked = work.save(asks, "queries")
    blocks, query_blocks = max(1, -(-n // BLOCK_ROWS)), max(1, -(-asked.count() // QUERY_ROWS))
    block = lambda m: F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = rows.select(block(blocks).alias("b"), every(query_blocks).alias("q"), "vec_id", "embedding")
    right = asked.select(every(blocks).alias("b"), block(query_blocks).alias("q"), "vec_id", "embedding")
    held = spark.sparkContext.broadcast(code)

    def search(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        got = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if mine.num_rows and theirs.num_rows:
            got = search_block(held.value, mine.column("vec_id").to_numpy(), _matrix(mine.column("embedding"), d), theirs.column("vec_id").to_numpy(), _matrix(theirs.column("embedding"), d), k)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, got), strict=True)))

    found = left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_multi_index_hashing(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))

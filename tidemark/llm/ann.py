"""Nearest neighbours by inner product: a block matrix join with int8 product tiles.

Vectors are dealt by hash into candidate blocks and query blocks; every pair of blocks is one tile.
In a tile the vectors are quantised to int8 (one scale each). The product of two int8 matrices
approximates all inner products with a known error bound, so a query's candidates whose upper bound
lies below its k-th largest lower bound are out; the rest are recomputed in double precision. Each
tile yields a query's k best, and these short sorted lists are merged by heaps.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from .common import materialize

#: Vectors of a block, about. A tile holds two blocks and a strip of their products.
CANDIDATES = 8192
QUERIES = 4096
STRIP = 512


def usable(vectors: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<float>): without null ids, null, empty, zero or non-finite vectors."""
    v = F.col(vec_col)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return vectors.filter(F.col("vec_id").isNotNull() & v.isNotNull() & F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def quantise(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Integers in [-127, 127] (held as float32 for the matrix product, which stays exact), scales, and
    norms of the rounded vectors and of the rounding errors."""
    scale = np.abs(m).max(axis=1, keepdims=True).astype(np.float64) / 127
    q = np.rint(m / scale)
    approx = q * scale
    return q.astype(np.float32), scale[:, 0], np.linalg.norm(approx, axis=1), np.linalg.norm(m - approx, axis=1)


def tile(query_ids, queries, cand_ids, cands, k: int):
    """(query index, candidate id, score) of each query's k best by (-score, id) in this tile. Rows are
    float64; equal candidates are scored once and stand for their k + 1 smallest ids, which suffice."""
    order = np.argsort(cand_ids, kind="stable")
    cand_ids, cands = cand_ids[order], cands[order]
    view = np.ascontiguousarray(cands).view(np.dtype((np.void, cands.dtype.itemsize * cands.shape[1])))[:, 0]
    _, first, inverse = np.unique(view, return_index=True, return_inverse=True)
    members = np.argsort(inverse, kind="stable")
    sizes = np.bincount(inverse)
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    distinct = cands[first]
    q8, qs, qn, qe = quantise(queries)
    c8, cs, cn, ce = quantise(distinct)
    exact_in_f32 = queries.shape[1] * 127 * 127 < 1 << 24
    if not exact_in_f32:
        q8, c8 = q8.astype(np.float64), c8.astype(np.float64)
    out_q, out_id, out_score = [], [], []
    # the k + 1 best, as the query itself may be among them
    take = min(k + 1, len(distinct))
    for lo in range(0, len(queries), STRIP):
        approx = (q8[lo : lo + STRIP] @ c8.T).astype(np.float64) * qs[lo : lo + STRIP, None] * cs[None, :]
        # |x.y - x'.y'| <= |x'||e_y| + |e_x||y'| + |e_x||e_y|, and a little for the arithmetic
        err = qn[lo : lo + STRIP, None] * ce[None, :] + qe[lo : lo + STRIP, None] * (cn + ce)[None, :]
        err += 1e-9 * (np.abs(approx) + err) + 1e-300
        low = np.partition(approx - err, len(distinct) - take, axis=1)[:, len(distinct) - take]
        rows, cols = np.nonzero(approx + err >= low[:, None])
        for a in range(0, len(rows), 200_000):
            r, c = rows[a : a + 200_000], cols[a : a + 200_000]
            score = _products(queries, lo + r, distinct, c)
            # each distinct vector stands for its smallest ids
            n = np.minimum(sizes[c], k + 1)
            rep = np.repeat(np.arange(len(c)), n)
            nth = np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
            ids = cand_ids[members[start[c[rep]] + nth]]
            other = ids != query_ids[lo + r[rep]]
            out_q.append((lo + r[rep])[other])
            out_id.append(ids[other])
            out_score.append(score[rep][other])
    qi, ids, score = (np.concatenate(x) if x else np.zeros(0, int) for x in (out_q, out_id, out_score))
    order = np.lexsort((ids, -score, qi))
    qi, ids, score = qi[order], ids[order], score[order]
    starts = np.flatnonzero(np.concatenate([[True], qi[1:] != qi[:-1]])) if len(qi) else np.zeros(0, int)
    rank = np.arange(len(qi)) - np.repeat(starts, np.diff(np.append(starts, len(qi))))
    keep = rank < k
    return qi[keep], ids[keep], score[keep]


def _products(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products x[i] . y[j] in double precision, summed in the order of the components, so that
    equal pairs have equal scores wherever they stand."""
    out = np.zeros(len(i))
    for d in range(x.shape[1]):
        out += x[i, d] * y[j, d]
    return out


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.float32())
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def nearest(vectors: DataFrame, k: int = 20, query_every: int = 20, vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each usable vector whose id is divisible by query_every, its
    k nearest others, nearest first, ties to the smaller id; all others if there are fewer. Vectors
    are compared with those of the same length. Rows that share the query's id are the query's own;
    repeated candidate rows count each."""
    spark = vectors.sparkSession
    good = materialize(usable(vectors, vec_col).withColumn("dim", F.size("v")), "vectors")
    n = good.count()
    nq = good.filter(F.col("vec_id") % query_every == 0).count()
    cols, rows = max(1, -(-n // CANDIDATES)), max(1, -(-nq // QUERIES))
    key = F.xxhash64("vec_id", F.lit(5))
    row_of, col_of = F.pmod(key, F.lit(rows)).cast("int"), F.pmod(F.xxhash64("vec_id", F.lit(6)), F.lit(cols)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    # the stated query set against all rows, in blocks: each side is dealt to the tiles of its row or column
    q = good.filter(F.col("vec_id") % query_every == 0).select("dim", row_of.alias("i"), every(cols).alias("j"), F.lit(True).alias("is_query"), "vec_id", "v")
    c = good.select("dim", every(rows).alias("i"), col_of.alias("j"), F.lit(False).alias("is_query"), "vec_id", "v")

    def one(key, t):
        dim = key[0].as_py()
        is_query = np.asarray(t["is_query"])
        ids = np.asarray(t["vec_id"])
        m = _matrix(t["v"], dim)
        if not is_query.any() or is_query.all():
            qi, cid, score = np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0)
            query_ids = ids[:0]
        else:
            query_ids = ids[is_query]
            qi, cid, score = tile(query_ids, m[is_query], ids[~is_query], m[~is_query], k)
        return pa.table({"query_id": pa.array(query_ids[qi] if len(qi) else [], pa.int64()), "vec_id": pa.array(cid, pa.int64()), "score": pa.array(score, pa.float64())})

    tiles = q.unionByName(c).groupBy("dim", "i", "j").applyInArrow(one, "query_id long, vec_id long, score double")
    tiles = materialize(tiles, "tiles")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = tiles.repartition(parts, "query_id").sortWithinPartitions("query_id", F.desc("score"), "vec_id")
    schema = StructType([StructField("query_id", LongType()), StructField("rank", IntegerType()), StructField("vec_id", LongType()), StructField("score", DoubleType())])

    def merge(batches):
        current, heap = None, []

        def done():
            best = sorted(heap, reverse=True)
            return [(current, r + 1, -i, s) for r, (s, i) in enumerate(best)]

        for b in batches:
            out = []
            for qid, vid, s in zip(*(b.column(x).to_pylist() for x in range(3))):
                if qid != current:
                    out += done()
                    current, heap = qid, []
                if len(heap) < k:
                    heapq.heappush(heap, (s, -vid))
                elif (s, -vid) > heap[0]:
                    heapq.heapreplace(heap, (s, -vid))
            yield _rows(out, schema)
        if heap:
            yield _rows(done(), schema)

    return dealt.mapInArrow(merge, schema)


def _rows(rows: list[tuple], schema: StructType) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.float64()))], names=schema.names)

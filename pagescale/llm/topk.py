"""Exact top-k inner products by pivot-table elimination.

Every vector is stored with its distances to ``pivots`` pivots. For a query the table gives
max |d(q, p) - d(c, p)| as a lower bound of d(q, c), and with the norms an upper bound of the inner
product. The candidates of the highest bounds are evaluated first and give a k-th best score; those whose
bound is below it cannot enter, the others are evaluated, so the answer is exact.

The query set meets all rows in blocks: rows and queries are hashed to blocks of a fixed
size, a task holds one block of each, and only the k best of a (query, block) leave it. The
pivots are a bounded sample (``pivots`` rows by hash order) of the vectors.

Defined cases: vectors that are null or empty, or hold a null or non-finite component, and rows with a
null id take no part; vectors of different lengths are not compared; an id that occurs in several rows is
one item whose score is the best of its rows; an empty table gives an empty result; other columns are not read.
Components must fit the 53 bits of a double, also summed up in a product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagescale.session import materialise

ROWS = 8192  # candidates in a block
QUERIES = 512  # queries in a block
FIRST = 256  # candidates evaluated before the test


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    v = F.col("v")
    inf = F.lit(float("inf"))
    d = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return d.where(F.col("id").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def pivot_table(vectors: DataFrame, pivots: int) -> DataFrame:
    """(id, dim, v, piv): distances to the pivots of the vector's own length."""
    picked: dict[int, list] = {}
    dims = [r[0] for r in vectors.select(F.size("v")).distinct().limit(1000).collect()]
    for n in dims:
        rows = vectors.where(F.size("v") == n).orderBy(F.xxhash64("id"), "id").limit(pivots).select("v").collect()
        picked[n] = [r[0] for r in rows]
    if not picked:
        picked = {0: []}

    def run(batches):
        for b in batches:
            sizes = b.column(1).value_lengths().to_numpy()
            for n in np.unique(sizes).tolist():
                own = b.filter(pa.array(sizes == n))
                x, p = matrix(own.column(1)), np.array(picked[n], float).reshape(-1, n)
                d2 = (x * x).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * x @ p.T
                piv = np.sqrt(np.maximum(d2, 0)).ravel()
                at = pa.array(np.arange(len(x) + 1) * len(p), pa.int32())
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(np.full(len(x), n), pa.int32()), own.column(1), pa.ListArray.from_arrays(at, pa.array(piv))], ["id", "dim", "v", "piv"])

    return vectors.mapInArrow(run, "id bigint, dim int, v array<double>, piv array<double>")


def best(q: np.ndarray, x: np.ndarray, ids: np.ndarray, bound: np.ndarray, k: int):
    """Ids and scores of the k best rows of one block for each of some queries, exactly. ``bound`` (queries, rows) is -inf
    for a query's own row. The rows of the highest bounds give a k-th best score; rows whose bound is below it
    for every query are settled, the others meet all these queries in one product."""
    n = len(ids)
    kth = np.full(len(q), -np.inf)
    for j, own in enumerate(bound):
        head = np.argpartition(own, n - FIRST)[n - FIRST :] if n > FIRST else np.arange(n)
        head = head[np.isfinite(own[head])]
        if len(head) >= k:
            kth[j] = np.partition(x[head] @ q[j], len(head) - k)[len(head) - k]
    open_ = (bound >= kth[:, None]) & np.isfinite(bound)
    rows = np.flatnonzero(open_.any(0))
    scores, open_, ids = q @ x[rows].T, open_[:, rows], ids[rows]
    for s, mine in zip(scores, open_, strict=True):
        s, i = s[mine], ids[mine]
        if len(s) > k:
            high = s >= np.partition(s, len(s) - k)[len(s) - k]
            s, i = s[high], i[high]
        order = np.lexsort((i, -s))[:k]
        yield i[order], s[order]


def _cell(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out_q, out_i, out_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if left.num_rows and right.num_rows:
            ids, x, xp = right["id"].to_numpy(), matrix(right["v"]), matrix(right["piv"])
            qid, q, qp = left["id"].to_numpy(), matrix(left["v"]), matrix(left["piv"])
            xx, qq = (x * x).sum(1), (q * q).sum(1)
            u, inv = np.unique(ids, return_inverse=True)
            single = len(u) == len(ids)

            def folded(q, own, x):
                for j, one in enumerate(q):
                    s = np.full(len(u), -np.inf)
                    np.maximum.at(s, inv, x @ one)
                    keep = u != own[j]
                    i, s = u[keep], s[keep]
                    o = np.lexsort((i, -s))[:k]
                    yield i[o], s[o]

            xt = np.ascontiguousarray(xp.T.astype(np.float32))
            for lo in range(0, len(q), 32):
                part = qp[lo : lo + 32].astype(np.float32)
                low = np.zeros((len(part), len(x)), np.float32)
                gap = np.empty_like(low)
                for p in range(xt.shape[0]):
                    np.subtract(part[:, p : p + 1], xt[p], out=gap)
                    np.abs(gap, out=gap)
                    np.maximum(low, gap, out=low)
                size = qq[lo : lo + 32, None] + xx[None, :]
                upper = (size - low.astype(float) ** 2) / 2 + 1e-5 * size + 1e-3  # rounding of the bound never drops a row
                if single:
                    upper[ids[None, :] == qid[lo : lo + 32, None]] = -np.inf
                    tops = best(q[lo : lo + 32], x, ids, upper, k)
                else:  # repeated ids: fold before cutting
                    tops = folded(q[lo : lo + 32], qid[lo : lo + 32], x)
                for a, (i, s) in enumerate(tops, lo):
                    out_q.append(np.full(len(i), qid[a]))
                    out_i.append(i)
                    out_s.append(s)
        return pa.table({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_i), "score": np.concatenate(out_s).astype(np.int64)})
    return run


def top_k(vectors: DataFrame, is_query, k: int = 20, pivots: int = 32) -> DataFrame:
    """(query_id, rank, vec_id, score) over (id, v) with integral components.

    Queries are the rows where ``is_query`` holds; candidates all rows but the query's
    own. Ties go to the smaller id.
    """
    table = materialise(pivot_table(vectors, pivots))
    n, m = table.count(), table.where(is_query).count()
    blocks, cuts = -(-n // ROWS), -(-m // QUERIES)
    every = lambda c: F.explode(F.sequence(F.lit(0), F.lit(max(0, c - 1))))
    rows = table.withColumn("cb", F.pmod(F.xxhash64("id"), F.lit(max(1, blocks))).cast("int")).withColumn("qb", every(cuts))
    asks = table.where(is_query).withColumn("qb", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(max(1, cuts))).cast("int")).withColumn("cb", every(blocks))
    cols = ["dim", "qb", "cb", "id", "v", "piv"]
    found = asks.select(cols).groupBy("dim", "qb", "cb").cogroup(rows.select(cols).toDF(*cols).groupBy("dim", "qb", "cb")).applyInArrow(_cell(k), "query_id bigint, vec_id bigint, score bigint")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(df: DataFrame, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v) with components floor(scale * x)."""
    return usable(df, id_col, vec_col).select("id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("double")).alias("v"))

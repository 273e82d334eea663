"""Centroid clustering in exact integers, with candidates filtered in PCA-rotated coordinates.

Vectors become integers, floor(scale * x). The covariance of all of them gives a rotation; a stored row
keeps its ``lead`` leading rotated coordinates and the norm of the others. For a vector x and a centroid
c the squared distance of the leading coordinates plus the squared difference of the two residual
norms is never more than the squared distance of x and c, so a centroid whose bound lies above a distance that is
already known cannot be nearest. The centroid with the least bound is computed first, in integers, then
every other one that its bound does not rule out; ties go to the smaller number. The bound is a
float, so a margin far above its rounding is taken off; results never depend on the rotation.

A round is one pass over the stored rows: each task adds up its vectors by cluster and
returns k x dim sums, which fold in a shuffle; the driver holds the k centroids. Sums
are exact, a centroid is the floor of the mean.

Defined cases: vectors that are null, of another length than ``dim``, or hold null or non-finite components
take no part; a null id is kept and comes last among the starting vectors; repeated ids are vectors of
their own (equal hashes start in the order of their components); fewer vectors than centroids give
fewer centroids; an empty table gives an empty result; other columns are not read. Components from 2^27 on
are an error, as squared distances would not fit 64 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagescale.llm.topk import matrix
from pagescale.session import materialise

LEAD = 16
LIMIT = 2**27
MARGIN = 1e-9  # of the squared norms, taken off every bound


def integers(df: DataFrame, id_col: str, vec_col: str, dim: int, scale: int) -> DataFrame:
    """(id, x) of the vectors that take part, as integers."""
    v, inf = F.col("v"), F.lit(float("inf"))
    d = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    d = d.where((F.size(v) == dim) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < inf)))
    x = F.transform(v, lambda c: F.floor(c * F.lit(float(scale))))
    return d.select("id", F.when(F.forall(v, lambda c: F.abs(c * F.lit(float(scale))) < F.lit(float(LIMIT))), x)
                    .otherwise(F.raise_error(F.lit("a component is too large for exact squared distances")).cast("array<bigint>")).alias("x"))


def add_up(rows: DataFrame, dim: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, sums and sums of products of all vectors; every task returns its own, folded by entry."""
    def run(batches):
        n, s, m = 0, np.zeros(dim), np.zeros((dim, dim))
        for b in batches:
            x = matrix(b.column(0)).astype(float)
            n, s, m = n + len(x), s + x.sum(0), m + x.T @ x
        i, j = np.triu_indices(dim)
        i, j = np.r_[np.full(dim + 1, -1), i], np.r_[-1, np.arange(dim), j]
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.r_[n, s, m[np.triu_indices(dim)]])], ["i", "j", "s"])

    got = rows.select("x").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toArrow()
    i, j, v = (got[c].to_numpy() for c in ("i", "j", "s"))
    m = np.zeros((dim, dim))
    m[i[i >= 0], j[i >= 0]] = m[j[i >= 0], i[i >= 0]] = v[i >= 0]
    s = np.zeros(dim)
    s[j[(i < 0) & (j >= 0)]] = v[(i < 0) & (j >= 0)]
    return int(v[(i < 0) & (j < 0)].sum()), s, m


class Rotation:
    """The principal directions of the vectors, largest variance first, about their mean."""

    def __init__(self, n: int, sums: np.ndarray, products: np.ndarray, lead: int):
        self.mean, self.lead = sums / max(1, n), lead
        self.axes = np.linalg.eigh(products / max(1, n) - np.outer(self.mean, self.mean))[1][:, ::-1]

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates and the norms of the others."""
        turned = (x - self.mean) @ self.axes
        return turned[:, : self.lead], np.sqrt((turned[:, self.lead :] ** 2).sum(1))


def nearest(x: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, turn: Rotation) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number, squared distance and number of centroids computed for each row."""
    c_lead, c_rest = turn(centroids)
    size, c_size = (lead**2).sum(1) + rest**2, (c_lead**2).sum(1) + c_rest**2
    low = np.empty((len(x), len(centroids)))
    for j in range(len(centroids)):
        low[:, j] = ((lead - c_lead[j]) ** 2).sum(1) + (rest - c_rest[j]) ** 2 - MARGIN * (size + c_size[j])
    first = low.argmin(1)
    number, best = first.copy(), ((x - centroids[first]) ** 2).sum(1)
    computed = np.ones(len(x), np.int64)
    for j in range(len(centroids)):
        at = np.flatnonzero((low[:, j] <= best) & (first != j))
        d = ((x[at] - centroids[j]) ** 2).sum(1)
        better = (d < best[at]) | ((d == best[at]) & (j < number[at]))
        best[at[better]], number[at[better]] = d[better], j
        computed[at] += 1
    return number, best, computed


def start(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of ``seed:id``."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.select(h.alias("h"), "x").orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()
    return np.array([r["x"] for r in first], np.int64)


def _stored(rows: DataFrame, turn: Rotation) -> DataFrame:
    def run(batches):
        for b in batches:
            x = matrix(b.column(1))
            lead, rest = turn(x)
            ends = pa.array(np.arange(len(x) + 1) * lead.shape[1], pa.int32())
            whole = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), whole, pa.ListArray.from_arrays(ends, pa.array(lead.ravel())), pa.array(rest)], ["id", "x", "lead", "rest"])

    return materialise(rows.mapInArrow(run, "id bigint, x array<int>, lead array<double>, rest double"))


def _assigned(stored: DataFrame, centroids: np.ndarray, turn: Rotation) -> DataFrame:
    def run(batches):
        for b in batches:
            number, distance, computed = nearest(matrix(b.column(1)).astype(np.int64), matrix(b.column(2)), b.column(3).to_numpy(), centroids, turn)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(number, pa.int32()), pa.array(distance), pa.array(computed, pa.int32())], ["id", "cluster", "distance", "computed"])

    return stored.mapInArrow(run, "id bigint, cluster int, distance bigint, computed int")


def _means(stored: DataFrame, centroids: np.ndarray, turn: Rotation) -> np.ndarray:
    """The centroids of the next round."""
    k, dim = centroids.shape

    def run(batches):
        n, s = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for b in batches:
            x = matrix(b.column(0)).astype(np.int64)
            number = nearest(x, matrix(b.column(1)), b.column(2).to_numpy(), centroids, turn)[0]
            n += np.bincount(number, minlength=k)
            for j in np.unique(number):
                s[j] += x[number == j].sum(0)
        c, at = np.divmod(np.arange(k * dim), dim)
        full = n[c] > 0
        yield pa.RecordBatch.from_arrays([pa.array(v[full], t) for v, t in ((c, pa.int32()), (at, pa.int32()), (n[c], pa.int64()), (s.ravel(), pa.int64()))], ["c", "at", "n", "s"])

    sums = stored.select("x", "lead", "rest").mapInArrow(run, "c int, at int, n bigint, s bigint").groupBy("c", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out = centroids.copy()
    for r in sums.collect():  # k x dim rows
        out[r["c"], r["at"]] = r["s"] // r["n"]
    return out


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vec_col: str = "embedding", lead: int = LEAD) -> tuple[DataFrame, np.ndarray]:
    """One row per vector: (id, cluster, distance, cluster_inertia, inertia, centroid_sha256, computed), and the
    centroids. ``computed`` is the number of centroids that the bounds left to integers in the last pass."""
    rows = integers(vectors, id_col, vec_col, dim, scale)
    turn = Rotation(*add_up(rows, dim), min(lead, dim))
    stored = _stored(rows, turn)
    centroids = start(stored, k, seed).reshape(-1, dim)
    if not len(centroids):
        none = stored.select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), *[F.lit(0).cast("bigint").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"), F.lit(0).alias("computed"))
        return none.limit(0), centroids
    for _ in range(rounds):
        centroids = _means(stored, centroids, turn)
    found = materialise(_assigned(stored, centroids, turn), stored)
    inertia = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    about = vectors.sparkSession.createDataFrame([(j, inertia[j], sum(inertia.values()), names[j]) for j in inertia], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    out = found.join(F.broadcast(about), "cluster")  # at most k rows
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "computed"), centroids


def _round_sql(r: int) -> str:
    dot = "list_dot_product"
    return f"""
a{r} as materialized (select v.i, arg_min(c.k, ({dot}(v.x, v.x) + {dot}(c.x, c.x) - 2 * {dot}(v.x, c.x)) * 16 + c.k) k, min({dot}(v.x, v.x) + {dot}(c.x, c.x) - 2 * {dot}(v.x, c.x)) d from v, c{r} c group by 1),
s{r} as (select k, p, cast(sum(cast(x[p] as bigint)) as bigint) s, count(*) n from (select a.k, v.x, unnest(range(1, 65)) p from a{r} a join v using (i)) group by 1, 2),
c{r + 1} as materialized (select c.k, coalesce(m.x, c.x) x from c{r} c left join (select k, list(cast((s - ((s % n) + n) % n) // n as double) order by p) x from s{r} group by 1) m using (k))"""


def check_sql() -> str:
    """The same by plain distances to all centroids, the rounds unrolled."""
    return f"""with v as materialized (select row_number() over () i, vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) x from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as materialized (select row_number() over (order by h, x) - 1 k, x from (select x, sha256('1:' || vec_id) h from v order by h nulls last, x limit 16)),{",".join(_round_sql(r) for r in range(4))},
t as (select k, sum(d) t from a3 group by 1)
select v.vec_id, cast(a.k as integer) "cluster", cast(a.d as bigint) distance, cast(t.t as bigint) cluster_inertia, cast((select sum(t) from t) as bigint) inertia,
  sha256(array_to_string(list_transform(c.x, lambda x: cast(x as bigint)), ',')) centroid_sha256
from a3 a join v using (i) join c3 c using (k) join t using (k)"""

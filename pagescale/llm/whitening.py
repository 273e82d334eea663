"""Whitening of embeddings by spectral divide and conquer.

Vectors become integers x = floor(scale * c) + offset. One pass adds them up exactly, a second one adds up the
products of the centred rows (n * x - S) / n, each task its own and folded by entry, so the covariance V
never comes from large uncentred products. V is dim x dim and is split on the driver:

* QDWH (dynamically weighted Halley steps by QR) gives the orthogonal polar factor U of V - shift * I;
* (U + I) / 2 is the projector on the invariant subspace of the eigenvalues above the shift; an orthonormal
  basis of it and of its complement cuts V into two diagonal blocks;
* each block is split again, until it is a number or a multiple of the identity.

The shift is the mean of a block's eigenvalues, which parts them; where one lies so close to it that the
blocks stay coupled, shifts beside the mean are taken. The basis and eigenvalues then go out with the tasks
that whiten (``most`` x dim numbers). A last pass adds up the products of the whitened rows for ``identity_error``.

Defined cases: rows whose vector is null or empty, or holds null or non-finite entries, are dropped; a null id is
kept; repeated ids are rows of their own; vectors of each length are a space of their own with its own n, sums
and components (``identity_error`` is the largest of all); components whose eigenvalue is below ``FLAT`` of the largest
have no variance but rounding and are left out, so equal vectors, or a single one, give no rows; an
empty table gives an empty result; other columns are not read. A deviation beyond 64 bits is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagescale.llm.topk import matrix
from pagescale.session import materialise

FLAT = 1e-11
BLOCK = 2**24  # entries of all covariances that are added up at a time
EPS = np.finfo(float).eps
OUT = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


# ---- the spectrum of a symmetric matrix -----------------------------------

def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by QDWH."""
    m = len(a)
    x = a / max(np.linalg.norm(a), np.finfo(float).tiny)
    try:
        low = 1 / np.linalg.norm(np.linalg.inv(x))
    except np.linalg.LinAlgError:
        low = 0.0
    low = min(max(low, EPS), 1.0)
    for _ in range(30):  # six steps reach 1 from any low above EPS
        l2 = low * low
        d = np.cbrt(4 * (1 - l2) / l2**2)
        r = np.sqrt(1 + d)
        p = r + np.sqrt(8 - 4 * d + 8 * (2 - l2) / (l2 * r)) / 2
        q = (p - 1) ** 2 / 4
        c = p + q - 1
        both = np.linalg.qr(np.r_[np.sqrt(c) * x, np.eye(m)])[0]
        y = q / c * x + (p - q / c) / np.sqrt(c) * both[:m] @ both[m:].T
        y = (y + y.T) / 2
        moved, x = np.linalg.norm(y - x), y
        low = min(low * (p + q * l2) / (1 + c * l2), 1.0)
        if moved <= np.cbrt(EPS) and 1 - low <= 10 * EPS:
            break
    return x


def _parted(a: np.ndarray, shift: float, rng: np.random.Generator) -> tuple[float, np.ndarray, int]:
    """How strongly the two blocks stay coupled, the basis, and the size of the upper block."""
    m = len(a)
    above = (polar(a - shift * np.eye(m)) + np.eye(m)) / 2
    k = int(round(np.trace(above)))
    if not 0 < k < m:
        return np.inf, above, k
    v = above @ rng.standard_normal((m, k))
    for _ in range(2):
        v = above @ np.linalg.qr(v)[0]
    basis = np.linalg.qr(v, mode="complete")[0]
    return float(np.linalg.norm(basis[:, k:].T @ a @ basis[:, :k])), basis, k


def spectrum(a: np.ndarray, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    rng, size = np.random.default_rng(seed), np.linalg.norm(a)
    parts, done = [((a + a.T) / 2, np.eye(len(a)))], []
    while parts:
        b, v = parts.pop()
        m = len(b)
        mean = np.trace(b) / m
        width = np.linalg.norm(b - mean * np.eye(m)) / np.sqrt(m)
        if m == 1 or width <= 4 * EPS * size:
            done.append(v)
            continue
        best = None
        for t in (0, 0.07, -0.07, 0.2, -0.2, 0.4, -0.4, 0.7, -0.7):
            got = _parted(b, mean + t * width, rng)
            if best is None or got[0] < best[0]:
                best = got
            if best[0] <= 50 * EPS * size:
                break
        if not np.isfinite(best[0]):  # nothing parts what is left: equal up to rounding
            done.append(v)
            continue
        _, basis, k = best
        for own in (basis[:, :k], basis[:, k:]):
            c = own.T @ b @ own
            parts.append(((c + c.T) / 2, v @ own))
    v = np.concatenate(done, axis=1) if done else np.zeros((0, 0))
    e = np.einsum("ij,ij->j", v, a @ v)
    order = np.argsort(-e, kind="stable")
    return e[order], v[:, order]


# ---- passes over the rows -------------------------------------------------

def integers(df: DataFrame, id_col: str, vec_col: str, scale: int, offset: int) -> DataFrame:
    """(id, dim, x) of the rows that remain."""
    v, inf = F.col("v"), F.lit(float("inf"))
    d = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    d = d.where((F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < inf)))
    return d.select("id", F.size("v").alias("dim"), F.transform("v", lambda c: F.floor(c * F.lit(float(scale))) + F.lit(offset)).alias("x"))


def _by_length(batch: pa.RecordBatch):
    """(rows, x) of each length of a batch."""
    dims = batch.column(1).to_numpy()
    for d in np.unique(dims).tolist():
        own = batch.filter(pa.array(dims == d))
        yield d, own, matrix(own.column(2))


def _sums(rows: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """n and the exact sums of each length."""
    def run(batches):
        total: dict[int, list] = {}
        for b in batches:
            for d, _, x in _by_length(b):
                own = total.setdefault(d, [0, np.zeros(d, np.int64)])
                own[0] += len(x)
                own[1] += x.sum(0)
        for d, (n, s) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d), pa.int32()), pa.array(np.arange(d), pa.int32()), pa.array(np.full(d, n), pa.int64()), pa.array(s)], ["dim", "at", "n", "s"])

    out: dict[int, tuple[int, np.ndarray]] = {}
    for r in rows.mapInArrow(run, "dim int, at int, n bigint, s bigint").groupBy("dim", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
        out.setdefault(r["dim"], (r["n"], np.zeros(r["dim"], np.int64)))[1][r["at"]] = r["s"]
    return out


def _apart(x: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    """n * x - S, exactly."""
    if n * int(np.abs(x).max(initial=0)) + int(np.abs(s).max(initial=0)) < 2**62:
        return n * x - s
    return n * x.astype(object) - s


def _products(rows: DataFrame, make, sizes: dict[int, int]) -> dict[int, np.ndarray]:
    """Sums of products of ``make(dim, x)`` over the rows of each length; ``sizes``: its columns."""
    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for d, _, x in _by_length(b):
                if d in sizes:
                    y = make(d, x)
                    total[d] = total.get(d, 0) + y.T @ y
        for d, m in total.items():
            i, j = np.triu_indices(len(m))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(m[i, j])], ["dim", "i", "j", "s"])

    got = rows.mapInArrow(run, "dim int, i int, j int, s double").groupBy("dim", "i", "j").agg(F.sum("s").alias("s")).toArrow()
    dim, i, j, s = (got[c].to_numpy() for c in ("dim", "i", "j", "s"))
    out = {}
    for d, m in sizes.items():
        own = np.zeros((m, m))
        at = dim == d
        own[i[at], j[at]] = own[j[at], i[at]] = s[at]
        out[d] = own
    return out


def _blocks(dims: list[int]) -> list[list[int]]:
    """Lengths in groups whose covariances together stay small."""
    out: list[list[int]] = []
    room = 0
    for d in sorted(dims):
        if not out or room < d * d:
            out.append([])
            room = BLOCK
        out[-1].append(d)
        room -= d * d
    return out


class Whitening:
    """The fit of one length: n, S, eigenvalues (falling), unit eigenvectors (columns), explained shares."""

    def __init__(self, n: int, s: np.ndarray, cov: np.ndarray, most: int):
        e, v = spectrum(cov)
        k = min(most, int((e > FLAT * max(e[0], 0.0)).sum())) if len(e) and e[0] > 0 else 0
        self.n, self.s, self.e, self.v = n, s, e[:k], v[:, :k]
        self.explained = self.e / np.trace(cov) if k else self.e

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (_apart(x, self.n, self.s) / self.n).astype(float) @ self.v / np.sqrt(self.e)

    def deviation(self, x: np.ndarray) -> list | np.ndarray:
        t = _apart(x, self.n, self.s)
        if t.dtype != object and int(np.abs(t).max(initial=0)) ** 2 * t.shape[1] < 2**62:
            return (t * t).sum(1)
        return [sum(int(c) ** 2 for c in r) for r in t]


def fit(rows: DataFrame, most: int) -> tuple[dict[int, Whitening], float]:
    """The fits of all lengths of (id, dim, x), and the identity error. The lengths are no more in
    number than the longest vector has entries."""
    fits: dict[int, Whitening] = {}
    error = 0.0
    for block in _blocks([r[0] for r in rows.select("dim").distinct().collect()]):
        part = rows.where(F.col("dim").between(block[0], block[-1]))
        sums = _sums(part)
        cov = _products(part, lambda d, x, sums=sums: (_apart(x, *sums[d]) / sums[d][0]).astype(float), {d: d for d in block})
        own = {d: Whitening(*sums[d], cov[d] / sums[d][0], most) for d in block}
        left = {d: len(w.e) for d, w in own.items() if len(w.e)}
        for d, m in _products(part, lambda d, x, own=own: own[d](x), left).items():
            error = max(error, float(np.abs(m / own[d].n - np.eye(len(m))).max()))
        fits |= own
    return fits, error


def whiten(vectors: DataFrame, most: int = 32, scale: int = 64, offset: int = 1_000_000, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per vector and component, numbered from 1 by falling eigenvalue: (id, component, n, deviation,
    whitened, explained, identity_error)."""
    rows = materialise(integers(vectors, id_col, vec_col, scale, offset))
    fits, error = fit(rows, most)
    kind = rows.schema["id"].dataType.simpleString()
    out = None
    for block in _blocks(sorted(fits)) or [[0]]:
        own = {d: fits[d] for d in block if d in fits and len(fits[d].e)}

        def run(batches, own=own):
            for b in batches:
                for d, part, x in _by_length(b):
                    if d not in own:
                        continue
                    w, k = own[d], len(own[d].e)
                    each = np.repeat(np.arange(len(x)), k)
                    yield pa.RecordBatch.from_arrays([
                        part.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(np.full(len(each), w.n), pa.int64()),
                        pa.array(w.deviation(x), pa.int64()).take(pa.array(each)), pa.array(w(x).ravel()), pa.array(np.tile(w.explained, len(x))), pa.array(np.full(len(each), error)),
                    ], ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

        part = rows.where(F.col("dim").between(block[0], block[-1])).mapInArrow(run, f"id {kind}, {OUT}")
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("id", id_col)

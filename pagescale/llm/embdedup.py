"""Near-duplicate embeddings by randomly rotated binary codes.

Vectors are brought to length 1 and turned by a random rotation (seeded). The signs of the rotated
vector o are its code, o' = signs / sqrt(d), and the correction factor <o', o> is stored
with it: <o', q> / <o', o> is then an unbiased estimate of <o, q>. The angle between o and o' is
known exactly, so <o, q> >= t is impossible when <o', q> < cos(angle + arccos t); this
confidence bound holds with certainty. Pairs it leaves are computed exactly in double precision;
pairs it rules out never are.

Pairs meet in cells: the nearest of the centroids (a sample of the vectors, at most
``CENTROIDS`` of them, by hash order) is a vector's home, and it also visits every cell whose home
vectors may be linked to it. With y's home c', w = c - c' and x in cell c, x.w >= 0 is needed; for
a pair at the threshold x.w = cos y.w + sin u.w with u a direction orthogonal to y, so u.w is at
most the length of the part of w that is orthogonal to y. Every cell that this bound leaves is
visited, so no link is missed, whatever the vectors' dimension really is (for a threshold of 0 or more;
every cell is visited below). Each link is counted once, in the home cell of the vector that counts it.

Neighbouring cells form groups of ``HOME`` home rows, which a vector visits once however many of their cells it visits, so the rows that travel
are as many as vectors times groups, not cells; codes are made where they are compared. Groups are cut in blocks of home and visiting rows, so a hot cell is many bounded tasks. A task
returns a count for each home row and a spanning forest of its links, never the pairs. Equal
vectors are one row with a multiplicity.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components, link with nothing and
form their own class; different lengths do not link; rows with a null id are kept with a null
class and count for no one; repeated ids are separate rows of one class; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagescale.llm.simhash import Forest
from pagescale.llm.topk import matrix, usable
from pagescale.operators.graph import components
from pagescale.session import materialise

CENTROIDS = 1024
PER_CELL = 1024  # vectors for each centroid, until the limit is reached
HOME, VISIT = 16_384, 16_384  # rows of a block of vectors of up to 64 components, fewer of longer ones
CELLS = 1 << 20  # numbers that are looked at in one go


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Bits (packed) and correction factors of unit rows."""
    turned = x @ rotation(x.shape[1], seed).T
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(1) / np.sqrt(x.shape[1])


def _signs(bits: np.ndarray, dim: int) -> np.ndarray:
    return (np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dim))


def _near(x: np.ndarray, c: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each unit row and the cells it visits (rows x centroids)."""
    lean, side = threshold, np.sqrt(1 - threshold**2)
    near = x @ c.T
    home = near.argmax(1)
    gap = near[np.arange(len(x)), home][:, None] - near  # y.c' - y.c
    apart = ((c * c).sum(1)[home][:, None] + (c * c).sum(1)[None, :] - 2 * (c @ c.T)[home]) - gap * gap
    visit = (lean * gap <= side * np.sqrt(np.maximum(apart, 0)) + 1e-7) | (lean < 0)  # apart: the part of w orthogonal to y, squared
    visit[np.arange(len(x)), home] = True
    return home, visit


def _coded(vectors: DataFrame, centroids: dict[int, np.ndarray], threshold: float, groups: dict[int, np.ndarray] | None = None) -> DataFrame:
    """(rep, n, dim, v, cell): a row a vector with its home cell. With the group of each cell (rep, n, dim, v, own, visits): its home group and
    all groups with a cell that it visits. Rows are taken a few at a time, so that rows x centroids stay ``CELLS``."""
    def run(batches):
        for b in batches:
            sizes = b.column(2).value_lengths().to_numpy()
            for dim in np.unique(sizes).tolist():
                every, c = b.filter(pa.array(sizes == dim)), centroids[dim]
                for lo in range(0, every.num_rows, step := max(1, CELLS // max(len(c), dim))):
                    own = every.slice(lo, step)
                    x = matrix(own.column(2))
                    home, visit = _near(x / np.linalg.norm(x, axis=1)[:, None], c, threshold)
                    cols = [own.column(0), own.column(1), pa.array(np.full(len(x), dim), pa.int32()), own.column(2)]
                    if groups is None:
                        yield pa.RecordBatch.from_arrays([*cols, pa.array(home, pa.int32())], ["rep", "n", "dim", "v", "cell"])
                        continue
                    of = groups[dim]
                    order = np.argsort(of, kind="stable")
                    names, start = np.unique(of[order], return_index=True)
                    row, k = np.nonzero(np.logical_or.reduceat(visit[:, order], start, axis=1))
                    ends = pa.array(np.searchsorted(row, np.arange(len(x) + 1)), pa.int32())
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(of[home], pa.int32()), pa.ListArray.from_arrays(ends, pa.array(names[k], pa.int32()))], ["rep", "n", "dim", "v", "own", "visits"])

    rest = "cell int" if groups is None else "own int, visits array<int>"
    return vectors.select("rep", "n", "v").mapInArrow(run, f"rep bigint, n bigint, dim int, v array<double>, {rest}")


def _grouped(c: np.ndarray, rows: np.ndarray, most: int) -> np.ndarray:
    """A group for each cell, of cells that lie near each other (each next to the last one's nearest that is left) and
    have ``most`` home rows, or of one cell that has more."""
    out, left, at, group, full = np.zeros(len(c), np.int64), np.ones(len(c), bool), 0, 0, 0
    for k in range(len(c)):
        left[at] = False
        if k and full + rows[at] > most:
            group, full = group + 1, 0
        out[at], full = group, full + rows[at]
        at = int(np.where(left, c @ c[at], -np.inf).argmax())
    return out


def _pairs(threshold: float):
    """Counts and forest of one block of home rows (left) and visiting rows (right)."""
    turn = float(np.arccos(threshold))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {k: [np.zeros(0, np.int64)] for k in ("rep", "links", "root")}
        if left.num_rows and right.num_rows:
            dim = left["dim"][0].as_py()
            ra, rb, nb = left["rep"].to_numpy(), right["rep"].to_numpy(), right["n"].to_numpy()
            a, b = matrix(left["v"]), matrix(right["v"])
            a, b = a / np.linalg.norm(a, axis=1)[:, None], b / np.linalg.norm(b, axis=1)[:, None]
            code, factor = encode(a)
            signs = _signs(code, dim)
            angle = np.arccos(np.clip(factor, -1, 1))
            least = np.where(angle + turn < np.pi, np.cos(np.minimum(angle + turn, np.pi)), -2) - 1e-5  # of <o', q>
            turned = (b @ rotation(dim).T).astype(np.float32).T
            links, forest, m = np.zeros(len(a), np.int64), Forest(len(a) + len(b)), len(a)
            same = np.argsort(ra, kind="stable")
            own = np.searchsorted(ra[same], rb)
            own = np.where((own < m) & (ra[same][np.minimum(own, m - 1)] == rb), own, -1)
            meets = np.flatnonzero(own >= 0)
            forest.join(same[own[meets]], meets + m)  # the row that visits is the one at home
            forest.flat()
            step, some = max(1, CELLS // len(b)), max(1, CELLS // dim)
            for lo in range(0, m, step):
                i, j = np.nonzero(signs[lo : lo + step] @ turned >= least[lo : lo + step, None])
                for s in range(0, len(i), some):
                    x, y = i[s : s + some] + lo, j[s : s + some]
                    hit = (np.einsum("ij,ij->i", a[x], b[y]) >= threshold) & (ra[x] != rb[y])
                    x, y = x[hit], y[hit]
                    links += np.bincount(x, nb[y], m).astype(np.int64)
                    forest.join(x, y + m)
                    forest.flat()
            reps, up = np.r_[ra, rb], forest.flat()
            moved = np.flatnonzero(reps != reps[up])
            some = np.flatnonzero(links)
            out["rep"] += [ra[some], reps[moved]]
            out["links"] += [links[some], np.zeros(len(moved), np.int64)]
            out["root"] += [ra[some], reps[up][moved]]
        return pa.table({k: np.concatenate(v) for k, v in out.items()})

    return run


def _centroids(vectors: DataFrame) -> dict[int, np.ndarray]:
    """A bounded sample of unit vectors for each length."""
    out = {}
    for r in vectors.groupBy(F.size("v").alias("dim")).count().limit(1000).collect():
        k = max(1, min(CENTROIDS, r["count"] // PER_CELL))
        rows = vectors.where(F.size("v") == r["dim"]).orderBy(F.xxhash64("rep"), "rep").limit(k).select("v").collect()
        x = np.array([v[0] for v in rows], float)
        out[r["dim"]] = x / np.linalg.norm(x, axis=1)[:, None]
    return out


def link_duplicates(df: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per vector: (id, n_links, component_id, kept)."""
    good = usable(df, id_col, vec_col).where(F.exists("v", lambda x: x != 0))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    good = good.where((size > 0) & (size < F.lit(float("inf"))))
    ids = materialise(good.select("id", "v"))
    flat = materialise(ids.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    centroids = _centroids(flat)
    homes = materialise(_coded(flat, centroids, threshold))
    held = {dim: np.zeros(len(c), np.int64) for dim, c in centroids.items()}
    for r in homes.groupBy("dim", "cell").count().collect():  # at most CENTROIDS of a length
        held[r["dim"]][r["cell"]] = r["count"]
    of_dim = lambda most, dim: max(1, most * 64 // max(64, dim))
    coded = materialise(_coded(homes, centroids, threshold, {dim: _grouped(c, held[dim], of_dim(HOME, dim)) for dim, c in centroids.items()}), homes)
    blocks = lambda most: F.ceil(F.count("*") * F.greatest(F.col("dim"), F.lit(64)) / (64 * most)).cast("int")
    sizes = coded.groupBy("dim", F.col("own").alias("cell")).agg(blocks(HOME).alias("hs"))
    visited = coded.select("dim", F.explode("visits").alias("cell")).groupBy("dim", "cell").agg(blocks(VISIT).alias("ws"))
    sizes = materialise(sizes.join(visited, ["dim", "cell"]))
    spot = lambda seed, n: F.pmod(F.xxhash64("rep", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cut = coded.select("dim", "rep", "n", "v", F.col("own").alias("cell")).join(F.broadcast(sizes), ["dim", "cell"])  # groups are no more than centroids
    left = cut.withColumn("hb", spot(1, "hs")).withColumn("wb", every("ws"))
    cut = coded.select("dim", "rep", "n", "v", F.explode("visits").alias("cell")).join(F.broadcast(sizes), ["dim", "cell"])
    right = cut.withColumn("wb", spot(2, "ws")).withColumn("hb", every("hs"))
    keys, cols = ["dim", "cell", "hb", "wb"], ["dim", "cell", "hb", "wb", "rep", "n", "v"]
    found = left.select(cols).groupBy(*keys).cogroup(right.select(cols).toDF(*cols).groupBy(*keys)).applyInArrow(_pairs(threshold), "rep bigint, links bigint, root bigint")
    found = materialise(found)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    label = components(flat.select(F.col("rep").alias("id")), found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    reps = flat.join(links, "rep", "left").join(label, flat["rep"] == label["id"]).select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "label")
    known = ids.join(reps, "v").select("id", "n_links", "label")
    every_id = df.select(F.col(id_col).cast("bigint").alias("id"))
    left_over = every_id.where("id is null").unionByName(every_id.where("id is not null").join(ids.select("id"), "id", "left_anti"))
    out = known.unionByName(left_over.select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("label")))
    return out.select(F.col("id").alias(id_col), "n_links", F.col("label").alias("component_id"), (F.col("id") == F.col("label")).alias("kept"))

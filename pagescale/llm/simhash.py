"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint bit is the majority of that bit over the XXH64 values of a text's word
shingles. Pairs within ``radius`` bits are found with structured bit masks: every bit position i gets
a vector m(i) of radius + 1 bits, and table v (each non-zero vector) keeps the positions with
<m(i), v> = 1. The vectors of any ``radius`` positions lie in a proper subspace, so some
v is orthogonal to all of them: that table does not see the difference, and the pair
collides in it. No pair within the radius is lost.

Equal fingerprints are folded to one row before the tables are built. A bucket never emits
all its pairs: small ones give their true links (at most ``SMALL`` for a fingerprint), others a
spanning forest of their links. A bucket of more than ``HOT`` fingerprints is covered a second time on
the bits its table does not see; then all but about a quarter of the bits are fixed, which bounds
the size of a sub-bucket (2^15 for radius 3) whatever the input.

Defined cases: a null or blank text has fingerprint 0 and links like any other; a row with
a null id keeps its fingerprint and has a null component; repeated ids share their
component; an empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagescale.operators.graph import components
from pagescale.session import materialise

BITS = 64
SMALL = 64  # buckets up to this size emit their links, larger ones a spanning forest
HOT = 16_384  # larger buckets are covered again
CHUNK = 65_536  # shingles hashed at a time


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of one text as an unsigned integer."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes.split() is [^\x20\x09-\x0D]+
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), seed)
    n = len(words) - shingle + 1
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, n, CHUNK):
        part = [words[lo + k : lo + k + min(CHUNK, n - lo)] for k in range(shingle)]
        h = np.fromiter((digest(b" ".join(s), seed) for s in zip(*part, strict=True)), np.uint64)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): ``fp`` is the fingerprint as a signed long."""
    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


def covering_masks(radius: int, positions: list[int]) -> list[int]:
    """The 2^(radius + 1) - 1 masks over the given bit positions."""
    tables = 2 ** (radius + 1) - 1
    return [sum(1 << p for i, p in enumerate(positions) if bin((1 + i % tables) & v).count("1") % 2) for v in range(1, tables + 1)]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _bucket_rows(fps: DataFrame, radius: int) -> DataFrame:
    masks = covering_masks(radius, list(range(BITS)))
    lits = F.array(*[F.lit(_signed(m)) for m in masks])
    return fps.select("fp", "rep", F.posexplode(lits).alias("t", "m")).select("fp", "rep", "t", F.col("fp").bitwiseAND(F.col("m")).alias("key"))


def _cover_again(rows: DataFrame, radius: int) -> DataFrame:
    """Rows of hot buckets with the key of each sub-table; t becomes (table, sub-table)."""
    subs = []
    for m in covering_masks(radius, list(range(BITS))):
        free = [p for p in range(BITS) if not m >> p & 1]
        subs.append(F.array(*[F.lit(_signed(m | s)) for s in covering_masks(radius, free)]))
    n = len(subs)
    out = rows.select("fp", "rep", "t", F.posexplode(F.get(F.array(*subs), F.col("t"))).alias("u", "m"))
    return out.select("fp", "rep", (F.col("t") * n + F.col("u") + n).alias("t"), F.col("fp").bitwiseAND(F.col("m")).alias("key"))


class Forest:
    """Union-find over the rows of one bucket."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return int(i)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Links a - b. Pairs already joined, and pairs of the same two trees, count once."""
        n = len(self.up)
        both = np.unique(self.up[a] * n + self.up[b])
        for x, y in zip((both // n).tolist(), (both % n).tolist(), strict=True):
            x, y = self.root(x), self.root(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)

    def flat(self) -> np.ndarray:
        while not np.array_equal(nxt := self.up[self.up], self.up):
            self.up = nxt
        return self.up


def _links(fp: np.ndarray, rep: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges between rows of equal ``group`` (neighbours, whole groups only)."""
    fp = fp.view(np.uint64)  # of signed numbers bitwise_count takes the absolute value
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    size = np.repeat(sizes, sizes)
    left = np.repeat(starts + sizes, sizes) - np.arange(len(group))  # rows up to the end of the group
    us, vs = [], []
    at = np.flatnonzero((size <= SMALL) & (left > 1))
    step = 1
    while len(at):
        hit = np.bitwise_count(fp[at] ^ fp[at + step]) <= radius
        us.append(rep[at[hit]])
        vs.append(rep[at[hit] + step])
        step += 1
        at = at[left[at] > step]
    for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        own, forest = fp[s : s + n], Forest(n)
        width = max(1, 2**22 // n)
        for lo in range(0, n, width):
            a, b = np.nonzero(np.bitwise_count(own[lo : lo + width, None] ^ own[None, :]) <= radius)
            forest.join(a + lo, b)
            forest.flat()
        us.append(rep[s : s + n])
        vs.append(rep[s : s + n][forest.flat()])
    return np.concatenate([np.zeros(0, np.int64), *us]), np.concatenate([np.zeros(0, np.int64), *vs])


def _edges(rows: DataFrame, radius: int) -> DataFrame:
    """(u, v) between representatives; each bucket lies whole and sorted in its partition."""
    def run(batches):
        held = None
        for b in batches:
            cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
            last = (held[2] == held[2][-1]) & (held[3] == held[3][-1])  # this bucket may go on
            done = int(len(last) - last.sum())
            if done:
                yield batch([x[:done] for x in held])
                held = [x[done:] for x in held]
        if held is not None:
            yield batch(held)

    def batch(cols):
        fp, rep, t, key = cols
        group = np.cumsum(np.r_[0, (t[1:] != t[:-1]) | (key[1:] != key[:-1])])
        u, v = _links(fp, rep, group, radius)
        keep = u != v
        return pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(v[keep])], ["u", "v"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "t", "key").sortWithinPartitions("t", "key").select("fp", "rep", "t", "key").mapInArrow(run, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, shingle: int = 3) -> DataFrame:
    """One row per document: (id, fingerprint, component_id, kept). ``id`` must be integral.

    ``component_id`` is the smallest id reachable over links of at most ``radius`` differing bits.
    """
    own = materialise(fingerprints(docs, id_col, text_col, shingle).select(F.col("id").cast("bigint").alias("id"), "fp"))
    fps = materialise(own.where("id is not null").groupBy("fp").agg(F.min("id").alias("rep")))
    rows = _bucket_rows(fps, radius)
    hot = materialise(rows.groupBy("t", "key").count().where(F.col("count") > HOT).select("t", "key"))
    edges = _edges(rows.join(hot, ["t", "key"], "left_anti"), radius)
    if not hot.isEmpty():
        edges = edges.unionByName(_edges(_cover_again(rows.join(hot, ["t", "key"], "left_semi"), radius), radius))
    label = components(fps.select(F.col("rep").alias("id")), edges)
    found = fps.join(label, fps["rep"] == label["id"]).select("fp", "label")
    out = own.join(found, "fp", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("label")).alias("component_id"),
        (F.col("id") == F.col("label")).alias("kept"),
    )

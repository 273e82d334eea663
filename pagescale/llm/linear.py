"""Shared parts of the linear text models: bounded labelled samples, hashed features, FTRL.

A model is fitted on the driver from a sample that is bounded by ``per_class`` rows of each label (by hash
order of the id, so it does not depend on partitions); the texts of the sample are read and hashed whole on the executors,
only their sparse counts are collected. Everything that scores documents runs over all of them.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagescale.session import materialise

FEW = 100_000  # labels whose counts are broadcast
Counts = tuple[np.ndarray, np.ndarray]  # feature numbers, counts


class WordFeatures:
    """Hashed counts of words (lower case, without outer punctuation), word shapes and repeats.

    A shape keeps the kind of each run of characters: letters by case, digits, and other
    characters as they are, so mark-up, shouting and table bars are seen on unknown words too. Words are
    split, and each different one looked up, for a whole batch of texts.
    """

    KEEP = 200_000  # words a worker remembers
    ROWS = 2048  # texts at a time
    CELLS = 2**24  # texts x features counted in one array

    def __init__(self, dim: int):
        self.dim, self.known, self.used = dim, {}, None
        self.repeat = xxhash.xxh32_intdigest("repeat") % dim

    def _word(self, w: str) -> tuple[int, int]:
        kinds = ("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in w)
        h = xxhash.xxh32_intdigest
        core = w.strip(".,;:!?\"'()[]{}|*#$%&@<>/\\-_=+~`^").lower()
        return h("w " + core) % self.dim, h("s " + "".join(k for k, _ in itertools.groupby(kinds))) % self.dim

    def codes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The text of each word, and the features of the word and its shape."""
        words = pc.utf8_split_whitespace(texts)
        row = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(words), 0).to_numpy())
        flat = pc.list_flatten(words)
        some = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        row, flat = row[some], flat.filter(pa.array(some)).dictionary_encode()
        if len(self.known) > self.KEEP:
            self.known.clear()
        known, names = self.known, flat.dictionary.to_pylist()
        for w in names:
            if w not in known:
                known[w] = self._word(w)
        return row, np.array([known[w] for w in names], np.int64).reshape(-1, 2)[flat.indices.to_numpy()]

    def _features(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts and features, one for each that is counted, and the words of each text."""
        row, ids = self.codes(texts)
        same = (ids[1:, 0] == ids[:-1, 0]) & (row[1:] == row[:-1])
        again = row[1:][same]
        return np.r_[row, row, again], np.r_[ids[:, 0], ids[:, 1], np.full(len(again), self.repeat)], np.bincount(row, minlength=len(texts))

    def counts(self, texts: pa.Array) -> list[Counts]:
        out = []
        for lo in range(0, len(texts), self.ROWS):
            part = texts[lo : lo + self.ROWS]
            row, f, _ = self._features(part)
            cell, c = np.unique(row * self.dim + f, return_counts=True)
            ends = np.searchsorted(cell, np.arange(len(part) + 1) * self.dim)
            out += [(cell[a:b] % self.dim, c[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return out

    def __call__(self, text: str | None) -> Counts:
        return self.counts(pa.array([text], pa.string()))[0]

    def scores(self, texts: pa.Array, idf: np.ndarray, length: float, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``weigh`` of each text times ``weights`` (dim x classes), and the words of each text."""
        if self.used is None:
            self.used = np.flatnonzero(idf > 0)
            self.place = np.full(self.dim, -1)
            self.place[self.used] = np.arange(len(self.used))
        k = max(1, len(self.used))
        own_idf = idf[self.used].astype(float)
        own_weights = (weights[:, None] if weights.ndim == 1 else weights)[self.used].astype(float)
        out, words = [np.zeros((0, own_weights.shape[1]))], [np.zeros(0, np.int64)]
        for lo in range(0, len(texts), self.ROWS):
            part = texts[lo : lo + self.ROWS]
            row, f, n = self._features(part)
            f = self.place[f]
            cell = row[f >= 0] * k + f[f >= 0]
            if len(part) * k <= self.CELLS:
                c = np.bincount(cell, minlength=1)
                cell = np.flatnonzero(c)
                c = c[cell]
            else:
                cell, c = np.unique(cell, return_counts=True)
            row, f = np.divmod(cell, k)
            v = (1 + np.log(c)) * own_idf[f] if len(cell) else np.zeros(0)
            size = np.sqrt(np.bincount(row, v * v, len(part)))
            v = v * length / np.maximum(size, 1e-300)[row]
            out.append(np.stack([np.bincount(row, v * own_weights[f, j], len(part)) for j in range(own_weights.shape[1])], 1) if own_weights.shape[1] else np.zeros((len(part), 0)))
            words.append(n)
        return np.concatenate(out), np.concatenate(words)


class CharFeatures:
    """Hashed counts of the 1- to ``most``-grams of a text's letters, lower case, other characters as one blank."""

    CHUNK = 2**18
    _letters: np.ndarray | None = None

    def __init__(self, dim: int, most: int = 3):
        self.dim, self.most = dim, most

    @classmethod
    def letters(cls) -> np.ndarray:
        if cls._letters is None:
            cls._letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        return cls._letters

    def __call__(self, text: str | None) -> Counts:
        """No counts at all for a text without letters."""
        total = np.zeros(self.dim)
        code = np.zeros(0, np.uint32)
        for lo in range(0, len(text or ""), self.CHUNK):
            part = np.frombuffer(text[lo : lo + self.CHUNK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
            part = np.where(self.letters()[part], part, 32)
            code = np.r_[code[-(self.most - 1) :], part].astype(np.uint64)
            fresh = len(part)
            keep = np.r_[True, (code[1:] != 32) | (code[:-1] != 32)]
            fresh = int(keep[len(keep) - fresh :].sum())
            code = code[keep]
            gram = np.zeros(len(code), np.uint64)
            for n in range(1, self.most + 1):
                gram = gram[: len(code) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1 :]
                mixed = gram * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(n)
                mixed = (mixed >> np.uint64(33)) % np.uint64(self.dim)
                total += np.bincount(mixed[max(0, len(code) - fresh - n + 1) :].astype(np.int64), minlength=self.dim)
            code = code.astype(np.uint32)
        if not text or not self.letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any():
            return np.zeros(0, np.int64), np.zeros(0)
        at = np.flatnonzero(total)
        return at, total[at]


def _count(feats: np.ndarray, dim: int) -> Counts:
    if len(feats) * 8 < dim:
        return np.unique(feats, return_counts=True)
    c = np.bincount(feats, minlength=dim)
    at = np.flatnonzero(c)
    return at, c[at]


def labelled_sample(docs: DataFrame, id_col: str, text_col: str, labels: DataFrame, per_class: int, features: Callable[[str | None], Counts]) -> tuple[list, list[Counts]]:
    """Labels and counts of at most ``per_class`` rows of each non-null label of ``labels`` (id,
    label). Ids are picked first, without texts; the texts then meet a bounded broadcast."""
    ids = labels.where("id is not null and label is not null").distinct().join(docs.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")
    order = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    # a label of very many rows is cut first where its hash order surely has enough, so no task ranks them all
    enough = per_class + 8 * per_class**0.5 + 40
    size = materialise(ids.groupBy("label").agg(F.count("*").alias("all")))
    size = F.broadcast(size) if size.count() <= FEW else size
    near = (F.xxhash64("id") / F.lit(2.0**64) + 0.5) * F.col("all") < enough
    picked = ids.join(size, "label").where(near).drop("all").withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_class).drop("k").select("id", "label")

    def run(batches):
        for b in batches:
            found = features.counts(b.column(2)) if isinstance(features, WordFeatures) else [features(t.as_py()) for t in b.column(2)]
            ends = np.cumsum([0] + [len(f[0]) for f in found])
            at = pa.array(ends, pa.int32())
            feats = pa.array(np.concatenate([np.zeros(0, np.int32), *[f[0] for f in found]]).astype(np.int32))
            counts = pa.array(np.concatenate([np.zeros(0, np.float32), *[f[1] for f in found]]).astype(np.float32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(at, feats), pa.ListArray.from_arrays(at, counts)], ["id", "label", "f", "c"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(picked), "id").select("id", "label", "text")  # bounded: per_class ids of each label
    kind = picked.schema
    got = rows.mapInArrow(run, f"id {kind['id'].dataType.simpleString()}, label {kind['label'].dataType.simpleString()}, f array<int>, c array<float>").toArrow()
    got = got.sort_by([("id", "ascending")])
    fs, cs = (got[k].combine_chunks() for k in ("f", "c"))
    ends = np.cumsum(np.r_[0, fs.value_lengths().to_numpy()]) if got.num_rows else np.zeros(1, int)
    f, c = fs.flatten().to_numpy(), cs.flatten().to_numpy()
    return got["label"].to_pylist(), [(f[a:b], c[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


FEWEST = 3  # rows of a class that a feature kept for that class alone is in


def inverse_frequency(rows: list[Counts], dim: int, least: float = 0.0, y: np.ndarray | None = None) -> np.ndarray:
    """Inverse document frequencies; 0 for features in fewer than the share ``least`` of the rows and,
    with classes ``y``, of the rows of every class, so that a small class keeps its own marks beside large ones."""
    df, kept = np.zeros(dim), np.zeros(dim, bool)
    for own in [np.arange(len(rows))] if y is None else [np.flatnonzero(y == k) for k in np.unique(y)]:
        part = np.zeros(dim)
        for i in own:
            part[rows[i][0]] += 1
        df += part
        kept |= part >= max(least * len(own), FEWEST)
    kept |= df >= least * len(rows)
    return np.where(kept, np.log((1 + len(rows)) / (1 + df)) + (least == 0), 0.0)


def weigh(row: Counts, idf: np.ndarray, length: float = 1.0) -> Counts:
    """TF-IDF (1 + log count) of the given length, without features of weight 0."""
    f, c = row
    used = idf[f] > 0
    f = f[used]
    v = (1 + np.log(np.maximum(c[used], 1))) * idf[f]
    size = np.sqrt((v * v).sum())
    return f, v * length / size if size else v


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list[Counts], y: np.ndarray, classes: int, dim: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.002, epochs: int = 4, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression by follow the regularised leader (proximal, per coordinate)
    with an elastic net; sparse weights (dim, classes) and biases."""
    z, n = np.zeros((dim, classes)), np.zeros((dim, classes))
    zb, nb = np.zeros(classes), np.zeros(classes)

    def weights(z, n, l1, l2):
        return np.where(np.abs(z) <= l1, 0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            f, v = rows[i]
            zf, nf = z[f], n[f]
            w, b = weights(zf, nf, l1, l2), weights(zb, nb, 0, l2)
            g = softmax(v @ w + b)
            g[y[i]] -= 1
            gf = v[:, None] * g
            more = nf + gf * gf
            z[f] = zf + gf - (np.sqrt(more) - np.sqrt(nf)) / alpha * w
            n[f] = more
            mb = nb + g * g
            zb += g - (np.sqrt(mb) - np.sqrt(nb)) / alpha * b
            nb = mb
    return weights(z, n, l1, l2), weights(zb, nb, 0, l2)


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the scores with the smallest log loss (golden section on its logarithm)."""
    if not len(y):
        return 1.0
    lo, hi, r = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2

    def loss(t):
        return -np.log(softmax(scores / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean()

    for _ in range(60):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def with_scores(docs: DataFrame, text_col: str, added: list[tuple[str, str]], score: Callable[[], Callable[[list], list]]) -> DataFrame:
    """``docs`` with columns added from its texts (older columns of those names go). ``score``
    makes a worker's function from an Arrow array of texts to one list per added column."""
    names = [n for n, _ in added]
    base = docs.drop(*names)
    columns, at = [*base.columns, *names], base.columns.index(text_col)
    schema = T.StructType([*base.schema.fields, *[T.StructField(n, T._parse_datatype_string(t)) for n, t in added]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = score()
        for b in batches:
            more = own(b.column(at).cast(pa.string()))
            types = [{"string": pa.string(), "double": pa.float64(), "bigint": pa.int64(), "boolean": pa.bool_()}.get(t) for _, t in added]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(m, t) for m, t in zip(more, types, strict=True)]], columns)

    return base.mapInArrow(run, schema)

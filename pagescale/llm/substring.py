"""Repeated passages, found with suffix automata over shards of reference text.

A word goes when it lies in a window of ``window`` words that also starts earlier (smaller id, or
earlier in the same text). Reference shards are bounded pieces of the corpus; each shard's
suffix automaton keeps, for every state, where its words end first, and the shard's texts
are streamed through it: matching statistics give the state of the last ``window`` words, its
first end tells whether the window started earlier.

What can repeat is found first, so that only that is sent to shards. Each window of a text names an anchor:
the leftmost smallest hash among its runs of ``GRAM`` words. Equal windows name equal anchors at
equal offsets, and about every eighth word is one. Anchors that occur once cannot belong to
a repeated window. Around each other anchor the words that its windows can reach form a region;
equal regions are folded to their first place (later ones go as a whole), and the different
regions of an anchor go to one shard. So no two equal windows are parted, one of a hundred thousand
copies of a passage is worked on, and only regions that must be compared travel as text.
The automata are built where their shard lands, not broadcast: the repeated text of a corpus has no size bound.

An anchor with more than ``HOT`` different regions (a common phrase in ever new surroundings)
would grow without bound; its regions are split further, into the windows themselves,
which fold to their first place in an aggregation.

Words and regions are compared by their text inside a shard, by 128 bits of hash (anchor and region)
when equal regions are folded.

Defined cases: a null or blank text has no words; rows with a null id, and rows of an id that has
different texts, take no part and lose nothing; repeated rows (same id and text) stand at the same place, so neither is earlier;
an empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagescale.session import materialise

GRAM = 5
HOT = 4000  # different regions of an anchor that go to one automaton
SHARD = 20_000  # words of a shard, unless one anchor has more


def split_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def anchors(words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of a text, for every window of it."""
    n = len(words) - window + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    m, g = len(words) - GRAM + 1, np.zeros(len(words) - GRAM + 1, np.uint64)
    for k in range(GRAM):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[k : k + m]
    g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(32)
    best, wide, span = np.arange(m), 1, window - GRAM + 1
    while wide < span:  # the leftmost smallest of twice as many, or of the span
        step = min(wide, span - wide)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(g[b] < g[a], b, a)
        wide += step
    at = np.unique(best[:n])
    return at, g[at]


class Automaton:
    """Suffix automaton of several word sequences, added in the order of their places.

    ``first[v]`` is the place (a number that grows with the order) where the words of state v end first.
    """

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]

    def add(self, words: list, places: list) -> None:
        nxt, link, length, first = self.next, self.link, self.length, self.first
        last = 0
        for w, at in zip(words, places, strict=True):
            q = nxt[last].get(w)
            if q is not None and length[q] == length[last] + 1:
                last = q
                continue
            if q is None:
                new = len(nxt)
                nxt.append({})
                length.append(length[last] + 1)
                first.append(at)
                link.append(0)
                p = last
                while p >= 0 and (q := nxt[p].get(w)) is None:
                    nxt[p][w] = new
                    p = link[p]
                if p < 0:
                    last = new
                    continue
                if length[q] == length[p] + 1:
                    link[new] = q
                    last = new
                    continue
            else:
                new, p = None, last
            copy = len(nxt)
            nxt.append(dict(nxt[q]))
            length.append(length[p] + 1)
            first.append(first[q])
            link.append(link[q])
            link[q] = copy
            while p >= 0 and nxt[p].get(w) == q:
                nxt[p][w] = copy
                p = link[p]
            if new is None:
                last = copy
            else:
                link[new] = copy
                last = new

    def statistics(self, words: list, window: int):
        """For each word the first place where the last ``window`` words end, None where no such run was added."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        v = n = 0
        for w in words:
            while v and w not in nxt[v]:
                v = link[v]
                n = length[v]
            if w in nxt[v]:
                v = nxt[v][w]
                n += 1
            while v and length[link[v]] >= window:
                v = link[v]
            n = min(n, max(window, length[v]))
            yield first[v] if n >= window else None


def _shard(rows: list[tuple], window: int) -> list[int]:
    """For rows (doc, end of the region's words, words) in any order: the bits of windows that start earlier."""
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0], rows[r][1] - len(rows[r][2])))
    own = Automaton()
    for r in order:
        doc, start, words = rows[r][0], rows[r][1] - len(rows[r][2]), rows[r][2]
        own.add(words, [(doc, start + k + 1) for k in range(len(words))])
    out = [0] * len(rows)
    for r in order:
        doc, start, words = rows[r][0], rows[r][1] - len(rows[r][2]), rows[r][2]
        for k, at in enumerate(own.statistics(words, window)):
            if at is not None and at < (doc, start + k + 1):
                out[r] |= 1 << (k + 1 - window)
    return out


def _region(words: list[bytes], pos: int, window: int) -> tuple[int, bytes]:
    """Start and words of what the windows of an anchor can reach."""
    lo = max(0, pos - (window - GRAM))
    return lo, b" ".join(words[lo : pos + window])


def _anchor_rows(docs: DataFrame, window: int) -> DataFrame:
    """(gram, key, id, pos); key is a hash of the region and of the anchor's place in it."""
    def run(batches):
        for b in batches:
            ids, pos, grams, keys = [], [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = split_words(text.as_py())
                at, g = anchors(words, window)
                ids.append(np.full(len(at), i, np.int64))
                pos.append(at)
                grams.append(g)
                for p in at.tolist():
                    lo, own = _region(words, p, window)
                    keys.append(xxhash.xxh64_intdigest(own, p - lo))
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(pos).astype(np.int32))], ["gram", "key", "id", "pos"])

    return docs.where("id is not null").select("id", "text").mapInArrow(run, "gram bigint, key bigint, id bigint, pos int")


def _regions(marked: DataFrame, window: int) -> DataFrame:
    """(gram, key, first, text) of the regions that ``marks`` name in (id, text, marks)."""
    def run(batches):
        for b in batches:
            out = []
            for i, text, marks in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                words = split_words(text.as_py())
                for m in marks:
                    lo, own = _region(words, m["pos"], window)
                    out.append((m["gram"], m["key"], {"id": i, "start": lo}, own.decode("utf-8", "surrogatepass")))
            gram, key, first, texts = zip(*out, strict=True) if out else ((), (), (), ())
            kind = pa.struct([("id", pa.int64()), ("start", pa.int32())])
            yield pa.RecordBatch.from_arrays([pa.array(gram, pa.int64()), pa.array(key, pa.int64()), pa.array(first, kind), pa.array(texts, pa.string())], ["gram", "key", "first", "text"])

    return marked.select("id", "text", "marks").mapInArrow(run, "gram bigint, key bigint, first struct<id: bigint, start: int>, text string")


def _judge(regions: DataFrame, window: int) -> DataFrame:
    """(gram, key, bits) of different regions (gram, key, first, text); an anchor's regions lie together and sorted."""
    def run(batches):
        held, size, last = [], 0, None
        for b in batches:
            for gram, key, first, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                if gram != last and size >= SHARD:
                    yield done(held)
                    held, size = [], 0
                words = split_words(text.as_py())
                held.append((gram, key, first["id"], first["start"] + len(words), words))
                size += len(words)
                last = gram
        if held:
            yield done(held)

    def done(held):
        bits = _shard([x[2:] for x in held], window)
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.int64()), pa.array([x[1] for x in held], pa.int64()), pa.array(bits, pa.int64())], ["gram", "key", "bits"])

    n = int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return regions.repartition(n, "gram").sortWithinPartitions("gram").select("gram", "key", "first", "text").mapInArrow(run, "gram bigint, key bigint, bits bigint")


def _judge_windows(regions: DataFrame, window: int) -> DataFrame:
    """The same for anchors with very many regions: each window folds to its first place."""
    w = F.split("text", " ")
    regions = _written(regions)
    each = regions.select("gram", "key", "first", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda t: F.array_join(F.slice(w, t + 1, window), " "))).alias("t", "own"))
    each = each.select("gram", "key", "t", F.xxhash64("own").alias("h"), F.crc32("own").alias("h2"), F.struct(F.col("first.id").alias("id"), (F.col("first.start") + F.col("t")).alias("start")).alias("at"))
    least = each.groupBy("gram", "h", "h2").agg(F.min("at").alias("least"))
    both = each.join(least, ["gram", "h", "h2"])
    return both.groupBy("gram", "key").agg(F.sum(F.when(F.col("least") < F.col("at"), F.expr("shiftleft(1L, t)")).otherwise(F.lit(0).cast("bigint"))).alias("bits"))


def _kept(docs: DataFrame, window: int) -> DataFrame:
    """(id, n_words, n_removed, kept) of (id, text, cut): cut has (start, bits) of regions."""
    def run(batches):
        for b in batches:
            total, gone, kept = [], [], []
            for text, cut in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                words = split_words(text.as_py())
                edge = np.zeros(len(words) + 1, np.int64)
                for c in cut or ():
                    lo = c["start"]
                    if c["bits"] < 0:  # every window of the region
                        hi = min(c["pos"] + window, len(words))
                        if hi - lo >= window:
                            edge[lo] += 1
                            edge[hi] -= 1
                        continue
                    for t in range(c["bits"].bit_length()):
                        if c["bits"] >> t & 1:
                            edge[lo + t] += 1
                            edge[lo + t + window] -= 1
                stays = np.cumsum(edge[:-1]) == 0
                total.append(len(words))
                gone.append(len(words) - int(stays.sum()))
                kept.append(b" ".join([w for w, s in zip(words, stays.tolist(), strict=True) if s]) if gone[-1] else b" ".join(words))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], ["id", "n_words", "n_removed", "kept"])

    return docs.select("id", "text", "cut").mapInArrow(run, "id bigint, n_words bigint, n_removed bigint, kept binary")


def _written(df: DataFrame, *done: DataFrame) -> DataFrame:
    """``materialise``, then let the driver drop what is done, so that its shuffle files go
    before the next step writes its own."""
    out = materialise(df, *done)
    df.sparkSession._jvm.System.gc()
    return out


def drop_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, n_words, n_removed, kept); ``kept`` are the UTF-8 bytes of the
    words that stay, joined by one space."""
    if not GRAM < window <= 60:
        raise ValueError("window must be 6 to 60 words")
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    named = texts.where("id is not null")
    mixed = materialise(named.select("id", F.xxhash64("text").alias("h")).groupBy("id").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("id"))
    if not mixed.isEmpty():
        named = named.join(mixed, "id", "left_anti")
    rows = _written(_anchor_rows(named, window))
    again = rows.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    places = _written(rows.join(again, "gram"), rows)
    different = _written(places.groupBy("gram", "key").agg(F.min(F.struct("id", "pos")).alias("first")).select("gram", "key", "first.id", "first.pos"))
    # an anchor with a single region needs no automaton: its first place stays, the others go
    several = different.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
    marks = different.join(several, "gram").select("id", F.struct("pos", "gram", "key").alias("m"), (F.col("n") > HOT).alias("hot"))
    regions = []
    for part in (~F.col("hot"), F.col("hot")):
        own = _written(marks.where(part).groupBy("id").agg(F.collect_list("m").alias("marks")))
        regions.append(_regions(named.join(own.hint("shuffle_hash"), "id"), window) if not own.isEmpty() else None)
    judged = spark.createDataFrame([], "gram bigint, key bigint, bits bigint")
    for found, judge in zip(regions, (_judge, _judge_windows), strict=True):
        if found is not None:
            judged = judged.unionByName(_written(judge(found, window)))
    reach = window - GRAM
    found = different.join(judged, ["gram", "key"], "left").select("gram", "key", F.struct("id", "pos").alias("first"), F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))
    each = places.join(found, ["gram", "key"])
    # all windows of a region that stands elsewhere before start earlier; a text's end can cut the region, its words tell
    bits = F.when(F.struct("id", "pos") == F.col("first"), F.col("bits")).otherwise(F.lit(-1).cast("bigint"))
    cut = each.select("id", F.greatest(F.col("pos") - reach, F.lit(0)).alias("start"), "pos", bits.alias("bits")).where("bits <> 0")
    cut = materialise(cut.groupBy("id").agg(F.collect_list(F.struct("start", "pos", "bits")).alias("cut")), places, different)
    out = texts.join(cut.hint("shuffle_hash"), "id", "left")
    return _kept(out, window).withColumnRenamed("id", id_col)

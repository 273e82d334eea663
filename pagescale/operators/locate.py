"""Approximate location of passages across a corpus, and edits placed with tolerance.

Passages are found by the pigeonhole rule: with e errors allowed, a pattern cut into p parts keeps at least
p - e of them whole, all within e places of where they belong. The parts of a block of patterns go out with the
tasks; each document is looked through in its own row, its votes fold by pattern and window of starts, and
only the text of windows with enough votes leaves it. Errors are then counted there by a bit-parallel edit
distance. No text is shuffled and nothing depends on how common a word is but the work in its row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = 24  # longest part of a pattern
PATTERNS = 2**23  # characters of the patterns that go out together
VOTES = 2**20  # votes folded at a time


def _flat(df: DataFrame, ident: str, text: str) -> DataFrame:
    return df.select(ident, F.translate(text, "\n", " ").alias("_t"))


def word_grams(df: DataFrame, ident: str, text: str, n: int) -> DataFrame:
    """(ident, p, gram): hash of each n consecutive words and where they start. The words
    of a text stay in its row until the grams are made."""
    d = _flat(df, ident, text).select(ident, F.split("_t", "").alias("_c"), F.expr("filter(split(_t, ' '), w -> w <> '')").alias("_w"))
    d = d.select(ident, "_w", F.expr("filter(transform(_c, (c, i) -> if(c <> ' ' and (i = 0 or _c[i - 1] = ' '), i, -1)), p -> p >= 0)").alias("_p"))
    d = d.where(F.size("_w") >= n)
    rows = F.transform(F.slice("_p", 1, F.size("_p") - (n - 1)), lambda p, i: F.struct(p.cast("bigint").alias("p"), F.xxhash64(F.slice("_w", i + 1, n)).alias("gram")))
    return d.select(ident, F.inline(rows))


# ---- edit distances -------------------------------------------------------

def distances(pattern: str, text: str, anywhere: bool) -> list[int]:
    """For each j from 0: the edit distance of the pattern and text[:j], or with ``anywhere`` the least one over
    the texts that end at j. A column of the table is two bit vectors, a character a few operations on them."""
    if not pattern:
        return [0 if anywhere else j for j in range(len(text) + 1)]
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(pattern)) - 1
    last, first = 1 << (len(pattern) - 1), 0 if anywhere else 1
    up, down, score = full, 0, len(pattern)
    out = [score]
    for c in text:
        same = where.get(c, 0)
        vertical = same | down
        diagonal = (((same & up) + up) ^ up) | same
        rise, fall = down | (full & ~(diagonal | up)), up & diagonal
        score += bool(rise & last) - bool(fall & last)
        rise, fall = (rise << 1 | first) & full, fall << 1 & full
        up, down = fall | (full & ~(vertical | rise)), rise & vertical
        out.append(score)
    return out


def errors_at(pattern: str, text: str) -> np.ndarray:
    """For each start x in the text: the least edit distance of the pattern and a text that begins at x."""
    return np.array(distances(pattern[::-1], text[::-1], True)[::-1])


# ---- passages -------------------------------------------------------------

def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n consecutive characters."""
    h = np.zeros(max(0, len(codes) - n + 1), np.uint64)
    for k in range(n if len(h) else 0):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : len(codes) - n + 1 + k]
    return h


class Parts:
    """The parts of a block of patterns by their hash."""

    def __init__(self, patterns: list[str], limit: float):
        self.length = np.array([len(p) for p in patterns], np.int64)
        self.allowed = np.floor(limit * self.length + 1e-9).astype(np.int64)
        size = np.minimum(self.length // (self.allowed + 1), PART)
        self.needed = self.length // size - self.allowed  # parts that stay whole
        self.width = 2 * self.allowed + 1
        self.groups = []
        for q in np.unique(size).tolist():
            item, at, gram = [], [], []
            for i in np.flatnonzero(size == q).tolist():
                own = _grams(_codes(patterns[i]), q)[::q]
                item.append(np.full(len(own), i))
                at.append(np.arange(len(own)) * q)
                gram.append(own)
            item, at, gram = np.concatenate(item), np.concatenate(at), np.concatenate(gram)
            order = np.argsort(gram, kind="stable")
            known, first, count = np.unique(gram[order], return_index=True, return_counts=True)
            self.groups.append((q, known, first, count, item[order], at[order]))

    def _votes(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Patterns and starts that parts found in a text speak for."""
        for q, known, first, count, item, at in self.groups:
            h = _grams(codes, q)
            slot = np.minimum(np.searchsorted(known, h), len(known) - 1)
            place = np.flatnonzero(known[slot] == h)
            slot = slot[place]
            ends = np.cumsum(count[slot])
            lo = 0
            while lo < len(place):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + VOTES, "right")))
                own = count[slot[lo:hi]]
                k = np.repeat(first[slot[lo:hi]] - np.cumsum(own) + own, own) + np.arange(own.sum())
                yield item[k], np.repeat(place[lo:hi], own) - at[k]
                lo = hi

    def windows(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(pattern, from, to) of the texts where enough parts agree. Starts are counted in windows of
        twice the width that overlap by half, so the starts of one occurrence fall into one of them."""
        keys, votes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for item, start in self._votes(_codes(text)):
            w = start // self.width[item]
            more = np.concatenate([item << 40 | (w + 2**39), item << 40 | (w + (2**39 - 1))])
            keys, back = np.unique(np.concatenate([keys, more]), return_inverse=True)
            votes = np.bincount(back, np.concatenate([votes, np.ones(len(more), np.int64)]), len(keys))
        item = keys >> 40
        good = votes >= self.needed[item]
        item, w = item[good], (keys[good] & (2**40 - 1)) - 2**39
        fresh = np.flatnonzero((item != np.roll(item, 1)) | (w > np.roll(w, 1) + 1) | (np.arange(len(w)) == 0))
        for lo, hi in zip(fresh, [*fresh[1:], len(w)], strict=len(w) > 0):  # neighbours become one
            i = int(item[lo])
            yield i, max(0, int(w[lo] * self.width[i])), min(len(text), int((w[hi - 1] + 2) * self.width[i] + self.length[i] + self.allowed[i]))


def candidate_windows(patterns: DataFrame, docs: DataFrame, limit: float) -> DataFrame:
    """(item_id, doc_id, at, text) of every text in which a pattern may stand with at most ``limit`` errors a character
    of it. Patterns (item_id, _t) go out in blocks of about ``PATTERNS`` characters, documents (doc_id, _t) pass once a block."""
    whole = patterns.where("item_id is not null and _t <> ''").distinct()
    size = whole.agg(F.sum(F.length("_t"))).first()[0] or 0
    blocks = max(1, -(-size // PATTERNS))
    kinds = {k: d.schema[k].dataType.simpleString() for k, d in (("item_id", patterns), ("doc_id", docs))}
    out = None
    for b in range(blocks):
        rows = whole.where(F.pmod(F.xxhash64("item_id", "_t"), F.lit(blocks)) == b).toArrow()
        parts, ids = Parts(rows["_t"].to_pylist(), limit) if rows.num_rows else None, rows["item_id"].combine_chunks()

        def run(batches, parts=parts, ids=ids):
            for batch in batches:
                found = []
                for row, text in enumerate(batch.column(1).to_pylist()):
                    if parts is not None and text:
                        found += [(i, row, lo, text[lo:hi]) for i, lo, hi in parts.windows(text)]
                item, row, at, text = zip(*found, strict=True) if found else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(item, pa.int64())), batch.column(0).take(pa.array(row, pa.int64())), pa.array(at, pa.int64()), pa.array(text, pa.string())], ["item_id", "doc_id", "at", "text"])

        part = docs.select("doc_id", "_t").mapInArrow(run, f"item_id {kinds['item_id']}, doc_id {kinds['doc_id']}, at bigint, text string")
        out = part if out is None else out.unionByName(part)
    return out


def locate_passages(patterns: DataFrame, docs: DataFrame, max_score: float = 0.15, expected: Column | None = None, distance: int = 1000) -> DataFrame:
    """Best place of each pattern (item_id, text) in each document (doc_id, text):
    (item_id, doc_id, x, errors, score).

    The errors at a start x are the least edit distance of the pattern and a text that begins there, line
    breaks read as blanks. score = errors / length (+ |expected - x| / distance) is at most ``max_score`` (below 1); the
    lowest wins, then the leftmost. Every such start is seen. Null and empty patterns and texts are found nowhere.
    """
    if not 0 <= max_score < 1:
        raise ValueError("max_score is a share of the pattern's characters below 1")
    flat = _flat(patterns, "item_id", "text")
    rows = candidate_windows(flat, _flat(docs, "doc_id", "text"), max_score)
    rows = rows.join(flat.where("item_id is not null and _t <> ''").distinct(), "item_id")
    rows = rows.select("item_id", "doc_id", "at", "text", "_t", (F.lit(None) if expected is None else expected).cast("bigint").alias("_e"))

    def run(batches):
        for b in batches:
            xs, errors, scores = [], [], []
            for at, text, pattern, loc in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                whole = text.find(pattern) if loc is None else -1
                e = np.array([0]) if whole >= 0 else errors_at(pattern, text)
                x = np.array([at + whole]) if whole >= 0 else at + np.arange(len(e))
                s = e / len(pattern) + (0 if loc is None else np.abs(loc - x) / distance)
                k = int(s.argmin())
                xs.append(int(x[k]))
                errors.append(int(e[k]))
                scores.append(float(s[k]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(xs, pa.int64()), pa.array(errors, pa.int64()), pa.array(scores)], ["item_id", "doc_id", "x", "errors", "score"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    found = rows.mapInArrow(run, f"item_id {kinds['item_id']}, doc_id {kinds['doc_id']}, x bigint, errors bigint, score double").where(F.col("score") <= max_score + 1e-12)
    best = found.groupBy("item_id", "doc_id").agg(F.min(F.struct("score", "x", "errors")).alias("_b"))
    return best.select("item_id", "doc_id", F.col("_b.x").alias("x"), F.col("_b.errors").alias("errors"), F.col("_b.score").alias("score"))


# ---- edits ----------------------------------------------------------------

def near(pattern: str, text: str, loc: int, max_score: float, distance: int) -> tuple[int, int] | None:
    """(start, errors) of the pattern in the text: whole at the place nearest to ``loc``, else the lowest errors / length +
    |start - loc| / distance; at most ``max_score``, then the leftmost."""
    loc = max(0, min(loc, len(text)))
    if text.startswith(pattern, loc):
        return loc, 0
    m, reach = len(pattern), int(max_score * distance)
    lo = max(0, loc - reach)
    whole = [x for x in (text.rfind(pattern, lo, loc + m), text.find(pattern, loc, loc + reach + m)) if x >= 0]
    if whole:
        return min(whole, key=lambda x: abs(x - loc)), 0
    errors = errors_at(pattern, text[lo : loc + reach + m + int(max_score * m) + 1])
    score = errors / m + np.abs(lo + np.arange(len(errors)) - loc) / distance
    k = int(score.argmin())
    return (lo + k, int(errors[k])) if score[k] <= max_score + 1e-12 else None


def changed_span(before: str, old: str, after: str, text: str, x: int, errors: int) -> tuple[int, int]:
    """Where ``old`` lies in the shortest text from x on that has these errors to before + old + after. Of the
    alignments with no more errors the one with the fewest in ``before``, then the fewest in ``after``, then the earliest."""
    if not errors:
        return x + len(before), x + len(before) + len(old)
    rest = text[x : x + len(before) + len(old) + len(after) + errors]
    end = distances(before + old + after, rest, False).index(errors)
    rest = rest[:end]
    head = distances(before, rest, False)
    tail = distances((old + after)[::-1], rest[::-1], False)[::-1]
    b = min((i for i in range(end + 1) if head[i] + tail[i] == errors), key=lambda i: head[i])
    middle = distances(old, rest[b:], False)
    tail = distances(after[::-1], rest[::-1], False)[::-1]
    c = min((i for i in range(b, end + 1) if head[b] + middle[i - b] + tail[i] == errors), key=lambda i: tail[i])
    return x + b, x + c


def edited(text: str, edits: list[dict], max_score: float, distance: int) -> tuple[str, str]:
    """The text with its edits, and a T or F for each; see :func:`apply_edits`."""
    out, done, shift, applied = [], 0, 0, []
    for e in edits:
        before, old, after = e["before"] or "", e["old"] or "", e["after"] or ""
        place = e["start1"] - len(before)
        found = near(before + old + after, text, place + shift, max_score, distance)
        b, c = changed_span(before, old, after, text, *found) if found else (-1, -1)
        if b < done:
            applied.append("F")
            continue
        out += [text[done:b], e["new"] or ""]
        done, shift = c, found[0] - place
        applied.append("T")
    return "".join([*out, text[done:]]), "".join(applied)


def apply_edits(docs: DataFrame, edits: DataFrame, keys: list[str], max_score: float = 0.5, distance: int = 1000) -> DataFrame:
    """Documents (keys, text) with their edits (keys, edit, start1, old, new, and if there before and after): the
    new text and, per edit in order, whether it was placed (T / F).

    Edits are in the coordinates of the text they were made from. Each is expected as far from its place as
    the last one placed was, and stands where before + old + after does: at the nearest place that has it whole, else where
    errors / length + displacement / distance is lowest; that sum is at most ``max_score``. What then stands for ``old`` is replaced. An
    edit that is found nowhere, or would reach into text that an earlier one replaced, is left out. A null text stays null;
    documents without edits stay as they are. The edits of a document are gathered beside its one text.
    """
    side = [F.col(c) if c in edits.columns else F.lit("").alias(c) for c in ("before", "after")]
    e = edits.select(*keys, F.struct("start1", "edit", "old", "new", *side).alias("_s")).groupBy(*keys).agg(F.array_sort(F.collect_list("_s")).alias("_e"))
    rows = docs.select(*keys, "text").join(e, keys, "left")

    def run(batches):
        for b in batches:
            got = [(None, "") if t is None else edited(t, own or [], max_score, distance) for t, own in zip(b.column(len(keys)).to_pylist(), b.column(len(keys) + 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keys))), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], [*keys, "text", "applied"])

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, "text", "_e").mapInArrow(run, f"{kinds}, text string, applied string")

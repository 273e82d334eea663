"""Iterative operators: components, box closures, reading order, XY-cut.

Every round writes its small state to the shared folder (``materialise``), so plans stay
short and a lost executor costs a round's tasks, not the whole history. The driver sees
one count per round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagescale.functions import boxes as B
from pagescale.operators.blocks import Scan, islands, number_rows, scan
from pagescale.operators.joins import TILE, overlap_join
from pagescale.session import materialise, parts, small_batches

SALTS = 16
HOT = 10_000  # rows of one value that are spread
STRETCH = 200_000  # edges contracted at a time
ROWS = 4096  # lines of a block
CELLS = 1 << 18  # pairs of lines looked at in one go
RUN = 4096  # columns of an array of cells


def _lookup(df: DataFrame, col: str, table: DataFrame, new: str) -> DataFrame:
    """Replace ``col`` by its value in ``table`` (k, v) where it has one. Values of ``col`` on more than HOT rows, as a
    component may hold a third of all vertices, are spread over SALTS keys and the table repeated for these alone;
    there is at most one for HOT rows, so they are broadcast. The tables grow with the input, so none of them is."""
    hot = F.broadcast(df.groupBy(F.col(col).alias("_h")).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT).select("_h"))
    salts = F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))
    own = F.when(F.col("_h").isNotNull(), F.pmod(F.xxhash64(*df.columns), F.lit(SALTS))).otherwise(F.lit(0).cast("bigint"))
    d = df.join(hot, F.col(col) == F.col("_h"), "left").withColumn("_s", own).drop("_h")
    each = F.when(F.col("_h").isNotNull(), salts).otherwise(F.array(F.lit(0).cast("bigint")))
    t = table.join(hot, F.col("k") == F.col("_h"), "left").select("k", "v", F.explode(each).alias("_s")).hint("merge")
    j = d.join(t, (d[col] == t["k"]) & (d["_s"] == t["_s"]), "left").drop(t["_s"]).drop("_s")
    return j.withColumn(new, F.coalesce("v", col)).drop("k", "v")


def _follow(step: DataFrame, hop: DataFrame) -> DataFrame:
    """Pointers (k, v), each moved on from v by ``hop``."""
    return _lookup(step.withColumnsRenamed({"k": "_k", "v": "_p"}), "_p", hop, "_q").select(F.col("_k").alias("k"), F.col("_q").alias("v"))


def _to_roots(hop: DataFrame) -> DataFrame:
    """Pointers (k, v) followed to their ends by doubling, twice per written round."""
    moving = True
    while moving:
        step = hop
        for _ in range(2):
            step = _follow(step, step)
        step = materialise(step, hop)
        moving = not step.select(F.col("v").alias("k")).join(step, "k", "left_semi").isEmpty()  # some end still points on
        hop = step
    return hop


def _whole_numbers(kind) -> bool:
    """Whether ids are integers or structs of integers, which numpy puts in Spark's order."""
    return all(f.dataType in (T.LongType(), T.IntegerType()) for f in kind.fields) if isinstance(kind, T.StructType) else kind in (T.LongType(), T.IntegerType())


def _numbered(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A number for each id, equal for equal ones and in their order (nulls first), and a place of each number."""
    cols = []
    for c in ids.flatten() if pa.types.is_struct(ids.type) else [ids]:
        cols += [c.is_valid().to_numpy(zero_copy_only=False), c.fill_null(0).to_numpy()]
    order = np.lexsort(cols[::-1])
    new = np.zeros(len(order), bool)
    for c in cols:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new)
    return number, order[np.flatnonzero(new | (np.arange(len(order)) == 0))]


def _smallest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest vertex each of n reaches over the edges, by hooking and pointer jumping."""
    at = np.arange(n)
    while (at[u] != at[v]).any():
        a, b = at[u], at[v]
        np.minimum.at(at, np.maximum(a, b), np.minimum(a, b))
        while (at[at] != at).any():
            at = at[at]
    return at


def _contracted(edges: DataFrame) -> DataFrame:
    """Pointers (k, r) of every vertex to the smallest one it reaches over the edges of its stretch: edges are put in the
    order of their ends, in which neighbours stand together, and cut into stretches of STRETCH. A vertex
    of several stretches has a pointer for each."""
    def run(batches):
        def stretch(part):
            ids = pa.concat_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for name in ("u", "v") for c in (b.column(name) for b in part)])
            number, place = _numbered(ids)
            half = len(ids) // 2
            to = _smallest(len(place), number[:half], number[half:])
            for lo in range(0, len(place), 10_000):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(place[lo : lo + 10_000])), ids.take(pa.array(place[to[lo : lo + 10_000]]))], ["k", "r"])

        part, n = [], 0
        for b in batches:
            part.append(b)
            n += b.num_rows
            if n >= STRETCH:
                yield from stretch(part)
                part, n = [], 0
        if n:
            yield from stretch(part)

    kind = edges.schema["u"].dataType.simpleString()
    return edges.repartitionByRange("u", "v").sortWithinPartitions("u", "v").mapInArrow(run, f"k {kind}, r {kind}")


def components(nodes: DataFrame, edges: DataFrame, near: bool = False) -> DataFrame:
    """Connected components: (id, label), label the smallest id of the component.

    ``nodes`` has ``id`` (any orderable type, also a struct), ``edges`` u and v. Contraction:
    each vertex points to its smallest neighbour (a folded minimum, so hubs cost nothing),
    pointers are followed to their ends by doubling, edges are renamed and made distinct. The vertices that
    still have edges shrink at least by half a round, so the loop ends by itself. Rounds only touch vertices
    with edges; their pointers become one written table that meets the nodes once at the end.

    ``near``: neighbours have ids (whole numbers) that are near in order, as boxes and runs of a page. Then stretches of
    edges contract in their tasks first, and only what several stretches share goes through the rounds.
    """
    e = materialise(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    own = ends = None
    if near and _whole_numbers(e.schema["u"].dataType):
        met = materialise(_contracted(e), e).groupBy("k").agg(F.min("r").alias("v"), F.collect_set("r").alias("s"))
        own = materialise(met.select("k", "v", F.when(F.size("s") > 1, F.col("s")).alias("s")))
        e = materialise(own.select("v", F.explode("s").alias("u")).where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
        own = own.select("k", "v")
    while not e.isEmpty():
        both = e.select(F.inline(F.array(F.struct(F.col("u").alias("k"), F.col("v").alias("n")), F.struct(F.col("v").alias("k"), F.col("u").alias("n")))))
        hop = both.groupBy("k").agg(F.min("n").alias("_m")).select("k", F.least("k", "_m").alias("v"))
        hop = _to_roots(materialise(hop.where("k <> v")))
        left = _lookup(_lookup(e.withColumnsRenamed({"u": "a", "v": "b"}), "a", hop, "u").select("u", "b"), "b", hop, "w").where("u <> w")
        e = materialise(left.select(F.least("u", "w").alias("u"), F.greatest("u", "w").alias("v")).distinct(), e)
        # the vertices of a round are roots of the ones before, so no key comes twice
        ends = hop if ends is None else materialise(_follow(ends, hop).unionByName(hop), ends, hop)
    out = nodes.select("id")
    if own is not None:
        ends = own if ends is None else _follow(own, ends)
    if ends is None:
        return out.withColumn("label", F.col("id"))
    return out.join(ends.hint("merge"), out["id"] == ends["k"], "left").select("id", F.coalesce("v", "id").alias("label"))


def cell_runs(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells compressed to row runs (keys, id, y0, x0, y1, x1); id = struct(keys, y, x). The cells are read once: those of a row become
    arrays of ``RUN`` columns, whose runs are written; where one ends at the edge of its array, runs that go on are put together."""
    row = cells.groupBy(*keys, "y", F.floor(F.col("x") / RUN).alias("_blk")).agg(F.sort_array(F.collect_set("x")).alias("_x"))
    firsts = F.expr("filter(_x, (v, i) -> i = 0 or get(_x, i - 1) < v - 1)").alias("x0")
    lasts = F.expr("filter(_x, (v, i) -> i = size(_x) - 1 or get(_x, i + 1) > v + 1)").alias("x1")
    runs = row.select(*keys, "y", F.explode(F.arrays_zip(firsts, lasts)).alias("_r")).select(*keys, "y", "_r.x0", (F.col("_r.x1") + 1).alias("x1"))
    runs = materialise(runs)
    if not runs.where(F.col("x1") % RUN == 0).isEmpty():
        whole = islands(runs, list(keys) + ["y"], "x0", "x1", ["x0"], F.floor(F.col("x0") / RUN), out="_r")
        runs = materialise(whole.groupBy(*keys, "y", "_r").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_r"), runs)
    return runs.select(*keys, F.struct(*keys, "y", F.col("x0").alias("x")).alias("id"), F.col("y").alias("y0"), "x0", (F.col("y") + 1).alias("y1"), "x1")


def run_edges(runs: DataFrame, keys: list[str], conn: int = 4, tile: int = 64) -> DataFrame:
    """Touching runs of neighbouring rows (u above v); corners touch for conn = 8. They meet
    on (row, column tile) keys."""
    slack = 1 if conn == 8 else 0
    up = runs.select(*keys, F.col("id").alias("u"), (F.col("y0") + 1).alias("_y"), F.col("x0").alias("_a0"), F.col("x1").alias("_a1"))
    up = up.withColumn("_t", F.explode(F.sequence(F.floor(F.col("_a0") / tile), F.floor((F.col("_a1") - 1 + slack) / tile))))
    lo = runs.select(*keys, F.col("id").alias("v"), F.col("y0").alias("_y"), F.col("x0").alias("_b0"), F.col("x1").alias("_b1"))
    lo = lo.withColumn("_t", F.explode(F.sequence(F.floor(F.col("_b0") / tile), F.floor((F.col("_b1") - 1 + slack) / tile))))
    hit = (F.col("_a0") < F.col("_b1") + slack) & (F.col("_b0") < F.col("_a1") + slack)
    return up.join(lo, list(keys) + ["_y", "_t"]).where(hit).select("u", "v").distinct()


def label_cells(cells: DataFrame, keys: list[str], conn: int = 4) -> DataFrame:
    """Adds ``comp``: the component of each cell, as struct(keys, y, x) of its first run. Runs, not their cells, move to the cells."""
    from pagescale.operators.cells import cells_in_boxes
    runs = cell_runs(cells, keys)
    comp = components(runs, run_edges(runs, keys, conn), near=True)
    lab = runs.join(comp, "id").select(*keys, *B.BOX, F.col("label").alias("comp"))
    at = list(keys) + ["y", "x"]
    return cells_in_boxes(cells, lab, keys, ["comp"], {"y": 1, "x": 64}).select(*at, *[c for c in cells.columns if c not in at], "comp")


def _closure(boxes: DataFrame, keys: list[str], pairs: DataFrame) -> DataFrame:
    """Boxes (keys, id, ...) with ``group``: the smallest id they are tied to by pairs (keys, a, b)."""
    ident = F.struct(*keys, "id")
    nodes = boxes.select(ident.alias("id"))
    edges = pairs.select(F.struct(*keys, F.col("a").alias("id")).alias("u"), F.struct(*keys, F.col("b").alias("id")).alias("v"))
    comp = components(nodes, edges, near=True).select(*[F.col(f"id.{k}").alias(k) for k in keys], F.col("id.id").alias("id"), F.col("label.id").alias("group"))
    return boxes.join(comp, list(keys) + ["id"])


def merge_intersected(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Closure of overlap: boxes that meet (ends included) become their common rectangle,
    until no two meet; each round leaves fewer boxes. (keys, id, box, n) with the smallest
    id and the number of boxes."""
    cur = materialise(boxes.select(*keys, "id", *B.BOX, F.lit(1).cast("bigint").alias("n")))
    while True:
        pairs = materialise(overlap_join(cur.drop("n"), keys))
        if pairs.isEmpty():
            return cur
        cur = materialise(_closure(cur, keys, pairs).groupBy(*keys, F.col("group").alias("id")).agg(
            F.min("y0").alias("y0"), F.min("x0").alias("x0"), F.max("y1").alias("y1"), F.max("x1").alias("x1"), F.sum("n").alias("n")))


def _sweep(start: np.ndarray, end: np.ndarray, along: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places a, b of boxes of a page: b is the next one along the other axis in some stretch that both cover. Between two places where
    a box begins or ends nothing changes, so a box stands once for each such stretch, not for each position; ``CELLS`` of these at a time."""
    order = np.argsort(along, kind="stable")
    places = np.unique(np.concatenate([start, end]))
    lo, hi = np.searchsorted(places, start[order]), np.searchsorted(places, end[order])
    held = np.cumsum(np.bincount(lo, minlength=len(places)) - np.bincount(hi, minlength=len(places))).cumsum()
    cuts = [0, *(np.flatnonzero(np.diff(held // CELLS)) + 1), len(places)]
    n, pairs = len(order), np.zeros(0, np.int64)
    for first, last in zip(cuts[:-1], cuts[1:], strict=True):
        at = np.flatnonzero((lo < last) & (hi > first))
        l, size = np.maximum(lo[at], first), np.minimum(hi[at], last) - np.maximum(lo[at], first)
        box = np.repeat(at, size)
        stretch = np.repeat(l - (np.cumsum(size) - size), size) + np.arange(len(box))
        by = np.argsort(stretch, kind="stable")
        box, stretch = box[by], stretch[by]
        same = stretch[1:] == stretch[:-1]
        pairs = np.unique(np.concatenate([pairs, box[:-1][same] * n + box[1:][same]]))
    return order[pairs // max(n, 1)], order[pairs % max(n, 1)]


def _same_id(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of ids in order the place of the first equal one, and how many are equal to it."""
    new = np.ones(len(ids), bool)
    if len(ids) > 1:
        code = ids.dictionary_encode().indices.to_numpy()
        new[1:] = code[1:] != code[:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(ids)))
    return np.repeat(first, size), np.repeat(size, size)


def _seen(boxes: DataFrame, keys: list[str], axes: tuple[str, ...]) -> DataFrame:
    """(keys, a, b, y0, x0, y1, x1): the neighbours of a sweep along each axis and the band between them. The boxes of a page
    become arrays in order of their ids, so a task holds one page's boxes. Boxes of one id each give their bands. A missing
    coordinate gives way to the other box's."""
    c, low, top = F.col, np.iinfo(np.int64).min, np.iinfo(np.int64).max
    whole = c("id").isNotNull()
    for k in keys:
        whole &= c(k).isNotNull()
    box = F.struct("id", *(F.coalesce(c(k).cast("bigint"), F.lit(low if k[1] == "0" else top)).alias(k) for k in B.BOX))
    pages = small_batches(boxes).where(whole).groupBy(*keys).agg(F.sort_array(F.collect_list(box)).alias("_l"))
    m = len(keys)

    def run(batches):
        for batch in batches:
            page, cut = batch.column(m).flatten(), np.concatenate([[0], np.cumsum(batch.column(m).value_lengths().to_numpy())])
            every, all_ids = {k: page.field(k).to_numpy() for k in B.BOX}, page.field(0)
            for r in range(batch.num_rows):
                ids = all_ids.slice(cut[r], cut[r + 1] - cut[r])
                at = {k: v[cut[r] : cut[r + 1]] for k, v in every.items()}
                first, size = _same_id(ids)
                for axis in axes:
                    along = "y" if axis == "x" else "x"
                    start, end = at[f"{axis}0"], at[f"{axis}1"]
                    has = np.flatnonzero(start > low)
                    i, j = _sweep(start[has], np.where(end[has] == top, start[has] + 1, np.maximum(end[has], start[has] + 1)), at[f"{along}0"][has])
                    i, j = np.divmod(np.unique(first[has[i]] * len(ids) + first[has[j]]), max(len(ids), 1))
                    if (size > 1).any():  # each box of the one id with each of the other
                        n = size[i] * size[j]
                        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        i, j, by = np.repeat(i, n), np.repeat(j, n), np.repeat(size[j], n)
                        i, j = i + k // np.maximum(by, 1), j + k % np.maximum(by, 1)
                    band = {f"{axis}0": np.maximum(at[f"{axis}0"][i], at[f"{axis}0"][j]), f"{axis}1": np.minimum(at[f"{axis}1"][i], at[f"{axis}1"][j]),
                            f"{along}0": np.minimum(at[f"{along}1"][i], at[f"{along}1"][j]), f"{along}1": np.maximum(at[f"{along}0"][i], at[f"{along}0"][j])}
                    for lo in range(0, len(i), ROWS):
                        part = slice(lo, lo + ROWS)
                        where = pa.array(np.full(len(i[part]), r))
                        cols = [pa.array(band[k][part], mask=(band[k][part] == low) | (band[k][part] == top)) for k in B.BOX]
                        yield pa.RecordBatch.from_arrays([*(batch.column(k).take(where) for k in range(m)), ids.take(pa.array(i[part])), ids.take(pa.array(j[part])), *cols], [*keys, "a", "b", *B.BOX])

    kinds = [f"`{k}` {boxes.schema[k].dataType.simpleString()}" for k in keys] + [f"{k} {boxes.schema['id'].dataType.simpleString()}" for k in ("a", "b")]
    return pages.select(*keys, "_l").mapInArrow(run, ", ".join(kinds + [f"{k} bigint" for k in B.BOX]))


def sweep_pairs(boxes: DataFrame, keys: list[str], axis: str) -> DataFrame:
    """Neighbours of a sweep: in each column (axis x) or row (axis y) position the next box
    along the other axis, so the pairs are the ones that see each other, not all overlapping ones.
    (keys, a, b) distinct."""
    return _seen(boxes, keys, (axis,)).select(*keys, "a", "b").distinct()


def group_boxes(boxes: DataFrame, cells: DataFrame, keys: list[str], size: dict[str, int] | None = None) -> DataFrame:
    """Boxes with ``group``: tied when they overlap on one axis and no ink lies in the band
    between them. Only boxes that see each other can have an empty band, so the sweep's
    neighbours are enough. ``size``: tile on which cells and bands meet (``cells_in_boxes``)."""
    from pagescale.operators.cells import cells_in_boxes
    found = materialise(_seen(boxes, keys, ("x", "y")))
    inked = cells_in_boxes(cells.select(*keys, "y", "x"), found.where("y1 > y0 and x1 > x0"), keys, ["a", "b"], size).select(*keys, "a", "b", "b_y0", "b_x0").distinct()
    free = found.join(inked.withColumnsRenamed({"b_y0": "y0", "b_x0": "x0"}), list(keys) + ["a", "b", "y0", "x0"], "left_anti")
    return _closure(boxes, keys, free.select(*keys, "a", "b"))


# ---- reading order --------------------------------------------------------

def _separated(box: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For the lines ``at`` (rows) and all lines (columns) of a page whether a third line separates them: it meets the y range of
    both and crosses the strip between them. Each end of the range is that of one line of the pair, so there are four cases."""
    y0, x0, y1, x1 = box
    low, top = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    out = np.zeros((len(at), len(y0)), bool)
    for lo in range(0, len(at), step := max(1, CELLS // max(1, len(y0)))):
        a = at[lo : lo + step]
        ay0, ay1, ax1 = y0[a, None], y1[a, None], x1[a, None]
        crosses, below, above = x0 < ax1, y1 >= ay0, y0 <= ay1
        reach = np.where(crosses & below & above, x1, low).max(1)[:, None]
        down = np.argsort(y0, kind="stable")
        far = np.maximum.accumulate(np.where(crosses & below, x1, low)[:, down], axis=1)
        to_b = np.concatenate([np.full((len(a), 1), low), far], axis=1)[:, np.searchsorted(y0[down], y1, "right")]
        up = np.argsort(-y1, kind="stable")
        far = np.maximum.accumulate(np.where(crosses & above, x1, low)[:, up], axis=1)
        from_b = np.concatenate([np.full((len(a), 1), low), far], axis=1)[:, np.searchsorted(-y1[up], -y0, "right")]
        first, last = ay0 <= y0, ay1 >= y1  # the range begins, ends with the line of the row
        out[lo : lo + step] = np.where(first, np.where(last, reach, to_b), np.where(last, from_b, low)) > x0
        around = np.flatnonzero((~first & ~last).any(0))  # lines that begin before and end behind one of the rows
        for k in range(0, len(around), step):
            b = around[k : k + step]
            least = np.where((x1 > x0[b, None]) & (y1 >= y0[b, None]) & (y0 <= y1[b, None]), x0, top).min(1)
            out[lo : lo + step, b] |= ~first[:, b] & ~last[:, b] & (least < ax1)
    return out


def _rules(box: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of all lines (columns) come behind the lines ``at`` (rows) by the first rule, and which by the second."""
    y0, x0, y1, x1 = box
    over = (x0[at, None] < x1) & (x1[at, None] > x0)
    left = ~over & (x1[at, None] < x0)
    if left.any():
        left &= ~_separated(box, at)
    return over & (y0[at, None] < y0), left


def _next_below(box: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The highest line that the first rule puts behind each line ``at``; the number of lines where there is none."""
    y0, x0, _, x1 = box
    under = (x0[at, None] < x1) & (x1[at, None] > x0) & (y0[at, None] < y0)
    return np.where(under.any(1), np.where(under, y0, np.iinfo(np.int64).max).argmin(1), len(y0))


def _last_above(box: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The lowest line that the first rule puts before each line ``at``; the number of lines where there is none."""
    y0, x0, y1, x1 = box
    return _next_below(np.array([-y0, x0, -y1, x1]), at)


def _in_order(box: np.ndarray, at: np.ndarray, implied: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of ``at``, line) of both rules. Without the ``implied`` ones a pair a, b is left out where the next line below a is
    before b by the same rule or a before the last line above b: two pairs from which it follows, each of less height."""
    n = box.shape[1]
    step = max(1, CELLS // n)
    found = _rules(box, at)
    if not implied:
        below = _next_below(box, at)
        above = np.concatenate([_last_above(box, np.arange(k, min(k + step, n))) for k in range(0, n, step)])
        beyond = _rules(box, np.minimum(below, n - 1))
        for own, other in zip(found, beyond, strict=True):
            follows = other & (below < n)[:, None]
            follows |= np.concatenate([own, np.zeros((len(at), 1), bool)], axis=1)[:, above]
            own &= ~follows
    return np.nonzero(found[0] | found[1])


def reading_order(lines: DataFrame, keys: list[str], implied: bool = True) -> DataFrame:
    """Pairs (keys, a, b) of a page's lines: a is read before b.

    Rules: x-overlapping lines go by height; others left to right unless a third line separates them. All pairs that the rules name are
    given, which may be as many as half the square of a page's lines. With ``implied=False`` pairs that follow from others are left out;
    what is left has the same transitive closure, so an order obeys it if and only if it obeys all pairs, and there is a pair or few a line.

    The lines of a page, as arrays, meet blocks of ``ROWS`` of them, so a task holds one page's lines and
    ``CELLS`` pairs at a time, and a large page is many tasks. Lines without a page, an id or a whole box have no pairs; a repeated id gives each pair once.
    The lines are read many times, so they are written once.
    """
    c = F.col
    lines = materialise(lines)
    whole = F.lit(True)
    for k in [*keys, *B.BOX]:
        whole &= c(k).isNotNull()
    box = F.struct("id", *(c(k).cast("bigint").alias(k) for k in B.BOX))
    pages = small_batches(lines).where(whole).groupBy(*keys).agg(F.collect_list(box).alias("_l"))
    pages = pages.withColumn("_b", F.explode(F.sequence(F.lit(0), F.floor((F.size("_l") - 1) / ROWS).cast("int"))))
    pages = pages.repartition(parts(lines), *keys, "_b").select(*keys, "_l", "_b")
    m = len(keys)

    def run(batches):
        def made():
            at = pa.array(np.concatenate(rows))
            return pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(m)), pa.concat_arrays(firsts), pa.concat_arrays(seconds)], [*keys, "a", "b"])

        for batch in batches:
            rows, firsts, seconds, n = [], [], [], 0
            page, cut = batch.column(m).flatten(), np.concatenate([[0], np.cumsum(batch.column(m).value_lengths().to_numpy())])
            every, all_ids = np.array([page.field(k).to_numpy() for k in range(1, 5)]), page.field(0)
            for r, block in enumerate(batch.column(m + 1).to_pylist()):
                ids = all_ids.slice(cut[r], cut[r + 1] - cut[r])
                box = every[:, cut[r] : cut[r + 1]]
                own = np.arange(len(ids))[block * ROWS :][:ROWS]
                for lo in range(0, len(own), step := max(1, CELLS // len(ids))):
                    at = own[lo : lo + step]
                    i, j = _in_order(box, at, implied)
                    rows.append(np.full(len(i), r))
                    firsts.append(ids.take(pa.array(at[i])))
                    seconds.append(ids.take(pa.array(j)))
                    n += len(i)
                    if n >= CELLS:
                        yield made()
                        rows, firsts, seconds, n = [], [], [], 0
            if n:
                yield made()

    kind = lines.schema["id"].dataType.simpleString()
    kinds = ", ".join(f"{k} {lines.schema[k].dataType.simpleString()}" for k in keys)
    pairs = pages.mapInArrow(run, f"{kinds}, a {kind}, b {kind}").where("a <> b")
    once = lines.groupBy(*keys, "id").count().where("count > 1").isEmpty()
    return pairs if once else pairs.distinct()


def _divided(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines with ``rank`` from 0 as the layout divides the page: lines that overlap all others
    of their group part it by height, and what lies between falls into side-by-side
    columns (chains of x-overlap); parts are divided again until nothing changes. Ties
    by y, x, id. Rounds are the nesting depth of the layout."""
    c = F.col
    d = materialise(lines.withColumn("_path", F.array().cast("array<bigint>")))
    n = -1
    while True:
        g = d.groupBy(*keys, "_path").agg(F.min("x1").alias("_lo"), F.max("x0").alias("_hi"))
        d2 = d.join(g, list(keys) + ["_path"])
        d2 = d2.withColumn("_sp", F.when((c("x0") < c("_lo")) & (c("x1") > c("_hi")), 1).otherwise(0)).drop("_lo", "_hi")
        blk = F.floor(c("y0") / 4096)
        d2 = scan(d2, list(keys) + ["_path"], ["y0", "x0", "id"], blk, _z=Scan("sum", c("_sp")))
        d2 = d2.withColumn("_z", c("_z") * 2 - c("_sp")).drop("_sp")
        d2 = islands(d2, list(keys) + ["_path", "_z"], "x0", "x1", ["x0", "y0", "id"], F.floor(c("x0") / 4096), gap=-1, out="_col")
        d = materialise(d2.withColumn("_path", F.concat("_path", F.array(c("_z"), c("_col")))).drop("_z", "_col"))
        m = d.select(*keys, "_path").distinct().count()
        if m == n:
            break
        n = m
    d = number_rows(d, keys, ["_path", "y0", "x0", "id"], F.get("_path", 0), "rank")
    return d.withColumn("rank", c("rank") - 1).drop("_path")


def _order_keys(own: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, key): arrays whose order is that of taking, again and again, the first line (by ``rank``) that
    has all its predecessors behind it. ``edges`` (keys, a, b, ra, rb) have the ranks of both ends.

    A line waits for the latest of all lines before it, m: if that is itself its key is its rank, else it comes in
    the group right behind m, and there again by the same rule among the lines of that group. m is
    carried along the edges; only edges that go against the ranks set it off and only what grows is carried
    on, so rounds are as many as lines in a row are held up, and a page in order needs none."""
    c = F.col
    nodes = own.withColumn("key", F.array().cast("array<bigint>"))
    e = materialise(edges)
    while True:
        late = materialise(e.where("ra > rb").groupBy(*keys, c("b").alias("id")).agg(F.max("ra").alias("m")))
        front = late
        while not front.isEmpty():
            step = e.join(front.withColumnRenamed("id", "a"), [*keys, "a"]).where("m > rb").groupBy(*keys, c("b").alias("id")).agg(F.max("m").alias("m"))
            step = step.join(late.withColumnRenamed("m", "_m"), [*keys, "id"], "left").where("_m is null or m > _m").drop("_m")
            front = materialise(step)
            if not front.isEmpty():
                late = materialise(late.unionByName(front).groupBy(*keys, "id").agg(F.max("m").alias("m")))
        if late.isEmpty():
            return nodes.select(*keys, "id", F.concat("key", F.array("rank")).alias("key"))
        nodes = materialise(nodes.join(late, [*keys, "id"], "left").withColumn("key", F.when(c("m").isNull(), c("key")).otherwise(F.concat("key", F.array("m")))).drop("m"))
        for end in ("a", "b"):  # edges inside a group stay
            e = e.join(late.withColumnsRenamed({"id": end, "m": f"_{end}"}), [*keys, end])
        e = materialise(e.where("_a = _b").drop("_a", "_b"))


def topsort(lines: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, rank): the lines of a page from 0 in an order that obeys its edges (keys, a, b:
    a before b). Of the lines whose predecessors are all placed the first in the order of the
    divided page (``_divided``) comes next; where a cycle leaves none, the first of all lines
    left is taken, so only edges into a cycle's lines can be broken.

    Pages without cycles are ordered by joins over all lines and edges (``_order_keys``); a page with a cycle, which
    the broken edges show, is ordered in one task."""
    import heapq

    c = F.col
    own = materialise(_divided(lines, keys).select(*keys, "id", c("rank").cast("bigint").alias("rank")))
    e = edges.select(*keys, "a", "b").where("a <> b").distinct()
    for end in ("a", "b"):
        e = e.join(own.withColumnsRenamed({"id": end, "rank": f"r{end}"}), [*keys, end])
    e = materialise(e)
    ranked = number_rows(_order_keys(own, e, keys), keys, ["key"], F.floor(F.get("key", F.lit(0)) / 4096), "rank").select(*keys, "id", (c("rank") - 1).alias("rank"))
    ranked = materialise(ranked)
    circular = materialise(order_faults(e, ranked, keys).select(*keys).distinct())
    if circular.isEmpty():
        return ranked

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        place = {r["id"]: (r["rank"], r["id"]) for r in left.select(["id", "rank"]).to_pylist()}
        after, waits = {i: [] for i in place}, dict.fromkeys(place, 0)
        for a, b in zip(right["a"].to_pylist(), right["b"].to_pylist(), strict=True) if right.num_rows else ():
            after[a].append(b)
            waits[b] += 1
        ready, rest, rank = [place[i] for i in place if not waits[i]], sorted(place.values()), {}
        heapq.heapify(ready)
        at = 0
        while len(rank) < len(place):
            if ready:
                i = heapq.heappop(ready)[1]
            else:
                while rest[at][1] in rank:
                    at += 1
                i = rest[at][1]
            if i in rank:
                continue
            rank[i] = len(rank)
            for j in after[i]:
                waits[j] -= 1
                if not waits[j]:
                    heapq.heappush(ready, place[j])
        out = left.select([*keys, "id"])
        return out.append_column("rank", pa.array([rank[i] for i in out["id"].to_pylist()], pa.int64()))

    kinds = ", ".join(f"{k} {own.schema[k].dataType.simpleString()}" for k in [*keys, "id"])
    again = own.join(circular, keys, "left_semi").groupBy(*keys).cogroup(e.join(circular, keys, "left_semi").select(*keys, "a", "b").toDF(*keys, "a", "b").groupBy(*keys))
    return ranked.join(circular, keys, "left_anti").unionByName(again.applyInArrow(run, f"{kinds}, rank bigint"))


def order_faults(edges: DataFrame, ranked: DataFrame, keys: list[str]) -> DataFrame:
    """Edges that do not ascend in the ranks."""
    r = ranked.select(*keys, "id", "rank")
    j = edges.join(r.withColumnsRenamed({"id": "a", "rank": "_ra"}), list(keys) + ["a"]).join(r.withColumnsRenamed({"id": "b", "rank": "_rb"}), list(keys) + ["b"])
    return j.where("_ra >= _rb").select(*keys, "a", "b")


def split_merged_lines(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes with ``lines_hit`` (groups they meet in y) and ``line`` (the group, when one).

    Groups are the stabbing points of interval scheduling: the earliest end, then the
    earliest end of the boxes starting behind it, and so on. The chain of ends is a
    pointer table; reachable ends are found by doubling, so rounds are log of the lines.
    """
    c = F.col
    ends = boxes.groupBy(*keys, c("y1").alias("e")).agg(F.lit(1).alias("_x")).select(*keys, "e")
    starts = boxes.groupBy(*keys, "y0").agg(F.min("y1").alias("end"))
    seq = ends.select(*keys, c("e").alias("y"), F.lit(1).alias("o"), F.lit(None).cast("bigint").alias("end")).unionByName(starts.select(*keys, c("y0").alias("y"), F.lit(0).alias("o"), "end"))
    seq = scan(seq, keys, ["y", "o"], F.floor(c("y") / 4096), _n=Scan("min_after", c("end")))
    hop = materialise(seq.where("o = 1 and _n is not null").select(*keys, c("y").alias("k"), c("_n").alias("v")))
    reached = materialise(boxes.groupBy(*keys).agg(F.min("y1").alias("e")))
    while not hop.isEmpty():
        more = reached.join(hop, [reached[k] == hop[k] for k in keys] + [reached["e"] == hop["k"]]).select(*[hop[k] for k in keys], hop["v"].alias("e"))
        reached = materialise(reached.unionByName(more).distinct())
        nxt = hop.select(*keys, c("k").alias("v"), c("v").alias("w"))
        hop = materialise(hop.withColumnRenamed("v", "_v").join(nxt.withColumnsRenamed({"v": "_v"}), list(keys) + ["_v"]).select(*keys, "k", c("w").alias("v")))
    tile = TILE["y"]
    pts = reached.withColumn("_t", F.floor(c("e") / tile))
    b = boxes.withColumn("_t", F.explode(F.sequence(F.floor(c("y0") / tile), F.floor(c("y1") / tile))))
    hit = b.join(pts, list(keys) + ["_t"]).where("e >= y0 and e <= y1").groupBy(*keys, "id").agg(F.count("*").alias("lines_hit"), F.min("e").alias("_e"))
    return boxes.join(hit, list(keys) + ["id"]).withColumn("line", F.when(c("lines_hit") == 1, c("_e"))).drop("_e")


def xy_cut(boxes: DataFrame, keys: list[str], gap_x: int, gap_y: int, mode: str = "all") -> DataFrame:
    """Boxes with ``leaf`` (an array naming the region). A region is cut on the axis with the
    widest empty band (x only when wider than y's), bands of at least ``gap_x`` / ``gap_y``
    count: at all of them, or (mode "widest") at those that tie for the widest. Regions without
    a band are leaves and leave the loop, so every round splits what is left."""
    c = F.col
    cur = materialise(boxes.withColumn("leaf", F.array().cast("array<bigint>")))
    done = None
    while True:
        d = cur
        on = list(keys) + ["leaf"]
        for ax, gap in (("x", gap_x), ("y", gap_y)):
            d = scan(d, on, [f"{ax}0", f"{ax}1", "id"], F.floor(c(f"{ax}0") / 4096), _reach=Scan("max_before", c(f"{ax}1")))
            room = c(f"{ax}0") - c("_reach")
            d = d.withColumn(f"_g{ax}", F.when(room >= gap, room)).drop("_reach")
        d = materialise(d)
        best = d.groupBy(*on).agg(F.max("_gx").alias("_mx"), F.max("_gy").alias("_my"))
        best = best.withColumn("_ax", F.when(c("_mx").isNull() & c("_my").isNull(), "-").when(c("_my").isNull() | (c("_mx") > c("_my")), "x").otherwise("y"))
        d = d.join(best.hint("merge"), on)
        leaves = materialise(d.where("_ax = '-'").select(*boxes.columns, "leaf"))
        done = leaves if done is None else done.unionByName(leaves)
        d = d.where("_ax <> '-'").withColumn("_p", F.when(c("_ax") == "x", c("x0")).otherwise(c("y0")))
        room, most = F.when(c("_ax") == "x", c("_gx")).otherwise(c("_gy")), F.when(c("_ax") == "x", c("_mx")).otherwise(c("_my"))
        at = d.where(room == most if mode == "widest" else room.isNotNull())
        cut = at.groupBy(*on, "_p").agg(F.lit(1).alias("_one")).select(*on, "_p")
        steps = number_rows(cut, on, ["_p"], F.floor(c("_p") / 4096), "_k")
        d = _count_cuts(d, steps, on)
        cur = materialise(d.select(*boxes.columns, F.concat("leaf", F.array("_c")).alias("leaf")))
        if cur.isEmpty():
            return done


def _count_cuts(d: DataFrame, steps: DataFrame, on: list[str]) -> DataFrame:
    """``_c``: number of cut positions at or before ``_p``, by a scan over boxes and cuts."""
    rows = d.select(*d.columns, F.lit(None).cast("bigint").alias("_k"), F.lit(1).alias("_o"))
    cuts = steps.select(*on, "_p", "_k", F.lit(0).alias("_o"))
    u = scan(rows.unionByName(cuts, allowMissingColumns=True), on, ["_p", "_o", "id"], F.floor(F.col("_p") / 4096), _c=Scan("prev", F.col("_k")))
    return u.where("_o = 1").withColumn("_c", F.coalesce("_c", F.lit(0)))

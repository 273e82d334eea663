"""Ordered scans over long sequences, without one task per key.

A plain window needs all rows of a key in one task. Here each key's sequence is
cut into blocks by an integer column; a window runs inside ``keys + block``, and
what a row needs from other blocks comes from a table with one row per block
(built with partial aggregation). A key that holds a third of all rows is thus
spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagescale.session import materialise


@dataclass(frozen=True)
class Scan:
    """One scanned column.

    kind: ``sum`` running sum with this row; ``prev`` / ``next`` nearest
    non-null value before / after this row; ``max_before`` / ``min_after`` /
    ``max_after`` extreme of all rows before / after this row;
    ``total`` sum over the key.
    """

    kind: str
    value: Column


def _order(cols, desc=False):
    return [F.col(c).desc() if desc else F.col(c).asc() for c in cols]


_BACK = {"next", "min_after", "max_after"}


def _fold(kind: str, value: Column, w) -> Column:
    if kind in ("prev", "next"):
        return F.last(value, ignorenulls=True).over(w)
    return {"max_before": F.max, "max_after": F.max, "min_after": F.min, "sum": F.sum}[kind](value).over(w)


def scan(df: DataFrame, keys, order, block: Column | None, **scans: Scan) -> DataFrame:
    """Add the scanned columns. ``order`` must be a total order inside a key and
    ``block`` must not decrease along it. ``block=None`` runs plain windows, for
    keys whose groups come from one input row.

    Carried values meet their rows by plain equality, which keeps the rows partitioned for the window (and rows that come
    partitioned by key where they are): a missing block comes first, rows with a missing key are one block."""
    keys, order = list(keys), list(order)
    before = Window.unboundedPreceding, -1
    upto = Window.unboundedPreceding, 0
    out = df
    for name, s in scans.items():
        out = out.withColumn(f"_v_{name}", s.value)
    part = list(keys)
    if block is not None:
        out = out.withColumn("_blk", F.coalesce(block.cast("bigint"), F.lit(-(1 << 63))))
        lone = None
        for k in keys:
            lone = F.col(k).isNull() if lone is None else lone | F.col(k).isNull()
        if lone is not None:
            out = out.withColumn("_blk", F.when(lone, F.lit(0).cast("bigint")).otherwise(F.col("_blk")))
        part = keys + ["_blk"]
        ord_struct = F.struct(*order)
        aggs = []
        for name, s in scans.items():
            v = F.col(f"_v_{name}")
            if s.kind == "prev":
                a = F.max_by(v, F.when(v.isNotNull(), ord_struct))
            elif s.kind == "next":
                a = F.min_by(v, F.when(v.isNotNull(), ord_struct))
            elif s.kind in ("max_before", "max_after"):
                a = F.max(v)
            elif s.kind == "min_after":
                a = F.min(v)
            else:
                a = F.sum(v)
            aggs.append(a.alias(f"_b_{name}"))
        table = out.groupBy(*part).agg(*aggs)
        fwd = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(*before)
        bwd = Window.partitionBy(*keys).orderBy(F.desc("_blk")).rowsBetween(*before)
        cols = []
        for name, s in scans.items():
            b = F.col(f"_b_{name}")
            if s.kind == "total":
                cols.append(F.sum(b).over(Window.partitionBy(*keys)).alias(f"_c_{name}"))
            else:
                cols.append(_fold(s.kind, b, bwd if s.kind in _BACK else fwd).alias(f"_c_{name}"))
        out = out.join(table.select(*part, *cols).hint("merge"), part, "left")
    lfwd = Window.partitionBy(*part).orderBy(*_order(order))
    lbwd = Window.partitionBy(*part).orderBy(*_order(order, desc=True))
    new = {}
    for name, s in scans.items():
        v = F.col(f"_v_{name}")
        carry = F.col(f"_c_{name}") if block is not None else None
        if s.kind == "total":
            whole = F.sum(v).over(Window.partitionBy(*part))
            new[name] = whole if carry is None else carry if lone is None else F.when(lone, whole).otherwise(carry)
            continue
        if s.kind == "sum":
            local = F.sum(v).over(lfwd.rowsBetween(*upto))
            zero = F.lit(0)
            new[name] = local if carry is None else F.coalesce(local, zero) + F.coalesce(carry, zero)
            continue
        w = lbwd if s.kind in _BACK else lfwd
        local = _fold(s.kind, v, w.rowsBetween(*before))
        if carry is None:
            new[name] = local
        elif s.kind in ("prev", "next"):
            new[name] = F.coalesce(local, carry)
        else:
            new[name] = (F.least if s.kind == "min_after" else F.greatest)(local, carry)
    out = out.withColumns(new)
    return out.drop("_blk", *[f"_v_{n}" for n in scans], *[f"_c_{n}" for n in scans])


def number_rows(df: DataFrame, keys, order, block: Column | None, out: str = "rn") -> DataFrame:
    """1-based row number inside each key."""
    return scan(df, keys, order, block, **{out: Scan("sum", F.lit(1).cast("bigint"))})


def rank_all(df: DataFrame, order, out: str = "rn") -> DataFrame:
    """1-based rank of every row by a total order, without a task that sees them all: rows are dealt to
    partitions by ranges of the order and written with their place in the partition; a table of one row per
    partition says how many stand before it."""
    d = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    d = materialise(d.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit(2**33 - 1))))
    size = d.groupBy("_part").agg(F.count("*").alias("_n"))
    ahead = size.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    return d.join(ahead, "_part").withColumn(out, F.col("_ahead") + F.col("_at") + 1).drop("_part", "_at", "_ahead")


def islands(df: DataFrame, keys, start: str, end: str, order, block: Column | None,
            gap: int = 0, out: str = "island") -> DataFrame:
    """Number maximal chains of intervals: a row opens a new chain when its start
    lies more than ``gap`` behind every earlier end. ``order`` begins with start."""
    df = scan(df, keys, order, block, _reach=Scan("max_before", F.col(end)))
    fresh = F.when(F.col("_reach").isNull() | (F.col(start) > F.col("_reach") + gap), 1).otherwise(0)
    df = df.withColumn("_fresh", fresh.cast("bigint")).drop("_reach")
    return scan(df, keys, order, block, **{out: Scan("sum", F.col("_fresh"))}).drop("_fresh")

"""Quality rules as column predicates, and checks of grids, segmentations, datasets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Predicate = Callable[[Column], Column]


def in_range(lo, hi) -> Predicate:
    return lambda c: c.between(lo, hi)


def non_negative() -> Predicate:
    return lambda c: c >= 0


def is_number() -> Predicate:
    """Castable to a number and not NaN."""
    return lambda c: c.try_cast("double").isNotNull() & ~F.isnan(c.try_cast("double"))


def is_bool() -> Predicate:
    return lambda c: c.isin(0, 1)


def one_of(*values) -> Predicate:
    return lambda c: c.isin(*values)


def of_type(*names: str) -> Predicate:
    return lambda c: F.typeof(c).isin(*names)


def all_of(*preds: Predicate) -> Predicate:
    def both(c):
        out = F.lit(True)
        for p in preds:
            out = out & p(c)
        return out
    return both


def any_of(*preds: Predicate) -> Predicate:
    def either(c):
        out = F.lit(False)
        for p in preds:
            out = out | p(c)
        return out
    return either


@dataclass(frozen=True)
class Rule:
    name: str
    field: str
    holds: Predicate
    message: str
    warning: bool = False


def check(df: DataFrame, rules: list[Rule], ident: list[str], mode: str = "report") -> DataFrame:
    """report: one row per broken rule (ident, rule, kind, field, value, message). strict:
    the input itself, failing at the first row that breaks an error rule. A NULL breaks
    every rule on its field. One pass, no shuffle."""
    def broken(r):
        return ~F.coalesce(r.holds(F.col(r.field)), F.lit(False))

    if mode == "strict":
        for r in rules:
            if not r.warning:
                text = F.concat(F.lit(f"{r.name}: {r.field}="), F.coalesce(F.col(r.field).cast("string"), F.lit("NULL")), F.lit(f" {r.message}"))
                df = df.where(F.when(broken(r), F.raise_error(text).cast("boolean")).otherwise(True))
        return df
    hits = F.array_compact(F.array(*[
        F.when(broken(r), F.struct(F.lit(r.name).alias("rule"), F.lit("warning" if r.warning else "error").alias("kind"), F.lit(r.field).alias("field"),
                                   F.col(r.field).cast("string").alias("value"), F.lit(r.message).alias("message"))) for r in rules]))
    return df.select(*ident, F.inline(hits))


def check_grid(cells: DataFrame, keys: list[str], v: str) -> DataFrame:
    """Per grid: value range, size, byte range, two-valued {0,1} or {0,255}, light (median
    above mean), page at least 600 x 600, line higher than 8."""
    odd = F.count_if(~F.col(v).isin(0, 1, 255))
    both = F.max(F.when(F.col(v) == 1, 1).otherwise(0)) + F.max(F.when(F.col(v) == 255, 1).otherwise(0))
    h, w = F.max("y") + 1, F.max("x") + 1
    return cells.groupBy(*keys).agg(
        F.min(v).alias("lo"), F.max(v).alias("hi"), h.alias("h"), w.alias("w"), ((F.min(v) >= 0) & (F.max(v) <= 255)).alias("byte_range"),
        ((odd == 0) & (both < 2)).alias("binary"), (F.median(v) > F.avg(v)).alias("light"), ((h >= 600) & (w >= 600)).alias("page_size"), (h > 8).alias("line_height"))


def check_segmentation(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Background stored as 0 (no cell holds 0xffffff) and labels without a column byte."""
    return cells.groupBy(*keys).agg((F.count_if(F.col("label") == 0xFFFFFF) == 0).alias("black_background"),
                                    F.count_if((F.col("label") != 0) & (F.col("label") < 0x10000)).alias("no_column"))


def check_dataset(df: DataFrame, vec: str, rows=(1, None), length: int | None = None, values=(None, None)) -> DataFrame:
    """Row count, vector lengths and value range, and whether all lie in the given limits."""
    got = df.agg(F.count("*").alias("n"), F.min(F.size(vec)).alias("min_len"), F.max(F.size(vec)).alias("max_len"),
                 F.min(F.array_min(vec)).alias("lo"), F.max(F.array_max(vec)).alias("hi"))
    ok = F.lit(True)
    for c, (lo, hi) in (("n", rows), ("lo", (values[0], None)), ("hi", (None, values[1]))):
        ok = ok & (F.col(c) >= lo if lo is not None else F.lit(True)) & (F.col(c) <= hi if hi is not None else F.lit(True))
    if length is not None:
        ok = ok & (F.col("min_len") == length) & (F.col("max_len") == length)
    return got.withColumn("ok", ok)

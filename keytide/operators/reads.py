"""Point, range and fold operators over a resolved state (key, value, ...)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keytide.plans.keyrange import KeyRange


def get(state: DataFrame, key: bytes | str) -> DataFrame:
    return state.where(F.col("key") == F.lit(bytearray(key) if isinstance(key, bytes) else key))


lookup = get


def multi_get(state: DataFrame, keys: DataFrame) -> DataFrame:
    """Values of many keys, null where there is none. Spark broadcasts the keys only if they are small."""
    return keys.select("key").join(state.select("key", "value"), "key", "left")


def scan(state: DataFrame, r: KeyRange) -> DataFrame:
    """Rows of an interval; the limit applies to visible rows in key order."""
    rows = state.where(r.predicate())
    return rows if r.limit is None else rows.orderBy("key").limit(r.limit)


def fold(state: DataFrame, r: KeyRange, **aggregates: Column) -> DataFrame:
    """Fold by aggregate functions: partial on each task, no order needed."""
    return scan(state, r).agg(*(c.alias(n) for n, c in aggregates.items()))


def fold_ordered(state: DataFrame, r: KeyRange, init: Column, step: Callable[[Column, Column], Column], by: list[str] | None = None, reverse: bool = False) -> DataFrame:
    """Fold whose result depends on key order, as an expression. Each group's rows meet in one row, so groups have to be small (or limited)."""
    rows = F.sort_array(F.collect_list(F.struct("key", "value")), asc=not reverse)
    src = scan(state, r)
    return (src.groupBy(*by) if by else src).agg(F.aggregate(rows, init, step).alias("acc"))


def fold_iter(state: DataFrame, r: KeyRange, fun: Callable[[Any, Any, Any], Any], acc: Any, until: Callable[[Any], bool] | None = None, reverse: bool = False) -> Any:
    """Fold by any Python function in key order, a partition at a time on the driver; it stops when ``until`` holds of the
    result so far, or by an exception. In ``reverse`` the rows of the interval (and limit) come last to first."""
    if r.limit == 0 or (until and until(acc)):
        return acc
    rows: Iterator = scan(state, r).orderBy(F.col("key").desc() if reverse else "key").select("key", "value").toLocalIterator()
    for row in rows:
        acc = fun(row.key, row.value, acc)
        if until and until(acc):
            break
    return acc


def pages(state: DataFrame, r: KeyRange, size: int) -> Iterator[list]:
    """Resumable scan: pages of ``size`` rows, each from after the last key of the one before."""
    while True:
        rows = scan(state, KeyRange(r.lo, r.hi, r.lo_inclusive, r.hi_inclusive, size)).collect()
        if rows:
            yield rows
        if len(rows) < size:
            return
        r = KeyRange(bytes(rows[-1].key) if not isinstance(rows[-1].key, str) else rows[-1].key, r.hi, False, r.hi_inclusive)


def first_key(state: DataFrame) -> DataFrame:
    return state.agg(F.min("key").alias("key"))


def floor_lookup(table: DataFrame, probes: DataFrame, buckets: list | None = None) -> DataFrame:
    """For each probe the greatest key at or below it, with its value; null below the first key.

    Both sides lie in one order; a probe takes the last key before it. With ``buckets`` (sorted boundaries) the
    order is cut into ranges handled apart, each opened by the greatest key of the lower ranges.
    """
    both = table.select(F.col("key").alias("at"), F.lit(0).alias("_p"), F.struct("key", "value").alias("_kv")).unionByName(
        probes.select(F.col("key").alias("at"), F.lit(1).alias("_p"), F.lit(None).alias("_kv")), allowMissingColumns=True
    )
    if not buckets:
        w = Window.orderBy("at", "_p").rowsBetween(Window.unboundedPreceding, 0)
        return both.withColumn("_f", F.last("_kv", ignorenulls=True).over(w)).where("_p = 1").select(F.col("at").alias("probe"), "_f.key", "_f.value")
    both = both.withColumn("_b", sum((F.when(F.col("at") >= F.lit(b), 1).otherwise(0) for b in buckets), F.lit(0)))
    ends = both.groupBy("_b").agg(F.max("_kv").alias("_end"))
    carry = ends.withColumn("_carry", F.last("_end", ignorenulls=True).over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).select("_b", "_carry")
    w = Window.partitionBy("_b").orderBy("at", "_p").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_l", F.last("_kv", ignorenulls=True).over(w)).where("_p = 1").join(carry, "_b", "left").withColumn("_f", F.coalesce("_l", "_carry"))
    return out.select(F.col("at").alias("probe"), "_f.key", "_f.value")


def edges(keys: DataFrame, parts: int, error: int = 1000) -> list:
    """At most ``parts - 1`` boundaries that cut numeric keys into about equal parts, from a sketch of quantiles."""
    at = [i / parts for i in range(1, parts)]
    found = keys.agg(F.percentile_approx("key", at, error).alias("e")).first()
    return sorted(set(found.e or []))


def dict_build(pairs: DataFrame, by: Column) -> DataFrame:
    """Pages: for each value of ``by`` one row (page, keys, values), the keys in order; of equal keys one stays. ``by`` has to
    bound the rows of a page, as the leading part of a key does."""
    rows = F.sort_array(F.collect_list(F.struct("key", "value")))
    pages = pairs.groupBy(by.alias("page")).agg(rows.alias("_r"))
    once = F.filter("_r", lambda x, i: (i == 0) | (F.get(F.col("_r"), i - 1)["key"] != x["key"]))
    return pages.withColumn("_r", once).select("page", F.col("_r.key").alias("keys"), F.col("_r.value").alias("values"))


def dict_entries(pages: DataFrame) -> DataFrame:
    """The pairs of pages: the inverse of :func:`dict_build`."""
    return pages.select(F.explode(F.arrays_zip("keys", "values")).alias("x")).select(F.col("x.keys").alias("key"), F.col("x.values").alias("value"))


def dict_find(pages: DataFrame, probes: DataFrame, by: Column) -> DataFrame:
    """For each probe (key) its value in its page, found by bisection; null where it isn't. ``by`` is that of the pages, over ``key``."""
    both = probes.withColumn("page", by).join(pages, "page", "left")
    steps = F.sequence(F.floor(F.log2(F.size("keys") + 1)).cast("int"), F.lit(0))
    below = F.aggregate(steps, F.lit(0), lambda lo, d: F.when(F.coalesce(F.get("keys", lo + F.pow(F.lit(2), d).cast("int") - 1) < F.col("key"), F.lit(False)), lo + F.pow(F.lit(2), d).cast("int")).otherwise(lo))
    at = both.withColumn("_i", F.when(F.col("keys").isNotNull(), below))
    return at.select("key", F.when(F.get("keys", F.col("_i")) == F.col("key"), F.get("values", F.col("_i"))).alias("value"))


def dict_merge(a: DataFrame, b: DataFrame, resolve: Callable[[Column, Column], Column]) -> DataFrame:
    """Union of two key/value tables; where both have a key, ``resolve(value of a, value of b)`` decides."""
    x, y = a.select("key", F.col("value").alias("_x"), F.lit(True).alias("_a")), b.select("key", F.col("value").alias("_y"), F.lit(True).alias("_b"))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return x.join(y, "key", "full_outer").select("key", F.when(both, resolve(F.col("_x"), F.col("_y"))).when(F.col("_a").isNotNull(), F.col("_x")).otherwise(F.col("_y")).alias("value"))

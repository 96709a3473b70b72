"""From a change log to its state.

The order of steps is the meaning: first the newest change of each key, then what hides it. So a delete or an
expired put hides all older changes, wherever they are stored, and filters on keys (and on nothing else)
may move below the choice; Catalyst does that.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(changes: DataFrame, key: str | list[str] = "key", order: str | list[str] = "seq") -> DataFrame:
    """The newest change of each key. Partial aggregates leave one row for each key and task before the shuffle."""
    keys, by = ([x] if isinstance(x, str) else x for x in (key, order))
    rest = [c for c in changes.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*by) if len(by) > 1 else F.col(by[0]))
    return changes.groupBy(*keys).agg(newest.alias("_v")).select(*(c if c in keys else F.col(f"_v.{c}").alias(c) for c in changes.columns))


def expired(as_of: Column | int) -> Column:
    """Whole seconds; a change that expires at ``as_of`` is still there."""
    return F.coalesce(F.col("expire_at") < as_of, F.lit(False))


def visible(newest: DataFrame, as_of: Column | int | None = None) -> DataFrame:
    return newest.where(~F.col("is_delete") & ~expired(F.unix_timestamp() if as_of is None else as_of))


def state(changes: DataFrame, as_of: Column | int | None = None, upto: int | None = None) -> DataFrame:
    """Visible rows; with ``upto`` those of the snapshot after that write."""
    return visible(latest(changes if upto is None else changes.where(F.col("seq") <= upto)), as_of)


def union_runs(*runs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, runs)


def merge(*runs: DataFrame) -> DataFrame:
    """Precedence merge of any number of runs: newest change of each key, deletes included."""
    return latest(union_runs(*runs))


def compact(runs: list[DataFrame], as_of: int | None, bottom: bool) -> DataFrame:
    """What a merged run holds. Only at the bottom, where no older run is left, may deletes and expired changes go."""
    merged = merge(*runs)
    return visible(merged, as_of) if bottom else merged

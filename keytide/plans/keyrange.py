"""Intervals of keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class KeyRange:
    """``[lo, hi)`` unless said otherwise; an empty ``lo`` and a ``hi`` of None are open ends. ``limit`` counts visible rows."""

    lo: bytes | str = b""
    hi: bytes | str | None = None
    lo_inclusive: bool = True
    hi_inclusive: bool = False
    limit: int | None = None

    def predicate(self, key: str = "key") -> Column:
        c = F.col(key)
        out = F.lit(True)
        if self.lo or not self.lo_inclusive:
            lo = F.lit(bytearray(self.lo) if isinstance(self.lo, bytes) else self.lo)
            out = c >= lo if self.lo_inclusive else c > lo
        if self.hi is not None:
            hi = F.lit(bytearray(self.hi) if isinstance(self.hi, bytes) else self.hi)
            out = out & (c <= hi if self.hi_inclusive else c < hi)
        return out

    def meets(self, low: str, high: str) -> bool:
        """Whether a run with these least and greatest keys (hex) can hold a key of the interval."""
        lo, hi = (k.encode() if isinstance(k, str) else k for k in (self.lo, self.hi if self.hi is not None else b""))
        if self.hi is not None and (bytes.fromhex(low) > hi or (bytes.fromhex(low) == hi and not self.hi_inclusive)):
            return False
        return bytes.fromhex(high) > lo or (bytes.fromhex(high) == lo and self.lo_inclusive)


def prefix(p: bytes) -> KeyRange:
    """All keys that begin with ``p``."""
    end = p.rstrip(b"\xff")
    return KeyRange(p, end[:-1] + bytes([end[-1] + 1]) if end else None)

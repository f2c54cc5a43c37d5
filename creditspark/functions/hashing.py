"""Reproducible pseudo-random order: the MD5 of a row's key and a salt.

Any engine can recompute it, and it does not depend on partitioning, so a
task that is run again after an executor loss makes the same choice.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _key(key: str | Sequence[str]) -> str:
    keys = [key] if isinstance(key, str) else list(key)
    return "concat_ws('|', " + ", ".join(f"CAST(`{k}` AS STRING)" for k in keys) + ")"


def hash_text(key: str | Sequence[str], salt: str | int) -> Column:
    return F.expr(f"md5({_key(key)} || ':{salt}')")


def order_text(key: str | Sequence[str], salt: str | int) -> Column:
    """Hash first, key second: one text that is unique where the key is unique."""
    return F.expr(f"md5({_key(key)} || ':{salt}') || ':' || {_key(key)}")


def bernoulli(key: str | Sequence[str], fraction: float, salt: str | int) -> Column:
    """True for a row with probability `fraction`, decided by its hash alone."""
    if fraction >= 1:
        return F.lit(True)
    if fraction <= 0:
        return F.lit(False)
    limit = f"{math.ceil(fraction * 2**32):08x}"
    return F.substring(hash_text(key, salt), 1, 8) < F.lit(limit)

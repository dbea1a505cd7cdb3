"""Repeatable random draws as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def u(seed: int, *key: Column) -> Column:
    """Uniform in [0, 1): the first 13 hex digits of an MD5 of seed and key over 2^52. The same after any retry, and in
    any engine that has MD5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))

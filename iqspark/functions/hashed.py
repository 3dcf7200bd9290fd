"""Numbers drawn by hash, the same on every run and at every size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hashed_uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of md5 of seed and parts."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(2**52)

"""Joins whose large side may hold one key on a third of its rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from assay.plans.sizing import BROADCAST_LIMIT_BYTES, estimated_bytes

#: Copies of the small side a shuffled join spreads each key over.
COPIES = 32

_SALT = "_salt"


def spread_join(
    large: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner", copies: int = COPIES
) -> DataFrame:
    """Join a large side to one with few rows per key.

    A small side of checked size is broadcast. Otherwise it is repeated ``copies`` times
    and each large row picks one copy by its content, so a hot key is met by ``copies``
    tasks rather than one. ``how`` keeps or drops rows of the large side: inner, left,
    left_semi or left_anti.
    """
    if estimated_bytes(small) <= BROADCAST_LIMIT_BYTES:
        return large.join(F.broadcast(small), list(keys), how)
    repeated = small.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    salted = large.withColumn(_SALT, F.pmod(F.xxhash64(*_hashable(large)), F.lit(copies)).cast("int"))
    return salted.join(repeated, [*keys, _SALT], how).drop(_SALT)


def _hashable(df: DataFrame) -> list[str]:
    return [field.name for field in df.schema if field.dataType.typeName() not in ("map", "variant")]

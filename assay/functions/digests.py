"""Content digests and digest comparison."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

#: Hex digits per digest name.
HEX_DIGITS = {"md5": 32, "xxh3_128": 32, "sha256": 64}


def md5_hex(content: Column) -> Column:
    return F.md5(content.cast("binary"))


def sha256_hex(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


@F.pandas_udf(StringType())
def _xxh3_128(content: pd.Series) -> pd.Series:
    from xxhash import xxh3_128_hexdigest

    return content.map(xxh3_128_hexdigest, na_action="ignore")


def xxh3_128_hex(content: Column) -> Column:
    """XXH3-128 in canonical big-endian hex. Spark's ``xxhash64`` is another function."""
    return _xxh3_128(content.cast("binary"))


DIGESTS = {"md5": md5_hex, "sha256": sha256_hex, "xxh3_128": xxh3_128_hex}


def digest_exact_len(content: Column, size: Column, digest: str = "md5") -> Column:
    """Struct ``(digest, error)`` over exactly the first ``size`` bytes.

    Bytes past the logical end are ignored; a short content is an error.
    """
    content = content.cast("binary")
    missing = size - F.octet_length(content)
    exact = DIGESTS[digest](F.substring(content, F.lit(1), size.cast("int")))
    return F.struct(
        F.when(missing <= 0, exact).alias("digest"),
        F.when(missing > 0, F.concat(missing.cast("string"), F.lit(" bytes missing"))).alias("error"),
    )


def digest_equal(left: Column, right: Column) -> Column:
    return F.lower(left) == F.lower(right)


def valid_digest(value: Column, digest: str = "md5") -> Column:
    return value.rlike("^[0-9A-Fa-f]{%d}$" % HEX_DIGITS[digest]) & ~value.endswith("\n")


def digest_to_bigint(hex_digest: Column) -> Column:
    """The leading 60 bits of a hex digest as a non-negative integer."""
    return F.conv(F.substring(hex_digest, 1, 15), 16, 10).cast("bigint")

"""Arrays of tokens: fitting, stacking, shifting, and their form as bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType
from pyspark.sql.types import ArrayType, BinaryType, IntegerType


def fit(x: Column, length: Column, pad: int) -> Column:
    """The array cut or padded to a length."""
    return F.slice(F.concat(x, F.array_repeat(F.lit(pad), F.greatest(F.lit(0), length - F.size(x)))), F.lit(1), length)


def stack(own: Column, other: Column) -> Column:
    """Rows of a main speaker: the own ones (text and codebooks), then the other speaker's without the text."""
    return F.concat(own, F.slice(other, F.lit(2), F.size(other)))


def shift(x: Column, by: Column, pad: int) -> Column:
    """The array shifted to the right (by > 0) or left (by < 0), by its length less one at most; pads fill up."""
    n = F.size(x)
    by = F.greatest(-(n - 1), F.least(by, n - 1))
    right = F.concat(F.array_repeat(F.lit(pad), F.greatest(by, F.lit(0))), F.slice(x, F.lit(1), n - F.greatest(by, F.lit(0))))
    left = F.concat(F.slice(x, 1 - F.least(by, F.lit(0)), n + F.least(by, F.lit(0))), F.array_repeat(F.lit(pad), -F.least(by, F.lit(0))))
    return F.when(n <= 1, x).when(by >= 0, right).otherwise(left)


# The functions inside are sent to the workers by value, so these need no package there.


def to_bytes(x: Column) -> Column:
    """Little-endian 32-bit integers; null stays null."""
    def pack(values):
        import numpy as np

        return values.map(lambda v: None if v is None else np.asarray(v, "<i4").tobytes())

    return F.pandas_udf(pack, BinaryType(), PandasUDFType.SCALAR)(x)


def from_bytes(x: Column) -> Column:
    def unpack(values):
        import numpy as np

        return values.map(lambda v: None if v is None else np.frombuffer(v, "<i4"))

    return F.pandas_udf(unpack, ArrayType(IntegerType()), PandasUDFType.SCALAR)(x)

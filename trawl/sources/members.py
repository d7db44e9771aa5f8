"""Which rows may have one of many keys: a bitmap of hashes of bounded size, so that texts of other rows needn't be shuffled."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a row of a bitmap, as ``bitmap_construct_agg`` makes them; bits for each key; rows at most, 4 KB each.
_ROW, _EACH, _ROWS = 1 << 15, 16, 1 << 12


def near(rows: DataFrame, key: str, keys: DataFrame, n: int, then: Callable[[Column], Column] | None = None) -> DataFrame:
    """The rows whose key is one of the keys (first column; about n), and a few others: a sixteenth, more if there are over 8 million keys.

    then: makes a condition that rows have to meet too from whether their key may be one. The bitmap is broadcast, 16 MB at most.
    """
    size = 1
    while size < _ROWS and size * _ROW < _EACH * n:
        size *= 2
    names = f"_bucket_{uuid.uuid4().hex}", f"_bits_{uuid.uuid4().hex}"
    spot = lambda c: F.pmod(F.xxhash64(c.cast("bigint")), F.lit(size * _ROW))
    bucket, place = (lambda c: F.floor(spot(c) / _ROW)), (lambda c: F.pmod(spot(c), F.lit(_ROW)))
    own = F.col(f"`{keys.columns[0]}`")
    bitmap = keys.groupBy(bucket(own).alias(names[0])).agg(F.bitmap_construct_agg(place(own)).alias(names[1]))
    key_col = F.col(f"`{key}`")
    byte = F.conv(F.hex(F.substring(F.col(names[1]), (F.floor(place(key_col) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(place(key_col), F.lit(8)))), F.lit(2)) == 1
    met = rows.join(F.broadcast(bitmap), bucket(key_col) == F.col(names[0]))
    return met.where(then(held) if then else held).select(*[F.col(f"`{c}`") for c in rows.columns])

"""A filter of hashes in one bitmap of fixed size, for broadcasting."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scale import tidied

#: 8 MB whatever the tables hold: with more hashes it lets more others pass, and loses none.
FILTER_BITS = 1 << 26
#: A hash sets the bits that its low digits name after these shifts.
SHIFTS = (0, 30)


def bitmap_of(hashes: DataFrame, column: str = "h") -> np.ndarray:
    """The bitmap of a bigint column: at most FILTER_BITS / 8 bytes come to the driver."""
    bit = F.explode(F.array(*[F.shiftright(column, k).bitwiseAND(F.lit(FILTER_BITS - 1)) + 1 for k in SHIFTS]))
    rows = hashes.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    with tidied(hashes.sparkSession):
        found = rows.collect()
    for r in found:
        some = np.frombuffer(bytes(r["bits"]), np.uint8)
        out[(r["k"] - 1) * len(some) : r["k"] * len(some)] = some
    return out


def known(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The places of the hashes that may be in the bitmap."""
    place = np.arange(len(hashes))
    for shift in SHIFTS:
        bit = (hashes[place] >> shift) & (FILTER_BITS - 1)
        place = place[(bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1]
    return place


def kept(bits, columns: list[str]):
    """For mapInArrow: rows whose column h may be in the broadcast bitmap, ``columns`` only."""

    def run(batches):
        for b in batches:
            yield b.take(pa.array(known(bits.value, b["h"].to_numpy()))).select(columns)

    return run

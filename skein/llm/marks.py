"""Bitmaps that thin a table before an exact join or grouping.

A key sets one bit at a hashed place.  Rows whose bit is not set hold none of the
keys and go; the others may hold one, so an exact step follows in every case.
The bitmap is cut into pieces of 32 768 bits, which are built by Spark's bitmap
functions and joined as rows.  It has 32 to 64 bits a key and at most MAX_BITS, so
at most 32 MB are broadcast whatever the size of the data.  Beyond 2**28 / 32
keys it lets more rows through and saves less; results are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

BITS_A_KEY = 32
MAX_BITS = 1 << 28
PIECE = 1 << 15


def _place(key: Column | str, bits: int) -> tuple[Column, Column]:
    """The piece and the place in it, from 0, of a key."""
    at = F.pmod(F.xxhash64(F.lit("marks"), key), F.lit(bits))
    return F.floor(at / PIECE), F.pmod(at, F.lit(PIECE)).cast("int")


def _words(bitmap: str) -> Column:
    """A piece as an array of longs, whose bits are read without making strings."""
    return F.transform(F.sequence(F.lit(1), F.lit(PIECE // 8), F.lit(8)), lambda i: F.conv(
        F.hex(F.substring(bitmap, i, F.lit(8))), 16, -10).cast("long")).alias("_words")


def maybe_in(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The ``rows`` whose ``column`` may be one of ``keys`` (a written table of
    one column without nulls).  Rows with a null there go, too."""
    wanted = max(1, keys.count()) * BITS_A_KEY
    bits = min(MAX_BITS, max(PIECE, 1 << (wanted - 1).bit_length()))
    piece, place = _place(keys[keys.columns[0]], bits)
    pieces = written(keys.select(piece.alias("_piece"), place.alias("_place"))
                     .repartition("_piece").groupBy("_piece")
                     .agg(F.bitmap_construct_agg("_place").alias("_bits")).select("_piece", _words("_bits")), "marks")
    piece, place = _place(F.col(column), bits)
    # the bytes of a word stand in descending order
    bit = F.call_function("getbit", F.col("_words")[F.shiftright("_place", 6)],
                          F.col("_place").bitwiseAND(63).bitwiseXOR(56))
    return rows.filter(F.col(column).isNotNull()).withColumns({"_piece": piece, "_place": place}) \
        .join(F.broadcast(pieces), "_piece").filter(bit == 1).select(*rows.columns)

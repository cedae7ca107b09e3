"""Rows that may repeat, told apart from those that cannot without moving either."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from webgrain.session import materialized

# Bits of the filter: so many for a repeated mark, in parts of 4 KB, and never more than 32 MB.
BITS_EACH, PART_BITS, MOST_BITS = 32, 1 << 15, 1 << 28


def split_repeats(rows: DataFrame, mark: Column) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose ``mark``, a 64-bit hash, no other row has, and all others, if any.

    Marks alone are counted.  The repeated ones set bits of a filter that every task gets (its size is
    bounded, so it is broadcast); a row whose bit is not set stands alone.  Some rows that stand
    alone are among the others: what is done with those must be exact by itself.
    """
    marks = rows.select(mark.alias("mark")).groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    marks = materialized(marks.select("mark"), "repeated-marks")
    n = marks.count()
    if not n:
        return rows, None
    size = min(MOST_BITS, max(PART_BITS, 1 << (n * BITS_EACH).bit_length()))
    place = lambda m: F.pmod(m, F.lit(size)).cast("long")
    part, bit = (lambda m: F.shiftright(place(m), 15)), (lambda m: place(m).bitwiseAND(F.lit(PART_BITS - 1)))
    bits = marks.select(part(F.col("mark")).alias("__part"), bit(F.col("mark")).alias("__bit")).groupBy("__part").agg(
        F.bitmap_construct_agg("__bit").alias("__bits"))
    marked = rows.select("*", part(mark).alias("__of"), bit(mark).alias("__at")).join(F.broadcast(bits), F.col("__of") == F.col("__part"), "left")
    byte = F.conv(F.hex(F.substr("__bits", (F.col("__at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.coalesce(F.getbit(byte, F.col("__at") % 8) == 1, F.lit(False))
    return marked.where(~is_set).select(*rows.columns), marked.where(is_set).select(*rows.columns)

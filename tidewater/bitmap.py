"""Bit maps of keys: a filter in front of a join.

A join with a large table of keys moves all rows of its other side, even if few of them meet a key.  ``maybe_in`` leaves out most of
those that meet none in the task that reads them.  The map has BITS_A_KEY bits for each key, MOST_BITS at most, so it can be broadcast at any size:
with more keys than that it leaves out fewer rows, but never one that meets a key.  The exact join follows it: an inner one with distinct
keys, since Spark would move a semi join in front of the map.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS_A_KEY, MOST_BITS = 16, 1 << 27
#: Bits of a row of the map: those that ``bitmap_construct_agg`` fills.
BLOCK = 1 << 15


def maybe_in(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` without most of those whose values of ``on`` (the same columns and types in both) are in no row of ``keys``, a written table."""
    bits = BLOCK
    while bits < min(MOST_BITS, BITS_A_KEY * keys.count()):
        bits *= 2
    place = F.pmod(F.xxhash64(*on), F.lit(bits))
    block, bit = F.shiftright(place, 15).cast("int"), place % BLOCK
    marks = keys.select(block.alias("bit_block"), bit.alias("bit")).repartition("bit_block").groupBy("bit_block").agg(F.bitmap_construct_agg("bit").alias("marks"))
    # as whole numbers, the first of eight bytes being the highest
    marks = marks.select("bit_block", F.expr(f"transform(sequence(0, {BLOCK // 64 - 1}), i -> cast(conv(hex(substring(marks, 8 * i + 1, 8)), 16, -10) as bigint))").alias("bit_words"))
    found = rows.select("*", block.alias("bit_block"), bit.cast("int").alias("bit_at")).join(F.broadcast(marks), "bit_block")
    found = found.where("getbit(bit_words[bit_at div 64], (7 - bit_at div 8 % 8) * 8 + bit_at % 8) = 1")
    return found.select(*[F.col(c) for c in rows.columns])

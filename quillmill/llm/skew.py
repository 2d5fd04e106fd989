"""Joins to keyed tables that hold whatever share of the rows one key has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with one of so many rows, or more, is hot: there are at most so many such keys.
HOT_KEYS = 1000


def join_counted(rows: DataFrame, keyed: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """``rows`` left-joined to ``keyed``, which has one row per key and, as ``n``, how many of ``rows`` hold the key.

    Hot keys are at most ``HOT_KEYS`` by their counts, so their rows of ``keyed`` are broadcast and
    their rows of ``rows`` stay where they are. The others are joined by shuffle: no key
    there has more than a ``HOT_KEYS``-th of all rows. Both tables are read twice: write them before. No key of ``rows`` may be null.
    """
    least = max(2, rows.count() // HOT_KEYS)
    hot, cold = keyed.filter(F.col(n) > least), keyed.filter(F.col(n) <= least)
    names = [c for c in keyed.columns if c not in keys]
    marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
    done = marked.filter("_hot").select(*rows.columns, *names)
    rest = marked.filter("_hot is null").select(*rows.columns)
    return done.unionByName(rest.join(cold, keys, "left").select(*rows.columns, *names))


def bitmap(keyed: DataFrame, keys: list[str], bits: int = 1 << 24) -> DataFrame:
    """``_word, _mask``: a set of hashed keys in at most ``bits / 64`` rows, however many keys there are."""
    place = F.pmod(F.xxhash64(*keys), F.lit(bits))
    one = F.expr("shiftleft(1L, cast(_place % 64 as int))")
    return keyed.select(place.alias("_place")).select(F.expr("_place div 64").alias("_word"), one.alias("_one")).groupBy("_word").agg(F.expr("bit_or(_one)").alias("_mask"))


def maybe_in(rows: DataFrame, words: DataFrame, keys: list[str], found: str, bits: int = 1 << 24) -> DataFrame:
    """``rows`` with ``found``: true if the keys are in the bitmap; rarely also if they are not."""
    rows = rows.withColumn("_place", F.pmod(F.xxhash64(*keys), F.lit(bits))).withColumn("_word", F.expr("_place div 64"))
    rows = rows.join(F.broadcast(words), "_word", "left")
    hit = F.expr("coalesce(shiftrightunsigned(_mask, cast(_place % 64 as int)) & 1L = 1L, false)")
    return rows.withColumn(found, hit).drop("_word", "_place", "_mask")

"""A filter of bounded size: which rows of a large table may have a key of a smaller one, before the large one is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediagraph.llm.words import free_name

#: Bits of the map: 8 MB, whatever the number of keys. Past some ten million keys most rows pass, which costs time, never rows.
BITS = 26


def spot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << BITS)) + 1  # Spark's bitmap functions count from 1


def marked(rows: DataFrame, key: str, keys: DataFrame, name: str) -> DataFrame:
    """`rows` with a boolean column `name`: false means that no row of `keys` (one column) has this key, true that one may."""
    at = F.col("__spot")
    maps = (
        keys.select(spot(F.col(keys.columns[0])).alias("__spot"))
        .groupBy(F.bitmap_bucket_number(at).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("__bits"))
    )
    at = spot(F.col(key))
    place = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring("__bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.floor(byte / F.pow(F.lit(2), place % 8)) % 2 == 1
    joined = rows.withColumn("__bucket", F.bitmap_bucket_number(at)).join(F.broadcast(maps), "__bucket", "left")  # at most 2,048 maps of 4 KB
    return joined.withColumn(name, F.coalesce(hit, F.lit(False)) & F.col(key).isNotNull()).drop("__bucket", "__bits")


def split(rows: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`rows` that may have one of the keys, and the rest."""
    name = free_name(rows.columns, "may_be_wanted")
    both = marked(rows, key, keys, name)
    return both.where(F.col(name)).drop(name), both.where(~F.col(name)).drop(name)

"""All pairs of entities in squares, so that no join key is hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILES = 8


def paired(a: DataFrame, b: DataFrame, on: list[str] = (), tiles: int = TILES) -> DataFrame:
    """Rows of ``a`` and ``b`` with a < b that agree on the columns ``on``, met in ``tiles`` by ``tiles`` squares of entities: every row is sent ``tiles`` times
    and no value of ``on``, however frequent, is a single key."""
    every = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(tiles)).cast("int")
    a = a.withColumn("_ta", place("a")).withColumn("_tb", every)
    b = b.withColumn("_tb", place("b")).withColumn("_ta", every)
    return a.join(b, [*on, "_ta", "_tb"]).filter("a < b").drop("_ta", "_tb")

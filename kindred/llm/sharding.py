"""Sharding by vector bin packing.

Every group of equal texts is a vector (bytes, tokens, rows).  Groups too heavy to be lost in a crowd are listed one by
one, all others are summed into a fixed number of hash bundles; both lists have a size that does not
depend on the corpus, so the driver places them, heaviest first, each where the dot product of its
vector with the shard's residual capacity is highest.  Rows then look their shard up in two small
tables whose size has that same bound.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, table, utf8_bytes

DIMENSIONS = ("bytes", "tokens", "rows")


def place(vectors: np.ndarray, n_shards: int, weights: tuple[float, ...]) -> np.ndarray:
    """Shard of each vector.  Vectors are shares of one shard's capacity; ties go to the lower shard."""
    order = np.lexsort((np.arange(len(vectors)), -vectors.max(axis=1)))
    residual = np.ones((n_shards, vectors.shape[1]))
    shard = np.zeros(len(vectors), dtype=np.int64)
    scaled = vectors * np.asarray(weights)
    for i in order:
        s = int(np.argmax(residual @ scaled[i]))
        residual[s] -= vectors[i]
        shard[i] = s
    return shard


def assign_shards(
    docs: DataFrame,
    n_shards: int = 24,
    id_col: str = "doc_id",
    text_col: str = "text",
    bundles_per_shard: int = 512,
    heavy_per_shard: int = 64,
    weights: tuple[float, float, float] = (8.0, 1.0, 1.0),
    rows_per_cell: int = 500_000,
) -> DataFrame:
    """Shard and slot of every row; columns doc_id, size, text_crc32, tokens, law, shard, slot, grown_shard.

    ``size`` is the text's UTF-8 bytes plus 8; ``tokens`` its runs of non-space characters.  The law is
    ``bytes``: shards have nearly equal sums of ``size``.  Equal texts stay together unless the group alone outweighs a
    whole shard: only then it is cut, by row, into quarters of a shard, because no packing could balance it whole.
    Null text: size 8, checksum 0, a group of its own.  Null ids and repeated rows are ordinary rows with
    slots of their own.  An empty table gives no rows.  Other columns are ignored.

    ``bundles_per_shard`` and ``heavy_per_shard`` fix how many vectors the driver sees: at most
    n_shards * (bundles_per_shard + 3 * heavy_per_shard) plus pieces, at any corpus size.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "sharding")
    text = F.col(text_col)
    rows = scratch.table(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (utf8_bytes(text) + 8).alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long").alias("tokens"),
            F.xxhash64(text).alias("grp"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    total = rows.agg(F.sum("size"), F.sum("tokens"), F.count("*")).first()
    capacity = [max(int(x or 0), 1) / n_shards for x in total]
    n_bundles = n_shards * bundles_per_shard

    groups = rows.groupBy("grp").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    share = F.greatest(*(F.col(d) / F.lit(c) for d, c in zip(DIMENSIONS, capacity, strict=True)))
    groups = scratch.table(groups.withColumn("heavy", share >= 1.0 / heavy_per_shard))
    light = groups.filter(~F.col("heavy")).groupBy(F.pmod("grp", F.lit(n_bundles)).cast("int").alias("bundle"))
    light = light.agg(*(F.sum(d).alias(d) for d in DIMENSIONS)).collect()
    heavy = groups.filter("heavy").collect()

    keys, vectors = [], []
    for r in light:
        keys.append((None, r["bundle"], 0, 1))
        vectors.append([r[d] / c for d, c in zip(DIMENSIONS, capacity, strict=True)])
    for r in heavy:
        v = [r[d] / c for d, c in zip(DIMENSIONS, capacity, strict=True)]
        pieces = 1 if max(v) <= 1 else int(np.ceil(4 * max(v)))
        for p in range(pieces):
            keys.append((r["grp"], None, p, pieces))
            vectors.append([x / pieces for x in v])
    shards = place(np.array(vectors).reshape(-1, len(DIMENSIONS)), n_shards, weights).tolist()
    placed = [(*k, s) for k, s in zip(keys, shards, strict=True)]
    of_bundle = spark.createDataFrame([(b, s) for g, b, _, _, s in placed if b is not None], "bundle int, of_bundle int")
    of_heavy = spark.createDataFrame([(g, n) for g, b, p, n, _ in placed if b is None and p == 0], "grp long, pieces int")
    of_piece = spark.createDataFrame([(g, p, s) for g, b, p, _, s in placed if b is None], "grp long, piece int, of_piece int")

    out = rows.withColumn("bundle", F.pmod("grp", F.lit(n_bundles)).cast("int"))
    out = out.join(F.broadcast(of_bundle), "bundle", "left").join(F.broadcast(of_heavy), "grp", "left")
    out = out.withColumn("piece", F.coalesce(F.pmod(F.xxhash64("row"), F.col("pieces").cast("long")).cast("int"), F.lit(0)))
    out = out.join(F.broadcast(of_piece), ["grp", "piece"], "left")
    out = out.withColumn("shard", F.coalesce("of_piece", "of_bundle"))

    # Slots: rows are numbered within small cells of a shard, and a cell starts where the cells before it end.
    n_cells = max(8, -(-int(total[2]) // (n_shards * rows_per_cell)))
    out = out.withColumn("cell", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(n_cells)).cast("int"))
    out = scratch.table(out.select("doc_id", "size", "text_crc32", "tokens", "row", "shard", "cell"))
    scratch.remove(rows, groups)
    ends = out.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "cell").orderBy("doc_id", "row")
    out = out.withColumn("pos", F.row_number().over(inside)).join(starts, ["shard", "cell"])
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        "tokens",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("start") + F.col("pos") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_vector_bin_packing(spark, sf_dir):
    return assign_shards(table(spark, sf_dir, "documents"))


QUERIES = {"op6_vector_bin_packing": op6_vector_bin_packing}

"""Sharding by vector bin packing: bytes, tokens and rows of every shard are balanced jointly.

Equal texts form a group and stay together unless the group is large against a shard; then its rows
are dealt into chunks. Groups are hashed into cells of about a thousand, and each cell packs its groups
into one bin for each shard. The bins of all cells are hashed into cells in turn, and so on, until
``TOP_CELLS`` or fewer are left, whose bins are packed into the shards at once. All packings take items by
falling size and put each where the dot product of its vector with the residual capacity is highest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonelake.llm.common import kept, small_batches, written

#: Items that a cell aims at, and the cells whose bins the driver packs at most.
CELL_GROUPS, TOP_CELLS = 1024, 256
#: Rows of a shard that are numbered at once, about, and the parts that rows alike in all are numbered in.
LANE_ROWS, PARTS = 100_000, 8
#: A group is cut into chunks of at most this part of a shard, as far as ``MAX_CHUNKS`` go.
CHUNK_PART, MAX_CHUNKS = 32, 256
#: Fixed bytes that each row counts besides its text.
ROW_BYTES = 8


def pack(items: np.ndarray, bins: int) -> np.ndarray:
    """The bin of each item (rows: vectors of sizes). Ties go to the bin with most room for bytes, then the first."""
    total = items.sum(axis=0).astype(float)
    scale = np.where(total > 0, total / bins, 1.0)
    vectors = items / scale
    room = np.ones((bins, items.shape[1]))
    order = np.lexsort((np.arange(len(items)), -vectors.sum(axis=1)))
    out = np.zeros(len(items), dtype=np.int64)
    for i in order:
        v = vectors[i]
        b = int(np.argmax(room @ v))
        out[i] = b
        room[b] -= v
    return out


def shard_documents(docs: DataFrame, shards: int = 24, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns ``key``, ``size`` (UTF-8 bytes of the text plus 8), ``tokens``, ``text_crc32``, ``shard``
    and ``slot`` (gapless from 0 within the shard) for each row of ``docs``.

    A null text has no bytes and groups with the empty one. Rows with equal keys, equal or null, are
    rows like any other. An empty table gives an empty result. Other columns take no part.
    """
    spark = docs.sparkSession
    small_batches(spark)
    body = F.coalesce(docs[text], F.lit(""))
    # dealt by place, as keys may repeat or be null
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(MAX_CHUNKS)).cast("int")
    # all that packing needs of a text: the corpus is read once. A written table, so that a row's salt stays what it was
    rows = written(docs.select(
        docs[key].alias("k"),
        (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"),
        F.regexp_count(body, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"),
        F.crc32(body).alias("text_crc32"),
        F.xxhash64(body).alias("g"),
        salt.alias("salt"),
    ), "rows")
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens")]
    total = rows.agg(F.count("*").alias("n"), *sums, F.approx_count_distinct("g", 0.02).alias("groups")).first()
    cells = int(max(1, total["groups"] // CELL_GROUPS))

    # the groups that exceed a chunk: fewer than shards * CHUNK_PART for each measure
    limits = {c: max(1, (total[c] or 0) // (shards * CHUNK_PART)) for c in ("n", "size", "tokens")}
    by_salt = rows.groupBy("g", "salt").agg(F.count("*").alias("n"), *sums)
    ratio = F.greatest(*[F.ceil(F.col(c) / F.lit(v)) for c, v in limits.items()])
    large = (
        by_salt.groupBy("g").agg(F.sum("n").alias("n"), *sums).filter((ratio > 1) & (F.col("n") > 1))
        .select("g", F.least(ratio, F.lit(MAX_CHUNKS)).cast("int").alias("chunks"))
    )
    large = spark.createDataFrame(large.collect(), "g long, chunks int")

    def unit(df: DataFrame) -> DataFrame:
        chunk = F.coalesce(F.pmod("salt", "chunks"), F.lit(0))
        return df.join(F.broadcast(large), "g", "left").withColumn("chunk", chunk).drop("chunks", "salt")

    units = (
        unit(by_salt).groupBy("g", "chunk").agg(F.sum("n").alias("n"), *sums)
        .withColumn("cell", F.pmod(F.xxhash64("g", "chunk", F.lit(2)), F.lit(cells)).cast("int"))
    )

    def filled(items: DataFrame, keys: tuple[str, str], cell: str, bin: str) -> DataFrame:
        """The items of each cell packed into its bins."""

        def fill(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(list(keys), ignore_index=True)
            pdf[bin] = pack(pdf[["size", "tokens", "n"]].to_numpy(), shards)
            return pdf

        fields = ", ".join(f"{c} {t}" for c, t in items.dtypes)
        return items.groupBy(cell).applyInPandas(fill, f"{fields}, {bin} bigint")

    binned = kept(filled(units, ("g", "chunk"), "cell", "bin"))
    bins = binned.groupBy("cell", "bin").agg(F.sum("n").alias("n"), *sums)
    levels = []
    while cells > TOP_CELLS:
        cells = max(1, cells * shards // CELL_GROUPS)
        above = bins.withColumn("up", F.pmod(F.xxhash64("cell", "bin", F.lit(4 + len(levels))), F.lit(cells)).cast("int"))
        levels.append(kept(filled(above, ("cell", "bin"), "up", "up_bin")))
        bins = levels[-1].groupBy(F.col("up").alias("cell"), F.col("up_bin").alias("bin")).agg(F.sum("n").alias("n"), *sums)
    top = bins.orderBy("cell", "bin").toPandas()
    if len(top):
        top["shard"] = pack(top[["size", "tokens", "n"]].to_numpy(), shards)
    places = F.broadcast(spark.createDataFrame(
        [(int(c), int(b), int(s)) for c, b, s in zip(top["cell"], top["bin"], top.get("shard", []), strict=True)], "cell int, bin long, shard int"
    ))
    for level in reversed(levels):
        places = level.select("cell", "bin", "up", "up_bin").join(places.select(F.col("cell").alias("up"), F.col("bin").alias("up_bin"), "shard"), ["up", "up_bin"]).select("cell", "bin", "shard")
    homes = binned.join(places, ["cell", "bin"]).select("g", "chunk", "shard")
    placed = unit(rows).join(homes, ["g", "chunk"])
    return slots(placed, 1 + total["n"] // (shards * LANE_ROWS)).select(F.col("k").alias(key), "size", "tokens", "text_crc32", "shard", "slot")


def slots(placed: DataFrame, lanes: int) -> DataFrame:
    """Gapless numbers within each shard: rows are numbered in lanes of hashed rows, and the lanes'
    counts say where each begins."""
    # a written table serves both the counts and the numbering, so they cannot disagree after a retry
    part = F.pmod(F.monotonically_increasing_id(), F.lit(PARTS))
    lane = F.pmod(F.xxhash64("k", "text_crc32", "size"), F.lit(lanes)) * PARTS + part
    placed = written(placed.select("k", "size", "tokens", "text_crc32", "shard", lane.cast("int").alias("lane")), "placed")
    before = Window.partitionBy("shard").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.groupBy("shard", "lane").agg(F.count("*").alias("n")).select("shard", "lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    order: list[Column] = [F.col(c).asc_nulls_first() for c in ("k", "text_crc32", "size")]
    number = F.row_number().over(Window.partitionBy("shard", "lane").orderBy(*order)) - 1
    return placed.withColumn("number", number).join(first, ["shard", "lane"]).withColumn("slot", F.col("first") + F.col("number"))

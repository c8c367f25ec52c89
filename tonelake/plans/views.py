"""Synthetic stand-ins for coded audio, derived from the driver's tables (they hold no audio)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonelake.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets(spark: SparkSession, sf_dir: str, *, numbered: bool = False) -> DataFrame:
    """stream_id, event_id, payload (16 bytes of a digest), and packet_no if asked for, as it costs a shuffle."""
    events = table(spark, sf_dir, "events")
    rows = events.select(F.col("user_id").alias("stream_id"), "event_id", "ts", F.unhex(F.md5(F.col("event_id").cast("string"))).alias("payload"))
    if numbered:
        rows = rows.withColumn("packet_no", F.row_number().over(Window.partitionBy("stream_id").orderBy("ts", "event_id")).cast("bigint"))
    return rows.drop("ts")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_orderkey").alias("serial"), F.col("l_linenumber").alias("seq"), F.col("l_quantity").cast("bigint").alias("granule"), "l_partkey", "l_suppkey")


def pcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_id"), F.col("embedding").alias("samples"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.array(F.concat(F.lit("LANG="), "lang"), F.concat(F.lit("Source="), "source"), F.concat(F.lit("lang="), "source")).alias("comments"))


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), "ts", "event_id", "value")


class Drawn:
    """Settings for each event, drawn from its number: ``event_id`` counts through all combinations of the given values, the
    first name's fastest. ``sql`` is the same table for DuckDB."""

    def __init__(self, **values: range | list):
        self.values = values
        at = [f"{x} AS {name}" for name, x in self._each("list_extract([{0}], {1} + 1)", "//", {str: "VARCHAR", bool: "BOOLEAN", int: "INTEGER", float: "BIGINT"})]
        self.sql = f"SELECT event_id, {', '.join(at)} FROM events"

    def _each(self, pick: str, div: str, types: dict):
        """Each name with the expression for its value; wide whole numbers go by the type of ``float``."""
        stride = 1
        for name, v in self.values.items():
            at = f"(event_id {div} {stride}) % {len(v)}"
            kind = types[float if isinstance(v[0], int) and max(map(abs, v)) >= 1 << 15 else type(v[0])]
            yield name, f"CAST({f'{v.start} + {v.step} * ({at})' if isinstance(v, range) else pick.format(', '.join(map(repr, v)), at)} AS {kind})"
            stride *= len(v)

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        types = {str: "STRING", bool: "BOOLEAN", int: "INT", float: "BIGINT"}
        at = self._each("element_at(array({0}), CAST({1} + 1 AS INT))", "div", types)
        return table(spark, sf_dir, "events").select("event_id", *[F.expr(x).alias(name) for name, x in at])

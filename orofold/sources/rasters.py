"""Rasters as cell tables (sheet, i, j, z): i grows south, j east, both from 1. Here: rasters derived from business tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """125 columns; z is a price as whole centimetres."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.lit(1).alias("sheet"), (F.floor(k / 125) + 1).alias("i"), (k % 125 + 1).alias("j"), F.rint(F.col("o_totalprice") * 100 / 250).cast("long").alias("z"))


def orders_sheets(spark: SparkSession, sf_dir: str, ny: int) -> DataFrame:
    """orders_raster cut into sheets of ny rows from the north; the last one may have fewer."""
    k = F.col("i") - 1
    return orders_raster(spark, sf_dir).select((F.floor(k / ny) + 1).cast("int").alias("sheet"), (k % ny + 1).alias("i"), "j", "z")


def embedding_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a vector, 64 columns; z in thousandths, rounded."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "v"))
    return v.select(F.lit(1).alias("sheet"), (F.col("vec_id") + 1).alias("i"), (F.col("p") + 1).cast("long").alias("j"), F.rint(F.col("v").cast("double") * 1000).cast("long").alias("z"))


def sparse_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source cells (i, j, z in centimetres) with several candidates for some places; the rest of the columns order them."""
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_partkey") + 1).alias("i"), (F.col("l_suppkey") + 1).alias("j"), F.rint(F.col("l_extendedprice") * 100 / 50).cast("long").alias("z"), F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate", "l_quantity").alias("file_order"))

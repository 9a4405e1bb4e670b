"""Tables as tab-separated text, each value padded to a fixed width, and the pairs written in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 20


def padded(df: DataFrame, width: int = WIDTH) -> DataFrame:
    """All columns as strings of at least width characters."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return df.select(*[F.when(F.length(text(c)) < width, F.rpad(text(c), width, " ")).otherwise(text(c)).alias(c) for c in df.columns])


def write(df: DataFrame, path: str, width: int = WIDTH) -> None:
    """Rows keep their order within and between part files; the header is padded as well."""
    out = padded(df, width)
    out.toDF(*[c.ljust(width) for c in out.columns]).write.mode("overwrite").csv(path, sep="\t", header=True, quote="", ignoreTrailingWhiteSpace=False, ignoreLeadingWhiteSpace=False)


def read(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Strings without padding; an error if the header isn't as expected."""
    raw = spark.read.csv(path, sep="\t", header=True, quote="")
    names = [c.strip() for c in raw.columns]
    if names != columns:
        raise ValueError(f"header {names}, expected {columns}")
    return raw.toDF(*names).select(*[F.trim(c).alias(c) for c in names])


def pair(text: Column) -> Column:
    """Struct (a, b) of text like "(12, -3)"; null parts where it isn't one."""
    part = lambda k: F.regexp_extract(text, r"^\s*\(\s*(-?\d+)\s*,\s*(-?\d+)\s*\)\s*$", k).try_cast("long")
    return F.struct(part(1).alias("a"), part(2).alias("b"))

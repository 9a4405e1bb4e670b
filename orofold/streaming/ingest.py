"""Summit graphs that grow as sheets arrive: vertices, edges and the boxes they lie in, merged by batches into tables of a folder a batch.

A sheet may come in any number of files and batches. Of rows that come again (a vertex of its sheet, an edge) the first batch's stay;
a batch that is delivered again overwrites its own folder, so that each row is there exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERTICES = "sheet long, id long, e long, n long, z double"
EDGES = "sheet long, a long, b long"
BOXES = "sheet long, vertices long, min_x long, min_y long, max_x long, max_y long"
SCHEMAS = {"vertices": VERTICES, "edges": EDGES, "boxes": BOXES}
#: What tells rows of a table apart.
KEYS = {"vertices": ["sheet", "id"], "edges": ["sheet", "a", "b"]}


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def merge_batch(batch: DataFrame, number: int, target: str, kind: str = "vertices") -> None:
    """Adds the rows of a batch that no other batch has brought; a batch that comes again changes nothing."""
    spark = batch.sparkSession
    there = _table(spark, f"{target}/{kind}", SCHEMAS[kind] + ", batch long").where(F.col("batch") != number)
    # Only the sheets at hand are looked up in what is there.
    there = there.join(batch.select("sheet").distinct(), "sheet", "left_semi").select(*KEYS[kind])
    new = batch.dropDuplicates(KEYS[kind]).join(there, KEYS[kind], "left_anti")
    new.write.mode("overwrite").parquet(f"{target}/{kind}/batch={number}")
    if kind == "vertices":
        added = _table(spark, f"{target}/vertices/batch={number}", VERTICES).groupBy("sheet")
        box = [f(k).alias(f"{name}_{axis}") for name, f in (("min", F.min), ("max", F.max)) for axis, k in (("x", "e"), ("y", "n"))]
        added.agg(F.count("*").alias("vertices"), *box).write.mode("overwrite").parquet(f"{target}/boxes/batch={number}")


def start(spark: SparkSession, source: str, target: str, checkpoint: str, kind: str = "vertices", files: int = 64):
    """A running query that merges files of vertices or edges as they appear in source, so many files a batch at most."""
    stream = spark.readStream.schema(SCHEMAS[kind]).option("maxFilesPerTrigger", files).parquet(source)
    return stream.writeStream.foreachBatch(lambda df, n: merge_batch(df, n, target, kind)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def vertices(spark: SparkSession, target: str) -> DataFrame:
    return _table(spark, f"{target}/vertices", VERTICES).select("sheet", "id", "e", "n", "z")


def edges(spark: SparkSession, target: str) -> DataFrame:
    return _table(spark, f"{target}/edges", EDGES).select("sheet", "a", "b")


def boxes(spark: SparkSession, target: str) -> DataFrame:
    """sheet, vertices, box of each sheet that has come, whole or in part."""
    out = _table(spark, f"{target}/boxes", BOXES).groupBy("sheet").agg(F.sum("vertices").alias("vertices"), F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"))
    return out


def merged_box(spark: SparkSession, target: str) -> DataFrame:
    """The box of all sheets."""
    return boxes(spark, target).agg(F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"))

"""Exact deduplication by deterministic block naming, with DataFrame functions alone.

Each text is cut into blocks of a fixed number of bytes. Distinct blocks are sorted by hash and then by content, and a block's
name is its place in that order, so the same table gives the same names however it is split. Then adjacent pairs of names are
sorted and named again, level by level, until each text has one name. Two texts of the same level have the same
name exactly if all their bytes are equal.

Defined results: null text counts as empty; a null doc_id is a document like any other, and stays only where its copies
all lack an id; rows that repeat a doc_id are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import rows_of, tidied, written

BLOCK = 16_384
#: Blocks are cut out of pieces of so many blocks, so that very long texts aren't copied once a block.
SUPER = 64
#: Leading bits of a hash by which sorting is dealt out.
BITS = 12


def _cut(data: Column, size: int) -> Column:
    n = F.greatest(F.lit(1), F.ceil(F.length(data) / F.lit(size)).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(data, i * size + 1, F.lit(size)))


def blocks_of(text: Column, size: int) -> Column:
    """The text's UTF-8 in blocks of size bytes; one empty block for an empty text."""
    data = F.coalesce(text, F.lit("")).cast("binary")
    few = _cut(data, size)
    many = F.flatten(F.transform(_cut(data, size * SUPER), lambda piece: _cut(piece, size)))
    return F.when(F.length(data) <= size * SUPER, few).otherwise(many)


def _named(keys: DataFrame, order: list[str], tag: str) -> DataFrame:
    """Rows that are distinct already, with name: their place in order, whose first column is a hash.

    Hashes of the same leading bits are sorted together; what goes before them is counted in a table of a row each."""
    over = Window.partitionBy("part").orderBy(*order)
    ranked = written(keys.withColumn("part", F.shiftrightunsigned(order[0], 64 - BITS).cast("int")).withColumn("place", F.row_number().over(over)), tag)
    sizes = ranked.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = written(sizes.select("part", before.alias("before")), tag + "-starts", 1 << BITS)
    return ranked.join(F.broadcast(starts), "part").withColumn("name", F.col("before") + F.col("place") - 1).drop("part", "place", "before")


def identities(docs: DataFrame, block: int = BLOCK, content_hash=F.xxhash64) -> DataFrame:
    """rid, doc_id, text_sha256, level, name: (level, name) is the collision-free identity of the text."""
    docs = rows_of(docs, "doc_id", "text")
    cut = docs.select(
        "rid", "doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"), blocks_of(F.col("text"), block).alias("blocks")
    )
    with tidied() as keep:
        # Level 0: each content gets a name. Contents travel once; copies are merged before they travel.
        contents = docs.select(F.explode(blocks_of(F.col("text"), block)).alias("block")).select(content_hash("block").alias("h"), "block")
        sets = contents.groupBy("h").agg(F.array_sort(F.collect_set("block")).alias("contents"))
        told = sets.select("h", F.size("contents").alias("n"), F.posexplode("contents").alias("k", "block"))
        names = _named(told.select("h", "n", "k", F.when(F.col("n") > 1, F.col("block")).alias("block")), ["h", "k"], "names-0")
        rows = cut.select("rid", "doc_id", "text_sha256", F.size("blocks").alias("blocks_n"), F.posexplode("blocks").alias("pos", "block")).withColumn("h", content_hash("block"))
        found = rows.drop("block").join(names.where("n = 1").select("h", "name"), "h")
        if not names.where("n > 1").isEmpty():  # different blocks of one hash: told apart by their bytes
            clash = names.where("n > 1").select("h", F.col("block").alias("other"), "name")
            found = found.unionByName(rows.join(clash, (rows.h == clash.h) & (rows.block == clash.other)).select(*[rows[c] for c in ("h", "rid", "doc_id", "text_sha256", "blocks_n", "pos")], "name"))
        found = keep(written(found.select("rid", "doc_id", "text_sha256", "blocks_n", "pos", "name"), "blocks-0"))
    done = found.where("blocks_n = 1").select("rid", "doc_id", "text_sha256", F.lit(0).alias("level"), "name")
    rest = (
        found.where("blocks_n > 1")
        .groupBy("rid")
        .agg(F.first("doc_id").alias("doc_id"), F.first("text_sha256").alias("text_sha256"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("names"))
    )
    level = 0
    rest = written(rest, "texts-0")
    while not rest.isEmpty():
        level += 1
        pairs = rest.select("rid", F.expr("posexplode(transform(sequence(0, cast((size(names) - 1) div 2 as int)), i -> struct(names[i * 2] as l, try_element_at(names, i * 2 + 2) as r)))").alias("pos", "pair")).select("rid", "pos", "pair.l", F.coalesce("pair.r", F.lit(-1)).alias("r"))
        with tidied() as keep:
            names = _named(pairs.select(F.xxhash64("l", "r").alias("h"), "l", "r").distinct(), ["h", "l", "r"], f"names-{level}").drop("h")
            up = pairs.join(names, ["l", "r"]).groupBy("rid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("names"))
            rest = keep(written(rest.drop("names").join(up, "rid"), f"texts-{level}"))
        done = done.unionByName(rest.where("size(names) = 1").select("rid", "doc_id", "text_sha256", F.lit(level).alias("level"), F.col("names")[0].alias("name")))
        rest = rest.where("size(names) > 1")
    return done


def exact_dedup(docs: DataFrame, block: int = BLOCK, content_hash=F.xxhash64) -> DataFrame:
    """rid, doc_id, keep_id, group_size, kept, text_sha256 for each row: of equal texts, the row with the largest doc_id stays."""
    ids = identities(docs, block, content_hash)
    groups = written(ids.groupBy("level", "name").agg(F.max(F.struct(F.col("doc_id"), F.col("rid"))).alias("keep"), F.count("*").alias("group_size")), "groups")
    return ids.join(groups, ["level", "name"]).select("rid", "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("keep.rid")).alias("kept"), "text_sha256")


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("rid")


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

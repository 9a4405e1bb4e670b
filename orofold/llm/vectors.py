"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors are turned by a fixed rotation and split into blocks of BLOCK dimensions. Two vectors of cosine c are
sqrt(2 - 2c) apart, so in one block at least their squared distance is within the block's share of 2 - 2c. Each block is
range-joined under that share, and the union of all blocks' pairs is verified on the whole vectors in double precision. Coordinates are
rounded to integers, with the rounding's error added to each share, so that no pair is lost.

How vectors meet depends on how many have their label and length. Up to SMALL of them meet in squares of CAP by CAP, each
pair in one square, where all blocks are joined at once. More are put on a grid of each block's first dimensions, the more of them the more
vectors there are, with cells as wide as a block's reach: a vector is stored in its own cell and asks in the cells that its ball touches.
A pair that meets in several blocks counts in the first of them alone, which a square tells from the vectors themselves; so no pair
is written or made distinct. A square gives a row a vector: how many it links with there, and the least of those it reaches there.

Vectors that are equal, component by component, are one class; pairs are found between classes, and members of a class link with
one another.

Defined results: vectors that are null, zero or hold a null or non-finite component, and rows with a null label, link with
nothing (component_id is their own vec_id, kept); lengths that differ never link; repeated rows and rows that share a
vec_id have a row each and link as different vectors do; a null vec_id links with nothing and has no component; an
empty table gives an empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of, tidied, written
from .components import components

BLOCK = 8
SCALE = 1 << 14
CAP = 4096
#: Vectors of a label and length that meet without a grid; each further dimension of it serves GROWTH times as many.
SMALL, GROWTH = 1 << 18, 4
#: So many rows of a table of numbers (16 MB) are broadcast at most.
ROWS = 500_000
#: Pairs that are verified at once.
PAIRS = 1 << 16
KEY = ["label", "dim", "block", "cell"]


def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(64_000 + d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def share(least: float, d: int, size: int) -> float:
    """The most squared distance, in rounded units, within a block of size out of d dimensions for a cosine of least."""
    return (np.sqrt((2 - 2 * least) * size / d + 1e-12) * SCALE + np.sqrt(size) + 1) ** 2


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors whose largest component is 1, so that no square overflows."""
    return x / np.abs(x).max(1, keepdims=True)


def turned(x: np.ndarray) -> np.ndarray:
    """Rounded coordinates of scaled vectors, rotated and of length 1."""
    return np.rint(x / np.linalg.norm(x, axis=1, keepdims=True) @ rotation(x.shape[1]) * SCALE)


def _matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _cells(least: float):
    """Rows label, dim, block, cell, asks, id, n, vector on the grid of each block's first `fine` dimensions."""

    def run(batches):
        for batch in batches:
            label, dim, fine, vectors = (batch.column(k) for k in ("label", "dim", "fine", "vector"))
            kinds = np.column_stack([dim.to_numpy(), fine.to_numpy()])
            for d, g in np.unique(kinds, axis=0).tolist():
                rows = np.flatnonzero((kinds == (d, g)).all(1))
                q = turned(scaled(_matrix(vectors.take(pa.array(rows)), d)))
                for b, lo in enumerate(range(0, d, BLOCK)):
                    part = q[:, lo : lo + BLOCK]
                    reach = np.sqrt(share(least, d, part.shape[1]))
                    width = int(reach) + 1
                    front = part[:, :g]
                    own = np.floor_divide(front, width)
                    for step in itertools.product((-1, 0, 1), repeat=front.shape[1]):
                        # How far the cell one step on lies, squared, over all dimensions.
                        gap = np.where(np.array(step) < 0, front - own * width, np.where(np.array(step) > 0, (own + 1) * width - front, 0))
                        at = np.flatnonzero((gap * gap).sum(1) <= reach * reach)
                        if not len(at):
                            continue
                        key = np.zeros(len(at), np.int64)
                        for j in range(front.shape[1]):
                            key = key * 1_000_003 + (own[at, j] + step[j]).astype(np.int64)
                        from_ = pa.array(rows[at])
                        for asks in (False, True) if not any(step) else (True,):
                            yield pa.record_batch([label.take(from_), dim.take(from_), pa.array(np.full(len(at), b), pa.int32()), pa.array(key), pa.array(np.full(len(at), asks)), *[batch.column(k).take(from_) for k in ("id", "n", "vector")]], names=[*KEY, "asks", "id", "n", "vector"])

    return run


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """root, the least row that each row reaches, with the links a to b."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (up := root[root]).tolist() != root.tolist():
            root = up


def _square(least: float):
    """Of a square's links: id, links (members of the classes that it links with here), root (an id that it reaches here)."""

    def run(key, rows):
        d, block = key[1].as_py(), key[2].as_py()
        # By id: of a pair that could count twice, the lesser is stored and the greater asks.
        rows = rows.sort_by("id")
        ids, n, role = rows.column("id").to_numpy(), rows.column("n").to_numpy(), rows.column("role").to_numpy()
        x = scaled(_matrix(rows.column("vector"), d))
        q, length = turned(x), np.sqrt((x * x).sum(1))
        stored, asking = np.flatnonzero(role != 1), np.flatnonzero(role != 0)
        both = block >= 0 or bool((role == 2).any())
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        starts = range(0, d if block < 0 else min(d, (block + 1) * BLOCK), BLOCK)
        right = []
        for lo in starts:
            part = q[asking, lo : lo + BLOCK]
            right.append(np.vstack([-2 * part.T, np.ones(len(part)), (part * part).sum(1) - np.floor(share(least, d, part.shape[1]))]))
        for first in range(0, len(stored), 512):
            own = stored[first : first + 512]
            near = []
            for lo, other in zip(starts, right, strict=True):
                # Whole numbers below 2^53, so the product is exact: squared distance less the share.
                part = q[own, lo : lo + BLOCK]
                near.append(np.column_stack([part, (part * part).sum(1), np.ones(len(part))]) @ other <= 0)
            hit = np.logical_or.reduce(near) if block < 0 else near[-1]
            if block > 0:
                hit &= ~np.logical_or.reduce(near[:-1])
            if both:
                hit &= ids[own][:, None] < ids[asking][None]
            i, j = np.nonzero(hit)
            i, j = own[i], asking[j]
            for lo in range(0, len(i), PAIRS):
                a, b = i[lo : lo + PAIRS], j[lo : lo + PAIRS]
                good = (x[a] * x[b]).sum(1) / (length[a] * length[b]) >= least
                a, b = a[good], b[good]
                np.add.at(links, a, n[b])
                np.add.at(links, b, n[a])
                root = _joined(root, a, b)
        got = np.flatnonzero(links)
        return pa.table({"id": pa.array(ids[got], pa.int64()), "links": pa.array(links[got], pa.int64()), "root": pa.array(ids[root[got]], pa.int64())})

    return run


def links_of(classes: DataFrame, least: float, cap: int = CAP, small: int = SMALL) -> DataFrame:
    """id, links, root of classes (id, label, vector, n: how many members), a row for each square that a class has links in."""
    sizes = written(classes.groupBy("label", F.size("vector").alias("dim")).agg(F.count("*").alias("all")), "sizes")
    fine = F.greatest(F.lit(0), F.ceil(F.log(F.col("all") / small) / float(np.log(GROWTH)))).cast("int")
    sizes = sizes.select("label", "dim", "all", F.least(fine, F.col("dim"), F.lit(BLOCK)).alias("fine"))
    known = classes.withColumn("dim", F.size("vector")).join(F.broadcast(sizes) if sizes.count() <= ROWS else sizes.hint("merge"), ["label", "dim"])
    # Without a grid: of the squares (s, q) with s <= q a vector of part m is in (m, q) and (s, m).
    side = F.ceil(F.col("all") / cap).cast("int")
    flat = known.where("fine = 0").withColumns({"side": side, "block": F.lit(-1), "cell": F.lit(0).cast("long")}).withColumn("mine", F.pmod(F.xxhash64("id"), "side").cast("int"))
    at = F.expr("transform(sequence(0, side - 1), i -> struct(least(i, mine) as s, greatest(i, mine) as q, if(i = mine, 2, if(mine < i, 0, 1)) as role))")
    flat = flat.withColumn("at", F.explode(at)).select(*KEY, "at.s", "at.q", "at.role", "id", "n", "vector")
    kind = dict(classes.dtypes)["vector"]
    rows = written(known.where("fine > 0").mapInArrow(_cells(least), f"label long, dim int, block int, cell long, asks boolean, id long, n long, vector {kind}"), "cells")
    full = rows.groupBy(*KEY).agg(F.count(F.when(~F.col("asks"), 1)).alias("stored"), F.count(F.when(F.col("asks"), 1)).alias("asking")).where("stored > 0 and asking > 0")
    full = written(full.select(*KEY, F.ceil(F.col("stored") / cap).cast("int").alias("down"), F.ceil(F.col("asking") / cap).cast("int").alias("across")), "full")
    dealt = rows.join(F.broadcast(full) if full.count() <= ROWS else full.hint("merge"), KEY)
    mine = F.pmod(F.xxhash64("id"), F.when(F.col("asks"), F.col("across")).otherwise(F.col("down"))).cast("int")
    at = F.when(F.col("asks"), F.expr("transform(sequence(0, down - 1), i -> struct(i as s, mine as q, 1 as role))")).otherwise(F.expr("transform(sequence(0, across - 1), i -> struct(mine as s, i as q, 0 as role))"))
    dealt = dealt.withColumn("mine", mine).withColumn("at", F.explode(at)).select(*KEY, "at.s", "at.q", "at.role", "id", "n", "vector")
    return written(flat.unionByName(dealt).groupBy(*KEY, "s", "q").applyInArrow(_square(least), "id long, links long, root long"), "links")


def embedding_dedup(vectors: DataFrame, least: float = 0.93, cap: int = CAP, small: int = SMALL) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding, label)."""
    rows = rows_of(vectors, "vec_id", "embedding", "label")
    # Components as wide as the table's own: a float is the same number as a double.
    kind = "array<float>" if dict(rows.dtypes)["embedding"] == "array<float>" else "array<double>"
    v = F.col("embedding").cast(kind)
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    zero = F.lit(0).cast(kind[6:-1])
    rows = rows.withColumn("set", F.when(F.coalesce(sound, F.lit(False)), F.struct(F.col("label").cast("long").alias("label"), F.transform(v, lambda x: x + zero).alias("vector"))))
    with tidied() as keep:
        known = keep(_known(rows, least, cap, small))
    out = rows.select("vec_id", "set").join(known, "set", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _known(rows: DataFrame, least: float, cap: int, small: int) -> DataFrame:
    """set, n_links, component_id of each class of rows (rid, vec_id, set)."""
    classes = rows.where("set is not null").groupBy("set").agg(F.min(F.struct("vec_id", "rid")).alias("first"), F.count("*").alias("n"))
    classes = written(classes.select(F.col("first.rid").alias("id"), F.col("set.label").alias("label"), F.col("set.vector").alias("vector"), "n", F.col("first.vec_id").alias("least")), "classes")
    found = links_of(classes.select("id", "label", "vector", "n"), least, cap, small)
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    comps = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    rooted = classes.join(counts, "id", "left").join(comps.toDF("id", "root"), "id", "left")
    rooted = written(rooted.select("id", "n", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "id").alias("root")), "rooted")
    roots = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "roots")
    told = written(rooted.join(roots, "root").select("id", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id"), "told")
    return written(told.join(classes.select("id", F.struct("label", "vector").alias("set")), "id").select("set", "n_links", "component_id"), "known")


def op10_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs of a label, and components by walking.
ORACLE = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0
), l AS MATERIALIZED (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND len(x.e) = len(y.e) AND x.vec_id <> y.vec_id
  WHERE list_dot_product(x.e, y.e) / (sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e))) >= 0.93
), walk AS (SELECT vec_id AS id, vec_id AS seen FROM embeddings UNION SELECT walk.id, l.b FROM walk JOIN l ON l.a = walk.seen),
c AS (SELECT id, min(seen) AS component_id FROM walk GROUP BY id), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON c.id = vec_id LEFT JOIN n ON n.a = vec_id
"""

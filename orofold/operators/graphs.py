"""Iterative operations over edge tables. Every round ends in a table in the folder that all machines share (spark.checkpoint.dir),
so lineage stays short and a lost executor costs a round at most."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Rounds after which what they found is written as one table, so that plans stay short.
FOLD = 8


def kept(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder."""
    spark: SparkSession = df.sparkSession
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if top is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        top = "file://" + tempfile.mkdtemp(prefix="orofold-")
        spark.conf.set("spark.checkpoint.dir", top)
    at = f"{top.rstrip('/')}/graph-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, label: the least id that each node (id) reaches over edges (a, b), by min-label exchange with pointer jumping."""
    both = kept(edges.select("a", "b").union(edges.select("b", "a")))
    labels = kept(nodes.select("id", F.col("id").alias("label")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        hop = labels.join(near, labels.id == near.a, "left").select("id", "label", F.least("label", F.coalesce("near", "label")).alias("next"))
        jump = hop.select(F.col("id").alias("next"), F.col("next").alias("far"))
        new = kept(hop.join(jump, "next", "left").select("id", "label", F.least("next", F.coalesce("far", "next")).alias("next")))
        changed = new.where("next <> label").limit(1).count()
        labels = new.select("id", F.col("next").alias("label"))
        if not changed:
            return labels


def cell_edges(marked: DataFrame) -> DataFrame:
    """a, b of 4-neighbours among marked cells (sheet, i, j, id)."""
    right = marked.select("sheet", "i", (F.col("j") - 1).alias("j"), F.col("id").alias("b"))
    down = marked.select("sheet", (F.col("i") - 1).alias("i"), "j", F.col("id").alias("b"))
    own = marked.select("sheet", "i", "j", F.col("id").alias("a"))
    return own.join(right, ["sheet", "i", "j"]).select("a", "b").union(own.join(down, ["sheet", "i", "j"]).select("a", "b"))


def closure(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct id reachable from seeds (id) over edges (a to b), seeds included: a frontier without what was seen."""
    seen = frontier = kept(seeds.select("id").distinct())
    rounds = 0
    while not frontier.isEmpty():
        frontier = kept(frontier.join(edges, frontier.id == edges.a).select(F.col("b").alias("id")).distinct().join(seen, "id", "left_anti"))
        seen = seen.union(frontier)
        rounds += 1
        if rounds % FOLD == 0:
            seen = kept(seen)
    return seen


def lineage(seeds: DataFrame, tree: DataFrame) -> DataFrame:
    """Distinct id on the way from seeds to the roots and leaves of a tree (id, parent)."""
    up = tree.where("id <> parent").select(F.col("id").alias("a"), F.col("parent").alias("b"))
    return closure(seeds, up).union(closure(seeds, up.select(F.col("b").alias("a"), F.col("a").alias("b")))).distinct()


def leaves(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices (id) without an edge upwards. Edges go from lower (a) to higher (b)."""
    return vertices.join(edges.select(F.col("a").alias("id")), "id", "left_anti")


def roots(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    return vertices.join(edges.select(F.col("b").alias("id")), "id", "left_anti")


def without_isolated(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    return vertices.join(edges.select(F.col("a").alias("id")).union(edges.select("b")), "id", "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    """id, n_in, n_out."""
    ends = edges.select(F.col("a").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select("b", F.lit(1), F.lit(0)))
    return ends.groupBy("id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def chain_reduce(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without its vertices of one edge in and one out, unless those or a neighbour are on the border (vertices: id, border).

    Chains shrink by doubling: each round a chain's vertex points past the next one."""
    d = degrees(edges).where("n_in = 1 and n_out = 1").select("id")
    border = vertices.where("border").select("id")
    near = edges.join(border, edges.a == border.id).select(F.col("b").alias("id")).union(edges.join(border, edges.b == border.id).select("a"))
    inner = kept(d.join(border, "id", "left_anti").join(near, "id", "left_anti"))
    to = kept(edges.join(inner, edges.a == inner.id).select(F.col("a").alias("id"), F.col("b").alias("to")))
    while True:  # pointer jumping along chains
        past = to.select(F.col("id").alias("to"), F.col("to").alias("past"))
        new = kept(to.join(past, "to", "left").select("id", F.col("to").alias("was"), F.coalesce("past", "to").alias("to")))
        more = new.where("was <> to").limit(1).count()
        to = new.select("id", "to")
        if not more:
            break
    rest = edges.join(inner, edges.a == inner.id, "left_anti")
    drawn = rest.join(to, rest.b == to.id, "left").select("a", F.coalesce("to", "b").alias("b")).distinct()
    return vertices.join(inner, "id", "left_anti"), drawn


def is_acyclic(edges: DataFrame) -> bool:
    """Whether peeling vertices without edges in leaves nothing."""
    rest = kept(edges.select("a", "b").distinct())
    while True:
        n = rest.count()
        if not n:
            return True
        peeled = kept(rest.join(rest.select(F.col("b").alias("a")).distinct(), "a", "left_semi"))
        if peeled.count() == n:
            return False
        rest = peeled


def reach_extreme(vertices: DataFrame, edges: DataFrame, best: str = "max") -> DataFrame:
    """id, top: the highest (or lowest) z among a vertex (id, z) and all above it, by peeling leaves upwards down the DAG."""
    pick = F.max if best == "max" else F.min
    most = F.greatest if best == "max" else F.least
    state = kept(vertices.select("id", F.col("z").alias("top")))
    while True:
        above = edges.join(state, edges.b == state.id).groupBy("a").agg(pick("top").alias("above"))
        new = kept(state.join(above, state.id == above.a, "left").select("id", "top", most("top", F.coalesce("above", "top")).alias("next")))
        changed = new.where("next <> top").limit(1).count()
        state = new.select("id", F.col("next").alias("top"))
        if not changed:
            return state


def prominence(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, z, prominence, saddle of each leaf: z over the highest vertex below from which higher ground is reached; z itself, and
    no saddle, for a highest leaf.

    Leaves walk down together; one stops at the first vertex with a higher top (in a tree the highest), and where a
    vertex has several below it (after merging sheets) it walks all ways."""
    tops = kept(vertices.select("id", "z").join(reach_extreme(vertices, edges), "id"))
    walk = kept(leaves(vertices, edges).select(F.col("id").alias("leaf"), F.col("z").alias("leaf_z"), F.col("id").alias("at")))
    down = edges.select(F.col("b").alias("at"), F.col("a").alias("below"))
    found = None
    frontier, rounds = walk, 0
    while not frontier.isEmpty():
        rounds += 1
        if found is not None and rounds % FOLD == 0:
            found = kept(found.groupBy("leaf").agg(F.max("hit").alias("hit")))
        stepped = frontier.join(down, "at").select("leaf", "leaf_z", F.col("below").alias("at")).distinct()
        told = kept(stepped.join(tops.toDF("at", "z", "top"), "at"))
        hits = told.where("top > leaf_z").groupBy("leaf").agg(F.max_by(F.struct("z", "at"), "z").alias("hit"))
        found = hits if found is None else found.union(hits)
        frontier = kept(told.where("top <= leaf_z").select("leaf", "leaf_z", "at"))
    none = "struct<z:double,at:bigint>"
    if found is None:
        found = walk.select("leaf", F.lit(None).cast(none).alias("hit")).where("false")
    best = found.groupBy("leaf").agg(F.max("hit").alias("hit"))
    out = walk.join(best, "leaf", "left")
    return out.select(F.col("leaf").alias("id"), F.col("leaf_z").alias("z"), F.coalesce(F.col("leaf_z") - F.col("hit.z"), F.col("leaf_z")).alias("prominence"), F.col("hit.at").alias("saddle"))


def prune_low(vertices: DataFrame, edges: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """The graph without leaves of less prominence than least and what leads to them alone; border vertices stay (vertices: id, z, border)."""
    low = prominence(vertices, edges).where(F.col("prominence") < least).select("id")
    gone = kept(low.join(vertices.where("border").select("id"), "id", "left_anti"))
    all_gone = gone
    stays = vertices.where("border").select("id").union(roots(vertices, edges).select("id"))
    while not gone.isEmpty():
        rest = edges.join(all_gone, edges.b == all_gone.id, "left_anti")
        cut = edges.join(gone, edges.b == gone.id).select(F.col("a").alias("id")).distinct()
        gone = kept(cut.join(rest.select(F.col("a").alias("id")), "id", "left_anti").join(stays, "id", "left_anti").join(all_gone, "id", "left_anti"))
        all_gone = kept(all_gone.union(gone))
    left = edges.join(all_gone, edges.b == all_gone.id, "left_anti")
    return vertices.join(all_gone, "id", "left_anti"), left.join(all_gone, left.a == all_gone.id, "left_anti")


def reduce_and_prune(vertices: DataFrame, edges: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Chains contracted and low leaves pruned until the number of vertices stays."""
    n = -1
    while True:
        vertices, edges = chain_reduce(vertices, edges)
        vertices, edges = (kept(x) for x in prune_low(vertices, edges, least))
        now = vertices.count()
        if now == n:
            return vertices, edges
        n = now


# -- merging sheets


def border_pairs(vertices: DataFrame, c: int) -> DataFrame:
    """a, b, za, zb: vertices (id, sheet, e, n, z) of different sheets that lie c apart, west or south one first."""
    steps = F.array(F.struct(F.lit(c).alias("de"), F.lit(0).alias("dn")), F.struct(F.lit(0).alias("de"), F.lit(c).alias("dn")))
    v = vertices.select("id", "sheet", "e", "n", "z")
    asked = v.withColumn("step", F.explode(steps)).select(F.col("id").alias("a"), F.col("sheet").alias("sa"), F.col("z").alias("za"), (F.col("e") + F.col("step.de")).alias("e"), (F.col("n") + F.col("step.dn")).alias("n"))
    other = v.select(F.col("id").alias("b"), F.col("sheet").alias("sb"), F.col("z").alias("zb"), "e", "n")
    return asked.join(other, ["e", "n"]).where("sa <> sb").select("a", "b", "za", "zb")


def oriented(pairs: DataFrame, high: DataFrame, low: DataFrame) -> DataFrame:
    """src, dst of pairs (a, b, za, zb): the higher rounded z is the destination; of equals the one with higher ground above (high:
    id, top); then the one whose ground above is less low (low: id, top); full ties give no edge."""
    t = pairs.join(high.toDF("a", "ha"), "a").join(high.toDF("b", "hb"), "b").join(low.toDF("a", "la"), "a").join(low.toDF("b", "lb"), "b")
    ra, rb = F.rint("za"), F.rint("zb")
    up = F.when(ra < rb, 1).when(ra > rb, -1).when(F.col("ha") < F.col("hb"), 1).when(F.col("ha") > F.col("hb"), -1).when(F.col("la") < F.col("lb"), 1).when(F.col("la") > F.col("lb"), -1)
    told = t.withColumn("up", up).where("up is not null")
    return told.select(F.when(F.col("up") == 1, F.col("a")).otherwise(F.col("b")).alias("src"), F.when(F.col("up") == 1, F.col("b")).otherwise(F.col("a")).alias("dst"))


def proxies(oriented_pairs: DataFrame, vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """a, b: oriented pairs, a destination that is a leaf with one parent of its own rounded height replaced by that parent."""
    z = vertices.select("id", F.rint("z").alias("r"))
    single = edges.groupBy("b").agg(F.count("*").alias("n"), F.min("a").alias("parent")).where("n = 1")
    same = leaves(vertices.select("id"), edges).join(z, "id").join(single, F.col("id") == F.col("b")).join(z.toDF("parent", "pr"), "parent").where("r = pr").select(F.col("id").alias("dst"), "parent")
    return oriented_pairs.join(same, "dst", "left").select(F.col("src").alias("a"), F.coalesce("parent", "dst").alias("b")).where("a <> b").distinct()


def merge_sheets(vertices: DataFrame, edges: DataFrame, c: int) -> tuple[DataFrame, DataFrame]:
    """Several sheets' graphs as one, with edges between them, without branches that end at a sheet's border and without vertices of no
    edge; an error if a loop arises."""
    pairs = kept(border_pairs(vertices, c))
    high, low = reach_extreme(vertices, edges, "max"), reach_extreme(vertices, edges, "min")
    all_edges = kept(edges.select("a", "b").union(proxies(oriented(pairs, high, low), vertices, edges)).distinct())
    joined = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    left = kept(without_ends(vertices.select("id"), all_edges, joined))
    out = kept(all_edges.join(left.toDF("a"), "a", "left_semi").join(left.toDF("b"), "b", "left_semi").select("a", "b"))
    if not is_acyclic(out):
        raise ValueError("merging made a loop")
    return kept(without_isolated(vertices, out)), out


def without_ends(vertices: DataFrame, edges: DataFrame, ends: DataFrame) -> DataFrame:
    """id of what is left when branches go that end at a vertex among ends (id) which one edge leads to, down to a fork or a root: all
    roots and other leaves, and what leads to these."""
    tops = leaves(vertices, edges).select("id")
    gone = tops.join(ends, "id", "left_semi").join(degrees(edges).where("n_in = 1").select("id"), "id", "left_semi")
    stays = tops.join(gone, "id", "left_anti").union(roots(vertices, edges).select("id"))
    return closure(stays, edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def ranked(df: DataFrame, key: str, by: list) -> DataFrame:
    """df with rank: its order by columns within a key."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*by)))

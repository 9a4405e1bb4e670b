"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A sketch has T coordinates. In round i < T every element of a set is hashed to one of T bins and stays where it is
the least of its round; in round T + i all elements go to bin i. Rounds end when no bin is empty, so that every
coordinate fills, however small the set, and the share of equal coordinates concentrates about the Jaccard similarity as
with independent samples. BANDS bands of ROWS coordinates propose pairs; the whole sketch drops a pair
only where fewer than LEAST of its coordinates agree; the full sets decide.

At similarity 0.8 a pair meets in no band with probability (1 - 0.8^6)^42 = 3e-6, and agrees in fewer than
0.65 T coordinates with probability below 2e-7.

Sets that are equal are one class; pairs are tried between classes. In a bucket all members are tried with its least
one; then what is left in different components is compared in squares of bounded size, sketches first and
full sets where these agree. No pair of one component is tried, and no pairs are written but links.

Defined results: null and empty texts (and those of white space alone) have no shingles and link with nothing;
repeated rows and rows that share a doc_id have a row each, and the component of their own text; a
row without doc_id links with nothing, has no component and stays; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, rows_of, shingle_set, tidied, word_hashes, written
from .components import components

T = 256
ROWS = 6
BANDS = T // ROWS
LEAST = 0.65
#: Rows by rows of a bucket that a task compares at most.
CAP = 2048
#: And so many bytes of their texts, where these travel.
TEXTS = 32 << 20
#: So many ids (16 MB) are broadcast at most.
IDS = 1_000_000
_U = np.uint64


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row of T 64-bit coordinates for each set that isn't empty (zeros for empty ones)."""
    n = len(sets)
    full = np.full(n * T, ~_U(0), _U)
    sizes = np.array([len(s) for s in sets], np.int64)
    live = np.flatnonzero(sizes)
    elements = np.concatenate([sets[i] for i in live]) if len(live) else np.zeros(0, _U)
    owner = np.repeat(live, sizes[live])
    empty = np.zeros(n, np.int64)
    empty[live] = T
    for i in range(2 * T):
        if not len(elements):
            break
        h = mix(elements ^ _U((i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        bins = (h & _U(T - 1)).astype(np.int64) if i < T else np.full(len(h), i - T)
        at = owner * T + bins
        open_ = full[at] == ~_U(0)
        at, h = at[open_], h[open_]
        # Of the round, the least hash in each bin that was empty.
        new = np.full(n * T, ~_U(0), _U) if len(at) > n * T // 8 else None
        if new is not None:
            np.minimum.at(new, at, h >> _U(8))
            got = np.flatnonzero(new != ~_U(0))
            full[got] = new[got]
        else:
            order = np.lexsort((h, at))
            at, h = at[order], h[order]
            first = np.ones(len(at), bool)
            first[1:] = at[1:] != at[:-1]
            got = at[first]
            full[got] = h[first] >> _U(8)
        if len(got):
            np.subtract.at(empty, got // T, 1)
            keep = empty[owner] > 0
            if not keep.all():
                elements, owner = elements[keep], owner[keep]
    out = full.reshape(n, T)
    out[sizes == 0] = 0
    return out


def _signed(k: int):
    def run(batches):
        for batch in batches:
            texts = batch.column(2)
            for lo in range(0, len(texts), 256):
                part = [shingle_set(word_hashes(t.as_py() or b""), k) for t in texts[lo : lo + 256]]
                rows = sketches(part)
                cut = rows[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
                bands = mix(cut[:, :, 0])
                for j in range(1, ROWS):
                    bands = mix(bands * _U(0xD6E8FEB86659FD93) + cut[:, :, j])
                yield pa.record_batch(
                    [
                        batch.column(0)[lo : lo + 256],
                        batch.column(1)[lo : lo + 256],
                        pa.array([len(s) for s in part], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in part], pa.binary()),
                        pa.array([r.tobytes() for r in mix(rows).astype(np.uint8)], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * BANDS, pa.int32()), pa.array(bands.reshape(-1).view(np.int64))),
                    ],
                    names=["rid", "doc_id", "n_shingles", "set_id", "sketch", "bands"],
                )

    return run


def signed(docs: DataFrame, k: int) -> DataFrame:
    """rid, doc_id, n_shingles, set_id, sketch (a byte a coordinate), bands for each row."""
    return docs.select("rid", "doc_id", F.col("text").cast("binary")).mapInArrow(_signed(k), "rid long, doc_id long, n_shingles long, set_id binary, sketch binary, bands array<long>")


def _alike(batches):
    """Pairs whose sketches agree in LEAST of the coordinates at least."""
    for b in batches:
        if len(b):
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, T) for i in (2, 3))
            yield b.filter(pa.array((x == y).mean(1) >= LEAST)).select([0, 1])


def _linked(k: int, percent: int):
    def run(batches):
        kept: dict[int, np.ndarray] = {}

        def set_of(i, text):
            if i not in kept:
                if len(kept) > 256:
                    kept.clear()
                kept[i] = shingle_set(word_hashes(text or b""), k)
            return kept[i]

        for b in batches:
            good = []
            for a, c, ta, tc in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                x, y = set_of(a, ta.as_py()), shingle_set(word_hashes(tc.as_py() or b""), k)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.filter(pa.array(good, pa.bool_())).select([0, 1])

    return run


def _texts_of(docs: DataFrame, near: DataFrame) -> DataFrame:
    """rid, text of the rows that near names. Their ids are broadcast only up to IDS rows; beyond, texts are
    shuffled once and written."""
    ids = written(near.select(F.col("a").alias("rid")).union(near.select("b")).distinct(), "ids", 2 * near.count())
    texts = docs.select("rid", F.col("text").cast("binary").alias("text"))
    if ids.count() <= IDS:
        return texts.join(F.broadcast(ids), "rid", "left_semi")
    return written(texts.join(ids.hint("merge"), "rid", "left_semi"), "texts")


def _sets(texts: list, k: int) -> list[np.ndarray]:
    return [shingle_set(word_hashes(t or b""), k) for t in texts]


def _agreeing(x: np.ndarray, y: np.ndarray):
    """For each row of x the places of rows of y whose sketches agree in LEAST of the coordinates at least."""
    for i, row in enumerate(x):
        yield i, np.flatnonzero((y == row).sum(1) >= LEAST * T)


def _square(rows: pa.Table):
    """Of a square of a bucket: asked rows (outside the bucket's largest component) and rows to compare them with."""
    role, component = rows.column("role").to_numpy(), rows.column("component").to_numpy()
    sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, T)
    asked = np.flatnonzero((role != 1) & (component != rows.column("largest").to_numpy()))
    return asked, np.flatnonzero(role != 0), component, sketch


def _active(key, rows):
    """rep of rows whose sketch agrees with one of another component."""
    asked, others, component, sketch = _square(rows)
    live = np.zeros(len(component), bool)
    for i, hits in _agreeing(sketch[asked], sketch[others]):
        hits = others[hits]
        hits = hits[component[hits] != component[asked[i]]]
        live[hits] = True
        live[asked[i]] |= len(hits) > 0
    return pa.table({"rep": pa.array(np.unique(rows.column("rep").to_numpy()[live]), pa.int64())})


def _joined(k: int, percent: int):
    """Links (a, b) between rows of different components, verified on full sets: no more than join these components, so a row at most."""

    def run(key, rows):
        asked, others, component, sketch = _square(rows)
        reps, texts = rows.column("rep").to_numpy(), rows.column("text")
        kept: dict[int, np.ndarray] = {}
        held = 0

        def set_of(i: int) -> np.ndarray:
            nonlocal held
            if i not in kept:
                if held > 4 * TEXTS:
                    kept.clear()
                    held = 0
                kept[i] = _sets([texts[i].as_py()], k)[0]
                held += kept[i].nbytes
            return kept[i]

        name = {c: c for c in component.tolist()}

        def root(c):
            while name[c] != c:
                name[c] = name[name[c]]
                c = name[c]
            return c

        a, b = [], []
        for i, hits in _agreeing(sketch[asked], sketch[others]):
            x = int(asked[i])
            for y in others[hits].tolist():
                if root(component[x]) == root(component[y]):
                    continue
                u, v = set_of(x), set_of(y)
                if 100 * min(len(u), len(v)) < percent * max(len(u), len(v)):
                    continue
                both = len(np.intersect1d(u, v, assume_unique=True))
                if 100 * both >= percent * (len(u) + len(v) - both):
                    name[root(component[x])] = root(component[y])
                    a.append(reps[x])
                    b.append(reps[y])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _dealt(rows: DataFrame, payload: DataFrame, tag: str) -> DataFrame:
    """Rows (band, key, rep, component) of buckets of several components with their payload (rep, ..., bytes), dealt out in squares of
    CAP by CAP and about TEXTS by TEXTS bytes: role 0 asks, 1 is asked about, 2 (a bucket of one square) both."""
    cells = rows.join(payload.select("rep", "bytes"), "rep").groupBy("band", "key", "component").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    per = cells.groupBy("band", "key").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max(F.struct("n", "component")).alias("most")).where("parts > 1")
    side = F.greatest(F.ceil(F.col("n") / CAP), F.ceil(F.col("bytes") / TEXTS)).cast("int")
    per = written(per.select("band", "key", F.col("most.component").alias("largest"), side.alias("side")), tag, rows.count())
    out = rows.join(per, ["band", "key"]).join(payload, "rep").withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("side")).cast("int"))
    squares = F.when(F.col("side") == 1, F.expr("array(struct(0 as s, 0 as q, 2 as role))")).otherwise(
        F.expr("concat(transform(sequence(0, side - 1), i -> struct(mine as s, i as q, 0 as role)), transform(sequence(0, side - 1), i -> struct(i as s, mine as q, 1 as role)))")
    )
    return out.withColumn("at", F.explode(squares)).select("band", "key", "at.s", "at.q", "at.role", "rep", "component", "largest", *[c for c in payload.columns if c not in ("rep", "bytes")])


def links(docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Verified links (a, b) between class representatives, enough to give their components.

    docs: rid, text. classes: rep (a rid), sketch, bands. First the members of each bucket are tried with its least one. Then
    in buckets that still hold several components, members outside the largest are compared with all of other components,
    in squares of bounded size that give no more links than join components."""
    buckets = _buckets(classes)
    in_buckets = buckets.count()
    star = buckets.groupBy("band", "key").agg(F.min("rep").alias("a"))
    pairs = buckets.join(star, ["band", "key"]).where("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    pairs = written(pairs, "pairs", in_buckets)
    tries = pairs.count()
    side = classes.select("rep", "sketch")
    near = written(pairs.join(side.toDF("a", "sa"), "a").join(side.toDF("b", "sb"), "b").select("a", "b", "sa", "sb").mapInArrow(_alike, "a long, b long"), "near", tries)
    texts = _texts_of(docs, near)
    found = written(near.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb").mapInArrow(_linked(k, percent), "a long, b long"), "links", tries * 8)
    comps = written(components(found, tries), "components", 2 * tries)
    rows = written(buckets.join(comps, buckets.rep == comps.id, "left").select("band", "key", "rep", F.coalesce("component", "rep").alias("component")), "rows", in_buckets)
    squares = ["band", "key", "s", "q"]
    active = written(_dealt(rows, side.withColumn("bytes", F.lit(T)), "open").groupBy(*squares).applyInArrow(_active, "rep long").distinct(), "active", in_buckets)
    if active.isEmpty():
        return found
    texts = _texts_of(docs, active.select(F.col("rep").alias("a"), F.col("rep").alias("b")))
    payload = side.join(texts.withColumnRenamed("rid", "rep"), "rep").withColumn("bytes", F.length("text"))
    more = _dealt(rows.join(active, "rep", "left_semi"), payload, "still-open").groupBy(*squares).applyInArrow(_joined(k, percent), "a long, b long")
    return found.unionByName(written(more.distinct(), "more-links", in_buckets))


def _buckets(classes: DataFrame) -> DataFrame:
    """band, key, rep of the buckets that hold more than one class."""
    rows = classes.select("rep", F.posexplode("bands").alias("band", "key"))
    shared = written(rows.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "shared", BANDS * classes.count() // 2)
    return written(rows.join(shared, ["band", "key"]).select("band", "key", "rep"), "buckets")


def near_dedup(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """rid, doc_id, n_shingles, component_id, kept: links join documents whose sets of k-word shingles have
    100 * |intersection| >= percent * |union|; of each component the smallest doc_id stays."""
    docs = rows_of(docs, "doc_id", "text")
    rows = written(signed(docs, k), "signed")
    with tidied() as keep:
        named = keep(_named(docs, rows, k, percent))
    out = rows.select("rid", "doc_id", "n_shingles", "set_id").join(named, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("rid", "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _named(docs: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """set_id, component_id of signed rows."""
    known = rows.where("doc_id is not null and set_id is not null")
    classes = known.groupBy("set_id").agg(F.min(F.struct("doc_id", "rid")).alias("first"), F.min(F.struct("sketch", "bands")).alias("x"))
    classes = written(classes.select("set_id", F.col("first.rid").alias("rep"), F.col("first.doc_id").alias("least"), "x.sketch", "x.bands"), "classes")
    found = links(docs, classes, k, percent)
    comps = components(found, found.count())
    n = classes.count()
    rooted = written(classes.join(comps, classes.rep == comps.id, "left").select("set_id", "least", F.coalesce("component", "rep").alias("root")), "rooted", n)
    roots = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "roots", n)
    return written(rooted.join(roots, "root").select("set_id", "component_id"), "named", n)


def op5_minhash(spark, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=2).drop("rid")


#: All pairs by their common shingles, and components by walking.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS sh FROM w WHERE len(w) > 1 UNION ALL SELECT doc_id, w[1] FROM w WHERE len(w) = 1)
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
walk AS (SELECT doc_id AS id, doc_id AS seen FROM documents UNION SELECT walk.id, e.b FROM walk JOIN e ON e.a = walk.seen),
c AS (SELECT id, min(seen) AS component_id FROM walk GROUP BY id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents LEFT JOIN n USING (doc_id) JOIN c ON c.id = doc_id
"""

"""Line deduplication over content-defined runs of lines.

A run starts at a line with words and ends at the next one that brings it to FEWEST words, or ends at a line and starts at the
last one that does; a line of LONG words or more is a run by itself. Runs overlap, and where one stands depends on its own lines
alone, so a passage has the same runs in whatever it is set. Runs whose bytes occur at several places, in one document or many,
stay at their first place (least doc_id, then row, then position) and go from all others, and with them lines without words
between two lines that go. The first place of each line's bytes always stays. Places are found by hash; then each run's bytes
are compared with those of the first place; where different runs share a hash, each has a first place by its bytes. Texts of any length are read whole.

Runs are told by a rolling hash over their lines' hashes. The lines' words, not the rolling hash, choose where runs end: ends that a rolling hash
chooses alone are far apart, and lose what lies between a passage's own ends and the nearest of them (of three lines of 18 words, nearly all).

Defined results: null and empty texts have no lines and stay as they are; repeated rows and rows that share a doc_id are
documents of their own; a null doc_id comes last in order, so that others' copies stay; of lines
that repeat at once, in turn, more than twice, the first turn stays; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of, written

#: A line of so many words is a run by itself.
LONG = 25
#: Other runs have two lines with words or more, and so many words at least.
FEWEST = 8


_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15


def line_hash(line: bytes) -> int:
    return xxhash.xxh64_intdigest(line)


def cut(text: bytes, digest=line_hash) -> list[tuple[int, int, int]]:
    """(first line, end, hash) of each run of a text, in order."""
    lines = text.split(b"\n")
    words = [len(x.split()) for x in lines]
    full = [i for i, n in enumerate(words) if n]
    sums = [0, *accumulate(words[i] for i in full)]
    spans, end, start = set(), 0, 0
    for k, i in enumerate(full):
        if words[i] >= LONG:
            spans.add((i, i + 1))
            continue
        end = max(end, k + 1)
        while end < len(full) and sums[end + 1] - sums[k] < FEWEST:
            end += 1
        if end < len(full):
            spans.add((i, full[end] + 1))
        while start + 1 < k and sums[k + 1] - sums[start + 1] >= FEWEST:
            start += 1
        if start < k and sums[k + 1] - sums[start] >= FEWEST:
            spans.add((full[start], i + 1))
    # A run's hash comes from those of all lines before its start and before its end.
    rolled = [0]
    for x in lines if spans else ():
        rolled.append((rolled[-1] * _BASE + digest(x)) & _MASK)
    return [(lo, hi, ((rolled[hi] - rolled[lo] * pow(_BASE, hi - lo, 1 << 64)) & _MASK) - (1 << 63)) for lo, hi in sorted(spans)]


def _places(digest):
    def run(batches):
        for batch in batches:
            rids, docs, at, hashes = [], [], [], []
            for rid, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                for k, (_, _, h) in enumerate(cut(text.as_py(), digest)) if text.as_py() else ():
                    rids.append(rid)
                    docs.append(doc)
                    at.append(k)
                    hashes.append(h)
            yield pa.record_batch([pa.array(rids, pa.int64()), pa.array(docs, pa.int64()), pa.array(at, pa.int32()), pa.array(hashes, pa.int64())], names=["rid", "doc_id", "at", "h"])

    return run


_MARK = pa.struct([("at", pa.int32()), ("h", pa.int64()), ("first", pa.bool_())])
_OUT = "rid long, doc_id long, n_lines long, n_removed long, text string, text_sha256 string, chunks array<struct<at:int,h:bigint,first:boolean,bytes:binary>>"


def _thinned(with_text: bool, digest):
    """Texts without their marked runs, and the marked runs' bytes. Columns: rid, doc_id, text, marks."""
    kind = pa.list_(pa.struct([("at", pa.int32()), ("h", pa.int64()), ("first", pa.bool_()), ("bytes", pa.binary())]))

    def run(batches):
        for batch in batches:
            n, gone, texts, digests, chunks = [], [], [], [], []
            for text, marks in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                data = text.as_py()
                lines = data.split(b"\n") if data else []
                stays, told = np.ones(len(lines), bool), []
                if marks:
                    by_place = {m["at"]: m for m in marks}
                    for k, (lo, hi, _) in enumerate(cut(data, digest)):
                        if m := by_place.get(k):
                            told.append(m | {"bytes": b"\n".join(lines[lo:hi])})
                            stays[lo:hi] &= m["first"]
                    full = [i for i, x in enumerate(lines) if x.strip()]
                    for i, j in pairwise(full):
                        if not stays[i] and not stays[j]:
                            stays[i:j] = False
                kept = b"\n".join([x for x, s in zip(lines, stays, strict=True) if s]) if lines else data
                n.append(len(lines))
                gone.append(len(lines) - int(stays.sum()))
                texts.append(kept.decode() if with_text and kept is not None else None)
                digests.append(hashlib.sha256(kept or b"").hexdigest())
                chunks.append(told)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string()), pa.array(digests, pa.string()), pa.array(chunks, kind)], names=["rid", "doc_id", "n_lines", "n_removed", "text", "text_sha256", "chunks"])

    return run


def line_dedup(docs: DataFrame, with_text: bool = True, digest=line_hash) -> DataFrame:
    """rid, doc_id, n_lines, n_removed, text (without repeated runs), text_sha256 for each row of docs; digest: what hashes a line."""
    docs = rows_of(docs, "doc_id", "text").select("rid", "doc_id", F.col("text").cast("binary").alias("text"))
    places = written(docs.mapInArrow(_places(digest), "rid long, doc_id long, at int, h long"), "places")
    order = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc_id"), "rid", "at")
    # Places that are said again are few against all of them, so these are read twice rather than carried along.
    repeated = written(places.groupBy("h").agg(F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1").select("h", "first"), "repeated")
    marks = places.join(repeated, "h").select("rid", F.struct("at", "h", ((F.col("rid") == F.col("first.rid")) & (F.col("at") == F.col("first.at"))).alias("first")).alias("mark"))
    marks = marks.groupBy("rid").agg(F.collect_list("mark").alias("marks"))
    done = written(docs.join(marks, "rid", "left").select("rid", "doc_id", "text", "marks").mapInArrow(_thinned(with_text, digest), _OUT), "thinned")
    # Byte comparison: of every run with the one at its first place.
    chunks = done.select("rid", "doc_id", F.explode("chunks").alias("c")).select("rid", "doc_id", "c.*")
    firsts = chunks.where("first").select("h", F.col("bytes").alias("other"))
    differ = written(chunks.where("not first").join(firsts, "h").where("bytes <> other").select("h"), "differ")
    out = ["rid", "doc_id", "n_lines", "n_removed", "text", "text_sha256"]
    if differ.isEmpty():
        return done.select(*out)
    # Different runs of one hash: each has a first place of its own, found by its bytes.
    mixed = chunks.join(differ, "h", "left_semi")
    groups = mixed.groupBy("h", "bytes").agg(F.count("*").alias("n"), F.min(order).alias("least"))
    told = mixed.join(groups, ["h", "bytes"]).select("rid", F.struct("at", "h", ((F.col("rid") == F.col("least.rid")) & (F.col("at") == F.col("least.at"))).alias("first"), "n").alias("mark"))
    anew = written(told.groupBy("rid").agg(F.collect_list("mark").alias("anew")), "anew")
    marks = "transform(filter(chunks, c -> not exists(anew, m -> m.at = c.at)), c -> struct(c.at as at, c.h as h, c.first as first))"
    marks = F.expr(f"concat({marks}, transform(filter(anew, m -> m.n > 1), m -> struct(m.at as at, m.h as h, m.first as first)))")
    again = docs.join(anew, "rid").join(done.select("rid", "chunks"), "rid").select("rid", "doc_id", "text", marks.alias("marks"))
    return done.join(anew, "rid", "left_anti").select(*out).unionByName(again.mapInArrow(_thinned(with_text, digest), _OUT).select(*out))


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
    return out.select("doc_id", "n_lines", "n_removed", (F.col("n_removed") > 0).alias("changed"), "text_sha256")

"""Language identification with error-correcting output codes.

Each language has a codeword of bits. A classifier a bit, over the byte n-grams of a text, says how likely the bit is set:
its weights are log-odds of hashed n-grams between the languages whose bit is set and the others, from the counts of all
training texts. Decoding adds up, for each codeword, the loss of every bit's margin, weighted by how often
that classifier is right on the training texts, and takes the nearest codeword; a text whose two nearest
codewords are nearly as far is flagged as ambiguous.

The model has BUCKETS weights a bit. Its tables are counts by language and bucket, summed on the executors.

The number of languages isn't bounded: weights are made on the executors, PARTS shares of the buckets at a time, and only they and a
margin for each language and bit reach the driver.

Defined results: null texts and those without a letter are `und` with score 0 (ambiguous); repeated rows and repeated or
null doc_id give a row each (a null doc_id is never held out and never trained on); of codewords equally near, the language first in order
is taken; texts of any length are read whole, piece by piece; without any training row all texts are `und`; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OWN, PIECE, only, pieces, written

#: n-grams of these many bytes, hashed to so many buckets.
GRAMS = (1, 2, 3, 4)
BUCKETS = 1 << 14
#: Shares of the buckets that a task each makes weights for.
PARTS = 16
#: The column that `identified` adds.
TOLD = OWN + "told"
#: Score below which a text counts as ambiguous.
SURE = 0.6
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes that say nothing of the language count as a blank: digits, ASCII marks, controls.
_FOLD = bytes(0x20 if b < 0x61 or 0x7B <= b < 0x80 else b for b in range(256))


def buckets(text: str | None):
    """Arrays of n-gram buckets of a whole text, piece by piece."""
    data = (text or "").encode(errors="replace").translate(_LOWER).translate(_FOLD)
    for part in pieces(data) if len(data) > PIECE else [data]:
        raw = np.frombuffer(b" " + part + b" ", np.uint8).astype(np.uint32)
        for n in GRAMS:
            if len(raw) < n:
                continue
            h = np.full(len(raw) - n + 1, n * 2654435761 & 0xFFFFFFFF, np.uint32)
            for j in range(n):
                h = (h ^ raw[j : len(raw) - n + 1 + j]) * np.uint32(16777619)
            yield ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - 14)


def codewords(n: int) -> np.ndarray:
    """A row of bits (0, 1) for each of n languages: the exhaustive code for up to 6, a code of random words far apart beyond."""
    if n <= 1:
        return np.zeros((n, 1), np.int8)
    if n <= 6:
        columns = [c for c in itertools.product((0, 1), repeat=n) if c[0] == 1 and not all(c)]
        return np.array(columns, np.int8).T
    rng, best = np.random.default_rng(7), None
    bits = max(15, int(np.ceil(10 * np.log2(n))))
    for _ in range(200 if n <= 200 else 1):
        code = rng.integers(0, 2, (n, bits), dtype=np.int8)
        code = code[:, (code.min(0) == 0) & (code.max(0) == 1)]
        if n > 200:  # two of n words of so many bits are hardly near; that they differ is all that is asked
            return code if len(np.unique(code, axis=0)) == n else np.hstack([code, (np.arange(n)[:, None] >> np.arange(32) & 1).astype(np.int8)])
        least = min(int((code[a + 1 :] != code[a]).sum(1).min()) for a in range(n - 1))
        if best is None or least > best[0]:
            best = (least, code)
    return best[1]


def _counts(batches):
    sums: dict[str, np.ndarray] = {}
    texts: dict[str, int] = {}
    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            own = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
            texts[lang] = texts.get(lang, 0) + 1
            for part in buckets(text.as_py()):
                own += np.bincount(part, minlength=BUCKETS)
    for lang, own in sums.items():
        at = np.flatnonzero(own)
        yield pa.record_batch([pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(own[at], texts[lang]), pa.int64())], names=["lang", "bucket", "n"])


def _weights(langs: list[str], totals: np.ndarray):
    """Of a share of the buckets: each bit's weights, and each language's mean margin from them."""
    code = codewords(len(langs)).astype(bool)
    place = {lang: i for i, lang in enumerate(langs)}
    size = BUCKETS // PARTS

    def run(rows: pa.Table) -> pa.Table:
        part = int(rows.column("part")[0].as_py())
        counts = np.zeros((len(langs), size))
        counts[[place[x] for x in rows.column("lang").to_pylist()], rows.column("bucket").to_numpy() - part * size] = rows.column("n").to_numpy()
        share = (counts + 0.5) / (totals[:, None] + 0.5 * BUCKETS)  # a language counts alike, however many its texts
        weights = np.zeros((size, code.shape[1]), np.float32)
        for b in np.flatnonzero(code.any(0) & ~code.all(0)):
            weights[:, b] = np.log(share[code[:, b]].mean(0)) - np.log(share[~code[:, b]].mean(0))
        return pa.table({"part": pa.array([part], pa.int32()), "weights": [weights.tobytes()], "margin": [(share @ weights.astype(np.float64)).tobytes()]})

    return run


class Model:
    def __init__(self, langs: list[str], weights: np.ndarray, margin: np.ndarray):
        self.langs, self.code, self.weights = langs, codewords(len(langs)), weights
        self.trust = np.ones(self.code.shape[1])
        for b in range(self.code.shape[1]):
            on, off = self.code[:, b] == 1, self.code[:, b] == 0
            if on.any() and off.any():
                # How well the bit's classifier parts its sides on the training counts: its least mean margin, in nats.
                self.trust[b] = max(1e-3, min(np.abs(margin[on, b]).min(), np.abs(margin[off, b]).min()))
        self.trust /= self.trust.sum()

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not self.langs or not text or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        seen, n = np.zeros(BUCKETS, np.int64), 0
        for part in buckets(text):
            seen += np.bincount(part, minlength=BUCKETS)
            n += len(part)
        total = seen.astype(np.float32) @ self.weights
        margin = total / max(n, 1) * min(n, 200)  # evidence grows with the text up to 200 n-grams
        sign = self.code * 2.0 - 1
        loss = (np.logaddexp(0, -sign * margin) * self.trust).sum(1)
        p = np.exp(-(loss - loss.min()) * 4)
        p /= p.sum()
        k = int(loss.argmin())
        return self.langs[k], float(p[k]), bool(p[k] < SURE)


def train(docs: DataFrame) -> Model:
    """docs: text, lang; rows with a null lang teach nothing."""
    rows = docs.where("lang is not null").select(F.coalesce("text", F.lit("")).alias("text"), "lang").mapInArrow(_counts, "lang string, bucket int, n long")
    sums = written(rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "counts")
    heads = sums.groupBy("lang").agg(F.sum(F.when(F.col("bucket") >= 0, F.col("n")).otherwise(0)).alias("n")).orderBy("lang").collect()
    langs = [r["lang"] for r in heads]
    code = codewords(len(langs))
    weights, margin = np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape)
    if langs:
        size = BUCKETS // PARTS
        # A row for each share, so that none is without its weights.
        every = sums.sparkSession.range(PARTS).select(F.lit(langs[0]).alias("lang"), (F.col("id") * size).cast("int").alias("bucket"), F.lit(0).cast("long").alias("n"))
        parts = sums.where("bucket >= 0").unionByName(every).groupBy("lang", "bucket").agg(F.sum("n").alias("n")).withColumn("part", F.floor(F.col("bucket") / size).cast("int"))
        for row in parts.groupBy("part").applyInArrow(_weights(langs, np.array([r["n"] for r in heads], float)), "part int, weights binary, margin binary").toLocalIterator():
            weights[row["part"] * size : (row["part"] + 1) * size] = np.frombuffer(row["weights"], np.float32).reshape(size, -1)
            margin += np.frombuffer(row["margin"]).reshape(code.shape)
    return Model(langs, weights, margin)


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """docs, all its columns, with TOLD: a struct of lang_pred, score and ambiguous."""
    from pyspark.sql.types import StructType

    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])

    def run(batches):
        for batch in batches:
            told = [dict(zip(("lang_pred", "score", "ambiguous"), held.value.predict(t.as_py()), strict=True)) for t in batch.column("text")]
            yield pa.record_batch([*batch.columns, pa.array(told, kind)], names=[*batch.schema.names, TOLD])

    return docs.mapInArrow(run, StructType(list(docs.schema.fields)).add(TOLD, StructType.fromDDL("lang_pred string, score double, ambiguous boolean")))


def remainder(parts: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous: learnt from the rows that aren't held out."""
    docs = only(docs, "doc_id", "text", "lang")
    model = train(docs.where(remainder(4) != 2))
    rows = docs.select("doc_id", "text", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"))
    return identified(rows, model).select("doc_id", "held_out", TOLD + ".*")


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))

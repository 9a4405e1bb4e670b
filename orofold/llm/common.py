"""What the corpus operators share: tables, the folder all machines share, hashing of words."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one where it is unset and all runs in this process, an error elsewhere."""
    conf = spark.sparkContext.getConf()
    at = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        at = "file://" + tempfile.mkdtemp(prefix="orofold-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: Rows that a task of a small table takes.
PART = 100_000


def written(df: DataFrame, tag: str, most: int | None = None) -> DataFrame:
    """df as a table in the shared folder, read again: lineage ends there and survives lost executors.

    most: a bound on its rows where one is known; a small table then takes few tasks and files, a large one as
    many as the session's shuffles have."""
    spark = df.sparkSession
    if most is not None:
        parts = max(4, -(-most // PART))
        if parts < int(spark.conf.get("spark.sql.shuffle.partitions")):
            df = df.coalesce(parts)
    at = f"{shared_dir(spark)}/orofold-{uuid.uuid4().hex}/{tag}"
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    for made in _open[-1:]:
        made.append((out, at))
    return out


#: What `written` made within each block of `tidied` that is open, the innermost last.
_open: list[list[tuple[DataFrame, str]]] = []


@contextmanager
def tidied():
    """A block at whose end the tables written in it are deleted, but for those given to the function that it gives."""
    kept: list[DataFrame] = []

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table)
        return table

    _open.append([])
    try:
        yield keep
    finally:
        for table, at in _open.pop():
            if any(table is k for k in kept):
                for outer in _open[-1:]:
                    outer.append((table, at))
            else:
                path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(at).getParent()
                path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Whether a query's shuffle files are deleted when it ends, rather than when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def swept(spark: SparkSession):
    """A block whose queries leave no shuffle files."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


#: Rows that readers decode at once, and bytes of rows that go to Python at once: by default they are thousands of whole texts.
SLIM = {"spark.sql.parquet.columnarReaderBatchSize": "256", "spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 22)}


@contextmanager
def slim(spark: SparkSession):
    """A block whose queries hold few long rows at a time; all rows are read all the same."""
    before = {k: spark.conf.get(k, None) for k in SLIM}
    for k, v in SLIM.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def let_go() -> None:
    """Memory that this process has freed goes back to the system, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: Columns that operators put beside a table's own begin so; no table may have one.
OWN = "_orofold_"
RID = OWN + "rid"
#: Bits of a row number that say which row of its file it is; the rest say which file.
ROW_BITS = 36
#: So many files' names are broadcast at most.
FILES = 500_000


def _from_files(df: DataFrame) -> bool:
    """Whether each row of df is a row of a Parquet file, as it stands there; False wherever that can't be told."""
    if not hasattr(df, "_jdf"):
        return False
    lines = [line.lstrip("+-: ") for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    return all(line.startswith("Project ") or line.startswith("Relation ") and line.rstrip().endswith(" parquet") for line in lines)


def numbered(df: DataFrame) -> DataFrame:
    """df with a row number RID that every reading gives alike, however it is split: the number of the row's file (in order of
    paths, in a written table) and of the row in its file. Anything but rows of files is written first."""
    if RID in df.columns:
        return df
    rows = df if _from_files(df) else written(df, "rows")
    meta = rows.metadataColumn("_metadata")
    rows = rows.select("*", meta["file_path"].alias(OWN + "file"), meta["row_index"].alias(OWN + "row"))
    files = written(rows.select(OWN + "file").distinct().coalesce(1).sortWithinPartitions(OWN + "file").withColumn(OWN + "no", F.monotonically_increasing_id()), "files", 1)
    files = F.broadcast(files) if files.count() <= FILES else files.hint("merge")
    number = F.shiftleft(F.col(OWN + "no"), ROW_BITS) + F.col(OWN + "row")
    return rows.join(files, OWN + "file").withColumn(RID, number).drop(OWN + "file", OWN + "row", OWN + "no")


def rows_of(df: DataFrame, *names: str) -> DataFrame:
    """rid, a row number as `numbered` gives it, and the named columns."""
    own = numbered(only(df, *names) if RID not in df.columns else df)
    return own.select(F.col(RID).alias("rid"), *names)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, the first of each name (case folded) where a table has clashing ones."""
    lower = [c.lower() for c in df.columns]
    if len(set(lower)) == len(lower):
        return df.select(*names)
    first = df.toDF(*[f"_{i}" for i in range(len(lower))])
    return first.select(*[F.col(f"_{lower.index(n.lower())}").alias(n) for n in names])


# -- vectorised word hashing ------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.int64).astype(_U)
#: Bytes hashed at once.
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64-bit words."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


_cache: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _cache or len(_cache["p"]) < n:
        size = max(n, PIECE + 4096)
        _cache["p"], _cache["q"] = _powers(_BASE, size), _powers(_INVERSE, size)
    return _cache["p"], _cache["q"]


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that aren't ASCII white space."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~_SPACE[raw]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of raw[start:end], the same wherever the bytes stand."""
    if not len(starts):
        return np.zeros(0, _U)
    p, q = _tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, _U)
    np.cumsum(_BYTE[raw] * p[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * q[starts] + (ends - starts).astype(_U))


def pieces(text: bytes):
    """text in pieces of about PIECE bytes, cut at white space only, so that words stay whole."""
    if len(text) <= PIECE:
        yield text
        return
    raw = np.frombuffer(text, np.uint8)
    at = 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        while end < len(text):
            gap = np.flatnonzero(_SPACE[raw[end : end + PIECE]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(end + PIECE, len(text))
        yield text[at:end]
        at = end


def word_hashes(text: bytes) -> np.ndarray:
    """A hash for each word of text, in order; A-Z count as a-z."""
    out = []
    for part in pieces(text.translate(_LOWER)):
        raw = np.frombuffer(part, np.uint8)
        out.append(span_hashes(raw, *word_bounds(raw)))
    return np.concatenate(out) if out else np.zeros(0, _U)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words count as one shingle, none as no shingle."""
    if not len(words):
        return words
    k = min(k, len(words))
    x = words[: len(words) - k + 1].copy()
    for j in range(1, k):
        x = mix(x * _U(0xD6E8FEB86659FD93) + words[j : len(words) - k + 1 + j])
    return np.unique(x)

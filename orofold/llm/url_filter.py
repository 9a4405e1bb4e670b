"""URL filtering with a sorted digest array.

Rules and a block list are keys of host and path (`com/fr/`). Their 64-bit xxhash digests lie sorted in a file that each
worker maps into memory; a url's candidates (its host and every parent domain no longer than the longest listed one, joined to the path's
prefixes of the lengths that rules have) are probed with one vectorised binary search a batch, and a hit counts only if the stored full
string is equal. Of the rules that fit the longest wins; where none fits, a host or a parent of it on the block list
blocks, and all else is allowed.

Both lists may be sequences or tables. The array is broadcast only while below `most` bytes; longer lists are joined by digest instead, with the same
comparison of full strings and the same result.

Defined results: a url that is null or lacks `://` has an empty host and path, fits no rule and is allowed; a null page_id
stays null; of a key that is listed twice the greater verdict (block) counts, of two keys that fit equally long the one with
the longer host; urls of any length are judged whole, and take no more candidates than the longest listed host has labels; repeated
rows give a row each; an empty table gives an empty result, and an empty list fits nothing.
"""

from __future__ import annotations

import mmap
import os
import tempfile
import uuid
from collections.abc import Iterable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, rows_of

LIST_BYTES = 64 << 20
#: The rules of the query: (key, verdict).
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Hosts that the method itself blocks, where no other list is given: a line each.
BLOCKED = tuple((Path(__file__).parent / "blocked_hosts.txt").read_text().split())
#: Lists that a worker keeps mapped.
MAPPED = 4


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    low = F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(low, F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class DigestArray:
    """Strings by their sorted 64-bit digests."""

    def __init__(self, strings: Iterable[str]):
        import xxhash

        data = sorted({s.encode() for s in strings})
        keys = np.array([xxhash.xxh64_intdigest(s) for s in data], np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, stored = keys[order], [data[i] for i in order]
        self.offsets = np.zeros(len(stored) + 1, np.int64)
        np.cumsum([len(s) for s in stored], out=self.offsets[1:])
        self.heap: bytes | mmap.mmap = b"".join(stored)

    def __len__(self) -> int:
        return len(self.keys)

    def packed(self) -> bytes:
        return np.int64(len(self)).tobytes() + self.keys.tobytes() + self.offsets.tobytes() + bytes(self.heap)

    @classmethod
    def mapped(cls, packed: bytes) -> DigestArray:
        """From the worker's own temporary file, which is gone from the folder as soon as it is mapped."""
        fd, name = tempfile.mkstemp(prefix="digests-")
        try:
            with os.fdopen(fd, "w+b") as f:
                f.write(packed)
                f.flush()
                view = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        finally:
            os.unlink(name)
        out = cls.__new__(cls)
        n = int(np.frombuffer(view, np.int64, 1)[0])
        out.keys = np.frombuffer(view, np.uint64, n, 8)
        out.offsets = np.frombuffer(view, np.int64, n + 1, 8 + 8 * n)
        out.heap = memoryview(view)[8 + 8 * n + 8 * (n + 1) :]
        return out

    def find(self, strings: list[bytes], digests: np.ndarray | None = None) -> np.ndarray:
        """Whether each string is in the array."""
        import xxhash

        if digests is None:
            digests = np.array([xxhash.xxh64_intdigest(s) for s in strings], np.uint64)
        if not len(self.keys) or not len(digests):
            return np.zeros(len(digests), bool)
        at = np.searchsorted(self.keys, digests)
        hit = (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == digests)
        for i in np.flatnonzero(hit):
            j, found = int(at[i]), False
            while j < len(self.keys) and self.keys[j] == digests[i] and not found:  # different strings of one digest
                found = bytes(self.heap[self.offsets[j] : self.offsets[j + 1]]) == strings[i]
                j += 1
            hit[i] = found
        return hit


#: What a worker has mapped, by the list's own name; the oldest go.
_arrays: dict[str, tuple[DigestArray, DigestArray]] = {}


def _mapped(name: str, packed: list[bytes]) -> tuple[DigestArray, DigestArray]:
    if name not in _arrays:
        while len(_arrays) >= MAPPED:
            _arrays.pop(next(iter(_arrays)))
        _arrays[name] = tuple(DigestArray.mapped(x) for x in packed)
    return _arrays[name]


def parents(host: str, longest: int) -> list[str]:
    """host and its parent domains, those of so many bytes at most."""
    # A character is a byte at least, so what is longer in characters needn't be cut out.
    out = [host] if len(host) <= longest else []
    start = max(0, len(host) - longest - 1)
    while (start := host.find(".", start) + 1) > 0:
        out.append(host[start:])
    return [h for h in out if h]


class Probes:
    """What a url is asked for: lengths are those of rules' paths, the longest hosts those of each list."""

    def __init__(self, lengths: list[int], rule_host: int, block_host: int):
        self.lengths, self.rule_host, self.block_host = sorted(lengths), rule_host, block_host

    def of(self, host: str, path: str) -> list[str]:
        own = [path[:n] for n in self.lengths if n <= len(path)]
        return [h + p for h in parents(host, self.rule_host) for p in own] if own and host else []

    def names(self, host: str) -> list[str]:
        return parents(host, self.block_host)


def _length(key: str) -> tuple[int, int]:
    """Characters of a key's path, bytes of its host."""
    cut = key.index("/")
    return len(key) - cut, len(key[:cut].encode())


def _broadcast_judge(rows: DataFrame, rules: list[tuple], blocked: list[tuple]) -> DataFrame:
    verdicts: dict[str, str] = {}
    for key, verdict in rules:
        verdicts[key] = max(verdict, verdicts.get(key, ""))
    hosts = {h for (h,) in blocked}
    probes = Probes(list({_length(k)[0] for k in verdicts}), max((_length(k)[1] for k in verdicts), default=0), max((len(h.encode()) for h in hosts), default=0))
    held, name = rows.sparkSession.sparkContext.broadcast([DigestArray(verdicts).packed(), DigestArray(hosts).packed()]), uuid.uuid4().hex

    def run(batches):
        rule_list, block_list = _mapped(name, held.value)
        for batch in batches:
            ids, hosts, paths = batch.columns
            asked: list[bytes] = []
            owner: list[int] = []
            names: list[bytes] = []
            named: list[int] = []
            for i, (host, path) in enumerate(zip(hosts.to_pylist(), paths.to_pylist(), strict=True)):
                for probe in probes.of(host, path):
                    asked.append(probe.encode())
                    owner.append(i)
                for h in probes.names(host):
                    names.append(h.encode())
                    named.append(i)
            best: dict[int, str] = {}
            for j in np.flatnonzero(rule_list.find(asked)):
                text = asked[j].decode()
                if len(text) > len(best.get(owner[j], "")):
                    best[owner[j]] = text
            bad = {named[j] for j in np.flatnonzero(block_list.find(names))}
            rule = [best.get(i) for i in range(len(ids))]
            verdict = [verdicts[r] if r else "block" if i in bad else "allow" for i, r in enumerate(rule)]
            yield pa.record_batch([ids, hosts, paths, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return rows.select("page_id", "host", "path").mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def _joined_judge(rows: DataFrame, rules: DataFrame, blocked: DataFrame) -> DataFrame:
    """The same by joins on digests: rows (rid, page_id, host, path). Spark splits digests that many urls ask for."""
    rules = rules.groupBy("key").agg(F.max("verdict").alias("verdict")).withColumn("cut", F.instr("key", "/"))
    told = rules.agg(F.collect_set(F.length("key") - F.col("cut") + 1).alias("lengths"), F.max(F.octet_length(F.expr("substring(key, 1, cut - 1)"))).alias("host")).first()
    longest = blocked.agg(F.max(F.octet_length("host")).alias("host")).first()["host"] or 0
    probes = Probes(told["lengths"], told["host"] or 0, longest)

    def run(batches):
        for batch in batches:
            rids, own, is_host = [], [], []
            for rid, host, path in zip(*(batch.column(k).to_pylist() for k in ("rid", "host", "path")), strict=True):
                for asked, kind in ((probes.of(host, path), False), (probes.names(host), True)):
                    rids += [rid] * len(asked)
                    own += asked
                    is_host += [kind] * len(asked)
            yield pa.record_batch([pa.array(rids, pa.int64()), pa.array(own, pa.string()), pa.array(is_host, pa.bool_())], names=["rid", "probe", "is_host"])

    asked = rows.select("rid", "host", "path").mapInArrow(run, "rid long, probe string, is_host boolean").withColumn("digest", F.xxhash64("probe"))
    listed = rules.select("key", "verdict", F.lit(False).alias("host")).unionByName(blocked.select(F.col("host").alias("key")).distinct().select("key", F.lit("block").alias("verdict"), F.lit(True).alias("host")))
    hits = asked.join(listed.withColumn("digest", F.xxhash64("key")), "digest").where("probe = key and is_host = host")
    best = hits.groupBy("rid").agg(F.max(F.when(~F.col("is_host"), F.struct(F.length("key").alias("n"), F.instr("key", "/").alias("cut"), "key", "verdict"))).alias("best"), F.max("is_host").alias("bad"))
    verdict = F.coalesce(F.col("best.verdict"), F.when(F.col("bad"), "block"), F.lit("allow"))
    return rows.join(best, "rid", "left").select("page_id", "host", "path", F.col("best.key").alias("rule"), verdict.alias("verdict"))


def _held(spark: SparkSession, given: Iterable | DataFrame, names: list[str], most: int) -> list[tuple] | DataFrame:
    """A list's rows here if they make most bytes at most, else as a table."""
    if isinstance(given, DataFrame):
        size = given.agg(F.coalesce(F.sum(sum([F.octet_length(n) for n in names], F.lit(16))), F.lit(0))).first()[0]
        return given if size > most else [tuple(r) for r in given.select(*names).collect()]
    rows = [(x,) if isinstance(x, str) else tuple(x) for x in given]
    size = sum(16 + sum(len(x.encode()) for x in r) for r in rows)
    return rows if size <= most else spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str]] | DataFrame = RULES, blocked: Iterable[str] | DataFrame = BLOCKED, most: int = LIST_BYTES) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages (page_id, url); rules (key, verdict), blocked (host)."""
    spark = pages.sparkSession
    lists = _held(spark, rules, ["key", "verdict"], most), _held(spark, blocked, ["host"], most)
    parts = [host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")]
    if not any(isinstance(x, DataFrame) for x in lists):
        return _broadcast_judge(only(pages, "page_id", "url").select("page_id", *parts), *lists)
    tables = [x if isinstance(x, DataFrame) else spark.createDataFrame(x, kind) for x, kind in zip(lists, ("key string, verdict string", "host string"), strict=True)]
    return _joined_judge(rows_of(pages, "page_id", "url").select("rid", "page_id", *parts), *tables)


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLE = f"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(rh, rp, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
b(name) AS (VALUES {", ".join(f"('{h}')" for h in BLOCKED)}),
f AS (
  SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict
  FROM s JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) AND host <> '' GROUP BY page_id
)
SELECT s.page_id, host, path, rule, coalesce(f.verdict, CASE WHEN EXISTS (SELECT 1 FROM b WHERE host = name OR ends_with(host, '.' || name)) THEN 'block' ELSE 'allow' END) AS verdict
FROM s LEFT JOIN f USING (page_id)
"""

"""Toxicity by class-conditional Kneser-Ney models of word pairs.

Each class has a model of words given the word before (or the text's start): the discounted count of the pair in the class
(once a text, as repeats in a text aren't independent), backed off to the discounted count of the word in the class (times how much likelier the word before makes it in either
class), backed off to the continuation distribution that both classes share: with how many different words before it the word was seen. A word's evidence is the log-likelihood ratio (toxic over
ordinary) of these chances. A text's features are the mean ratio of its words and the mean of its strongest ones; a
logistic curve makes them a score.

Counts come from all labelled training rows and are keyed by 64-bit hashes in written tables that grow with the
vocabulary, packed by shards (as many as the session's shuffles have). Texts are scored in blocks: a block asks each shard for its distinct pairs
and words, and the answers meet the block again. Blocks come in WAVES one after another, so that only a wave's questions and answers are on disk.
Nothing of the model is broadcast or reaches the driver but totals. The curve is fitted on about CALIBRATION rows at most of a fold of its own, taken by hash; these are scored by the model less their counts, all others by the model of all counts.

Defined results: null, empty and wordless texts have features 0 and so the score of a text without evidence; rows without a label
teach nothing; repeated rows give a row each; a null doc_id is never trained on nor held out; without training rows of
both classes all scores are the share of toxic rows (0 without any); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW_BITS, let_go, mix, only, pieces, rows_of, slim, span_hashes, swept, table, tidied, written
from .langid import remainder

#: Rows, about, that the logistic curve is fitted on at most.
CALIBRATION = 20_000
#: Labels (64 MB) that are broadcast at most.
LABELS = 4_000_000
#: The strongest words whose mean ratio is a feature.
TOP = 4
DISCOUNT = 0.9
#: Words of the lower order that each first word's counts are filled up with, so that few pairs aren't taken for all.
STRENGTH = 1000.0
#: Different words before it that each word is given beyond those seen: the continuation's own lower order, alike for all words.
FILL = 100.0
#: Words that a block of texts, or a task's counts in memory, closes at.
BLOCK = 1 << 20
#: Keys that a row of the model has at most, and bytes of arrays, about, that a task hands over at once: rows and batches stay small wherever they pass.
KEYS = 1 << 15
SENT = 1 << 22
#: Pairs whose chances are reckoned at once.
PAIRS = 1 << 15
#: Waves that a large table's texts are scored in; a small one's have about WAVE rows.
WAVES = 8
WAVE = 10_000
#: Neighbouring rows of a file are of one wave, 1 << RUN_BITS of them, so that blocks are large.
RUN_BITS = 11
#: The word before a text's first.
START = np.zeros(1, np.uint64)
#: Pairs of one first word are dealt over so many shards.
SALTS = 8
_PACKED = "block long, shard int, parts array<binary>"
_SCHEMA = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("parts", pa.list_(pa.binary()))])


#: What a byte of a word counts as: letters lower-cased, digits and bytes beyond ASCII as they are; all else is a blank.
_SPELT = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))
#: Bytes of texts that are hashed at once.
TOGETHER = 1 << 16


def _bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(raw) + 2, bool)
    np.not_equal(raw, 0x20, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def spelled_each(texts: Iterable[bytes | None]) -> Iterator[np.ndarray]:
    """The hashes of each text's words, letters lower-cased; marks at a word's ends don't count. Short texts are hashed together."""

    def told(held):
        raw = np.frombuffer(b" ".join(held), np.uint8)
        starts, ends = _bounds(raw)
        hashes = span_hashes(raw, starts, ends)
        cuts = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in held])).tolist()
        return [hashes[lo:hi] for lo, hi in zip([0, *cuts], cuts, strict=False)]

    held, size = [], 0
    for text in texts:
        text = (text or b"").translate(_SPELT)
        if len(text) > TOGETHER:
            if held:
                yield from told(held)
                held, size = [], 0
            yield np.concatenate([told([part])[0] for part in pieces(text)])
            continue
        held.append(text)
        size += len(text)
        if size > TOGETHER:
            yield from told(held)
            held, size = [], 0
    if held:
        yield from told(held)


def spelled(text: str | None) -> np.ndarray:
    return next(spelled_each([(text or "").encode(errors="replace")]))


def _spelled_column(texts: pa.Array) -> Iterator[np.ndarray]:
    return spelled_each(t.as_py() for t in texts.cast(pa.large_binary()))


def _order(x: np.ndarray) -> np.ndarray:
    """The stable order of 64-bit keys: their leading bits are sorted with places in the rest, which is far quicker than argsort;
    where keys differ in the rest alone, argsort it is."""
    low = np.uint64((1 << len(x).bit_length()) - 1)
    order = x & ~low
    order |= np.arange(len(x), dtype=np.uint64)
    order.sort()
    order &= low
    order = order.astype(_numbers(len(x)))
    s = x[order]
    return order if (s[1:] >= s[:-1]).all() else np.argsort(x, kind="stable")


def _numbers(n: int) -> type:
    """What holds numbers below n: blocks have millions, so their memory is half."""
    return np.int32 if n < 1 << 28 else np.int64


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct key first stands, keys rising, and of each of x the number of its key."""
    order = _order(x)
    s = x[order]
    new = np.ones(len(s), bool)
    np.not_equal(s[1:], s[:-1], out=new[1:])
    del s
    inverse = np.empty(len(order), _numbers(len(order)))
    number = np.cumsum(new, dtype=inverse.dtype)
    number -= 1
    inverse[order] = number
    return order[new], inverse


def _before(words: np.ndarray) -> np.ndarray:
    return np.concatenate([START, words[:-1]]) if len(words) else words


def _pair(first: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(mix(first) * np.uint64(0xD6E8FEB86659FD93) + word)


def _pairs(single: np.ndarray, first: np.ndarray, word: np.ndarray) -> np.ndarray:
    """_pair of words that are numbers among single."""
    key = (mix(single) * np.uint64(0xD6E8FEB86659FD93))[first]
    key += single[word]
    return mix(key)


def _shard(first: np.ndarray, word: np.ndarray, shards: int) -> np.ndarray:
    return (mix(first + (word & np.uint64(SALTS - 1)) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(shards)).astype(np.int64)


def _word_shard(word: np.ndarray, shards: int) -> np.ndarray:
    return (word % np.uint64(shards)).astype(np.int64)


_ZSTD = pa.Codec("zstd", compression_level=1)


def _closed(x: np.ndarray) -> bytes:
    """An array's bytes: rising keys as steps, columns one after another, by byte places, compressed."""
    steps = x.dtype == np.uint64 and bool((x[1:] >= x[:-1]).all())
    x = np.ascontiguousarray(np.diff(x, prepend=np.uint64(0)) if steps else x.T)
    places = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T)
    return bytes([steps]) + places.nbytes.to_bytes(8, "little") + _ZSTD.compress(places, asbytes=True)


def _opened(data: bytes, kind, width: int = 0) -> np.ndarray:
    size = int.from_bytes(data[1:9], "little")
    places = np.frombuffer(_ZSTD.decompress(data[9:], size, asbytes=True) if size else b"", np.uint8)
    x = np.ascontiguousarray(places.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
    if data[0]:
        return np.cumsum(x, dtype=np.uint64)
    return np.ascontiguousarray(x.reshape(width, -1).T) if width else x


def _rows(rows: list[tuple[int, int, list[np.ndarray]]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([[_closed(p) for p in r[2]] for r in rows], pa.list_(pa.binary()))], schema=_SCHEMA)


def _batches(rows: Iterable[tuple[int, int, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
    """The batches of rows, each closed before more are made."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(p.nbytes for p in row[2])
        if size > SENT:
            yield _rows(held)
            held, size = [], 0
    if held:
        yield _rows(held)


def _whole(rows: Iterable[tuple[int, int, list[np.ndarray]]]) -> pa.Table:
    out = pa.Table.from_batches(list(_batches(rows)), _SCHEMA)
    let_go()
    return out


def _cuts(shard: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by shard, and where each shard starts and ends in it."""
    few = shard.astype(np.uint16) if shards <= 1 << 16 else shard  # those are sorted by digits
    return np.argsort(few, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(shard, minlength=shards))])


def _dealt(shard: np.ndarray, shards: int, base: int, columns: list[np.ndarray]) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    order, ends = _cuts(shard, shards)
    for s in range(shards):
        if ends[s] < ends[s + 1]:
            part = order[ends[s] : ends[s + 1]]
            yield 0, base + s, [c[part] for c in columns]


def _parted(shard: int, columns: list[np.ndarray]) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """A shard's table, in rows of KEYS keys at most; where keys rise, each row's are beyond those of the row before."""
    for at in range(0, len(columns[0]), KEYS):
        yield 0, shard, [c[at : at + KEYS] for c in columns]


def _sums(inverse: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    out = np.empty((n, counts.shape[1]), np.uint32)
    for c in range(counts.shape[1]) if n else ():
        out[:, c] = np.bincount(inverse, counts[:, c], n)
    return out


def _unpacked(rows, at: int, kind, width: int = 0) -> np.ndarray:
    return np.concatenate([_opened(r[at], kind, width) for r in rows]) if rows else np.zeros((0, width) if width else 0, kind)


def _counted(shards: int):
    """Pairs of labelled texts by kind of row (ordinary, toxic, both again for the calibration rows), summed in bounded steps."""

    def run(batches):
        held, size = [], 0

        def told():
            first, word, kind = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            at, inverse = _distinct(_pair(first, word))
            first, word = first[at], word[at]
            counts = np.empty((len(at), 4), np.uint32)
            for k in range(4):
                counts[:, k] = np.bincount(inverse[kind == k], minlength=len(at))
            del inverse, kind, at
            order = _order(first)
            first, word, counts = first[order], word[order], counts[order]
            del order
            yield from _batches(_dealt(_shard(first, word, shards), shards, 0, [first, word, counts]))
            let_go()

        for batch in batches:
            for words, kind in zip(_spelled_column(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                if len(words):
                    first = _before(words)
                    at = np.unique(_pair(first, words), return_index=True)[1]
                    held.append((first[at], words[at], np.full(len(at), kind, np.int8)))
                    size += len(at)
                if size > BLOCK:
                    yield from told()
                    size = 0
        if held:
            yield from told()

    return run


def _by_model(counts: np.ndarray) -> np.ndarray:
    """Counts of ordinary and toxic rows: of all rows, then of those that aren't for calibration."""
    return np.concatenate([counts[:, :2] + counts[:, 2:], counts[:, :2]], 1)


#: Columns of a word's row, for each of the two models: as first word its pairs and different pairs by class, its
#: count by class, and the different words before it and after it in either class.
WIDTH = 16


def _merged(shards: int):
    """The table of a shard's pairs, and what they add to the rows of their words."""

    def run(group: pa.Table) -> pa.Table:
        rows, shard = group.column("parts").to_pylist(), group.column("shard")[0].as_py()
        first, word, counts = _unpacked(rows, 0, np.uint64), _unpacked(rows, 1, np.uint64), _unpacked(rows, 2, np.uint32, 4)
        del rows
        key = _pair(first, word)
        at, inverse = _distinct(key)
        key = key[at]
        n = _by_model(_sums(inverse, counts, len(key)))
        first, word = first[at], word[at]
        del counts, inverse
        words = np.concatenate([first, word])
        at, inverse = _distinct(words)
        words = words[at]
        own = np.zeros((len(words), WIDTH), np.uint32)
        as_first, as_word = inverse[: len(first)], inverse[len(first) :]
        own[:, 0:4], own[:, 4:8], own[:, 8:12] = _sums(as_first, n, len(words)), _sums(as_first, n > 0, len(words)), _sums(as_word, n, len(words))
        either = np.stack([n[:, :2].any(1), n[:, 2:].any(1)], 1)
        own[:, 12:14], own[:, 14:] = _sums(as_word, either, len(words)), _sums(as_first, either, len(words))
        return _whole(chain(_parted(shard, [key, n]), _dealt(_word_shard(words, shards), shards, shards, [words, own])))

    return run


def _merged_words(group: pa.Table) -> pa.Table:
    """The table of a shard's words, and in each row the totals of its words."""
    rows = group.column("parts").to_pylist()
    words = _unpacked(rows, 0, np.uint64)
    at, inverse = _distinct(words)
    words = words[at]
    own = _sums(inverse, _unpacked(rows, 1, np.uint32, WIDTH), len(words))

    def totalled():
        for _, shard, (part, n) in _parted(group.column("shard")[0].as_py(), [words, own]):
            totals = np.concatenate([n[:, 8:14].sum(0, dtype=np.float64), (n[:, 8:12] > 0).sum(0), (n[:, 12:14] > 0).sum(0)])
            yield 0, shard, [part, n, totals.astype(np.float64)]

    return _whole(totalled())


class Block:
    """The distinct pairs and words of texts, both in order of their shards. The texts' words as numbers among single, their
    distinct words in order; lengths: words of each text."""

    def __init__(self, single: np.ndarray, numbers: np.ndarray, lengths: np.ndarray, shards: int):
        numbers = numbers.astype(_numbers(len(numbers)))
        if len(numbers) and single[0] != START[0]:
            single, numbers = np.concatenate([START, single]), numbers + 1
        before = np.zeros_like(numbers)  # START is number 0
        before[1:] = numbers[:-1]
        before[(np.cumsum(lengths) - lengths)[lengths > 0]] = 0
        key = _pairs(single, before, numbers)
        at, inverse = _distinct(key)
        first, word = before[at], numbers[at]
        order, self.ends = _cuts(_shard(single[first], single[word], shards), shards)
        self.keys = key[at[order]]
        del key, before, numbers
        word_order, self.word_ends = _cuts(_word_shard(single, shards), shards)
        self.words = single[word_order]
        rank, word_rank = (np.empty(len(x), _numbers(len(x))) for x in (order, word_order))
        rank[order], word_rank[word_order] = np.arange(len(order)), np.arange(len(word_order))
        #: Of each text word its pair; of each pair its words.
        self.numbers = rank[inverse]
        self.first, self.word = word_rank[first[order]], word_rank[word[order]]


def _asked(shards: int, asks: bool):
    """Blocks of texts (rid, doc_id, text, held_out, kind): what they ask of each shard, or the texts themselves by numbers of words."""

    def told(held):
        words, block = np.concatenate([h[4] for h in held]), held[0][0]
        ids = np.array([[h[0], h[1] or 0, h[1] is None, h[2], h[3], len(h[4])] for h in held], np.int64)
        held.clear()
        at, numbers = _distinct(words)
        single = words[at]
        del words, at
        if asks:
            b = Block(single, numbers, ids[:, 5], shards)
            rows = []
            for base, keys, ends in ((0, b.keys, b.ends), (shards, b.words, b.word_ends)):
                rows += [(block, base + s, [keys[ends[s] : ends[s + 1]]]) for s in range(shards) if ends[s] < ends[s + 1]]
            del b, numbers
            yield from _batches(rows)
        else:
            yield _rows([(block, -1, [ids, single, numbers.astype(np.uint32)])])
        let_go()

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for rid, doc, words, out, kind in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _spelled_column(batch.column(2)), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                held.append((rid, doc, out, -1 if kind is None else kind, words))
                size += len(held[-1][4]) + 1
                if size > BLOCK:
                    yield from told(held)
                    size = 0
        if held:
            yield from told(held)

    return run


def _answered(shards: int):
    def told(asked, known):
        if len(asked):
            shard = asked.column("shard")[0].as_py()
            width = 4 if shard < shards else WIDTH
            rows = sorted(known.column("parts").to_pylist(), key=lambda r: _opened(r[0], np.uint64)[0])
            keys, values = _unpacked(rows, 0, np.uint64), _unpacked(rows, 1, np.uint32, width)
            del rows
            for block, parts in zip(asked.column("block").to_pylist(), asked.column("parts"), strict=True):
                wanted = _opened(parts[0].as_py(), np.uint64)
                got = np.zeros((len(wanted), width), np.uint32)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                    hit = keys[at] == wanted
                    got[hit] = values[at[hit]]
                yield block, shard, [got]

    def run(asked: pa.Table, known: pa.Table) -> pa.Table:
        return _whole(told(asked, known))

    return run


def ratios(n: np.ndarray, words: np.ndarray, first: np.ndarray, word: np.ndarray, totals: np.ndarray, model: int) -> np.ndarray:
    """The log-likelihood ratio of each pair: n its counts, first and word the numbers of its words among words.

    model 0: of all rows, 1: of all but the calibration's. totals: counts (4), different pairs (2), words by class (4), words (2)."""
    seen = words[:, 12 + model].astype(float)
    shared = (seen + FILL) / (totals[4 + model] + FILL * (totals[10 + model] + 1))
    single, of = [], (2 * model, 2 * model + 1)
    for c in of:
        total = max(totals[c], 1.0)
        single.append((np.maximum(words[:, 8 + c] - DISCOUNT, 0) + max(DISCOUNT * totals[6 + c], DISCOUNT) * shared) / total)
    out = np.empty(len(n))
    for at in range(0, len(n), PAIRS):
        part = slice(at, at + PAIRS)
        a, b, own = words[first[part]], word[part], n[part]
        # How much likelier the pair makes its word in either class: common to both, so that a rare pair isn't evidence by itself.
        after = a[:, 2 * model : 2 * model + 2].sum(1, dtype=float)
        both = np.maximum(own[:, 2 * model : 2 * model + 2].sum(1, dtype=float) - DISCOUNT, 0)
        lift = np.where(after > 0, (both + DISCOUNT * a[:, 14 + model] * shared[b]) / np.maximum(after, 1) / shared[b], 1)
        chance = []
        for c, lower in zip(of, single, strict=True):
            pairs, different = a[:, c].astype(float), a[:, 4 + c]
            chance.append((np.maximum(own[:, c] - DISCOUNT, 0) + (DISCOUNT * different + STRENGTH) * (lower[b] * lift)) / (pairs + STRENGTH))
        out[part] = np.log(chance[1] / chance[0])
    return out


def _features(shards: int, totals: np.ndarray):
    """rid, doc_id, held_out, kind and the features by either model of a block's texts."""

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group.column("shard").to_pylist(), group.column("parts").to_pylist(), strict=True), key=lambda r: r[0])
        ids, single, numbers = (_opened(x, *k) for x, k in zip(rows[0][1], ((np.int64, 6), (np.uint64,), (np.uint32,)), strict=True))
        block = Block(single, numbers, ids[:, 5], shards)
        n = _unpacked([p for s, p in rows if 0 <= s < shards], 0, np.uint32, 4)
        words = _unpacked([p for s, p in rows if s >= shards], 0, np.uint32, WIDTH)
        del rows
        ratio = [ratios(n, words, block.first, block.word, totals, 0), np.zeros(len(n))]
        # The other model's are asked for by the pairs of calibration rows alone.
        asked = np.zeros(len(n), bool)
        asked[block.numbers[np.repeat(ids[:, 4] >= 2, ids[:, 5])]] = True
        ratio[1][asked] = ratios(n[asked], words, block.first[asked], block.word[asked], totals, 1)
        ends = np.cumsum(ids[:, 5])
        out = np.zeros((len(ids), 4))
        for k, (hi, length, kind) in enumerate(zip(ends, ids[:, 5], ids[:, 4], strict=True)):
            for m in (0, 1) if kind >= 2 else (0,):
                if length:
                    r = ratio[m][block.numbers[hi - length : hi]]
                    top = min(TOP, length)
                    out[k, 2 * m : 2 * m + 2] = r.mean(), np.partition(r, -top)[-top:].sum() / TOP
        del block, n, words, numbers, single, ratio
        let_go()
        return pa.table({"doc_id": pa.array(ids[:, 1], mask=ids[:, 2].astype(bool)), "held_out": ids[:, 3].astype(bool), "kind": ids[:, 4].astype(np.int32)} | {f"x{k}": out[:, k] for k in range(4)})

    return run


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, with a small ridge."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.array([np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)), 0.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + 1e-2 * w
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(3)
        step = np.linalg.solve(h, g)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(known: DataFrame, shards: int) -> tuple[DataFrame, np.ndarray]:
    """The packed tables of pairs and words of known (text, kind: toxic, and 2 more for calibration rows), and their totals."""
    counted = known.select("text", "kind").mapInArrow(_counted(shards), _PACKED)
    pairs = written(counted.groupBy("shard").applyInArrow(_merged(shards), _PACKED), "pairs")
    words = written(pairs.where(F.col("shard") >= shards).groupBy("shard").applyInArrow(_merged_words, _PACKED), "words")
    totals = np.zeros(12)
    for row in words.select(F.col("parts")[2].alias("totals")).collect():
        totals += _opened(row.totals, np.float64)
    return pairs.where(F.col("shard") < shards).unionByName(words.withColumn("parts", F.slice("parts", 1, 2))), totals


def _wave(waves: int) -> Column:
    """A row's wave, by its number: runs of rows take turns, each file's from another one on."""
    return F.pmod(F.shiftright("rid", RUN_BITS) + F.shiftright("rid", ROW_BITS), F.lit(waves))


def features(docs: DataFrame, model: DataFrame, totals: np.ndarray, shards: int) -> DataFrame:
    """doc_id, held_out, kind and the features by either model of each row of docs (rid, doc_id, text, held_out, kind), written."""
    asked = docs.mapInArrow(_asked(shards, True), _PACKED)
    answers = asked.groupBy("shard").cogroup(model.groupBy("shard")).applyInArrow(_answered(shards), _PACKED)
    texts = docs.mapInArrow(_asked(shards, False), _PACKED)
    return written(texts.unionByName(answers).groupBy("block").applyInArrow(_features(shards, totals), "doc_id long, held_out boolean, kind int, x0 double, x1 double, x2 double, x3 double"), "features")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    docs = rows_of(docs, "doc_id", "text")
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = remainder(5)
    told = only(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null").where(part != 0).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sizes = told.agg(F.count("*").alias("all"), F.count(F.when(part == 1, 1)).alias("fold")).first()
    share = min(1.0, CALIBRATION / max(sizes["fold"], 1))
    bounded = (part == 1) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    told = told.withColumn("kind", F.col("toxic") + F.when(bounded, 2).otherwise(0)).select("doc_id", "kind")
    # Labels are broadcast to the texts up to LABELS rows; beyond, texts are shuffled to them, and written to keep their order.
    docs = docs.join(F.broadcast(told) if sizes["all"] <= LABELS else told.hint("merge"), "doc_id", "left")
    docs = docs.select("rid", "doc_id", "text", F.coalesce(part == 0, F.lit(False)).alias("held_out"), "kind")
    if sizes["all"] > LABELS:
        docs = written(docs, "labelled")
    known = docs.where("kind is not null")
    rows = {r["kind"]: r["n"] for r in docs.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    ordinary, toxic = rows.get(0, 0) + rows.get(2, 0), rows.get(1, 0) + rows.get(3, 0)
    base = toxic / max(ordinary + toxic, 1)
    if not ordinary or not toxic:
        return docs.select("doc_id", "held_out", F.lit(base).alias("score"), F.lit(int(base >= 0.5)).alias("predicted"))
    waves = min(WAVES, -(-sum(rows.values()) // WAVE))
    with tidied() as keep, swept(docs.sparkSession), slim(docs.sparkSession):
        model, totals = train(known, shards)
        got = reduce(DataFrame.unionByName, [keep(features(docs.where(_wave(waves) == k), model, totals, shards)) for k in range(waves)])
    curve = np.array([np.log(base / (1 - base)), 1.0, 1.0])
    if rows.get(0) and rows.get(1) and (rows.get(2) or rows.get(3)):
        told = got.where("kind >= 2").select("x2", "x3", (F.col("kind") - 2).alias("y")).toArrow()
        curve = fit(np.column_stack([told.column("x2").to_numpy(), told.column("x3").to_numpy()]), told.column("y").to_numpy().astype(float))
    z = F.lit(float(curve[0])) + F.lit(float(curve[1])) * F.col("x0") + F.lit(float(curve[2])) * F.col("x1")
    score = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
    return got.select("doc_id", "held_out", score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), table(spark, sf_dir, "labels"))

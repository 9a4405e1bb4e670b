"""Packing documents into sequences by best-fit decreasing.

A document's ids end in a separator. Overlong documents are first cut into full windows; what is left of each goes,
longest first, into the tightest open window that takes it, found in a segment tree over remaining capacities.
Pieces may be cut freely, so at the end of a block of remainders the emptiest windows are dealt out into
the others' gaps; one window at most stays open and joins the next block. The last one of a partition is cut by the binary digits of its length,
so that its parts are powers of two and need no padding.

A partition packs its own rows in blocks of bounded size: no shuffle, and memory that doesn't grow with the input. Rows
keep their scan order, so a task that runs again packs alike.

Defined results: null and empty texts are a separator alone; repeated rows and rows that share a doc_id are
packed each, whole; a null doc_id stays null; an empty table gives an empty result; texts of any length are tokenised whole.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import only

WINDOW = 1024
#: Ids of remainders that are packed at once (16 MB).
BLOCK = 4_000_000
#: Words whose ids a worker keeps.
KEPT = 400_000
#: Between a character that isn't white space and a blank.
BORDER = re.compile(r"(?<=\S)(?= )")
LATIN = "\u0250"


def byte_letters() -> dict[int, str]:
    """Of each byte the printable character that stands for it in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}


class Tokens:
    """Ids as the tokenizers library gives them, words' ids kept for later.

    A blank after a character that isn't white space always begins a match of the pre-tokeniser's pattern, so text
    between two such places has the same ids wherever it stands. The library's own model merges all words: those of Latin characters alone
    (below U+0250, whose classes no version of Unicode changes) match by match of the pattern, each match once while it is kept; others go through the whole tokenizer.
    Words that are kept neither are empty nor end in white space, so a text with white space before a blank has a word that isn't kept."""

    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.matches = self.tokenizer.model, regex.compile(pattern).findall
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = byte_letters()
        #: By what follows a blank: the ids of both; those kept now, and those before, of which the ones that are used again are kept.
        self.kept: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        #: Of matches without a blank their ids.
        self.parts: dict[str, bytes] = {}

    def _merged(self, match: str) -> bytes:
        if match.isascii() and match.isprintable():
            own = match.replace(" ", self.letters[32])
        else:
            own = match.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(own)]).tobytes()

    def _match(self, match: str) -> bytes:
        blank = match[0] == " "
        held, key = (self.kept, match[1:]) if blank else (self.parts, match)
        ids = held.get(key)
        if ids is None:
            ids = blank and self.before.get(key) or self._merged(match)
            if not blank or key and not key[-1].isspace():
                held[key] = ids
        return ids

    def _word(self, word: str) -> bytes:
        if max(word, default="") < LATIN:
            return b"".join(map(self._match, self.matches(word)))
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _keep(self, words: set[str]) -> None:
        """words, which follow a blank, neither are empty nor have white space before a blank or at their end, are kept."""
        kept, mixed = self.kept, []
        if len(kept) + len(self.parts) + len(words) > KEPT // 2:
            self.before, self.kept, self.parts = kept, {}, {}
            kept = self.kept
        latin, blank, merge, before = max("".join(words)) < LATIN, self.letters[32], self.model.tokenize, self.before.get
        for word in words:
            ids = before(word)
            if ids is not None:
                kept[word] = ids
            elif not latin and max(word) >= LATIN:
                kept[word] = self._word(" " + word)
            elif not word.isalpha():
                mixed.append(word)
            elif word.isascii():  # one match
                kept[word] = array("I", [t.id for t in merge(blank + word)]).tobytes()
            else:
                kept[word] = self._merged(" " + word)
        # Each blank here begins a word and a match.
        at, ids = -1, []
        for match in self.matches("".join([" " + word for word in mixed])):
            if match[0] == " ":
                if ids:
                    kept[mixed[at]] = b"".join(ids)
                at, ids = at + 1, []
            ids.append(self._match(match))
        if ids:
            kept[mixed[at]] = b"".join(ids)

    def ids(self, text: str) -> np.ndarray:
        """Special tokens' strings count as the library's default has them."""
        if any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        if not text:
            return np.zeros(0, np.uint32)
        first, *after = text.split(" ")
        got = list(map(self.kept.get, after))
        if None in got or not first or first[-1].isspace():
            new = {p for p, ids in zip(after, got, strict=True) if ids is None}
            if not first or first[-1].isspace() or any(not p or p[-1].isspace() for p in new):
                parts = BORDER.split(text)
                return np.frombuffer(b"".join(map(self._word, parts)), np.uint32)
            self._keep(new)
            kept = self.kept
            got = [ids or kept[p] for p, ids in zip(after, got, strict=True)]
        return np.frombuffer(b"".join([self._word(first), *got]), np.uint32)


class Capacities:
    """A segment tree over remaining capacities 0..size that finds the least one not below a given need."""

    def __init__(self, size: int):
        self.leaves = 1
        while self.leaves <= size:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(self.leaves)]

    def add(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        i = room + self.leaves
        while i:
            self.count[i] += 1
            i //= 2

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, window) of the tightest window with room for need; the window leaves the tree."""
        i = need + self.leaves
        while not self.count[i]:
            while i & 1:  # up to the first subtree on the right
                i //= 2
            if not i:
                return None
            i += 1
        while i < self.leaves:
            i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.leaves
        window = self.windows[room].pop()
        while i:
            self.count[i] -= 1
            i //= 2
        return room, window


def best_fit(pieces: list[tuple], size: int) -> list[list[tuple]]:
    """pieces (document, start, ids) in windows of size, by best-fit decreasing; ties keep their order."""
    tree, windows = Capacities(size), []
    for piece in sorted(pieces, key=lambda p: -len(p[2])):
        n = len(piece[2])
        room, at = tree.take(n) or (size, len(windows))
        if at == len(windows):
            windows.append([])
        windows[at].append(piece)
        if room > n:
            tree.add(room - n, at)
    return windows


def close_gaps(windows: list[list[tuple]], size: int) -> tuple[list[list[tuple]], list[tuple]]:
    """Full windows, and the pieces of one that isn't: pieces of the emptiest windows are cut to fill the others."""
    used = [sum(len(p[2]) for p in w) for w in windows]
    full = [w for w, n in zip(windows, used, strict=True) if n == size]
    open_ = sorted(((n, w) for w, n in zip(windows, used, strict=True) if n < size), key=lambda x: x[0])
    lo, hi = 0, len(open_) - 1
    while lo < hi:
        n, target = open_[hi]
        while n < size and lo < hi:
            given = open_[lo][1]
            doc, start, ids = given.pop()
            k = min(len(ids), size - n)
            target.append((doc, start, ids[:k]))
            n += k
            if k < len(ids):
                given.append((doc, start + k, ids[k:]))
            elif not given:
                lo += 1
        if n == size:
            full.append(target)
            hi -= 1
        else:
            open_[hi] = (n, target)
    return full, open_[lo][1] if open_ and lo <= hi else []


def powers(pieces: list[tuple]) -> list[list[tuple]]:
    """pieces in windows whose lengths are distinct powers of two."""
    left, out = sum(len(p[2]) for p in pieces), []
    pieces = pieces[::-1]
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        out.append([])
        while room:
            doc, start, ids = pieces.pop()
            k = min(room, len(ids))
            out[-1].append((doc, start, ids[:k]))
            if k < len(ids):
                pieces.append((doc, start + k, ids[k:]))
            room -= k
    return out


def packer(tokens, size: int = WINDOW, block: int = BLOCK, separator: int = 0):
    """A function over (doc_id, text) batches that yields batches of pieces."""

    def run(batches):
        part, next_id = TaskContext.get().partitionId() if TaskContext.get() else 0, 0
        source = tokens()
        rest: list[tuple] = []
        held = 0

        def told(windows):
            nonlocal next_id
            rows = []
            for w in windows:
                at = 0
                for (doc, total), start, ids in w:
                    rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, (part << 40) + next_id, at))
                    at += len(ids)
                next_id += 1
            names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
            return pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 7)], names=list(names))

        for batch in batches:
            full = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(source.ids(text.as_py() or ""), np.uint32(separator))
                key = (doc, len(ids))
                cut = len(ids) - len(ids) % size
                full += [[(key, i, ids[i : i + size])] for i in range(0, cut, size)]
                if cut < len(ids):
                    rest.append((key, cut, ids[cut:].copy()))
                    held += len(ids) - cut
                if held >= block:
                    done, rest = close_gaps(best_fit(rest, size), size)
                    held = sum(len(p[2]) for p in rest)
                    full += done
                if len(full) > 50_000:
                    yield told(full)
                    full = []
            yield told(full)
        done, rest = close_gaps(best_fit(rest, size), size)
        yield told(done + powers(rest))

    return run


def pack(docs: DataFrame, tokenizer_path: str, pattern: str, size: int = WINDOW, separator: int = 0) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return only(docs, "doc_id", "text").mapInArrow(packer(lambda: _loaded(tokenizer_path, pattern), size, separator=separator), schema)


_tokens: dict[str, Tokens] = {}


def _loaded(path: str, pattern: str) -> Tokens:
    if path not in _tokens:
        _tokens[path] = Tokens(path, pattern)
    return _tokens[path]


def op3_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)

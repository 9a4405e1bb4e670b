"""Byte-level BPE encoding and decoding as a monoid tree reduction.

Encoding halves a text until leaves are short, encodes the leaves, and joins neighbours by encoding a window about
their boundary anew. The window grows until both its ends are places that no match of the pattern can span
(a character that isn't white space, then a blank, tab or line feed): tokens outside stay. Where a window finds no such place,
it is cut into the pattern's matches, and a long match is reduced in the same way on its bytes: there a window is
right as soon as the pairs of tokens over its two ends each encode to themselves, since a token sequence
is the encoding of its bytes exactly if each adjacent pair is. Decoding concatenates up the tree.

Defined results: null text counts as empty (no tokens); repeated rows and repeated or null doc_id give a row
each; an empty table gives an empty result; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only

#: Characters that a leaf has at most; most documents are longer, and so are joined from several.
LEAF = 512
#: Window each side to begin with, and the one from which the matches themselves are reduced.
WINDOW, WIDE = 64, 8_192
#: Bytes of a match from which it is reduced as a tree.
LONG = 4_096
_BLANK = " \t\n\r"


class Encoder:
    """ranks: bytes -> id; pattern: what splits text before merging."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF, window: int = WINDOW, wide: int = WIDE, long: int = LONG):
        import tiktoken

        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes = dict(zip(ranks.values(), ranks.keys(), strict=True))
        self.pattern, self.leaf, self.window, self.wide, self.long = pattern, leaf, window, wide, long

    @classmethod
    def load(cls, path: str, pattern: str) -> Encoder:
        with open(path, "rb") as f:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}, pattern)

    # -- texts

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.leaf:
            return self.core.encode_ordinary(text)
        mid = len(text) // 2
        return self._join(text, mid, self.encode(text[:mid]), self.encode(text[mid:]))

    def _join(self, text: str, mid: int, left: list[int], right: list[int]) -> list[int]:
        lo, hi = self._place(text, mid, -1), self._place(text, mid, 1)
        between = text[lo:hi]
        ids = self.core.encode_ordinary(between) if len(between) <= self.wide else self._by_match(between)
        a, b = self._drop(left[::-1], len(text[lo:mid].encode())), self._drop(right, len(text[mid:hi].encode()))
        return left[: len(left) - a] + ids + right[b:]

    def _place(self, text: str, mid: int, way: int) -> int:
        """The nearest place before or after mid that no match spans; the text's end if there is none."""
        size = self.window
        while True:
            lo, hi = (max(1, mid - size), mid) if way < 0 else (max(1, mid), min(len(text), mid + size))
            for i in reversed(range(lo, hi)) if way < 0 else range(lo, hi):
                if text[i] in _BLANK and not text[i - 1].isspace():
                    return i
            if lo == 1 and way < 0:
                return 0
            if hi == len(text) and way > 0:
                return len(text)
            size *= 4

    def _drop(self, ids, n: int) -> int:
        """How many of ids make up n bytes."""
        k = 0
        while n > 0:
            n -= len(self.bytes[ids[k]])
            k += 1
        assert n == 0, "a window ends within a token"
        return k

    def _by_match(self, text: str) -> list[int]:
        import regex

        out: list[int] = []
        for m in regex.finditer(self.pattern, text):
            out += self.piece(m.group().encode())
        return out

    # -- one match's bytes

    def piece(self, data: bytes) -> list[int]:
        if len(data) <= self.long:
            return self.core._encode_single_piece(data)
        mid = len(data) // 2
        return self._join_piece(self.piece(data[:mid]), self.piece(data[mid:]))

    def _join_piece(self, left: list[int], right: list[int]) -> list[int]:
        n = 4
        while True:
            a, b = max(0, len(left) - n), min(len(right), n)
            ids = self.core._encode_single_piece(b"".join(map(self.bytes.__getitem__, left[a:] + right[:b])))
            if (a == 0 or self._stable(left[a - 1], ids[0])) and (b == len(right) or self._stable(ids[-1], right[b])):
                return left[:a] + ids + right[b:]
            n *= 2

    def _stable(self, x: int, y: int) -> bool:
        return self.core._encode_single_piece(self.bytes[x] + self.bytes[y]) == [x, y]

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join(map(self.bytes.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One a worker: the vocabulary is installed with the library on every machine, so only its path travels."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder.load(path, pattern)
    return _encoders[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row, and the ids themselves on demand."""

    def run(batches):
        coder = encoder(path, pattern)
        text_of: dict[int, str] = {}
        for batch in batches:
            out = []
            for value in batch.column(1):
                ids = coder.encode(value.as_py() or "")
                if not text_of:
                    text_of.update((i, str(i)) for i in coder.bytes)
                out.append((len(ids), hashlib.sha256(" ".join([text_of[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest(), ids if with_ids else None))
            n, a, b, ids = zip(*out, strict=True) if out else ((), (), (), ())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.record_batch(columns + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names=names + ["ids"] * with_ids)

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def decode_documents(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text of rows doc_id, ids."""

    def run(batches):
        coder = encoder(path, pattern)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([coder.decode(x or []).decode(errors="replace") for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return only(rows, "doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)

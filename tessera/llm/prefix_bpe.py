"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

For every byte prefix of a piece exactly one token can end its encoding. With these last tokens stored, the encoding of
any prefix is read off backwards, appending bytes only extends the table, and after an edit the table is recomputed from
the edit to where it meets the old one again. A token can follow the last token of the prefix before it if merging the
two, from their parts up, would never have crossed the border between them: `compatible` checks that by undoing merges
on both sides, the later one first, and looking for a merge across the border that would have come before it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_rows, chunks, col, documents, texts_of

#: Pieces whose ids are kept in a Python worker; twice as many at most.
CACHED_PIECES = 500_000


class Vocabulary:
    """Ranks of byte strings, and for each of several bytes the two tokens that its last merge joins."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.known: dict[int, bool] = {}
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1 and (parts := self._parts(token, i)):
                self.halves[i] = parts
                self.joined[parts] = i
        # tokens that merges lead to: the others can only be whole pieces
        self.made = {b: i for b, i in ranks.items() if len(b) == 1 or i in self.halves}

    def _parts(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The last two parts when only merges before this token's are applied; None if they don't lead to two."""
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 2:
            at = [(self.ranks.get(a + b, rank), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))]
            best, k = min(at)
            if best >= rank:
                return None
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return (self.ranks[parts[0]], self.ranks[parts[1]]) if all(p in self.ranks for p in parts) else None

    def compatible(self, left: int, right: int) -> bool:
        """Whether left and right stand side by side in the encoding of their joined bytes."""
        known = self.known.get(left << 32 | right)
        if known is None:
            if len(self.known) > 1_000_000:
                self.known.clear()
            known = self.known[left << 32 | right] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        # bound: merges across the border count only if they come before the merge that was undone last
        bound = float("inf")
        while True:
            across = self.joined.get((left, right))
            if across is not None and across < bound:
                return False
            in_left, in_right = left in self.halves, right in self.halves
            if not in_left and not in_right:
                return True
            # the merge that came later is undone first; of equal ones the right one, as merges go from the left
            if in_left and (not in_right or left > right):
                bound, left = left, self.halves[left][1]
            else:
                # a merge across of the same rank lies further left, and so comes before
                bound, right = right + 1, self.halves[right][0]


class Prefixes:
    """The last tokens of all prefixes of a byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def _last(self, end: int) -> int:
        data, last, made, known = self.data, self.last, self.vocabulary.made.get, self.vocabulary.known.get
        for start in range(max(0, end - self.vocabulary.longest), end):
            token = made(data[start:end])
            if token is not None:
                if not start:
                    return token
                before = last[start - 1]
                fits = known(before << 32 | token)
                if fits or (fits is None and self.vocabulary.compatible(before, token)):
                    return token
        raise ValueError(f"byte {data[end - 1]} is not in the vocabulary")

    def append(self, data: bytes) -> None:
        begin = len(self.data)
        self.data += data
        for end in range(begin + 1, len(self.data) + 1):
            self.last.append(self._last(end))

    def replace(self, start: int, end: int, data: bytes) -> int:
        """Puts data in the place of [start, end); returns how many entries were computed anew."""
        old, tail = self.last, self.data[end:]
        shift = start + len(data) - end
        self.data = self.data[:start] + data + tail
        self.last = old[:start]
        met = 0
        while len(self.last) < len(self.data):
            at = len(self.last)
            self.last.append(self._last(at + 1))
            # an entry depends on the bytes and entries that its longest token can reach: that many equal ones settle the rest
            met = met + 1 if at >= start + len(data) and self.last[at] == old[at - shift] else 0
            if met >= self.vocabulary.longest:
                done = len(self.last) - start
                self.last += old[at - shift + 1 :]
                return done
        return len(self.last) - start

    def ids(self, end: int | None = None) -> list[int]:
        at, out = len(self.data) if end is None else end, []
        while at:
            out.append(self.last[at - 1])
            at -= len(self.vocabulary.bytes_of[out[-1]])
        return out[::-1]


def encode_piece(vocabulary: Vocabulary, piece: bytes) -> list[int]:
    """A piece that is a token is that token, also if no merges lead to it."""
    whole = vocabulary.ranks.get(piece)
    return [whole] if whole is not None else Prefixes(vocabulary, piece).ids()


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class _Pieces(dict):
    """Decimal ids, joined by commas, of the pieces seen before; beyond CACHED_PIECES the older half goes."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.before = vocabulary, {}

    def __missing__(self, piece: str) -> str:
        ids = self.before.get(piece)
        if ids is None:
            ids = ",".join(map(str, encode_piece(self.vocabulary, piece.encode())))
        if len(piece) <= 64:
            if len(self) >= CACHED_PIECES:
                self.before = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pieces = _Pieces(Vocabulary(ranks))
        self.pattern = regex.compile(pattern)
        self.bytes_of = {str(i): b for b, i in ranks.items()}

    def encode(self, text: str) -> str:
        """Decimal ids joined by commas."""
        return ",".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(","))) if ids else b""


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by commas), decoded (bytes) of every whole text.

    Null texts are empty: no ids. Rows are independent, so ties and repeated rows each give a row; other columns are ignored.
    """
    batch_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in chunks(batches):
            ids = [c.encode(t) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays(
                [col(batch, "doc_id"), pa.array([x.count(",") + 1 if x else 0 for x in ids], pa.int64()), pa.array(ids, pa.string()), pa.array([c.decode(x) for x in ids], pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids string, decoded binary")


def op8_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

"""Canonical length-limited Huffman codes over token ids, packed and unpacked by numpy.

A shard is a byte string: a header (magic, ids, documents, ids a block, first position), one bit offset for each block
of ids (the checkpoints), the number of ids of each document, and the bit stream. Any block can be decoded by itself
from its checkpoint; decode() walks all blocks of a shard side by side through one table.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"THF1"
#: Longest code in bits; the decoding table has 2**MAX_BITS entries. Vocabularies have far fewer ids than that.
MAX_BITS = 18
#: Ids in an independent block.
BLOCK = 512
_HEADER = struct.Struct("<4sIQQQ")


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most max_bits for the ids with counts above 0 (package-merge); 0 for the others."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n <= 1:
        lengths[used] = 1
        return lengths
    if n > 1 << max_bits:
        raise ValueError(f"{n} ids do not fit in codes of {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.float64)
    packages, levels = np.zeros(0), []
    for _ in range(max_bits):
        items = np.concatenate([leaf, packages])
        rank = np.argsort(items, kind="stable")
        levels.append(rank < n)
        ranked = items[rank]
        packages = ranked[0 : len(ranked) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * n - 2
    bits = np.zeros(n, np.int64)
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        bits[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[order] = bits
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: codes of one length are consecutive in the order of ids."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code, before = 0, int(lengths[order[0]]) if len(order) else 0
    for length in np.unique(lengths[order]):
        same = order[lengths[order] == length]
        code <<= int(length) - before
        codes[same] = np.arange(code, code + len(same), dtype=np.uint64)
        code, before = code + len(same), int(length)
    return codes


def table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """id << 5 | code length for every value of the next bits, and how many bits that is."""
    bits = max(1, int(lengths.max(initial=0)))
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    entries = (order.astype(np.uint32) << np.uint32(5)) | lengths[order].astype(np.uint32)
    filled = np.repeat(entries, (1 << (bits - lengths[order].astype(np.int64))))
    out = np.zeros(1 << bits, np.uint32)
    out[: len(filled)] = filled
    return out, bits


def encode(ids: np.ndarray, doc_lengths: np.ndarray, first: int, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    n = len(ids)
    size = lengths[ids].astype(np.int64)
    offsets = np.cumsum(size) - size
    total = int(size.sum())
    words = np.zeros((total + 63) // 64 + 2, np.uint64)
    if n:
        word, room = offsets >> 6, 64 - (offsets & 63) - size
        code = codes[ids]
        high = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
        begins = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[begins]] = np.bitwise_or.reduceat(high, begins)
        over = np.flatnonzero(room < 0)
        words[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
    marks = offsets[::BLOCK].astype("<u8")
    head = _HEADER.pack(MAGIC, BLOCK, n, len(doc_lengths), first)
    return head + marks.tobytes() + doc_lengths.astype("<u8").tobytes() + words.astype(">u8").tobytes()


def header(payload: bytes) -> tuple[int, int, int, int]:
    """Ids a block, ids, documents, position of the first id."""
    magic, block, n, docs, first = _HEADER.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a shard of ids")
    return block, n, docs, first


def decode(payload: bytes, decoding: tuple[np.ndarray, int]) -> tuple[np.ndarray, np.ndarray, int]:
    """The ids, the number of ids of each document, and the position of the first id."""
    lookup, bits = decoding
    block, n, docs, first = header(payload)
    blocks = -(-n // block)
    marks = np.frombuffer(payload, "<u8", blocks, _HEADER.size).astype(np.int64)
    at = _HEADER.size + 8 * blocks
    doc_lengths = np.frombuffer(payload, "<u8", docs, at).astype(np.int64)
    stream = np.frombuffer(payload, np.uint8, -1, at + 8 * docs)
    # the 32 bits from each 16-bit boundary on; a code of at most 18 bits never needs more than 33 - 16 of them
    half = stream.view(">u2").astype(np.uint64)
    wide = (half[:-2] << np.uint64(32)) | (half[1:-1] << np.uint64(16)) | half[2:]
    out = np.zeros((block, blocks), np.uint32)
    where = marks
    mask = np.uint64((1 << bits) - 1)
    lanes = blocks
    for k in range(min(block, n)):
        if k == n - (blocks - 1) * block and blocks:
            lanes = blocks - 1  # the last block is the only short one
            where = where[:lanes]
            if not lanes:
                break
        shift = (48 - bits - (where & 15)).astype(np.uint64)
        entry = lookup[(wide[where >> 4] >> shift) & mask]
        out[k, :lanes] = entry >> np.uint32(5)
        where = where + (entry & np.uint32(31))
    return out.T.reshape(-1)[:n], doc_lengths, first

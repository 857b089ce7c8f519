"""Counting quotient filters over 64-bit fingerprints: built per partition, merged without loss by sorted remainders.

A fingerprint splits into a quotient (its high bits) and a remainder. Remainders of one quotient form a sorted run that starts at
the quotient's slot or right after the run before it (Robin Hood order). Two bit vectors locate the runs: `occupied` marks quotients
that have a run, `runend` marks the last slot of each run. Counts over one are kept beside the slots. As quotient and remainder
together are the whole fingerprint, decoding gives back exactly the multiset that went in.
"""

from __future__ import annotations

import struct

import numpy as np

HEAD = struct.Struct("<BIII")


def build(fingerprints: np.ndarray, counts: np.ndarray | None = None) -> bytes:
    """Encode a multiset of unsigned 64-bit fingerprints."""
    values, inverse = np.unique(fingerprints.astype(np.uint64), return_inverse=True)
    counts = np.bincount(inverse, weights=counts, minlength=len(values)).astype(np.uint32) if len(values) else np.zeros(0, np.uint32)
    bits = min(32, max(1, int(np.ceil(np.log2(len(values) / 0.75 + 1)))))
    quotient = (values >> np.uint64(64 - bits)).astype(np.int64)
    order = np.arange(len(values))
    slot = order + np.maximum.accumulate(quotient - order) if len(values) else order
    size = int(slot[-1]) + 1 if len(values) else 0
    occupied, runend, many = np.zeros(1 << bits, bool), np.zeros(size, bool), np.zeros(size, bool)
    occupied[quotient] = True
    runend[slot[np.append(quotient[1:] != quotient[:-1], True)] if len(values) else slot] = True
    many[slot] = counts > 1
    width = (64 - bits + 7) // 8
    slots = np.zeros(size, "<u8")
    slots[slot] = values & np.uint64((1 << (64 - bits)) - 1)
    body = slots.view(np.uint8).reshape(size, 8)[:, :width].tobytes()
    return HEAD.pack(bits, len(values), size, int((counts > 1).sum())) + np.packbits(occupied).tobytes() + np.packbits(runend).tobytes() + np.packbits(many).tobytes() + body + counts[counts > 1].astype("<u4").tobytes()


def decode(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints in ascending order, and how often each was put in."""
    bits, n, size, n_many = HEAD.unpack_from(data)
    at = HEAD.size

    def vector(length: int) -> np.ndarray:
        nonlocal at
        used = (length + 7) // 8
        found = np.unpackbits(np.frombuffer(data, np.uint8, used, at), count=length).astype(bool)
        at += used
        return found

    occupied, runend, many = vector(1 << bits), vector(size), vector(size)
    width = (64 - bits + 7) // 8
    slots = np.zeros((size, 8), np.uint8)
    slots[:, :width] = np.frombuffer(data, np.uint8, size * width, at).reshape(size, width)
    slots = slots.reshape(-1).view("<u8")
    above = np.frombuffer(data, "<u4", n_many, at + size * width)
    quotient, end = np.flatnonzero(occupied), np.flatnonzero(runend)
    start = np.maximum(quotient, np.concatenate(([0], end[:-1] + 1))) if len(end) else end
    length = end - start + 1
    which = np.repeat(np.arange(len(end)), length)
    used = np.arange(n) - np.repeat(np.cumsum(length) - length, length) + start[which] if n else np.zeros(0, np.int64)
    values = (quotient[which].astype(np.uint64) << np.uint64(64 - bits)) | slots[used]
    counts = np.ones(n, np.int64)
    counts[many[used]] = above
    return values, counts


def merge(filters: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all filters in ascending order with their summed counts: runs of equal remainders meet in sorted order."""
    pairs = [decode(f) for f in filters]
    values = np.concatenate([v for v, _ in pairs]) if pairs else np.zeros(0, np.uint64)
    counts = np.concatenate([c for _, c in pairs]) if pairs else np.zeros(0, np.int64)
    order = np.argsort(values, kind="stable")  # timsort: the inputs are sorted runs
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    return values[first], np.add.reduceat(counts, first) if len(first) else counts

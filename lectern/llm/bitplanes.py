"""Hamming distances of many fingerprints at once, on bit planes that stand vertically."""

from __future__ import annotations

import numpy as np

#: Fingerprints (lanes) in a block: the bits of one word of a plane.
LANES = 64
#: Bit planes between two looks at which blocks can be abandoned.
STRIDE = 8
#: Blocks that are compared in one go, which bounds memory.
AT_ONCE = 1 << 16
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def planes_of(fp: np.ndarray) -> np.ndarray:
    """(64, words): word k of plane b holds bit b of fingerprints 64k to 64k+63; zeros fill the last word."""
    padded = np.zeros(-(-len(fp) // LANES) * LANES, "<u8")
    padded[: len(fp)] = fp
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def lanes_between(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A word for each pair of numbers with the bits low to high - 1 set, both cut to 0..64."""
    below = lambda n: np.where(n >= LANES, ALL, (np.uint64(1) << np.clip(n, 0, LANES - 1).astype(np.uint64)) - np.uint64(1))
    return below(np.maximum(high, 0)) & ~below(np.maximum(low, 0))


def exceeding(planes: np.ndarray, one: np.ndarray, word: np.ndarray, dead: np.ndarray, radius: int) -> np.ndarray:
    """For each block (one fingerprint against one word of lanes): the lanes that differ in more than radius bits.

    Each plane, turned over where the fingerprint has that bit, is added to the distances of all lanes through a
    carry-save counter of a few bit planes with a sticky overflow. Blocks whose lanes all exceed are abandoned: none
    of their further planes is read. dead: lanes that count as exceeding from the start.
    """
    size = max(1, radius.bit_length())
    found, alive = dead.copy(), np.flatnonzero(dead != ALL)
    counter, over = [np.zeros(len(alive), np.uint64) for _ in range(size)], dead[alive]
    for b in range(64):
        turned = np.uint64(0) - (one[alive] >> np.uint64(b) & np.uint64(1))
        carry = planes[b][word[alive]] ^ turned
        for i in range(size):
            counter[i], carry = counter[i] ^ carry, counter[i] & carry
        over = over | carry
        if b % STRIDE == STRIDE - 1:
            more, equal = over.copy(), ~over
            for i in reversed(range(size)):  # counter > radius, from the highest bit
                if radius >> i & 1:
                    equal &= counter[i]
                else:
                    more |= equal & counter[i]
                    equal &= ~counter[i]
            found[alive] = more
            keep = more != ALL
            if not keep.all():
                alive, over, counter = alive[keep], over[keep], [c[keep] for c in counter]
                if not len(alive):
                    break
    return found


def close_pairs(fp: np.ndarray, first: np.ndarray, end: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) with first[i] <= j < end[i] whose fingerprints differ in at most radius bits."""
    planes = planes_of(fp)
    start = first // LANES
    blocks = np.where(end > first, (end - 1) // LANES - start + 1, 0)
    total = np.cumsum(blocks)
    rows, lanes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, int(total[-1]) if len(total) else 0, AT_ONCE):
        nth = np.arange(at, min(at + AT_ONCE, int(total[-1])))
        i = np.searchsorted(total, nth, side="right")
        word = start[i] + nth - (total[i] - blocks[i])
        own = lanes_between(first[i] - word * LANES, end[i] - word * LANES)
        near = ~exceeding(planes, fp[i], word, ~own, radius)
        hit = np.flatnonzero(near)
        bits = np.unpackbits(near[hit].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        block, lane = np.nonzero(bits)
        rows.append(i[hit[block]])
        lanes.append(word[hit[block]] * LANES + lane)
    return np.concatenate(rows), np.concatenate(lanes)


def within(fp: np.ndarray, radius: int, one: int = 0) -> np.ndarray:
    """Which of the fingerprints differ from one in at most radius bits."""
    query = np.concatenate((fp, np.array([one], np.uint64)))
    first, end = np.zeros(len(query), np.int64), np.zeros(len(query), np.int64)
    end[-1] = len(fp)
    found = np.zeros(len(fp), bool)
    found[close_pairs(query, first, end, radius)[1]] = True
    return found


def spanning_star(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root, member) for each set of 0..n-1 that the pairs (a, b) connect; the root is its smallest."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    member = np.flatnonzero(label != np.arange(n))
    return label[member], member


def majority(hashes: np.ndarray) -> np.uint64:
    """The bits that are set in over half of the hashes; 0 for none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # giant texts in pieces
        bits = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(bits, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0]

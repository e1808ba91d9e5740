"""Spans of text that operators report, and the digest columns of their queries."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable
from itertools import accumulate

Span = tuple[int, int, str]  # start, end (exclusive), kind; in code points


def listed(spans: Iterable[Span], order: dict[str, int]) -> str:
    """kind:start:end by start, then by kind in the given order, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], order[s[2]], s[1])))


def digest(spans: Iterable[Span], order: dict[str, int]) -> str:
    return hashlib.sha256(listed(spans, order).encode()).hexdigest()


def beside(spans: list[Span], others: Iterable[Span]) -> list[Span]:
    """Those of the spans that overlap none of the others; both may be many."""
    ordered = sorted(others)
    starts = [a for a, _, _ in ordered]
    furthest = [0, *accumulate((b for _, b, _ in ordered), max)]  # where the first k of the others end
    return [s for s in spans if furthest[bisect_left(starts, s[1])] <= s[0]]


def cut(spans: list[Span], others: Iterable[Span]) -> list[Span]:
    """What of the spans is in none of the others, piece by piece; both may be many, and spans overlap each other nowhere."""
    pieces, gone, k = [], sorted((a, b) for a, b, _ in others), 0
    furthest = [0, *accumulate((b for _, b in gone), max)]  # where the first k of the others end
    for a, b, kind in sorted(spans):
        while k < len(gone) and furthest[k + 1] <= a:
            k += 1
        at, i = a, k
        while i < len(gone) and gone[i][0] < b:
            if gone[i][0] > at:
                pieces.append((at, gone[i][0], kind))
            at, i = max(at, gone[i][1]), i + 1
        if at < b:
            pieces.append((at, b, kind))
    return pieces

"""Keys that fingerprints of 64 bits share if few of their bits differ, by the pigeonring principle.

A fingerprint is cut into t + 1 consecutive segments for t differing bits. If two fingerprints differ in at
most t bits, then on the ring of segments some start has, for every length l, no more than l * t / (t + 1) differing
bits in its first l segments, so l - 1 in whole bits (pigeonring principle). Each segment after the first is halved:
of the 2j halves that follow the first segment at least j agree, for each j. A chain key is therefore the first
segment and a set of l - 1 agreeing halves with that property; two linked fingerprints share such a key, whatever
the length of chain, so the length only decides how selective the keys are. Within a key the cumulative differences
along the chain are held against their budgets before the full Hamming distance is taken.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

BITS = 64


def _segments(threshold: int) -> list[list[int]]:
    """Bit masks: for each of threshold + 1 segments its whole and its two halves."""
    m, out, at = threshold + 1, [], 0
    for i in range(m):
        width = BITS // m + (i < BITS % m)
        low = width - width // 2
        mask = lambda a, n: ((1 << n) - 1) << a
        out.append([mask(at, width), mask(at, low), mask(at + low, width - low)])
        at += width
    return out


def chain_keys(threshold: int, length: int) -> list[tuple[int, tuple[int, ...]]]:
    """For each kind of key its mask, and the masks of the chain's first 1, 2, .. length segments."""
    seg, m = _segments(threshold), threshold + 1
    sets = [s for s in combinations(range(2 * (length - 1)), length - 1) if all(sum(x < 2 * j for x in s) >= j for j in range(1, length))]
    keys = []
    for i in range(m):
        chain = [seg[(i + k) % m] for k in range(length)]
        prefix = tuple(sum(c[0] for c in chain[: k + 1]) for k in range(length))
        keys += [(chain[0][0] + sum(chain[1 + x // 2][1 + x % 2] for x in s), prefix) for s in sets]
    return keys


def chain_length(n: int, threshold: int) -> int:
    """The shortest chain, 3 at least, whose keys deal n random fingerprints to buckets of some hundred at most. Any length is exact."""
    width = BITS // (threshold + 1)
    return next((k for k in range(min(3, threshold + 1), threshold + 1) if width + (k - 1) * width / 2 >= np.log2(max(n, 2)) - 8), threshold + 1)


def signed(mask: int) -> int:
    """64 bits as the signed number that Spark has for them."""
    return mask - (1 << 64) if mask >> 63 else mask


def within_chain(d: np.ndarray, prefix: tuple[int, ...], threshold: int) -> np.ndarray:
    """Whether differences keep the budgets of a chain's first segments."""
    ok = np.ones(d.shape, bool)
    for n, mask in enumerate(prefix[1:], 2):
        ok &= np.bitwise_count(d & np.uint64(mask)) <= n * threshold // (threshold + 1)
    return ok


def first_meeting(d: np.ndarray, keys: list, kind: int, threshold: int) -> np.ndarray:
    """Whether kind is the first one that fingerprints of differences d share: each pair has one bucket of its own."""
    mask, prefix = keys[kind]
    ok = (np.bitwise_count(d) <= threshold) & (d & np.uint64(mask) == 0) & within_chain(d, prefix, threshold)
    left = np.flatnonzero(ok)
    for mask, prefix in keys[:kind]:
        if not len(left):
            break
        same = d[left] & np.uint64(mask) == 0
        at = left[same]
        gone = at[within_chain(d[at], prefix, threshold)]
        if len(gone):
            ok[gone] = False
            left = left[ok[left]]
    return ok


def buckets(batches, by: int = 1):
    """Columns of Arrow batches that are sorted by the first of them, a bucket (equal values of these) at a time; a bucket of one row is left out."""
    held: list[list[np.ndarray]] = []

    def whole():
        return [np.concatenate(x) for x in zip(*held)] if len(held) > 1 else held[0]

    for b in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if not len(now[0]):
            continue
        new = np.zeros(len(now[0]), bool)
        for c in now[:by]:
            new[1:] |= c[1:] != c[:-1]
        new[0] = bool(held) and any(c[0] != h[0] for c, h in zip(now[:by], held[0]))
        cuts = np.flatnonzero(new)
        for a, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(new)]):
            if new[a]:
                if sum(len(x[0]) for x in held) > 1:
                    yield whole()
                held = []
            if e > a:
                held.append([x[a:e] for x in now])
    if sum(len(x[0]) for x in held) > 1:
        yield whole()

"""Vectorised words and word-window hashes of Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LONG = 64  # bytes from which a word is hashed on its own
_rng = np.random.Generator(np.random.PCG64(20))  # a fixed seed: hashes agree between workers and runs
TABLES = _rng.integers(0, 1 << 64, (2, 256), np.uint64)
BASES = _rng.integers(0, 1 << 64, (2, 2), np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads each bit over all (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of a column of texts: data (bytes), start and end of each word, doc (row of each word), first (of each row, its first word; one more at the end)."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.binary()), b"")
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        offsets -= offsets[0]
        ink = ~SPACE[data]
        begin, end = ink.copy(), ink.copy()
        begin[1:] &= ~ink[:-1]
        end[:-1] &= ~ink[1:]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        begin[inner] |= ink[inner]
        end[inner - 1] |= ink[inner - 1]
        self.data, self.start, self.end = data, np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def hashes(self, which: int) -> np.ndarray:
        """A 64-bit hash of each word; which (0 or 1) selects one of two independent functions."""
        base, table = BASES[which, 0], TABLES[which]
        size = self.end - self.start
        h = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        order = np.argsort(-np.minimum(size, LONG + 1).astype(np.int8), kind="stable")  # long words first, so that each step takes a leading part
        starts, counts = self.start[order], np.bincount(np.minimum(size, LONG + 1), minlength=LONG + 2)
        active = counts[::-1].cumsum()[::-1]  # words of at least so many bytes
        g = h[order]
        skip = counts[LONG + 1]
        for k in range(LONG):
            if active[k + 1] <= skip:
                break
            part = slice(skip, active[k + 1])
            g[part] = g[part] * base + table[self.data[starts[part] + k]]
        if skip:
            from xxhash import xxh3_64_intdigest

            g[:skip] = [xxh3_64_intdigest(self.data[a:b].tobytes(), which) for a, b in zip(starts[:skip], self.end[order[:skip]])]
        h[order] = mix(g)
        return h

    def windows(self, width: int, which: int) -> tuple[np.ndarray, np.ndarray]:
        """For each run of width consecutive words of one row: its first word's number and its hash."""
        n = len(self.start) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[:n] == self.doc[width - 1 :])
        w, base = self.hashes(which), BASES[which, 1]
        h = np.zeros(n, np.uint64)
        for k in range(width):
            h *= base
            h += w[k : k + n]
        return at, mix(h[at])


def lean(run):
    """A function of Arrow batches that leaves a reused worker small: what large arrays took goes back to the system at once, the rest at the end."""

    def wrapped(batches):
        small_steps()
        yield from run(batches)
        give_back()

    return wrapped


def small_steps() -> None:
    """From now on arrays of a megabyte are taken from the system one by one; else that bound grows with the largest array there has been."""
    libc = _libc()
    if libc is not None:
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD


def give_back() -> None:
    """Returns unused memory to the system."""
    pa.default_memory_pool().release_unused()
    libc = _libc()
    if libc is not None:
        libc.malloc_trim(0)


def _libc():
    """The C library, if it is one with these two functions."""
    import ctypes

    try:
        libc = ctypes.CDLL(None)
        return libc if libc.mallopt and libc.malloc_trim else None
    except (AttributeError, OSError):
        return None


def binaries(column: pa.Array) -> list[np.ndarray]:
    """The values of a binary column without nulls as views of its bytes."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return [data[a:b] for a, b in zip(offsets, offsets[1:])]


def slices(batch: pa.RecordBatch, column: int, step: int):
    """A batch in slices of whole rows with about step bytes of text in a column, so that arrays made of them stay small."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column).cast(pa.binary())), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(batch):
        e = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + step)))
        yield batch.slice(a, e - a)
        a = e

"""Hashed word shingles of texts, computed on whole batches of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes hashed at once; bounds the memory of a task.
BLOCK_BYTES = 1 << 19
#: Words of a shingle.
WIDTH = 5

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of a 64-bit number."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse, as far as a block needs them."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def to(cls, n: int) -> None:
        if len(cls.up) < n:
            size = max(n, BLOCK_BYTES + 4096)
            up, down = np.full(size, _BASE, dtype=np.uint64), np.full(size, _INVERSE, dtype=np.uint64)
            up[0] = down[0] = 1
            cls.up, cls.down = np.cumprod(up), np.cumprod(down)


def _block_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of a block."""
    b = np.frombuffer(raw, dtype=np.uint8)
    space = np.concatenate(([True], _SPACE[b], [True]))
    starts = np.flatnonzero(space[:-1] & ~space[1:])
    ends = np.flatnonzero(~space[:-1] & space[1:])
    _Powers.to(len(b) + 1)
    sums = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[b] * _Powers.up[: len(b)], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _Powers.down[starts]
    return starts, mix(hashes + (ends - starts).astype(np.uint64) * np.uint64(_BASE))


def word_hashes(raw: bytes) -> np.ndarray:
    """Hashes of a text's words, in blocks cut at white space."""
    if len(raw) <= BLOCK_BYTES:
        return _block_words(raw)[1]
    return np.concatenate([h for _, _, h in _long_blocks(raw)])


def _combine(words: np.ndarray, width: int) -> np.ndarray:
    """One hash for each window of ``width`` words."""
    n = len(words) - width + 1
    acc = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        acc = mix((acc ^ words[k : k + n]) * np.uint64(_BASE)) if k == width - 1 else (acc ^ words[k : k + n]) * np.uint64(_BASE)
        if k < width - 1:
            acc ^= acc >> np.uint64(32)
    return acc


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of ``width`` words.

    A-Z are lower-cased; words are separated by the six ASCII separators. A text
    of fewer words is one shingle, one without words has none.
    """

    def of(words: np.ndarray) -> np.ndarray:
        if not len(words):
            return words
        return np.unique(_combine(words, min(width, len(words))))

    group: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        offsets = np.cumsum([0, *(len(r) + 1 for r in group)])
        starts, hashes = _block_words(b"\n".join(group))
        cuts = np.searchsorted(starts, offsets)
        windows = _combine(hashes, width) if len(hashes) >= width else hashes[:0]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield np.unique(windows[a : b - width + 1]) if b - a >= width else of(hashes[a:b])

    for text in texts:
        raw = (text or "").encode().lower()
        if len(raw) > BLOCK_BYTES:
            if group:
                yield from flush()
                group, size = [], 0
            yield of(word_hashes(raw))
            continue
        if group and size + len(raw) > BLOCK_BYTES:
            yield from flush()
            group, size = [], 0
        group.append(raw)
        size += len(raw) + 1
    if group:
        yield from flush()


def word_blocks(raws: list[bytes | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in blocks of bounded size: the first text's place, the hashes of the words, each text's first word (and the end), the word after each line with a word."""

    def block(group: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = b"\n".join(group)
        offsets = np.cumsum([0, *(len(r) + 1 for r in group)])
        if len(group) > 1 or len(raw) <= BLOCK_BYTES:
            starts, hashes = _block_words(raw)
        else:
            parts = list(_long_blocks(raw))
            starts, hashes = np.concatenate([at + s for at, s, _ in parts]), np.concatenate([h for _, _, h in parts])
        breaks = np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) == 10)
        ends = np.unique(np.append(np.searchsorted(starts, breaks), len(starts)))
        return hashes, np.searchsorted(starts, offsets).astype(np.int64), ends[ends > 0].astype(np.int64)

    group: list[bytes] = []
    size = first = 0
    for raw in raws:
        raw = raw or b""
        if group and size + len(raw) > BLOCK_BYTES:
            yield first, *block(group)
            first, group, size = first + len(group), [], 0
        group.append(raw)
        size += len(raw) + 1
    if group:
        yield first, *block(group)


def _long_blocks(raw: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Places, starts and hashes of the parts of a long text, cut at white space."""
    at = 0
    while at < len(raw):
        end = at + BLOCK_BYTES
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        yield at, *_block_words(raw[at:end])
        at = end

"""A bounded per-worker table from white-space-delimited chunks of text to their encoding.

A word-level tokenizer that drops white space encodes every chunk on its own, so
a text's encoding is its chunks' encodings in a row. Chunks are cut at ASCII
white space only; other white space stays inside a chunk and is left to the
tokenizer. Chunks seen after the table is full are encoded for the batch at hand
and forgotten, so memory stays bounded and no word is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

#: Entries kept by one worker; an entry takes about 150 bytes.
MAX_ENTRIES = 300_000
#: Longer chunks are never kept.
MAX_CHUNK_BYTES = 64


class ChunkTable:
    """``encode_words`` encodes words of letters only; ``encode_other`` anything else; both take many and give bytes."""

    def __init__(
        self,
        encode_words: Callable[[list[bytes]], Iterable[bytes]],
        encode_other: Callable[[list[bytes]], Iterable[bytes]],
        joiner: bytes,
        max_entries: int = MAX_ENTRIES,
    ) -> None:
        self.encode_words = encode_words
        self.encode_other = encode_other
        self.joiner = joiner
        self.max_entries = max_entries
        self.known: dict[bytes, bytes] = {}

    @staticmethod
    def core(chunk: bytes) -> bytes | None:
        """The word of letters that a chunk consists of, but for full stops and commas after it."""
        word = chunk.rstrip(b".,")
        if word.isalpha() and word.isascii():
            return word.lower()
        if not word.isascii() and word.decode().isalpha():
            return word
        return None

    def learn(self, chunks: set[bytes]) -> list[bytes]:
        """Encodes the unknown chunks; returns the keys that must be forgotten after the batch."""
        missing = chunks.difference(self.known)
        if not missing:
            return []
        cores: dict[bytes, bytes] = {}
        for chunk in missing:
            if len(chunk) <= MAX_CHUNK_BYTES and (word := self.core(chunk)) is not None:
                cores[chunk] = word
        words = [w for w in dict.fromkeys(cores.values()) if w not in self.known]
        tails = {chunk[len(chunk.rstrip(b".,")) :] for chunk in cores} - {b""}
        others = [c for c in dict.fromkeys((*tails, *(c for c in missing if c not in cores))) if c not in self.known]
        self.known.update(zip(words, self.encode_words(words), strict=True))
        self.known.update(zip(others, self.encode_other(others), strict=True))
        added = [*words, *others]
        for chunk, word in cores.items():
            if chunk not in self.known:
                tail = chunk[len(chunk.rstrip(b".,")) :]
                self.known[chunk] = self.joiner.join((self.known[word], self.known[tail])) if tail else self.known[word]
                added.append(chunk)
        room = self.max_entries - (len(self.known) - len(added))
        return [c for i, c in enumerate(added) if i >= room or len(c) > MAX_CHUNK_BYTES]

    def forget(self, keys: list[bytes]) -> None:
        for key in keys:
            self.known.pop(key, None)

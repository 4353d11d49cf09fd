"""Cost-balanced packing of documents into fixed-length training sequences.

The cost of a piece of n tokens is estimated as linear + quadratic attention
work, ``n * (LINEAR + QUADRATIC * n)``: attention stays inside a document. Each
task packs groups of about ``GROUP_TOKENS`` tokens on its own, without a
shuffle. Inside a group, documents come in descending order of cost; each goes
to the lowest-cost sequence that still has token capacity for it. A document
that fits nowhere is cut: the lowest-cost open sequence is filled and the rest
goes on. The group's capacities add up to exactly its tokens: full sequences,
and the remainder in binary as sequences of a power of two tokens, which need no
padding.

Defined results for odd input: a null or empty text is its closing token alone;
repeated rows are packed once each; a null doc_id keeps its pieces; a text of
any length is cut into pieces; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import heapq
import math
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcstep.llm.bpe import vocabulary_path
from arcstep.llm.common import map_batches, next_power_of_two, table
from arcstep.llm.word_cache import ChunkTable

#: Tokens of a full sequence.
CAPACITY = 2048
#: The id that closes a document.
CLOSE = 1
#: Tokens that one task packs together; the memory of a group is four bytes each.
GROUP_TOKENS = 1 << 20
#: Cost of a token by itself, and of each pair of tokens of one piece.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "capacity long"
)


def cost(n: int) -> float:
    """Estimated work of a piece of ``n`` tokens."""
    return n * (LINEAR + QUADRATIC * n)


def capacities(total: int, capacity: int = CAPACITY) -> list[int]:
    """Sequence lengths that add up to ``total``: full ones, then powers of two, largest first."""
    rest = total % capacity
    return [capacity] * (total // capacity) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def assign(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Packs one group: (document, start, length, sequence, offset) for every piece.

    Longer documents are first cut to at most a full sequence each, so that the
    pieces left are comparable; then the greedy rule of the module's description
    places them in descending cost.
    """
    sizes = capacities(sum(lengths), capacity)
    used = [0] * len(sizes)
    spent = [0.0] * len(sizes)
    out: list[tuple[int, int, int, int, int]] = []

    def put(doc: int, start: int, n: int, seq: int) -> None:
        out.append((doc, start, n, seq, used[seq]))
        used[seq] += n
        spent[seq] += cost(n)

    # A heap of (cost, sequence) for each number of free tokens, and a tree of the heaps' least entries.
    none = (math.inf, -1)
    width = next_power_of_two(capacity)
    heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
    tree = [none] * (2 * width)

    def changed(free: int) -> None:
        at = width + free - 1
        tree[at] = heaps[free][0] if heaps[free] else none
        while at := at >> 1:
            tree[at] = min(tree[2 * at], tree[2 * at + 1])

    def offer(seq: int) -> None:
        if free := sizes[seq] - used[seq]:
            heapq.heappush(heaps[free], (spent[seq], seq))
            changed(free)

    def lowest(need: int) -> int | None:
        """Takes the lowest-cost sequence with ``need`` free tokens or more."""
        best, a, b = none, width + need - 1, 2 * width
        while a < b:
            if a & 1:
                best = min(best, tree[a])
                a += 1
            a, b = a >> 1, b >> 1
        if best is none:
            return None
        free = sizes[best[1]] - used[best[1]]
        heapq.heappop(heaps[free])
        changed(free)
        return best[1]

    def roomiest() -> int:
        """Takes the lowest-cost one of the sequences with most free tokens."""
        at = 1
        while at < width:
            at = 2 * at + (tree[2 * at + 1] is not none)
        return lowest(at - width + 1)

    for seq in range(len(sizes)):
        offer(seq)
    pieces = []
    for doc, n in enumerate(lengths):
        start = 0
        while n - start > capacity:
            pieces.append((capacity, doc, start))
            start += capacity
        if n > start:
            pieces.append((n - start, doc, start))
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    for n, doc, start in pieces:
        while n:
            seq = lowest(n)
            take = n
            if seq is None:  # fits nowhere: fill the sequence with most room, lowest cost first
                seq = roomiest()
                take = min(n, sizes[seq] - used[seq])
            put(doc, start, take, seq)
            offer(seq)
            start, n = start + take, n - take
    return out


_loaded: dict[str, ChunkTable] = {}


def _chunks(path: str) -> ChunkTable:
    """The worker's table from a chunk of text to its ids as little-endian unsigned 32-bit numbers."""
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        size = library.get_vocab_size(with_added_tokens=True)
        suffix = library.model.end_of_word_suffix
        ends = np.array([bool(suffix) and (library.id_to_token(i) or "").endswith(suffix) for i in range(size)])

        def other(chunk: bytes) -> bytes:
            return np.array(library.encode(chunk.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()

        def words(many: list[bytes]) -> list[bytes]:
            if not many:
                return []
            # Words of letters end in a token with the suffix each, so one call encodes them all.
            ids = np.array(library.encode(b" ".join(many).decode(), add_special_tokens=False).ids, dtype="<u4")
            cuts = np.flatnonzero(ends[ids]) + 1
            if len(cuts) != len(many):
                return [other(w) for w in many]
            raw, at = ids.tobytes(), [0, *(4 * cuts).tolist()]
            return [raw[a:b] for a, b in zip(at, at[1:])]

        _loaded[path] = ChunkTable(words, lambda many: map(other, many), b"")
    return _loaded[path]


def token_bytes(path: str, texts: list[str | None]) -> Iterator[bytes]:
    """Each text's ids and the closing id, as little-endian unsigned 32-bit numbers."""
    chunks = _chunks(path)
    close = np.array([CLOSE], dtype="<u4").tobytes()
    for at in range(0, len(texts), 256):
        parts = [(t or "").encode().split() for t in texts[at : at + 256]]
        forget = chunks.learn(set().union(*parts))
        look = chunks.known.__getitem__
        for part in parts:
            yield b"".join(map(look, part)) + close
        chunks.forget(forget)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS, with_ids: bool = False) -> DataFrame:
    """One row a piece: where it comes from, its sequence and its place there.

    ``sequence_id`` is the task's number and a counter, so that a task which is
    run again numbers its sequences alike. With ``with_ids`` the piece's ids are
    returned as well.
    """
    schema = PIECES + (", ids array<int>" if with_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        held: list[tuple[int | None, bytes]] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal first, held, tokens
            lengths = [len(raw) // 4 for _, raw in held]
            sizes = capacities(tokens, capacity)
            columns: list[list] = [[] for _ in names]
            for doc, start, n, seq, offset in assign(lengths, capacity):
                doc_id, raw = held[doc]
                part = raw[4 * start : 4 * (start + n)]
                row = [doc_id, start, n, zlib.crc32(part), lengths[doc], first + seq, offset, sizes[seq]]
                if with_ids:
                    row.append(np.frombuffer(part, dtype="<u4").astype(np.int32))
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            first += len(sizes)
            held, tokens = [], 0
            arrays = [pa.array(c, pa.list_(pa.int32()) if x == "ids" else pa.int64()) for x, c in zip(names, columns, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for doc_id, raw in zip(ids, token_bytes(path, batch.column(1).to_pylist()), strict=True):
                held.append((doc_id, raw))
                tokens += len(raw) // 4
                if tokens >= group_tokens:
                    yield flush()
        if held:
            yield flush()
        _loaded.clear()  # the worker lives on, and other stages need its memory

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(texts, run, schema)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces."""
    return pack(table(spark, sf_dir, "documents"), vocabulary_path())


def oracle_sql() -> dict[str, str]:
    return {}


def queries() -> dict:
    return {"op4_packing": op4_packing}

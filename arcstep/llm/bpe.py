"""BPE encoding and decoding with a bounded-lookahead streaming transducer.

A merge list bounds how far to the right the fate of a token boundary can depend
on the text. ``Merges.lookahead`` computes a sufficient bound from the list
itself; the transducer reads characters, encodes the part it holds, emits the
tokens that end at least that far before the end of it, and forgets them. Its
memory is constant for any length of word. Decoding is a state machine over
token ids that hands out text as soon as it is complete.

A text is fed in portions of bounded size, and all it leaves behind are its
tokens. Words of up to ``BLOCK`` bytes inside a portion end before the
lookahead lets any token go, so their machines only act when the word ends: these
are ended many at once (``Merges.finish_many``), and a bounded table remembers
what they gave. Longer words feed a ``Transducer`` each, and text without white
space goes through ``Tokenizer.stream``, where a word may stay open over any
number of portions.

The tokenizer file is read for its vocabulary, merge list, normaliser and
pattern; no tokenizer library takes part.

Defined results for odd input: a null or empty text, or one of white space only,
has no tokens and decodes to the empty text; a null doc_id keeps its row;
repeated rows give equal results; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcstep.llm.common import map_batches, table
from arcstep.llm.word_cache import ChunkTable

#: White space as the tokenizer's patterns see it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Characters of a word that the transducer holds at most, beyond the lookahead.
BLOCK = 256
#: Bytes of a text that are fed at once.
PORTION = 1 << 16
#: Chunks whose tokens a worker remembers.
MAX_ENTRIES = 400_000
#: Characters kept back from a portion, so that no special token or contraction is cut.
TAIL = 32


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Merges:
    """A merge list with ranks, an optional suffix on a word's last character, and its lookahead."""

    def __init__(self, pairs: list[tuple[str, str]], vocab: dict[str, int], suffix: str = "") -> None:
        self.ranks = {pair: rank for rank, pair in reversed(list(enumerate(pairs)))}
        self.vocab = vocab
        self.suffix = suffix
        self.pairs = pairs
        self._lookahead: int | None = None
        self._numbers: tuple | None = None

    @property
    def lookahead(self) -> int:
        """Characters right of a boundary that decide it, at most.

        A merge (x, y) removes the boundary between x and y if y is still whole
        then. That depends on y's own characters and on the earlier merges that
        could take one of the last parts of y away to the right: those of a part
        z on y's right spine, ranked before z disappears into its parent and
        before (x, y). The bound of a merge is y's length plus the largest bound
        of such merges, whose ranks are smaller, so one pass in rank order does.
        """
        if self._lookahead is None:
            width = lambda t: len(t) - (len(self.suffix) if self.suffix and t.endswith(self.suffix) else 0)
            made: dict[str, tuple[str, int]] = {}
            for rank, (x, y) in enumerate(self.pairs):
                made.setdefault(x + y, (y, rank))
            ranks_of: dict[str, list[int]] = {}
            best_of: dict[str, list[int]] = {}
            most = 1
            for rank, (x, y) in enumerate(self.pairs):
                extra, part, until = 0, y, rank
                while True:
                    known = ranks_of.get(part)
                    if known and (at := bisect_left(known, until)):
                        extra = max(extra, best_of[part][at - 1])
                    if part not in made:
                        break
                    part, absorbed = made[part]
                    until = min(until, absorbed)
                need = width(y) + extra
                most = max(most, need)
                ranks_of.setdefault(x, []).append(rank)
                best = best_of.setdefault(x, [])
                best.append(max(need, best[-1]) if best else need)
            self._lookahead = most
        return self._lookahead

    def tokens(self, symbols: list[str]) -> list[str]:
        """The canonical segmentation: lowest rank first, leftmost first."""
        ranks = self.ranks
        none = len(ranks)
        while len(symbols) > 1:
            at = [ranks.get(p, none) for p in zip(symbols, symbols[1:])]
            least = min(at)
            if least == none:
                break
            merged, i, n = [], 0, len(symbols)
            while i < n:
                if i < n - 1 and at[i] == least:
                    merged.append(symbols[i] + symbols[i + 1])
                    i += 2
                else:
                    merged.append(symbols[i])
                    i += 1
            symbols = merged
        return symbols

    def word(self, characters: str) -> list[str]:
        """The tokens of one whole short word."""
        symbols = list(characters)
        symbols[-1] += self.suffix
        return self.tokens(symbols)

    def _numbered(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Numbers of a byte's symbol inside and at the end of a word; sorted codes of pairs, with their ranks and results; decimal ids (empty if there is none)."""
        if self._numbers is None:
            number: dict[str, int] = {}
            for x, y in self.ranks:
                for z in (x, y, x + y):
                    number.setdefault(z, len(number))
            for z in byte_characters():
                number.setdefault(z, len(number))
                number.setdefault(z + self.suffix, len(number))
            codes = np.array([number[x] << 32 | number[y] for x, y in self.ranks], dtype=np.int64)
            order = np.argsort(codes)
            ranks = np.fromiter(self.ranks.values(), dtype=np.int64, count=len(codes))[order]
            made = np.array([number[x + y] for x, y in self.ranks], dtype=np.int64)[order]
            ids = [b"%d" % i if (i := self.vocab.get(z)) is not None else b"" for z in number]
            inner, final = (np.array([number[z + x] for z in byte_characters()], dtype=np.int64) for x in ("", self.suffix))
            self._numbers = inner, final, codes[order], ranks, made, ids
        return self._numbers

    def finish_many(self, words: list[bytes]) -> list[bytes]:
        """The tokens of whole short words as decimal ids parted by spaces: machines that end together, merged in lockstep.

        In every round each word makes its merge of lowest rank, wherever it has it, leftmost first.
        """
        inner, final, codes, ranks, made, ids = self._numbered()
        if not words:
            return []
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbols, last = inner[raw], np.cumsum(lengths) - 1
        symbols[last] = final[raw[last]]
        word = np.repeat(np.arange(len(words)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        none = len(codes)
        while len(symbols):
            code = symbols[:-1] << 32 | symbols[1:]
            at = np.searchsorted(codes, code)
            at[at == none] = 0
            rank = np.where((codes[at] == code) & (word[:-1] == word[1:]), ranks[at], np.iinfo(np.int64).max) if none else np.full(len(code), np.iinfo(np.int64).max)
            rank = np.append(rank, np.iinfo(np.int64).max)
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(word))))
            ended = least == np.iinfo(np.int64).max
            if ended.any():
                done.append((word[ended], symbols[ended]))
            hit = (rank == least) & ~ended
            # Of places in a row every second one merges.
            place = np.flatnonzero(hit)
            if len(place):
                run = np.flatnonzero(np.concatenate(([True], np.diff(place) > 1)))
                offset = np.arange(len(place)) - np.repeat(run, np.diff(np.append(run, len(place))))
                place = place[offset % 2 == 0]
                symbols[place] = made[at[place]]
            keep = ~ended
            keep[place + 1] = False
            symbols, word = symbols[keep], word[keep]
        owner, found = np.concatenate([w for w, _ in done]), np.concatenate([x for _, x in done])
        order = np.argsort(owner, kind="stable")
        parts, cuts = list(map(ids.__getitem__, found[order].tolist())), np.searchsorted(owner[order], np.arange(len(words) + 1)).tolist()
        return [b" ".join(filter(None, parts[a:b])) for a, b in zip(cuts, cuts[1:])]


class Transducer:
    """Feeds one word's characters in any portions; yields tokens once they are stable."""

    def __init__(self, merges: Merges, block: int = BLOCK) -> None:
        self.merges = merges
        self.block = block
        self.held: list[str] = []

    def feed(self, characters: Iterable[str]) -> Iterator[str]:
        look = self.merges.lookahead
        for c in characters:
            self.held.append(c)
            if len(self.held) >= self.block + look + 1:
                # The last character held may still be the word's last, with the suffix: it decides nothing yet.
                limit = len(self.held) - 1 - look
                end = 0
                for token in self.merges.tokens(self.held[:-1]):
                    if end + len(token) > limit:
                        break
                    end += len(token)
                    yield token
                if end:
                    del self.held[:end]
                else:  # a single token longer than the block: hold more
                    self.block *= 2

    def finish(self) -> Iterator[str]:
        if self.held:
            yield from self.merges.word("".join(self.held))
        self.held = []


class Decoder:
    """Incremental decoding; ``byte_level`` joins bytes, else tokens are parted by single spaces."""

    def __init__(self, tokens: dict[bytes, bytes] | dict[int, bytes], byte_level: bool = False) -> None:
        self.tokens = tokens
        self.byte_level = byte_level
        self.started = False
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list) -> bytes:
        """The UTF-8 text that is complete after these ids."""
        if self.byte_level:
            raw = b"".join(map(self.tokens.__getitem__, ids))
            return self.utf8.decode(raw).encode()
        if not ids:
            return b""
        text = b" ".join(map(self.tokens.__getitem__, ids))
        if self.started:
            return b" " + text
        self.started = True
        return text

    def finish(self) -> bytes:
        return self.utf8.decode(b"", final=True).encode() if self.byte_level else b""


class Tokenizer:
    """What this module needs of a word-level byte BPE tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("only plain BPE models are supported")
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = Merges(pairs, self.vocab, model.get("end_of_word_suffix") or "")
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        if kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("only NFC, white-space and lower-case normalisation is supported")
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if split["type"] != "Split" or not split["invert"] or split["behavior"] != "Removed":
            raise ValueError("only a pattern that names the words is supported")
        pattern = split["pattern"]["Regex"].replace("[^\\s", f"[^{SPACE}")
        self.words = regex.compile(pattern)
        # The pattern's alternatives that match runs of any length.
        self.runs = [regex.compile(r"\p{L}+"), regex.compile(f"[^{SPACE}\\p{{L}}\\p{{N}}]+")]
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.bytes = byte_characters()
        self.byte_level_decoder = bool(spec.get("decoder")) and spec["decoder"]["type"] == "ByteLevel"
        names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        back = {c: b for b, c in enumerate(self.bytes)}
        as_bytes = (lambda t: bytes(back[c] for c in t)) if self.byte_level_decoder else str.encode
        self.names: dict[int, bytes] = {i: t.encode() if t in self.added else as_bytes(t) for i, t in names.items()}
        self.names_by_text = {b"%d" % i: t for i, t in self.names.items()}

    def _bytes(self, word: str) -> str:
        return "".join(map(self.bytes.__getitem__, word.encode()))

    def _named(self, tokens: Iterable[str]) -> Iterator[int]:
        for token in tokens:
            if (i := self.vocab.get(token)) is not None:  # without an unknown token, others have no id
                yield i

    @staticmethod
    def _plain(text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        return text.lower() if text.isascii() else "".join(map(str.lower, text))

    def pieces(self, text: str) -> Iterator[int | bytes]:
        """The ids of special tokens, and the words between them."""
        at = 0
        for found in self.specials.finditer(text) if self.specials else ():
            yield from map(str.encode, self.words.findall(self._plain(text[at : found.start()])))
            yield self.added[found.group()]
            at = found.end()
        yield from map(str.encode, self.words.findall(self._plain(text[at:])))

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """As ``encode_many``, for words of letters, lower-cased if they are ASCII: those are pieces as they stand."""
        plain = [w for w in words if w.isascii() and len(w) <= BLOCK]
        known = dict(zip(plain, self.merges.finish_many(plain), strict=True))
        rest = [w for w in words if w not in known]
        known.update(zip(rest, self.encode_many(rest), strict=True))
        return [known[w] for w in words]

    def encode_many(self, texts: list[bytes]) -> list[bytes]:
        """Decimal ids parted by spaces, for each of many short texts."""
        found = [list(self.pieces(x.decode())) for x in texts]
        words = list({p for own in found for p in own if isinstance(p, bytes)})
        short = [w for w in words if len(w) <= BLOCK]
        known = dict(zip(short, self.merges.finish_many(short), strict=True))
        for w in words:
            if len(w) > BLOCK:
                known[w] = b" ".join(b"%d" % i for i in self._named(_through(self.merges, self._bytes(w.decode()))))
        return [b" ".join(filter(None, (known[p] if isinstance(p, bytes) else b"%d" % p for p in own))) for own in found]

    def stream(self, portions: Iterable[str]) -> Iterator[int]:
        """The ids of a text that comes in portions, in order; a word may go on over any number of them.

        What is kept from one portion to the next are ``TAIL`` characters and the
        open word's machine. Where a portion can be normalised on its own is
        before a character below U+0300 or an ideograph; text without one is kept.
        """
        machine: Transducer | None = None
        run = None  # what an open word consists of
        raw = plain = ""
        for portion, last in _marked_last(portions):
            raw += portion
            special = self.specials.search(raw) if self.specials else None
            while special or last or len(raw) > TAIL:
                if special:
                    part, raw = raw[: special.start()], raw[special.end() :]
                elif last:
                    part, raw = raw, ""
                else:
                    cut = next((i for i in range(len(raw) - TAIL, 0, -1) if raw[i] < "\u0300" or "\u4e00" <= raw[i] <= "\u9fff"), 0)
                    part, raw = raw[:cut], raw[cut:]
                plain += self._plain(part)
                over = last or special is not None
                at = 0
                while True:
                    if machine is not None:
                        end = run.match(plain, at).end() if run.match(plain, at) else at
                        if end < len(plain) or over:
                            yield from self._named(machine.feed(self._bytes(plain[at:end])))
                            yield from self._named(machine.finish())
                            machine, at = None, end
                        else:
                            yield from self._named(machine.feed(self._bytes(plain[at:])))
                            at = len(plain)
                            break
                    found = self.words.search(plain, at)
                    if found is None:
                        at = len(plain) if over else max(at, len(plain) - TAIL)
                        break
                    if found.end() > len(plain) - TAIL and not over:
                        kind = next((r for r in self.runs if r.fullmatch(found.group())), None)
                        if kind is None or found.end() - found.start() <= TAIL:
                            at = found.start()
                            break
                        machine, run, at = Transducer(self.merges), kind, found.start()
                        continue
                    yield from self._named(self.merges.word(self._bytes(found.group())) if found.end() - found.start() <= TAIL else _through(self.merges, self._bytes(found.group())))
                    at = found.end()
                plain = plain[at:]
                if not special:
                    break
                yield self.added[special.group()]
                special = self.specials.search(raw)

    def encode(self, text: str) -> Iterator[int]:
        """The ids of a text, in order, without holding them."""
        yield from self.stream([text])

    def decoder(self, by_text: bool = False) -> Decoder:
        return Decoder(self.names_by_text if by_text else self.names, self.byte_level_decoder)


def _marked_last(portions: Iterable[str]) -> Iterator[tuple[str, bool]]:
    before = None
    for x in portions:
        if before is not None:
            yield before, False
        before = x
    yield before or "", True


def _through(merges: Merges, characters: str) -> Iterator[str]:
    """A whole word through a machine."""
    machine = Transducer(merges)
    yield from machine.feed(characters)
    yield from machine.finish()


_loaded: dict[str, tuple[Tokenizer, ChunkTable]] = {}


def _tokenizer(path: str) -> tuple[Tokenizer, ChunkTable]:
    """The worker's tokenizer and its table of chunks, encoded as decimal ids parted by spaces."""
    if path not in _loaded:
        own = Tokenizer(path)
        _loaded[path] = own, ChunkTable(own.encode_words, own.encode_many, b" ", MAX_ENTRIES)
    return _loaded[path]


def _portions(raw: bytes) -> Iterator[bytes]:
    """A text in parts of bounded size that end at white space, or in the middle of a longer chunk without any."""
    at = 0
    while at < len(raw):
        end = at + PORTION
        if end < len(raw):
            cut = max(raw.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            end = cut + 1 if cut >= at else end
            while end < len(raw) and raw[end] & 0xC0 == 0x80:  # a character's later bytes
                end += 1
        yield raw[at:end]
        at = end


def _encoded_parts(path: str, text: str | bytes | None) -> Iterator[bytes]:
    """Decimal ids parted by spaces, for each portion of a text."""
    own, chunks = _tokenizer(path)
    raw = text.encode() if isinstance(text, str) else text or b""
    open_: list[str] = []  # portions of a chunk that no white space has ended
    for part in _portions(raw):
        whole = part[-1:].isspace()
        if open_ or not (whole or len(part) < PORTION):
            open_.append(part.decode())
            if not whole and len(part) >= PORTION:
                continue
            yield b" ".join(b"%d" % i for i in own.stream(open_))
            open_ = []
            continue
        words = part.split()
        forget = chunks.learn(set(words))
        yield b" ".join(filter(None, map(chunks.known.__getitem__, words)))
        chunks.forget(forget)
    if open_:
        yield b" ".join(b"%d" % i for i in own.stream(open_))


def _encoded_texts(path: str, texts: list[str | None]) -> Iterator[list[bytes]]:
    """For each text its ids in portions; the words of short texts are learned together."""
    _, chunks = _tokenizer(path)
    group: list[bytes] = []

    def flush() -> Iterator[list[bytes]]:
        forget = chunks.learn(set().union(*(r.split() for r in group if len(r) <= PORTION)))
        for raw in group:
            yield list(filter(None, _encoded_parts(path, raw)))
        chunks.forget(forget)

    size = 0
    for text in texts:
        raw = text if isinstance(text, bytes) else (text or "").encode()
        group.append(raw)
        size += len(raw)
        if size > 16 * PORTION:
            yield from flush()
            group, size = [], 0
    if group:
        yield from flush()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the token ids of every whole text, array<int>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [[int(i) for x in parts for i in x.split()] for parts in _encoded_texts(path, batch.column(1).cast(pa.binary()).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return map_batches(_texts(docs), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the text that the ids stand for; a null list is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                machine = _tokenizer(path)[0].decoder()
                texts.append((machine.feed(ids or []) + machine.finish()).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_batches(encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids"), run, "doc_id long, text string")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """n_tokens and the digests of the ids and of the decoded text, in one pass without keeping the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = _tokenizer(path)
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for parts in _encoded_texts(path, batch.column(1).cast(pa.binary()).to_pylist()):
                machine, digest, id_digest, n = own.decoder(by_text=True), hashlib.sha256(), hashlib.sha256(), 0
                for part in parts:
                    tokens = part.split()
                    id_digest.update(b" " + part if n else part)
                    digest.update(machine.feed(tokens))
                    n += len(tokens)
                digest.update(machine.finish())
                counts.append(n)
                of_ids.append(id_digest.hexdigest())
                of_text.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return map_batches(_texts(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document; digests of both."""
    return round_trip_digests(table(spark, sf_dir, "documents"), vocabulary_path())


def oracle_sql() -> dict[str, str]:
    return {}


def queries() -> dict[str, Callable]:
    return {"op9_bpe": op9_bpe}

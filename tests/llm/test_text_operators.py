"""Chat formatting, quality rules, BPE, packing and licence scans against brute force and round trips."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcstep.llm import bpe, chat_format, license_scan, packing, quality_rules

DOCS = "doc_id long, text string"
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one two three"), (5, "one two three"), (None, "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo"), (6, "x" * 3000),
    (7, "word " * 40), (8, "a\n\na\nb\n"), (9, "É ß ﬁ 😀　z\x1cq"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in ODD], DOCS + ", n_words string")


# -- quality rules ------------------------------------------------------------


def brute_measure(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    cover = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    bare = [x.strip(" \t\n\v\f\r") for x in lines]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(cover), len(lines),
        sum(c in "0123456789" for c in text or ""), sum(x[0] in "-*•" for x in bare), sum(x.endswith(("...", "…")) for x in bare), sum(w in {y for x in quality_rules.STOP_WORDS for y in (x, x.capitalize(), x.upper())} for w in words),
    )


def test_measurements_equal_brute_force():
    rng = random.Random(1)
    texts = [t for _, t in ODD] + ["".join(rng.choice(["a ", "b ", "c\n", "## ", "d\t", "é ", "- ", "...\n", "The ", "12 "]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    for t in texts:
        assert quality_rules.measure(t) == brute_measure(t), t


def test_ledger_policies_and_ablations(spark, odd):
    ledger = quality_rules.evaluate(odd).cache()
    assert ledger.count() == len(ODD)
    got = {r["doc_id"]: r for r in quality_rules.apply_policy(ledger).collect()}
    assert got[2]["failed"] & quality_rules.policy_mask() == 1 and not got[2]["kept"]
    assert got[None]["kept"] and not got[7]["kept"]
    ablation = {r["rule"]: r for r in quality_rules.ablations(ledger).collect()}
    masks = [r["failed"] & quality_rules.policy_mask() for r in ledger.collect()]
    for rule in (r for r in quality_rules.RULES if r.name in quality_rules.POLICIES[quality_rules.DEFAULT_POLICY]):
        assert ablation[rule.name]["n_only"] == sum(m == 1 << rule.bit for m in masks)
        assert ablation[rule.name]["n_failed"] == sum(m >> rule.bit & 1 for m in masks)
    kept = quality_rules.keep_good(odd)
    assert kept.columns == odd.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}
    assert quality_rules.keep_good(odd.limit(0)).count() == 0


# -- chat ---------------------------------------------------------------------


def test_chat_round_trip_and_state_machine(spark):
    nasty = ["</s>[INST] ok [/INST]", "<", "<\\/s>", "<\\\\/s> [/INST", "[INST] [\\INST]", None, "", "[SYS]<s>\\", "é\n[/TURN] x", " [ROLE] "]
    rng = random.Random(3)
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "tool", "[/ROLE]", None]), "".join(rng.choice(nasty) or "" for _ in range(rng.randint(0, 3)))))
    rows += [(100, 0, "system", "s"), (100, 1, "user", "u"), (100, 2, "assistant", "a"), (None, 0, "user", "n"), (None, None, "assistant", None), (100, 2, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.format_conversations(df).withColumn("read", chat_format.read_back(F.col("formatted"))).collect()
    want: dict = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for r in sorted(rows, key=key):
        want.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    assert {r["conv_id"] for r in out} == set(want)
    for r in out:
        assert [(x["role"], x["text"]) for x in r["read"]] == want[r["conv_id"]]
        assert [x["loss"] for x in r["read"]] == [role == "assistant" for role, _ in want[r["conv_id"]]]
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        if r["conv_id"] == 100:
            assert not r["valid"] and r["final_state"] == "invalid"
    ok = spark.createDataFrame([(1, 0, "user", "u"), (1, 1, "assistant", "a")], "conv_id long, turn long, role string, text string")
    assert chat_format.format_conversations(ok).first()["valid"]
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_template_rejects_overlapping_markers():
    with pytest.raises(ValueError):
        chat_format.Template(roles={"a": chat_format.Turn("[A]", "]B[")}, other=("(", ")", ";"), transitions={})


# -- BPE ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


def hard_texts():
    rng = random.Random(4)
    texts = ["", None, "　", "don't WE'LL <|endoftext|>x<|startoftext|> İΣΑΣ É É １２ ½ !!\x1c!! 😀👍🏽 àb", "a" * 4000, "ab" * 3000 + "thing" * 400, "...,,,. a.,. É., A.,b", "ʼn ǰ ß ẞ"]
    texts += ["".join(rng.choice(["in", "th", "e", "a", "tion", "s", "er", "é", "1", " ", ".", ","]) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    return texts + ["".join(rng.choice("thinaeors") for _ in range(2000)) for _ in range(5)]


def test_encoding_and_decoding_equal_the_library(spark, library):
    texts = hard_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    path = bpe.vocabulary_path()
    ids = bpe.encode(docs, path).cache()
    text = {r["doc_id"]: r["text"] for r in bpe.decode(ids, path).collect()}
    digests = {r["doc_id"]: r for r in bpe.round_trip_digests(docs, path).collect()}
    for r in ids.collect():
        want = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == want
        assert text[r["doc_id"]] == library.decode(want, skip_special_tokens=False)
        d = digests[r["doc_id"]]
        assert d["n_tokens"] == len(want)
        assert d["decoded_sha256"] == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()
        assert d["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()


def test_long_texts_and_portions_equal_the_library(library):
    rng = random.Random(5)
    own = bpe.Tokenizer(bpe.vocabulary_path())
    texts = ["x" * 200_000, "ab!?" * 50_000 + "é" * 70_000 + " end", "…" * 90_000 + "<|endoftext|>" + "a" * 90_000 + "'ll", "日本語" * 50_000, "é" * 40_000 + " a"]
    for t, parts in zip(texts, bpe._encoded_texts(bpe.vocabulary_path(), texts), strict=True):
        assert [int(i) for x in parts for i in x.split()] == library.encode(t, add_special_tokens=False).ids
    for t in filter(None, hard_texts()[:200]):
        cuts = sorted(rng.randrange(len(t) + 1) for _ in range(4))
        assert list(own.stream([t[a:b] for a, b in zip([0, *cuts], [*cuts, len(t)])])) == library.encode(t, add_special_tokens=False).ids


def test_bpe_of_an_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert bpe.round_trip_digests(empty, bpe.vocabulary_path()).count() == 0
    assert bpe.decode(bpe.encode(empty, bpe.vocabulary_path()), bpe.vocabulary_path()).count() == 0


def test_transducer_with_any_merge_list():
    """Streaming in small blocks gives the canonical tokens, for random proper merge lists."""
    rng = random.Random(6)
    for _ in range(150):
        known, pairs = list("abc"), []
        for _ in range(rng.randint(1, 14)):
            pair = (rng.choice(known), rng.choice(known))
            if pair not in pairs and "".join(pair) not in known:
                pairs.append(pair)
                known.append("".join(pair))
        merges = bpe.Merges(pairs, {})
        for _ in range(12):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 120)))
            machine = bpe.Transducer(merges, block=rng.randint(1, 8))
            got, at = [], 0
            while at < len(word):
                step = rng.randint(1, 9)
                got += machine.feed(word[at : at + step])
                at += step
            got += machine.finish()
            assert got == merges.tokens(list(word)), (pairs, word)


def test_byte_level_decoder_is_incremental():
    tokens = {0: b"\xc3", 1: b"\xa9", 2: b"a", 3: b"\xf0\x9f"}
    machine = bpe.Decoder(tokens, byte_level=True)
    assert machine.feed([2, 0]) == b"a"
    assert machine.feed([1]) == "é".encode()
    assert machine.feed([3]) + machine.finish() == "�".encode()


# -- packing ------------------------------------------------------------------------


def test_assignment_is_gapless_and_whole():
    rng = random.Random(7)
    for lengths in ([], [1], [2048], [2049], [1] * 5000, [2047] * 100, *[[int(rng.lognormvariate(5, 1.3)) + 1 for _ in range(400)] for _ in range(20)]):
        sizes, filled, found = packing.capacities(sum(lengths)), Counter(), {}
        for doc, start, n, seq, offset in packing.assign(list(lengths)):
            assert n > 0 and offset == filled[seq]
            filled[seq] += n
            found.setdefault(doc, []).append((start, n))
        assert [filled[k] for k in range(len(sizes))] == sizes
        assert all(s == 2048 or s & (s - 1) == 0 for s in sizes)
        for doc, n in enumerate(lengths):
            end = 0
            for start, k in sorted(found[doc]):
                assert start == end
                end += k
            assert end == n


def test_the_cheapest_sequence_with_room_is_chosen():
    """The rule itself, by looking at every sequence."""
    rng = random.Random(9)
    for lengths in [[int(rng.lognormvariate(3, 1.2)) + 1 for _ in range(rng.randint(1, 120))] for _ in range(30)]:
        capacity = 64
        sizes = packing.capacities(sum(lengths), capacity)
        used, spent, want = [0] * len(sizes), [0.0] * len(sizes), []
        cut = [(min(capacity, n - a), doc, a) for doc, n in enumerate(lengths) for a in range(0, n, capacity)]
        for n, doc, start in sorted(cut, key=lambda p: (-p[0], p[1], p[2])):
            while n:
                room = [z - u for z, u in zip(sizes, used, strict=True)]
                fits = [k for k, r in enumerate(room) if r >= n] or [k for k, r in enumerate(room) if r == max(room)]
                k = min(fits, key=lambda k: (spent[k], k))
                take = min(n, room[k])
                want.append((doc, start, take, k, used[k]))
                used[k] += take
                spent[k] += packing.cost(take)
                start, n = start + take, n - take
        assert packing.assign(list(lengths), capacity) == want


def test_costs_are_balanced():
    rng = random.Random(8)
    lengths = [int(rng.uniform(20, 700)) for _ in range(3000)]
    sizes, cost = packing.capacities(sum(lengths)), Counter()
    for _, _, n, seq, _ in packing.assign(lengths):
        cost[seq] += packing.cost(n)
    full = [cost[k] for k, s in enumerate(sizes) if s == packing.CAPACITY]
    assert max(full) < 1.25 * sum(full) / len(full)


def test_packed_pieces_hold_the_tokens(spark, library):
    texts = hard_texts()[:60] + ["", None, "same", "same"]
    docs = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts)], DOCS).repartition(3)
    rows = packing.pack(docs, bpe.vocabulary_path(), capacity=64, group_tokens=500, with_ids=True).collect()
    pieces: dict = {}
    for r in rows:
        pieces.setdefault(r["doc_id"] or 0, []).append(r)
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
    for i, t in enumerate(texts):
        ids = [x for r in sorted(pieces[i], key=lambda r: r["start"]) for x in r["ids"]]
        assert ids == [*library.encode(t or "", add_special_tokens=False).ids, 1]
    assert packing.pack(docs.limit(0), bpe.vocabulary_path()).count() == 0


# -- licences --------------------------------------------------------------------------


def brute_licences(text):
    out = set()
    def compare(kind, place, unit):
        own = set()
        words = re.findall(r"[^\W_]+", unit.lower())
        own = set(zip(words, words[1:]))
        for name, template in license_scan.TEMPLATES.items():
            tw = re.findall(r"[^\W_]+", template.lower())
            other = set(zip(tw, tw[1:]))
            if own and 10 * 2 * len(own & other) >= 8 * (len(own) + len(other)):
                out.add((kind, place, name, len(own & other)))
    if text:
        for i, line in enumerate(text.split("\n")):
            compare("line", i, line)
        parts = re.split(r"\n[\x20\x09-\x0D]*\n", text)
        for i, p in enumerate(parts):
            if "\n" in p:
                compare("paragraph", i, p)
        if len(parts) > 1:
            compare("text", 0, text)
    return out


def test_licence_matches_equal_brute_force(spark, odd):
    rng = random.Random(10)
    pool = [" ".join(rng.sample(t.split(), len(t.split()) - 1)) if rng.random() < 0.3 else t for t in license_scan.TEMPLATES.values() for _ in range(3)]
    texts = [t for _, t in ODD]
    for _ in range(80):
        words = rng.choice(pool).split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = "changed"
        cut = rng.randrange(len(words))
        texts.append(rng.choice(["", "intro text\n\n"]) + " ".join(words[:cut]) + rng.choice([" ", "\n"]) + " ".join(words[cut:]) + rng.choice(["", "\n\nmore"]))
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got: dict = {}
    for r in license_scan.scan(docs).collect():
        got.setdefault(r["doc_id"], set()).add((r["kind"], r["place"], r["license"], r["shared"]))
    for i, t in enumerate(texts):
        assert got.get(i, set()) == brute_licences(t), t
    assert license_scan.scan(odd.limit(0)).count() == 0

"""Words, index searches and forms against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from arcstep.llm import spelling_variants as sv


def brute_words(rows):
    found = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            if h % 97 == 0:
                k = h % len(word)
                word = word[:k] + word[k + 1 :]
            found[word] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute_variants(words):
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and v != w and one_edit(v, w)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def test_suffix_ranks_and_branches_equal_counting():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(60)})
    codes = np.array([ord(c) - 96 for w in words for c in w])
    index = sv.Index(codes, np.cumsum([0, *map(len, words)]), 3)
    text = "$" + "$".join(words) + "$"
    zero = np.zeros(1, np.int64)
    for pattern in ["a$", "ba$", "$ab", "abc", "cc", "$a", "c$", *("$" + w + "$" for w in words)]:
        # The last delimiter has no word behind it, so patterns that end with one begin with the interval of all.
        ended = pattern[-1] == "$"
        low, high = zero, np.full(1, len(words) + 1 if ended else len(text))
        for c in reversed(pattern[:-1] if ended else pattern):
            low, high = index.extend(low, high, np.array([0 if c == "$" else ord(c) - 96]))
        count = sum(text.startswith(pattern, i) for i in range(len(text)))
        assert max(0, int(high[0] - low[0])) == count, pattern
        if pattern[0] == "$" and pattern[-1] == "$" and len(pattern) > 2:
            assert words[int(low[0])] == pattern[1:-1]
        if pattern[0] != "$" and count:
            _, a, b = index.branches(low, high, zero)
            assert (b > a).all() and len(a) == len({text[i - 1] for i in range(1, len(text)) if text.startswith(pattern, i) and text[i - 1] != "$"})


@pytest.mark.parametrize("letters", ["ab", "abcdeé"])
def test_every_pair_is_found_once(letters):
    rng = random.Random(len(letters))
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(300)})
    found = Counter()
    for back in (False, True):
        names, indexed, shorter = [], [], []
        for w in words:
            for s in (False, True):
                if not s or len(w) > 5:
                    names.append(w)
                    indexed.append(not s)
                    shorter.append(s)
        a, b = sv.near_in_bucket(names, np.array(indexed), np.array(shorter), back)
        found.update(frozenset((names[x], names[y])) for x, y in zip(a.tolist(), b.tolist(), strict=True))
    want = {frozenset((a, b)) for a in words for b in words if a < b and one_edit(a, b)}
    assert set(found) == want and set(found.values()) <= {1}


def generated(rng, n):
    base = ["".join(rng.choice("abcdeéÀ") for _ in range(rng.randint(4, 8))) for _ in range(60)]
    out = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 40)):
            w = rng.choice(base[: rng.choice([3, 10, 60])])
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abx") + w[k:], w[:k] + rng.choice("abx") + w[k + 1 :]])
            words.append(rng.choice([w, w.upper() if w.isascii() else w, w.capitalize() if w[0] != "é" else w]))
        out.append((i, "".join(w + rng.choice([" ", "\n", "-", "Ā", "×1", "€", ", "]) for w in words)))
    return out


@pytest.mark.parametrize(("bucket", "held"), [(60_000, 300_000), (7, 20)])
def test_variants_equal_brute_force(spark, monkeypatch, bucket, held):
    """With small buckets, halves are split over several indexes."""
    monkeypatch.setattr(sv, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(sv, "HELD_WORDS", held)
    rows = generated(random.Random(4), 150) + [(1000, None), (1001, ""), (None, "abacus abacus ABACUS"), (None, "abacus"), (7, "hello hello hello helo helloo hellx"), (7, "hello hello hello helo helloo hellx"), (7, "helo helloo hellx"), (8, "x" * 5000 + " "), (8, "x" * 5000), (9, "x" * 5000), (9, "x" * 4999), (10, "x" * 4999), (11, "x" * 4999)]
    docs = spark.createDataFrame([(i, t, {"w": "x"}, 1) for i, t in rows], "doc_id long, text string, word map<string,string>, n int").repartition(3)
    words = brute_words(rows)
    assert any(len(w) >= 4999 for w in words)
    got = [tuple(r) for r in sv.variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(words) and set(got) == brute_variants(words)
    assert any(r[1] for r in got)


def test_chains_of_forms_end_at_their_roots(spark):
    chain = [(f"w{i:02d}", f"w{i + 1:02d}") for i in range(62)]
    got = dict(sv.roots(spark.createDataFrame(chain, "word string, form string")).collect())
    assert got == {w: "w62" for w, _ in chain}


def test_empty_table(spark):
    assert sv.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0

"""Wavelet matrix, cuts and round trips against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from arcstep.llm import fill_in_middle as fim

UNITS = {
    "line": lambda t: re.findall(r"[^\n]*\n|[^\n]+", t),
    # A run of letters and digits, or of others, with the white space behind it; leading white space is a unit of its own.
    "run": lambda t: re.findall(r"(?:[^\W_]+|(?:[^\w\s]|_)+)\s*|\s+", t),
}


def draws(key, seed=7):
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def brute(key, text, unit="line", rate=100, spm=50):
    text = text or ""
    h = draws(key)
    parts = UNITS[unit](text)
    assert "".join(parts) == text
    n = len(parts)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (n, "plain", None, None, text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    form = "spm" if h[3] % 100 < spm else "psm"
    return (n, form, len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}")


def test_rank_and_select_equal_counting():
    rng = np.random.default_rng(3)
    for size in (0, 1, 63, 64, 65, 700):
        s = rng.integers(0, 6, size).astype(np.uint8)
        matrix = fim.WaveletMatrix(s)
        at = np.arange(size + 1)
        for c in range(8):
            assert matrix.rank(c, at).tolist() == [int((s[:i] == c).sum()) for i in at]
            places = np.flatnonzero(s == c)
            assert matrix.select(c, np.arange(len(places))).tolist() == places.tolist()
        both = np.flatnonzero((s == 3) | (s == 5))
        assert matrix.select_of((3, 5), np.arange(len(both))).tolist() == both.tolist()


ODD = [
    (1, None), (2, ""), (3, "\n"), (4, "\n\n"), (5, "a"), (6, "a\nb"), (7, "a\nb\n"), (8, "é 😀\n\nﬁ"), (9, "x <P> y\nz"), (10, "<\nS>\n<"), (None, "a\nb\nc"), (11, "one\ntwo"), (11, "one\ntwo"),
    (12, "".join(f"line {i} of many words\n" for i in range(40_000))), (13, "word " * 60_000), (14, "\x0b\x0c \x1c"),
]


@pytest.mark.parametrize("unit", ["line", "run"])
def test_every_cut_equals_brute_force(spark, unit):
    rng = random.Random(5)
    rows = ODD + [(i, "".join(rng.choice(["a", "b1 ", "\n", ", ", "É", "(", "  ", "\n\n", "_", "<", "P>"]) for _ in range(rng.randint(0, 40)))) for i in range(100, 400)]
    docs = spark.createDataFrame([(i, t, {"k": t}, "x") for i, t in rows], "doc_id long, text string, output map<string,string>, fim string")
    template = fim.Template(unit=unit, rate=80, spm=40)
    made = fim.transform(docs, template, column="fim_")
    assert made.columns == ["doc_id", "text", "output", "fim", "fim_"]
    got = made.select("doc_id", "text", "fim_.*", fim.restored(made["fim_"]["output"], made["fim_"]["form"], template).alias("back")).collect()
    assert all(r["back"] == (r["text"] or "") for r in got)
    key = lambda r: (r[0] is None, r[0] or 0, repr(r[1:]))
    want = [(i, *brute(i, t, unit, 80, 40)) for i, t in rows]
    assert sorted([(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got], key=key) == sorted(want, key=key)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_empty_table_and_other_sentinels(spark):
    assert fim.transform(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    template = fim.Template("[pre]", "[suf]", "[mid]")
    docs = spark.createDataFrame([(i, "a\nb\n[p\n") for i in range(20)], "doc_id long, text string")
    made = fim.transform(docs, template)
    assert all(r[0] == "a\nb\n[p\n" for r in made.select(fim.restored(made["fim"]["output"], made["fim"]["form"], template)).collect())
    for bad in (("<P>", "<P>x", "<M>"), ("ab", "bc", "d"), ("", "a", "b")):
        with pytest.raises(ValueError):
            fim.Template(*bad)

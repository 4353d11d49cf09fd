"""Line dedup, near-duplicate joins, embeddings, URL filters, scores and the pipeline against brute force."""

from __future__ import annotations

import os
import random
import re
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcstep.llm import embedding_dedup, line_dedup, lm_score, ngram_join, packing, quality_rules, url_filter
from arcstep.llm.common import connected_components
from arcstep.llm.shingles import shingle_sets

DOCS = "doc_id long, text string"
WORDS = [f"w{i}" for i in range(4000)]


def say(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def find_groups(nodes, links):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


# -- components ---------------------------------------------------------------


def test_connected_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(40)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component_id"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == find_groups({x for e in real for x in e}, real)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- line dedup ---------------------------------------------------------------


def brute_dedup(docs):
    """The module's rules, document by document: the dead words of each."""
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    words, ends, dead, seen, first, places = [], [], [], set(), {}, []
    for k, (_, t) in enumerate(order):
        words.append(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        counts = [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in (t or "").split("\n")]
        ends.append(np.cumsum([n for n in counts if n]).tolist())
        copy = t in seen and len(words[-1]) >= line_dedup.RUN_WORDS
        dead.append(set(range(len(words[-1]))) if copy else set())
        if t not in seen:
            for _, block in line_dedup.texts_of([t]):
                _, prints, at, gaps, _ = block.fingerprints()
                for pos, p, gap in sorted(zip(at.tolist(), prints.tolist(), gaps.tolist(), strict=True)):
                    places.append((k, p, pos, gap))
                    if not gap:
                        first.setdefault(p, (k, pos))
        seen.add(t)

    def spread(a, b, i, j):
        start = i
        while start and j and a[start - 1] == b[j - 1]:
            start, j = start - 1, j - 1
        j += i - start
        while i < len(a) and j < len(b) and a[i] == b[j]:
            i, j = i + 1, j + 1
        return start, i

    for k, p, pos, gap in places:
        k0, pos0 = (k, pos - gap) if gap else first[p]
        if (k0, pos0) == (k, pos):
            continue
        if p & 1:
            a, b = spread(words[k], words[k0], pos, pos0)
            if b - a >= line_dedup.RUN_WORDS:
                dead[k] |= set(range(a, b))
        else:
            lines = [[tuple(w[x:y]) for x, y in zip([0, *e], e)] for w, e in ((words[k], ends[k]), (words[k0], ends[k0]))]
            a, b = spread(*lines, [0, *ends[k]].index(pos), [0, *ends[k0]].index(pos0))
            dead[k] |= set(range([0, *ends[k]][a], ends[k][b - 1]) if b > a else ())
    return {order[k][0]: (words[k], dead[k], sum(set(range(x, y)) <= dead[k] for x, y in zip([0, *ends[k]], ends[k]))) for k in range(len(order))}


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(2)
    passage = [say(rng, 9) for _ in range(8)]
    long_line = say(rng, 60)
    short = say(rng, 9)
    docs = []
    for i in range(60):
        body = [say(rng, rng.randint(1, 30)) for _ in range(rng.randint(0, 9))]
        if rng.random() < 0.4:
            at = rng.randint(0, len(body))
            body[at:at] = passage[rng.randint(0, 2) :]
        if rng.random() < 0.4:
            body.insert(rng.randint(0, len(body)), long_line)
        if rng.random() < 0.6:
            body.insert(rng.randint(0, len(body)), short)
        docs.append((i, "\n".join(x + rng.choice(["", "", "\n"]) for x in body)))
    huge = "\n".join(say(rng, 40) for _ in range(300))
    docs += [(60, docs[0][1]), (61, None), (62, ""), (63, "\n \n"), (64, "\n".join([long_line] * 3)), (None, long_line), (65, "\n".join(["tiny"] * 200))]
    docs += [(66, huge), (67, "x " + huge + "\nmore"), (68, huge), (69, docs[0][1]), (70, huge[: len(huge) // 2])]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS + ", d string, `a.b` int").repartition(4)
    out = {r["doc_id"]: r for r in line_dedup.dedup_text(df).collect()}
    want = brute_dedup(docs)
    assert len(out) == len(docs)
    for i, t in docs:
        r, (words, dead, lines) = out[i], want[i]
        assert r["d"] == "x" and r["a.b"] == 1
        assert r["dedup"]["removed_words"] == len(dead) and r["dedup"]["n_removed"] == lines, i
        assert (r["text"] or "").split() == [w for k, w in enumerate(words) if k not in dead]
        if not dead:
            assert r["text"] == t
    assert sum((r["text"] or "").count(long_line) for r in out.values()) == 1
    assert len(want[67][1]) >= 12000 and len(want[68][1]) == 12000 and len(want[70][1]) >= 5900
    assert line_dedup.dedup_text(df.limit(0)).count() == 0


def test_repeated_rows_of_line_dedup_get_equal_results(spark):
    rng = random.Random(21)
    t = say(rng, 80)
    out = line_dedup.dedup_text(spark.createDataFrame([(1, t), (1, t), (2, t), (2, t)], DOCS)).collect()
    assert sorted((r["doc_id"], r["text"] == t, r["text"] == "") for r in out) == [(1, True, False)] * 2 + [(2, False, True)] * 2


def test_passages_inside_lines_are_found_wherever_lines_break(spark):
    rng = random.Random(13)
    passage = say(rng, 60).split()
    cut = lambda: "".join(w + rng.choice([" ", " ", " ", "\n"]) for w in passage).strip()
    docs = [(i, f"{say(rng, 30)} {cut()} {say(rng, 30)}\n{say(rng, 9)}") for i in range(30)]
    docs += [(30, f"{docs[0][1]} and more"), (31, f"{say(rng, 5)} {' '.join(passage[:49])} {say(rng, 5)}"), (32, "word " * 3000), (33, " ".join(f"{say(rng, 3)} {' '.join(passage)}" for _ in range(3)))]
    frame = spark.createDataFrame(docs, DOCS).repartition(4)
    out = {r["doc_id"]: r for r in line_dedup.dedup_text(frame).collect()}
    assert out[0]["text"] == docs[0][1]
    for i in range(1, 30):
        words = docs[i][1].split()
        assert out[i]["text"].split() == words[:30] + words[90:] and out[i]["dedup"]["removed_words"] == 60, i
        assert out[i]["text"].endswith("\n" + docs[i][1].rsplit("\n", 1)[1])
    assert out[30]["text"].split() == ["and", "more"]
    assert out[31]["text"] == docs[31][1]
    assert set(out[32]["text"].split()) == {"word"} and len(out[32]["text"].split()) < 50
    assert len(out[33]["text"].split()) == 9


def test_words_deleted_from_a_line_leave_the_rest_as_it_was():
    text = " a  b\tc d \n\ne f\n\n g\n"
    cut = lambda *spans: line_dedup.delete_words(text, [{"first": x, "last": y} for x, y in spans])
    assert cut((0, 1)) == (" b\tc d \n\ne f\n\n g\n", 3, 0, 1)
    assert cut((1, 3)) == (" a  d \n\ne f\n\n g\n", 3, 0, 2)
    assert cut((3, 5)) == (" a  b\tc \n\nf\n\n g\n", 3, 0, 2)
    assert cut((1, 2), (4, 7)) == (" a  c d \n", 3, 2, 4)


# -- n-gram Jaccard join ---------------------------------------------------------


def brute_sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_near(docs):
    sets = [brute_sets(t) for _, t in docs]
    links = []
    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    return sets, links


def test_join_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT", 4)  # so that small data has frequent tokens, too
    monkeypatch.setattr(ngram_join, "BLOCK", 8)  # and large groups
    monkeypatch.setattr(ngram_join, "GROUP_ROWS", 200)
    rng = random.Random(3)
    common = say(rng, 40)
    docs = []
    for _ in range(30):
        base = say(rng, rng.choice([1, 2, 4, 5, 8, 30, 90, 300])).split()
        if rng.random() < 0.4:
            base[len(base) // 2 : len(base) // 2] = common.split()
        for _ in range(rng.choice([1, 1, 2, 3, 14])):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            docs.append((len(docs), rng.choice(["", " "]) + " ".join(words)))
    docs += [(len(docs) + k, t) for k, t in enumerate([None, "", " \n", "A b c d", "a b c D", "a b c d e", common, common.upper(), docs[0][1]])]
    frame = spark.createDataFrame([(i, t, 0) for i, t in docs], DOCS + ", n long").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(frame).collect()}
    sets, links = brute_near(docs)
    group = find_groups(range(len(docs)), links)
    assert got == {i: (len(sets[i]), group[i]) for i in range(len(docs))}
    assert ngram_join.near_duplicates(frame.limit(0)).count() == 0


def test_null_ids_and_repeated_rows(spark):
    rng = random.Random(4)
    t = say(rng, 50)
    frame = spark.createDataFrame([(None, t), (9, t), (9, t), (3, t + " more"), (None, ""), (4, say(rng, 30))], DOCS)
    got = sorted(((r["doc_id"] or -1), (r["component_id"] or -1)) for r in ngram_join.near_duplicates(frame).collect())
    assert got == [(-1, -1), (-1, 3), (3, 3), (4, 4), (9, 3), (9, 3)]


def test_index_entries_share_one_for_every_linked_pair():
    """The prefix argument, on random sets with any frequent tokens."""
    rng = np.random.default_rng(5)
    for _ in range(300):
        universe = rng.integers(0, 1 << 63, 80, dtype=np.uint64)
        frequent = np.sort(rng.choice(universe, rng.integers(0, 80), replace=False))
        order = rng.permutation(len(frequent))
        n = int(rng.integers(2, 60))
        x = np.unique(rng.choice(universe, n, replace=False))
        y = x[rng.random(len(x)) > 0.1]
        y = np.unique(np.concatenate((y, rng.choice(universe, rng.integers(0, 4)))))
        both = len(np.intersect1d(x, y))
        if len(y) > 1 and 100 * both >= 80 * (len(x) + len(y) - both):
            assert len(np.intersect1d(ngram_join.index_entries(x, frequent, order), ngram_join.index_entries(y, frequent, order)))


def test_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(6)
    for _ in range(60):
        x = np.unique(rng.integers(0, 1 << 63, int(rng.integers(2, 3000)), dtype=np.uint64))
        y = np.unique(np.concatenate((x[rng.random(len(x)) > 0.09], rng.integers(0, 1 << 63, len(x) // 12, dtype=np.uint64))))
        sketch = []
        for s in (x, y):
            size = ngram_join.sketch_size(len(s))
            sketch.append(np.frombuffer(np.packbits(np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1, bitorder="little").tobytes(), dtype=np.uint64))
        both = len(np.intersect1d(x, y))
        if 100 * both >= 80 * (len(x) + len(y) - both):
            assert ngram_join.may_link(np.array([len(x)]), np.array([len(y)]), [sketch[0]], [sketch[1]])[0, 0]


def test_shingle_sets_do_not_depend_on_blocks(monkeypatch):
    rng = random.Random(7)
    texts = [say(rng, n) for n in (0, 1, 4, 5, 6, 50, 400)] + [None, "É é\x0bx", "z" * 900]
    from arcstep.llm import shingles

    whole = [s.tolist() for s in shingle_sets(texts)]
    monkeypatch.setattr(shingles, "BLOCK_BYTES", 200)
    assert [s.tolist() for s in shingle_sets(texts)] == whole


# -- embeddings -------------------------------------------------------------------


def test_embeddings_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)
    rng = np.random.default_rng(8)
    rows = rng.normal(size=(600, 32))
    hot = rng.normal(size=32)
    rows = np.concatenate([rows, hot + 0.1 * rng.normal(size=(250, 32)), np.repeat(hot[None], 40, 0)])
    for _ in range(200):
        rows = np.concatenate([rows, rows[rng.integers(0, 600)][None] + 0.2 * rng.normal(size=(1, 32))])
    vectors = [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(rows)]
    n = len(vectors)
    bad = [(n, None), (n + 1, [0.0] * 32), (n + 2, [float("nan")] * 32), (n + 3, [float("inf")] + [0.0] * 31), (n + 4, [None] + [1.0] * 31), (n + 5, [1.0, 2.0])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in vectors + bad], "vec_id long, embedding array<float>, label int").repartition(4)
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(frame).collect()}
    assert len(got) == n + len(bad)
    x = np.array([v for _, v in vectors], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    found = np.array([got[i]["n_links"] for i in range(n)])
    assert (found <= near.sum(1)).all()
    assert found.sum() >= 0.995 * near.sum()
    for i in range(n, n + len(bad)):
        assert got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"]
    group = find_groups(range(n), zip(*np.nonzero(near)))
    same = sum(got[i]["component_id"] == group[i] for i in range(n))
    assert same >= 0.99 * n
    assert embedding_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_table_lookup_bound_holds():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(500, 20))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = embedding_dedup.fit(x, len(x))
    home, probed = q.probes(x)
    assert probed[np.arange(len(x)), home].all()
    codes, error = q.encode(x - q.centroids[home])
    for c in np.unique(home)[:5]:
        inside = np.flatnonzero(home == c)
        far = q.lookup(x - q.centroids[c], codes[inside])
        true = np.linalg.norm(x[:, None] - x[inside][None], axis=2)
        assert (far - error[inside][None] <= true + 1e-9).all()


# -- URLs --------------------------------------------------------------------------


def test_url_parts_rules_and_propagation(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/x">' for h in hosts)
    pages = [
        (1, "HTTP://WWW.Example.com/en/a?q", link("good.org")), (2, "http://example.com/en/", ""), (3, "http://example.com", None), (4, "http://a.b.net/fr/x#y", link("ok.org")),
        (5, "http://net.com/", ""), (6, None, None), (7, "no scheme", "<a href='//evil.org'>"), (8, "x://", ""), (9, "http://spam.org/a", link("a.b.net")), (10, "http://good.org/z", ""), (11, "http://ok.org", ""),
        (12, "http://xcom/", ""), (10, "http://good.org/z", ""),
    ]
    frame = spark.createDataFrame([(i, u, h, "r") for i, u, h in pages], "page_id long, url string, html string, rule string")
    out = url_filter.judge(frame).collect()
    assert len(out) == len(pages)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out}
    assert got[1] == ("www.example.com", "/en/a", "www.example.com/en/", "allow")
    assert got[2] == ("example.com", "/en/", "example.com/en/", "block")
    assert got[3] == ("example.com", "", None, "block")  # as most of its host's and its neighbours' pages
    assert got[4] == ("a.b.net", "/fr/x", "net/fr/", "block")
    assert got[5][2:] == ("com/", "allow")
    assert got[6] == got[7] == ("", "", None, "allow")
    assert got[9][2:] == (None, "block")  # links to a blocked host
    assert got[10][2:] == (None, "allow") and got[11][2:] == (None, "allow")
    assert got[12][2] is None
    assert url_filter.judge(frame.limit(0)).count() == 0


# -- scores --------------------------------------------------------------------------


def test_scores_tell_held_out_targets_apart(spark):
    rng = random.Random(11)
    good = lambda: " ".join(rng.choice(["the cat", "a dog", "sat on", "ran to", "the mat"]) for _ in range(40))
    poor = lambda: " ".join(rng.choice(["buy now", "click here", "free the", "cat offer"]) for _ in range(40))
    docs = [(i, good() if i % 2 else poor(), 1) for i in range(200)] + [(200, None, 1), (201, "", 1), (None, good(), 1)]
    frame = spark.createDataFrame(docs, DOCS + ", n_tokens int")
    train = frame.where("doc_id < 100")
    targets = frame.where("doc_id < 100 and doc_id % 2 = 1").select("doc_id")
    out = {r["doc_id"]: r for r in lm_score.score(frame, targets, train=train).collect()}
    assert len(out) == len(docs)
    assert max(out[i]["ce_difference"] for i in range(101, 200, 2)) < min(out[i]["ce_difference"] for i in range(100, 200, 2))
    assert out[200]["ce_difference"] is None and out[201]["n_tokens"] == 0
    own = {r["doc_id"]: r for r in lm_score.score(frame, targets).collect()}
    assert max(own[i]["ce_difference"] for i in range(101, 200, 2)) < min(own[i]["ce_difference"] for i in range(100, 200, 2))
    none = lm_score.score(frame, targets.limit(0))
    assert none.where("ce_difference is not null").count() == 201
    assert lm_score.score(frame.limit(0), targets).count() == 0


@pytest.mark.parametrize("hot", [0, 1 << 19])
def test_scores_equal_the_formula(spark, monkeypatch, hot):
    monkeypatch.setattr(lm_score, "MAX_HOT", hot)
    rng = random.Random(14)
    docs = [(0, "a b a b c"), (1, "b c C"), (2, "a a"), (3, " ".join(rng.choice("abcdefgh") for _ in range(3000))), (4, "a b a b c"), (4, "a b a b c"), (4, "h g"), (None, "a a b"), (5, "once only words")]
    docs += [(6 + k, " ".join(rng.choice(WORDS[:90]) for _ in range(50))) for k in range(30)]
    aims = {1, 3, 4, 7, 8, 9}
    frame = spark.createDataFrame(docs, DOCS).repartition(3)
    seen = [[], []]
    rows = []
    for i, t in docs:
        ws = t.lower().split()
        own = {}
        for h, w in zip(["<", *ws], ws):
            for x in ((w,), (h, w)):
                own[x] = own.get(x, 0) + 1
        own[("<",)] = 1
        rows.append((i, ws, own))
        seen[i in aims].append(own)
    counts = [{}, {}]
    for k in range(2):
        for own in seen[k]:
            for x, n in own.items():
                counts[k][x] = counts[k].get(x, 0) + n
    size = [sum(n for x, n in counts[k].items() if len(x) == 2) for k in range(2)]
    words = len({x for k in range(2) for x in counts[k] if len(x) == 1}) - 1
    worth = [size[1] / size[0], 1]

    def count(x, own, k, aim):
        return max(counts[k].get(x, 0) - (own[x] if k == aim else 0), 0) * worth[k]

    def loss(h, w, own, k, aim):
        one = (count((w,), own, k, aim) + lm_score.PRIOR) / (size[1] + lm_score.PRIOR * words)
        two = (count((h, w), own, k, aim) + lm_score.PRIOR) / (count((h,), own, k, aim) + lm_score.PRIOR * words)
        return -lm_score.MIX * np.log(one) - (1 - lm_score.MIX) * np.log(two)

    want = []
    for i, ws, own in rows:
        means = [np.mean([loss(h, w, own, k, i in aims) for h, w in zip(["<", *ws], ws)]) for k in range(2)]
        want.append((i if i is not None else -1, len(ws), means[1], means[0], means[1] - means[0]))
    got = [(r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["target_loss"], r["background_loss"], r["ce_difference"]) for r in lm_score.score(frame, spark.createDataFrame([(i,) for i in aims], "doc_id long")).collect()]
    assert np.allclose(sorted(got), sorted(want), atol=2e-6)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no tables")
def test_held_out_targets_rank_before_others(spark):
    """Trained on documents with even ids, labelled ones with odd ids are scored: P(a target is lower) has a floor, well above a coin's."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    good = labels.where("quality = 1").select("doc_id")
    held = docs.join(labels.where("doc_id % 2 = 1"), "doc_id", "left_semi")
    scores = {r["doc_id"]: r["ce_difference"] for r in lm_score.score(held, good, train=docs.where("doc_id % 2 = 0")).collect()}
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    side = lambda q: np.array([s for i, s in scores.items() if s is not None and quality[i] == q])
    a, b = side(1), np.sort(side(0))
    assert len(a) > 1000 and len(b) > 100
    assert 1 - np.searchsorted(b, a).mean() / len(b) > 0.85


# -- pipeline --------------------------------------------------------------------------


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_pipeline_equals_brute_force(spark):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    import corpus_pipeline

    source = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{source}/documents.parquet").collect()]
    enforced = [r.fails for r in quality_rules.RULES if r.name in quality_rules.POLICIES[quality_rules.DEFAULT_POLICY]]
    names = [x.split()[0] for x in quality_rules.MEASURES.split(", ")]
    kept = [(i, t) for i, t in docs if not any(eval(rule.replace(" = ", " == "), {}, dict(zip(names, quality_rules.measure(t)))) for rule in enforced)]  # noqa: S307
    clean = []
    for i, (words, dead, gone) in brute_dedup(kept).items():
        text = dict(kept)[i]
        lines = sum(bool(x.split()) for x in (text or "").split("\n"))
        if lines == 0 or (gone < lines and len(dead) <= corpus_pipeline.LEAST_LOST * len(words)):
            spans = [{"first": k, "last": k + 1} for k in dead]
            clean.append((i, line_dedup.delete_words(text, spans)[0]))
    _, links = brute_near(clean)
    group = find_groups(range(len(clean)), links)
    final = {clean[k][0]: clean[k][1] for k in range(len(clean)) if group[k] == k}
    rows = corpus_pipeline.run(spark, source).collect()
    assert {r["doc_id"] for r in rows} == set(final)
    lengths = {i: len(raw) // 4 for (i, _), raw in zip(final.items(), packing.token_bytes(corpus_pipeline.bpe.vocabulary_path(), list(final.values())))}
    pieces: dict = {}
    for r in rows:
        assert r["doc_tokens"] == lengths[r["doc_id"]]
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for i, found in pieces.items():
        end = 0
        for start, n in sorted(found):
            assert start == end
            end += n
        assert end == lengths[i]


def test_stages_keep_the_columns(spark):
    import corpus_pipeline

    rng = random.Random(12)
    docs = spark.createDataFrame([(i, say(rng, 40), "en", "s", 5) for i in range(5)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), "").count() == 0
    assert out.agg(F.count(F.lit(1))).first()[0] == 5


def test_stages_with_a_map_column(spark):
    """Maps have no order and no hash; rows that differ in nothing else are still one."""
    import corpus_pipeline

    rng = random.Random(3)
    text = say(rng, 60)
    rows = [(1, text, "a", {"x": 1}), (1, text, "a", {"x": 1}), (2, text, "b", None), (3, say(rng, 60), "c", {"y": 2}), (None, None, None, {"z": 3})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra map<string,int>")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert {r["doc_id"] for r in out.collect()} >= {1, 3}, name
    assert sorted(r["doc_id"] or 0 for r in out.collect()) == [0, 1, 3]
    assert {r["extra"]["x"] for r in out.collect() if r["doc_id"] == 1} == {1}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() > 0


def test_stages_with_odd_rows_and_names(spark):
    """Repeated ids and rows, nulls, clashing and dotted names, in every stage."""
    import corpus_pipeline

    rng = random.Random(15)
    t, other = say(rng, 60), say(rng, 70)
    near = t.split()
    near[30] = "changed"
    rows = [(5, t), (5, t), (5, other), (3, " ".join(near)), (None, t), (None, None), (8, ""), (9, None), (9, "short text"), (None, say(rng, 45))]
    names = "dedup string, __m_n_words int, `a.b` int, ledger int, d long, t long, k long, h long, stays boolean, spans string, done int, row int, n_words int"
    frame = spark.createDataFrame([(i, x, "e", 1, 2, 3, 4, 5, 6, 7, True, "s", 8, 9, 10) for i, x in rows], DOCS + ", " + names)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, "")
        assert out.columns == frame.columns and out.dtypes == frame.dtypes
        got = out.collect()
        assert all(r["a.b"] == 2 and r["dedup"] == "e" and r["d"] == 4 for r in got)
        texts = [(r["doc_id"], r["text"]) for r in got]
        if name == "ngram_jaccard_join":
            assert texts.count((5, other)) == 1 and (3, " ".join(near)) in texts and (5, t) not in texts and (None, t) not in texts
            assert len(texts) == 7
        if name == "quality_rules":
            assert sorted(texts, key=str) == sorted(((i, x) for i, x in rows if x and len(x.split()) >= 10), key=str)
        if name == "line_dedup":
            assert (5, other) in texts and (None, t) in texts and (5, t) not in texts and (9, None) in texts and (8, "") in texts
        assert stage(spark, frame.limit(0), "").count() == 0
    same = spark.createDataFrame([(7, t, 1), (7, t, 2), (7, t, 1)], DOCS + ", x int")
    assert [tuple(r) for r in corpus_pipeline.near_stage(spark, same, "").collect()] == [(7, t, 1)]


def test_written_tables_keep_the_estimate_bounded(spark):
    """Forty rounds of joins of a table with itself do not blow up what the optimizer expects."""
    from arcstep.llm.common import written

    rows = spark.range(100).withColumn("x", F.col("id") % 7)
    for _ in range(40):
        rows = written(rows.join(rows.withColumnRenamed("x", "y"), "id").select("id", (F.col("x") + F.col("y") * 0).alias("x")))
    assert int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1 << 20

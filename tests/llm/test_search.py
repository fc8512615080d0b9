"""Spelling variants, highest inner products and ranked search against plain versions, and their defined results for odd input."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lingotide.llm import pivots, ranked, spellings

# ---- spelling variants


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:k] + long[k + 1:] == short for k in range(len(long)))


def plain_forms(counts):
    out = {}
    for w in counts:
        near = [v for v in counts if one_edit(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        out[w] = (best if best and counts[best] >= 5 * counts[w] else None, len(near))
    return out


@pytest.mark.parametrize("most", [256, 4])
def test_forms_and_roots(spark, monkeypatch, most):
    rng = random.Random(3)
    counts = {"".join(rng.choices("abé", k=rng.randint(1, 7))): rng.choice([1, 3, 5, 7, 40, 200, 1000]) for _ in range(350)}
    counts |= {"stem" + "".join(rng.choices("xyzÿ", k=3)) + "end": rng.choice([1, 5, 30]) for _ in range(60)}
    counts |= {"q" * 3000: 9, "q" * 2999: 50, "lonely": 5}
    groups = spellings.prefix_suffix_groups
    # small groups are refined down to one undecided letter
    monkeypatch.setattr(spellings, "prefix_suffix_groups", lambda words: groups(words, most))
    rows = [(w, n, "clash", 1, 2) for w, n in counts.items()] + [(None, 3, "", 0, 0), ("", 3, "", 0, 0), ("nocount", None, "", 0, 0)]
    got = spellings.group_spellings(spark.createDataFrame(rows, "word string, n long, form string, longer int, _n int")).collect()
    forms = plain_forms(counts)
    assert len(got) == len(counts)
    for r in got:
        root = r.word
        while forms[root][0]:
            root = forms[root][0]
        form, near = forms[r.word]
        assert (r.form, r.n_near, r.root, r.n, r.form_n) == (form, near, root, counts[r.word], counts[form] if form else None)


def test_spelled_words(spark):
    texts = {1: "Straße STRASSE naïveté naïveté, abcdef abcdeF", 2: "abcdef " * 40 + "x", 3: None, 4: "", None: "abcdef ABCDEF"}
    rows = [(i, t, "w", 1) for i, t in texts.items()] * 2
    df = spark.createDataFrame(rows, "id long, text string, word string, n int")
    for every in (None, 3):
        want = Counter()
        for i, t, *_ in rows:
            for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
                run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                if every and h % every == 0:
                    run = run[:h % len(run)] + run[h % len(run) + 1:]
                want[run] += 1
        got = {r.word: r.n for r in spellings.spelled_words(df, min_count=2, every=every).collect()}
        assert got == {w: n for w, n in want.items() if n >= 2 and len(w) >= 6}
    # string ids as sentences have them, and nothing at all
    named = spark.createDataFrame([("ts_000001", "spelling spelling")], "id string, text string")
    assert [tuple(r) for r in spellings.spelled_words(named, min_count=1).collect()] == [("spelling", 2)]
    assert spellings.group_spellings(spellings.spelled_words(named.limit(0))).count() == 0


# ---- highest inner products


def plain_top(rows, queries, k):
    vectors = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {(q, tuple(v)) for q, v in vectors if q in queries}:
        found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in vectors if i != q and len(w) == len(v))[:k]
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(found)]
    return sorted(out)


def test_top_contours(spark, monkeypatch):
    monkeypatch.setattr(pivots, "ANNULUS_ROWS", 32)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 6)) * 3
    rows = [(int(i), (centres[i % 8] + rng.normal(size=6) * 0.1).round(3).tolist()) for i in range(600)]
    # ties, repeated rows, zero and odd vectors, other lengths
    rows += [(1000 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.5]) for i in range(90)] + [(7, rows[7][1]), (2000, [0.0] * 6), (2001, None), (2002, [1.0, None, 0.0, 0.0, 0.0, 0.0])]
    rows += [(2003, [float("nan")] * 6), (2004, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (50, [1.0, 2.0]), (2005, [0.5, -2.0]), (2006, [])]
    rows += [(2007, [3e18, 0.0, 0.0]), (2008, [2e18, 1.0, 0.0]), (2009, [-5e18, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "id long, f0_norm array<double>, part int, score int")
    asked = {0, 7, 50, 100, 1000, 2000, 2006, 2007, 599}
    got = pivots.top_contours(df, df.filter(df.id.isin(sorted(asked))), k=7)
    want = [(q, r, i, max(-pivots.LARGEST, min(pivots.LARGEST, s))) for q, r, i, s in plain_top(rows, asked, 7)]
    assert sorted(map(tuple, got.collect())) == want
    assert pivots.top_contours(df.limit(0), df).count() == 0 and pivots.top_contours(df, df.limit(0)).count() == 0


def test_annulus_bounds_hold():
    rng = np.random.default_rng(6)
    x, q = rng.normal(size=(200, 5)), rng.normal(size=(20, 5))
    index = pivots.Pivots({5: x[:4]}, {5: 0}, {p: float((x**2).sum(1).max()) for p in range(4)})
    part = index.nearest(list(x))
    far = index.distances(list(x), part)
    for v in q:
        for p in range(4):
            own = part == p
            bound = pivots.annulus_bounds(v, index.at(p, 5), index.reach[p], far[own], far[own])
            assert (bound >= x[own] @ v).all()


def test_string_ids_of_contours(spark):
    rows = [(f"u{i}", [float(i), 1.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "id string, f0_norm array<double>")
    got = pivots.top_contours(df, df.filter("id = 'u3'"), k=2).collect()
    assert [(r.query_id, r["rank"], r.id) for r in sorted(got, key=lambda r: r["rank"])] == [("u3", 1, "u29"), ("u3", 2, "u28")]


# ---- ranked search


def plain_terms(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text or "")]


def plain_ranking(texts, items, k):
    docs = [(i, Counter(plain_terms(t))) for i, t in texts]
    docs = [(i, c) for i, c in docs if c]
    n, length = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in {(i, t or "") for i, t in items if i is not None}:
        scored = []
        for i, c in docs:
            m = 25 + 75 * sum(c.values()) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in plain_terms(text) if t in c)
            if i is not None and score > 0:
                scored.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def test_ranked_search(spark, monkeypatch):
    # many small segments, so that bounds are carried and blocks are passed over
    monkeypatch.setattr(ranked, "SEGMENT_ROWS", 40)
    monkeypatch.setattr(ranked, "DRAWN", 100)
    rng = random.Random(8)
    words = [f"w{k}" for k in range(200)] + ["Élan", "ÉLAN", "naïve", "你好", "X1", "x1"]
    weights = [1 / (k + 1) for k in range(len(words))]
    texts = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 60)))) for i in range(900)]
    texts += [(5000 + i, "w7 w9 Élan") for i in range(30)] + [(3, texts[3][1])] * 2 + [(6000, None), (6001, "  .,!"), (None, "w3 w4"), (6002, "w150 " * 5000)]
    items = [(k, " ".join(rng.choices(words, k=8))) for k in range(25)] + [(100, "w7, w7 W9!"), (101, None), (102, "unseen"), (0, "w150"), (None, "w1"), (103, "你好-x1"), (100, "w7, w7 W9!")]
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in texts], "id long, text string, item_no int, terms string").repartition(5)
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, id int")
    got = sorted(map(tuple, ranked.rank_sentences(docs, asked).collect()))
    assert got == plain_ranking(texts, items, 10)
    # several passes over the items give the same
    monkeypatch.setattr(ranked, "ITEM_BYTES", 600)
    assert sorted(map(tuple, ranked.rank_sentences(docs, asked).collect())) == got
    assert ranked.rank_sentences(docs.limit(0), asked).count() == 0 and ranked.rank_sentences(docs, asked.limit(0)).count() == 0


def test_ranking_sentences_by_string_id(spark):
    rows = [("ts_000002", "wo hao"), ("ts_000001", "wo hao"), ("ts_000003", "ni"), ("ts_000004", None)]
    docs = spark.createDataFrame(rows, "id string, text string")
    got = ranked.rank_sentences(docs, spark.createDataFrame([("q", "hao")], "item_id string, text string")).collect()
    assert sorted((r["rank"], r.id) for r in got) == [(1, "ts_000001"), (2, "ts_000002")]


def test_blocks_are_passed_over():
    """With a bound that only some blocks reach, the others' sentences are not scored."""
    rng = np.random.default_rng(9)
    n, v = 512, 30
    table = rng.random((n, v)) < 0.2
    table[:, 0] = True
    rows, terms = np.nonzero(table)
    weights = ranked.Weights(n, int(table.sum()), np.arange(v, dtype=np.int64) * 10 + 5)
    segment = ranked.Segment(table.sum(1), rows, terms, np.ones(len(rows), dtype=np.int64), weights)
    query = np.array([0, 27, 28, 29])
    exact = segment.gain[:, query].astype(np.int64) @ weights.weight[query]
    least = int(np.sort(exact)[-10])
    found, scores = segment.search(query, np.ones(4, dtype=np.int64), least, 10, np.arange(n))
    assert sorted(scores.tolist()) == np.sort(exact)[-10:].tolist() and (exact[found] == scores).all()
    bound = segment.summary(29)[:, query].astype(np.int64) @ weights.weight[query]
    assert 0 < (bound < least).sum() < len(bound)

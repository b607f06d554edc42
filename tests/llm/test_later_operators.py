"""Whitening, repeated passages and ranked search against brute-force versions, on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

from fieldglass.llm import common, lexical, substrings, whitening
from tests.llm.test_operators import KIND, prose, rows

# 11

VECTORS = "vec_id long, embedding array<float>, label int, vector int, n int, i int, row int, component int, deviation string"


def vectors(rng, n, d, rank=None):
    basis = rng.normal(size=(rank or d, d)) * np.geomspace(1, 0.01, rank or d)[:, None]
    return rng.normal(size=(n, rank or d)) @ basis


def as_rows(spark, found, parts=3):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4, 5, 6, "x") for i, v in found], VECTORS).repartition(parts)


def brute_whitening(kept):
    x = np.floor(64 * np.array([v for _, v in kept], np.float32).astype(float)) + 1_000_000
    apart = x - x.mean(axis=0)
    size, axes = np.linalg.eigh(apart.T @ apart / len(x))
    return x.astype(np.int64), apart, size[::-1], axes[:, ::-1]


@pytest.mark.parametrize("parts", [1, 7])
def test_whitening_equals_the_eigenvectors(spark, parts):
    rng = np.random.default_rng(1)
    kept = [(i, v.tolist()) for i, v in enumerate(vectors(rng, 300, 12) * 20)]
    kept += [kept[5], kept[5], (None, kept[9][1])] + [(900 + i, kept[3][1]) for i in range(150)]
    bad = [(1000, None), (1001, []), (1002, [None] + [0.0] * 11), (1003, [math.nan] + [0.0] * 11), (1004, [math.inf] + [0.0] * 11), (1005, [1.0] * 5)]
    got = whitening.whitened(as_rows(spark, kept + bad, parts)).collect()
    x, apart, size, axes = brute_whitening(kept)
    assert len(got) == len(kept) * 12
    by = collections.defaultdict(dict)
    for k, r in enumerate(got):
        by[k // 12][r["component"]] = r
    want = collections.Counter((i, sum((len(x) * int(a) - int(s)) ** 2 for a, s in zip(row, x.sum(axis=0), strict=True))) for (i, _), row in zip(kept, x, strict=True))
    assert collections.Counter((o[1]["vec_id"], o[1]["deviation"]) for o in by.values()) == want
    place = {i: k for k, (i, _) in enumerate(kept)}
    signs = collections.defaultdict(set)
    for o in by.values():
        assert sorted(o) == list(range(1, 13))
        for c, r in o.items():
            assert r["n"] == len(kept) and math.isclose(r["explained"], size[c - 1] / size.sum(), rel_tol=1e-9) and r["identity_error"] < 1e-9
            mine = apart[place[r["vec_id"]]] @ axes[:, c - 1] / math.sqrt(size[c - 1])
            assert math.isclose(abs(r["whitened"]), abs(mine), rel_tol=1e-6, abs_tol=1e-7)
            if abs(mine) > 1e-3:
                signs[c].add(np.sign(r["whitened"] * mine))
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_of_ill_conditioned_and_dependent_dimensions(spark):
    rng = np.random.default_rng(2)
    some = vectors(rng, 400, 6) * 1e5
    some[:, 5] = some[:, 0] * 2 + rng.normal(size=400)  # nearly dependent
    same = np.column_stack([some[:, :3], np.floor(some[:, 0]), np.floor(some[:, 0]), np.full(400, 7.0)])  # equal, and constant
    for table, rank in ((some, 6), (same, 4)):
        kept = [(i, v.tolist()) for i, v in enumerate(table.astype(np.float32))]
        got = whitening.whitened(as_rows(spark, kept)).collect()
        _, apart, size, _ = brute_whitening(kept)
        assert {r["component"] for r in got} == set(range(1, rank + 1)) and max(r["identity_error"] for r in got) < 1e-4
        for c in range(1, rank + 1):
            assert math.isclose(next(r["explained"] for r in got if r["component"] == c), size[c - 1] / size.sum(), rel_tol=1e-4)


def test_whitening_without_variance_and_beyond_longs(spark):
    assert whitening.whitened(spark.createDataFrame([], VECTORS)).count() == 0
    assert whitening.whitened(as_rows(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.whitened(as_rows(spark, [(i, [1.0, 2.0]) for i in range(5)])).count() == 0
    assert whitening.whitened(as_rows(spark, [(1, None), (None, None)])).count() == 0
    got = whitening.whitened(as_rows(spark, [(0, [3e38, 1.0]), (1, [0.0, 2.0]), (2, [1.0, 5.0])])).collect()
    assert {r["deviation"] for r in got} == {None} and {r["vec_id"] for r in got} == {0, 1, 2}


def test_turning_by_a_factor_is_a_triangular_solve():
    rng = np.random.default_rng(3)
    rows_, r = rng.normal(size=(50, 8)), np.triu(rng.normal(size=(8, 8))) + 5 * np.eye(8)
    assert np.allclose(whitening.turned(rows_, [r]) @ r, rows_) and np.allclose(whitening.turned(rows_, [r, r]) @ r @ r, rows_)
    g = rows_.T @ rows_
    assert np.allclose(whitening.factor(g, 50, False).T @ whitening.factor(g, 50, False), g)
    assert np.isfinite(whitening.factor(np.ones((4, 4)), 4, True)).all()  # singular: the shift makes it positive


# 12


def brute_repeats(table, width):
    """table: (id, text). Order: id, null ids last, MD5 of the text."""
    order = sorted(range(len(table)), key=lambda k: (table[k][0] is None, table[k][0] or 0, hashlib.md5((table[k][1] or "").encode()).hexdigest()))
    seen, out = set(), []
    for k in order:
        w = (table[k][1] or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            window = tuple(w[s : s + width])
            if window in seen:
                gone[s : s + width] = [True] * width
            seen.add(window)
        out.append((table[k][0], len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return collections.Counter(out)


def repeats(rng):
    passage, other = prose(rng, 60), prose(rng, 33)
    few = lambda n: " ".join(rng.choice("a b c d".split()) for _ in range(n))
    texts = [f"{prose(rng, rng.randint(0, 30))} {passage} {prose(rng, rng.randint(0, 30))}" for _ in range(40)]
    texts += [f"{other}\t{other}\n{other}", "x " * 400, "x " * 25, "y x " * 90, few(600), few(600), few(19), few(20), passage, passage.upper(), prose(rng, 4000) + " " + passage]
    texts += [" ".join(passage.split()[a : a + n]) for a, n in ((0, 19), (1, 20), (5, 21), (30, 30))]
    return [(3 * i, t) for i, t in enumerate(texts)] + [(1, texts[3]), (0, texts[3]), (0, texts[3]), (3, texts[0]), (None, texts[5]), (None, prose(rng, 50)), (None, None)]


@pytest.mark.parametrize(("parts", "many"), [(1, 50_000), (8, 50_000), (3, 3)])
def test_repeated_passages_equal_brute_force(spark, monkeypatch, parts, many):
    monkeypatch.setattr(common, "MANY_KEYS", many)  # 3: all but the hottest keys are joined by shuffle
    table = [(r[0], r[1]) for r in rows()] + repeats(random.Random(4))
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 0.5, "n", "l", 1, "k", 2, "r", b"i") for i, t in table], KIND).repartition(parts)
    got = collections.Counter(tuple(r) for r in substrings.without_repeats(docs).collect())
    assert got == brute_repeats(table, 20)


@pytest.mark.parametrize("width", [4, 8, 12])
def test_repeated_passages_of_other_widths(spark, width):
    table = repeats(random.Random(width))[30:]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    assert collections.Counter(tuple(r) for r in substrings.without_repeats(docs, width).collect()) == brute_repeats(table, width)


def test_texts_without_repeats(spark):
    assert substrings.without_repeats(spark.createDataFrame([], KIND)).count() == 0
    table = [(1, prose(random.Random(1), 50)), (2, "short text"), (3, None), (4, " ")]
    assert collections.Counter(tuple(r) for r in substrings.without_repeats(spark.createDataFrame(table, "doc_id long, text string")).collect()) == brute_repeats(table, 20)
    with pytest.raises(ValueError):
        substrings.without_repeats(spark.createDataFrame(table, "doc_id long, text string"), 10)


def test_least_places_are_the_leftmost_least():
    h = np.random.default_rng(5).integers(0, 9, 300).astype(np.uint64)
    for span in (1, 2, 3, 16, 17):
        assert substrings.least_places(h, span).tolist() == [s + int(np.argmin(h[s : s + span])) for s in range(len(h) - span + 1)]


# 13


def brute_search(table, items, best=10):
    split = lambda text: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))
    bags = [(i, collections.Counter(split(t))) for i, t in table]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n, length, df = len(bags), sum(b[2] for b in bags), collections.Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for i, b, own in bags:
            m = 100 - 90 + (90 * own * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * b[t]) // (1000 * b[t] + 8 * m)) for t in set(split(text)) if b[t])
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, k, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scores)[:best], 1)]
    return collections.Counter(out)


def asked(rng):
    texts = [r[1] for r in rows() if r[1]]
    items = [(i, " ".join(rng.sample(texts[rng.randrange(120)].split(), 3))) for i in range(30)]
    return items + [(40, None), (41, ""), (42, "zzz unknown"), (43, "The THE the é 漢字"), (None, texts[3]), (7, texts[4]), (7, texts[4]), (44, texts[5] * 3), (45, "x" * 5000)]


@pytest.mark.parametrize(("parts", "block", "cells", "exact"), [(1, 8_000_000, 4_000_000, 2**53), (6, 200, 50, 2**53), (3, 8_000_000, 4_000_000, 0)])
def test_search_equals_brute_force(spark, monkeypatch, parts, block, cells, exact):
    for name, value in (("ITEM_BYTES", block), ("CELLS", cells), ("EXACT", exact)):
        monkeypatch.setattr(lexical, name, value)
    rng = random.Random(6)
    table = [(r[0], r[1]) for r in rows()]
    table += [(500 - i, table[11][1]) for i in range(40)] + [(600 + i, " ".join(rng.sample(table[12][1].split(), len(table[12][1].split())))) for i in range(20)] + [(None, table[11][1])] * 3
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 0.5, "n", "l", 1, "k", 2, "r", b"i") for i, t in table], KIND).repartition(parts)
    items = asked(rng)[: 12 if block == 200 else None]
    got = lexical.search(docs, spark.createDataFrame(items, "item_id long, text string").coalesce(1))
    assert collections.Counter(tuple(r) for r in got.collect()) == brute_search(table, items)


def test_search_of_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "one two")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "two")], "item_id long, text string")
    assert lexical.search(none, items).count() == lexical.search(docs, items.limit(0)).count() == 0
    assert [tuple(r) for r in lexical.search(docs, items).collect()] == [(1, 1, 1, math.floor(1000 * math.log(4 / 3)) * (1_000_000_000 // (1000 + 8 * 100)))]


def test_equal_bags_are_one_class(spark):
    texts = [(i, "b a a" if i % 2 else "a b, A!") for i in range(50)] + [(90, "a b"), (91, "a a b c")]
    bags = spark.createDataFrame(texts, "doc_id long, text string").mapInArrow(lexical._bags({b"a": 0, b"b": 1}), "doc_id long, n long, terms array<int>, tfs array<int>")
    found = {(r["m"], *r["tfs"]): r["ids"] for r in lexical.classes(bags.withColumnRenamed("n", "m"), 10).collect()}
    assert found == {(3, 2, 1): list(range(10)), (2, 1, 1): [90], (4, 2, 1): [91]}

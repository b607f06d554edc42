"""Topics by variational Bayes: every word of every document counts."""

import math
import random

import numpy as np
import pytest

from fieldglass.operators import lda
from fieldglass.plans import ALL_QUERIES


def planted(spark, parts):
    rng, words = random.Random(3), [[f"{a}{b}{c}" for b in "abcdefgh" for c in "klmno"] for a in "xyz"]
    rows = [(i, " ".join(rng.choice(words[i % 3]) for _ in range(30))) for i in range(150)] + [(200, None), (201, "1 2 3"), (202, "onlyhere onlyhere"), (203, "")]
    return spark.createDataFrame(rows, "id long, t string").repartition(parts)


def test_topics_of_planted_words(spark, monkeypatch):
    want = None
    for parts, at_once in ((1, 1 << 18), (7, 100)):
        monkeypatch.setattr(lda, "AT_ONCE", at_once)
        rows, words = lda.counted(planted(spark, parts), "id", "t", 4)
        assert words == 121 and {r["id"] for r in rows.collect()} == {*range(150), 202}
        topics = lda.fitted(rows, words, 3, 2)
        got = {r["id"]: r["shares"] for r in lda.shares(rows, topics).collect()}
        assert all(sum(s) == pytest.approx(1) for s in got.values()) and len({tuple(np.argmax([got[i] for i in range(k, 150, 3)], axis=1)) for k in range(3)}) == 3
        assert all(len({int(np.argmax(got[i])) for i in range(k, 150, 3)}) == 1 and max(got[k]) > 0.9 for k in range(3))
        if want is not None:
            np.testing.assert_allclose(topics, want, rtol=1e-6)
        want = topics


def test_one_batch_counts_every_word_once(spark):
    rows, words = lda.counted(planted(spark, 3), "id", "t", 1)
    topics = lda.fitted(rows, words, 4)
    # the first step takes the place of the start: what is over the prior are the words
    np.testing.assert_allclose(topics.sum() - words, 150 * 30 + 2, rtol=1e-9)
    # in batches, each stands for the corpus
    rows, words = lda.counted(planted(spark, 3), "id", "t", 5)
    seen = [r["batch"] for r in rows.collect()]
    assert len(seen) == 151 and set(seen) == set(range(5))


def test_digamma():
    x = np.array([1.0, 0.5, 2.0, 30.0])
    e = 0.5772156649015329
    np.testing.assert_allclose(lda._digamma(x), [-e, -e - 2 * math.log(2), 1 - e, sum(1 / i for i in range(1, 30)) - e], rtol=1e-10)


@pytest.mark.parametrize("name", ["lda_topics", "lda_grid_search"])
def test_queries_use_all_words_and_documents(spark, tmp_path, monkeypatch, name):
    # 3,000 words, each in one document; 4 documents a batch or so
    rows = [(i, " ".join(f"w{chr(97 + i)}{chr(97 + j // 26 // 26)}{chr(97 + j // 26 % 26)}{chr(97 + j % 26)}" for j in range(150)), "en", "s", 1) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    monkeypatch.setattr(lda, "fitted", lambda rows, words, k, passes=1, seed=7, f=lda.fitted: seen.append((words, rows.count(), passes)) or f(rows, words, k, passes, seed))
    got = ALL_QUERIES[name](spark, str(tmp_path)).collect()
    assert seen and set(seen) == {(3000, 20, 1)}
    if name == "lda_topics":
        assert {r["doc_id"] for r in got} == set(range(20))

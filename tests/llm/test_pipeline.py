"""The stages and the whole of corpus_pipeline against their operators' decisions made one by one."""

import collections
import random

import pytest

import corpus_pipeline
from tests.llm.test_operators import KIND, brute_components, prose, words


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """400 documents: junk, toxic ones, copies, benchmark passages and clean ones; names that the operators use inside; nulls."""
    rng = random.Random(17)
    items = [(i, prose(rng, 30)) for i in range(5)]
    out, marks, kinds = [], [], {}
    clean = [prose(rng, rng.randint(40, 120)) for _ in range(300)]
    for i in range(400):
        text, kind = (clean[i], "clean") if i < 300 else (None, "")
        if i >= 300:
            kind = ["junk", "toxic", "copy", "leak"][i % 4]
            if kind == "junk":
                text = " ".join(f"{w.upper()}!!" for w in prose(rng, 60).split())
            elif kind == "toxic":
                w = prose(rng, 60).split()
                for _ in range(5):
                    w.insert(rng.randrange(len(w)), rng.choice(["vile", "Wretch,", "rotten", "scoundrel"]))
                text = " ".join(w)
            elif kind == "copy":
                text = clean[i - 300]
            else:
                text = f"{prose(rng, 20)} {items[i % 5][1]} {prose(rng, 20)}"
        out.append((i, text, "en", "s", len(text), 0.5, "n", "l", 1, "k", 2, "r", b"i"))
        marks.append((i, int(kind != "junk"), int(kind == "toxic")))
        kinds[i] = kind
    out += [(None, None, *[None] * 11), (401, "", "en", "s", 0, 0.5, "n", "l", 1, "k", 2, "r", b"i"), (None, clean[5], *[None] * 11), out[5]]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(out, KIND).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, kinds


def test_each_stage_decides_on_all_that_the_one_before_kept(spark, sf_dir):
    path, kinds = sf_dir
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, before = docs.columns, collections.Counter(r["doc_id"] for r in docs.collect())
    gone = {"quality classifier": "junk", "toxicity": "toxic", "MinHash near-dedup": "copy", "benchmark decontamination": "leak"}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = [tuple(r) for r in docs.collect()]
        docs = corpus_pipeline.staged(stage(spark, docs, path), "test")
        assert docs.columns == columns
        kept = docs.collect()
        after = collections.Counter(r["doc_id"] for r in kept)
        lost = before - after
        assert not after - before
        if name == "MinHash near-dedup":
            groups = brute_components([r for r in rows if words(r[1])])
            assert sum(after.values()) == len({c[2] for c in groups}) + sum(not words(r[1]) for r in rows)
            assert all(r["doc_id"] is None or not words(r["text"]) or any(c[0] == r["doc_id"] and c[3] for c in groups) for r in kept)
        else:
            bad = [i for i in lost if i is not None and i < 400]
            assert {i for i, k in kinds.items() if k == gone[name]} & {*before} <= {*bad}
            assert sum(kinds[i] != gone[name] for i in bad) <= 4
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    assert {r["doc_id"] for r in packed} == {*before}


def test_run_is_the_stages_in_order(spark, sf_dir):
    path, kinds = sf_dir
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "toxicity", "MinHash near-dedup", "benchmark decontamination", "packing"]
    found = corpus_pipeline.run(spark, path).collect()
    ids = {r["doc_id"] for r in found}
    clean = {i for i, k in kinds.items() if k == "clean"}
    assert len(clean - ids) <= 8 and all(kinds[i] == "clean" for i in ids if i is not None and i < 400)
    for doc in clean & ids:
        own = sorted((r["start"], r["length"], r["doc_tokens"]) for r in found if r["doc_id"] == doc)
        assert sum(n for _, n, _ in own) == own[0][2]
